"""The queries of this subpackage, and SQL for those that SQL can express."""

from quillspark.llm import mixing, near_dedup, packing, secrets, shards, spotsigs, token_counts, toxicity, url_rules, vector_search

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_topk_search": vector_search.op2_topk_search,
    "op3_fingerprints": spotsigs.op3_fingerprints,
    "op4_sequence_packing": packing.op4_sequence_packing,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_url_filters": url_rules.op9_url_filters,
    "op10_sharding": shards.op10_sharding,
}
ORACLES = {
    "op1_minhash_near_dedup": near_dedup.ORACLE,
    "op2_topk_search": vector_search.ORACLE,
    "op3_fingerprints": spotsigs.ORACLE,
    "op6_secret_scans": secrets.ORACLE,
    "op9_url_filters": url_rules.ORACLE,
}
