"""The stages against plain versions of what each promises."""

import re

import corpus_pipeline
from quillspark.llm import near_dedup, secrets, toxicity


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, labels, before = docs.columns, spark.read.parquet(f"{data}/labels.parquet"), None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "source_weights", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        rows = {r["doc_id"]: r for r in before.collect()}
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score(spark, before, labels).collect() if r["predicted"]}
            assert {r["doc_id"]: r for r in docs.collect()} == {i: r for i, r in rows.items() if i not in bad}
        elif name == "near_duplicates":
            kept = {r["doc_id"] for r in near_dedup.near_groups(spark, before).collect() if r["kept"]}
            assert {r["doc_id"]: r for r in docs.collect()} == {i: r for i, r in rows.items() if i in kept}
        elif name == "secrets":
            found = dict(zip(rows, secrets.Scanner().scan([r["text"] for r in rows.values()])))
            for r in docs.collect():
                assert r["text"] == secrets.masked(rows[r["doc_id"]]["text"], found[r["doc_id"]]) and r["n_chars"] == len(r["text"])
            assert docs.count() == len(rows)
        elif name == "source_weights":
            words = {}
            for r in docs.collect():
                words[r["source"]] = words.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
            total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows.values())
            assert abs(sum(words.values()) - 1.5 * total) < 32 * len(words)
        else:
            ends = docs.groupBy("sequence_id").sum("length").collect()
            assert max(r[1] for r in ends) <= 1024
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(rows)


def test_run_gives_the_last_stage(spark, data):
    assert corpus_pipeline.run(spark, data).columns[0] == "doc_id"
    assert corpus_pipeline.ORACLE_SQL is None
