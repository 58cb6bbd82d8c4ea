"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Sources get targets by weight, none above ``most`` times its own size, the excess shared again by weight. The targets
are counted in equal blocks of words: blocks go to sources by highest quotients target / (2 j + 1), which gives each
source an integer quota, and each source's quota goes to its shards by the same rule. Within a shard the documents lie
in a seeded order and are cut into blocks. All blocks are taken as often as the quota covers the shard; of the blocks
left over, those come first that a seeded permutation of the shard's blocks ranks lowest. The permutation is
rank = (a * block + c) mod (n - 1) with a prime a that doesn't divide n - 1 and a seeded c; the last block, which may be
shorter, always ranks last.

A shard holds about ``SHARD_ROWS`` documents of one source, so a source that holds most rows is many shards; beyond
``MOST_SHARDS`` of them shards grow instead, so that the windows over a source's shards stay bounded. Quotients are not
listed from 0 on: with k rivals for n blocks, the quota of a share s lies within s k / 2 + 1 of s n, so about 4 k
quotients settle all of them.

Defined cases: a null text has size 0; texts of any length are cut by words; a null source is a source, the last;
sources without words get target 0 and nothing taken; equal quotients go to the source or shard that comes first; an
empty table gives no rows; a repeated row is a document of its own; extra columns, whatever their names, are left out by
mix() and kept by mixed().
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.plans.staging import Stage

WORD = r"[^\x20\x09-\x0D]+"
SHARD_ROWS, MOST_SHARDS = 4096, 65_536
BLOCK_WORDS = 32
#: The largest primes below 2^31, one of which steps through the blocks of a shard.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sources: named, source, source_size. Adds weight and target; target is min(most * size, level * weight)."""
    order = Window.orderBy("unnamed", "source")
    ranked = sources.withColumn("pos", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("pos", F.lit(len(weights)))).cast("double"))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # sources reach their caps in order of cap / weight; the lift rises until the first one that does not, then falls
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("capped", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    from_end = Window.orderBy((F.col("cap") / F.col("weight")).desc(), F.desc("pos"))
    ranked = ranked.withColumn("open", F.sum("weight").over(from_end.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(all_rows))
    ranked = ranked.withColumn("lift", (F.col("total") - F.col("capped")) / F.col("open"))
    level = F.max("lift").over(all_rows)
    return ranked.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).drop("cap", "capped", "open", "lift", "pos", "total")


def apportion(rivals: DataFrame, votes: str, blocks: Column, within: list[str], key: list[str]) -> DataFrame:
    """Adds quota: of ``blocks`` (the same in all rows of a group ``within``), by the highest quotients votes / (2 j + 1)."""
    group = Window.partitionBy(*within)
    rivals = rivals.withColumn("_n", blocks).withColumn("_all", F.sum(votes).over(group)).withColumn("_k", F.count("*").over(group))
    part = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(F.lit(0.0))
    rivals = rivals.withColumn("_fair", part * F.col("_n")).withColumn("_slack", part * F.col("_k") / 2 + 1)
    rivals = rivals.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_fair") - F.col("_slack"))).cast("long"))
    rivals = rivals.withColumn("_last", (F.ceil(F.col("_fair") + F.col("_slack"))).cast("long"))
    rivals = rivals.withColumn("_left", F.col("_n") - F.sum("_sure").over(group))
    open_ = rivals.where(F.col(votes) > 0).select("*", F.explode(F.sequence("_sure", "_last")).alias("_j"))
    quotient = F.col(votes) / (2 * F.col("_j") + 1)
    rank = F.row_number().over(group.orderBy(quotient.desc(), *key, "_j"))
    won = open_.withColumn("_rank", rank).groupBy(*within, *[c for c in key if c not in within]).agg(
        (F.first("_sure") + F.sum((F.col("_rank") <= F.col("_left")).cast("long"))).alias("quota")
    )
    on = [*within, *[c for c in key if c not in within]]
    return rivals.drop("_n", "_all", "_k", "_fair", "_slack", "_sure", "_last", "_left").join(won, on, "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def mix(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, and passes, ranges: whole copies, and the ranges of words (begin, end) taken once more."""
    stage = Stage(spark, "mixing")
    source = F.col(source_col).cast("string")
    rows = stage.write(docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("unnamed")), "rows")
    name = ["unnamed", "source"]
    sources = rows.groupBy(*name).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = targets(sources, weights, share, most).withColumn("_one", F.lit(0))
    all_blocks = F.round(F.sum("target").over(Window.partitionBy("_one")) / BLOCK_WORDS).cast("long")
    sources = stage.write(apportion(sources, "target", all_blocks, ["_one"], name).drop("_one").withColumn("n_shards", F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("n_docs") / SHARD_ROWS))).cast("int")), "sources")
    dealt = rows.join(sources.select(*name, "n_shards"), name).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_shards")).cast("int")).drop("n_shards")
    dealt = stage.write(dealt, "dealt")
    shards = dealt.groupBy(*name, "shard").agg(F.sum("size").cast("double").alias("shard_size"))
    shards = shards.join(sources.select(*name, "source_size", "target", F.col("quota").alias("source_quota")), name)
    shards = apportion(shards, "shard_size", F.col("source_quota"), name, [*name, "shard"])
    words = F.least(F.col("quota") * BLOCK_WORDS, (F.lit(float(most)) * F.col("shard_size")).cast("long"))
    whole = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / BLOCK_WORDS)).cast("long")
    seeded = F.xxhash64(F.lit(seed + 1), *name, "shard")
    steps = F.array(*map(F.lit, STEPS))
    others = F.greatest(F.lit(1), n_blocks - 1).cast("long")
    step = F.get(F.filter(F.concat(F.slice(steps, F.pmod(seeded, F.lit(len(STEPS))).cast("int") + 1, len(STEPS)), steps), lambda a: a % F.col("others") != 0), F.lit(0))
    shards = shards.withColumn("others", others).select(
        *name, "shard", "source_size", "target", F.col("shard_size").cast("long").alias("shard_size"), whole.alias("passes"), (words - whole * F.col("shard_size")).cast("long").alias("rest"),
        n_blocks.alias("n_blocks"), "others", (F.coalesce(step, F.lit(1)) % F.col("others")).cast("long").alias("a"), F.pmod(seeded, F.col("others")).cast("long").alias("c"),
    )
    line = Window.partitionBy(*name, "shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id", "size")
    placed = dealt.withColumn("at", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(shards, [*name, "shard"])
    full, over = F.floor(F.col("rest") / BLOCK_WORDS), F.col("rest") % BLOCK_WORDS

    def taken_of(block: Column) -> Column:
        rank = F.when(block == F.col("n_blocks") - 1, block).otherwise((F.col("a") * block + F.col("c")) % F.col("others"))
        begin, n = block * BLOCK_WORDS, F.when(rank < full, BLOCK_WORDS).when(rank == full, over).otherwise(0)
        return F.struct((F.greatest(F.col("at"), begin) - F.col("at")).alias("begin"), (F.least(F.col("at") + F.col("size"), begin + n) - F.col("at")).alias("end"))

    blocks = F.sequence(F.floor(F.col("at") / BLOCK_WORDS), F.floor((F.col("at") + F.col("size") - 1) / BLOCK_WORDS))
    ranges = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.filter(F.transform(blocks, taken_of), lambda r: r["end"] > r["begin"]))
    placed = placed.select("doc_id", "size", "source_size", "target", "passes", F.coalesce(ranges, F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("ranges"))
    more = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return placed.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + more).cast("long").alias("taken"), "passes", "ranges")


def mixed(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The mix as rows of documents: a row for each whole copy, and one of the blocks taken once more, if any.

    Blocks that don't follow each other stand on lines of their own. Rows of one id all get the copies of the first of
    them; nulls in other columns and extra columns of any name stay.
    """
    own = "_take"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    take = mix(spark, docs, **how).where("taken > 0").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias(f"{own}id"), F.struct("size", "taken", "passes", "ranges").alias(own))
    field = lambda name: F.col(f"{own}.{name}")
    copies = F.concat(F.array_repeat(F.lit(False), field("passes").cast("int")), F.when(F.size(field("ranges")) > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = docs.join(take, F.col("doc_id").eqNullSafe(F.col(f"{own}id"))).select("*", F.explode(copies).alias(f"{own}part"))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumn(f"{own}words", F.when(F.col(f"{own}part") & (field("taken") < (field("passes") + 1) * field("size")), words))

    def part(r: Column, i: Column) -> Column:
        apart = (i > 0) & (F.get(field("ranges"), i - 1)["end"] != r["begin"])
        return F.concat(F.when(apart, F.lit("\n")).otherwise(F.lit("")), F.array_join(F.slice(F.col(f"{own}words"), r["begin"].cast("int") + 1, (r["end"] - r["begin"]).cast("int")), ""))

    text = F.when(F.col(f"{own}words").isNotNull(), F.array_join(F.transform(field("ranges"), part), "")).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
