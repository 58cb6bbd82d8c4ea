"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group. Large groups are items of their own; the others are dealt by hash into small bins,
which are items too, so that at most ``BINS`` + 3 * ``LARGE`` items (and the parts of groups that fit no shard) are
placed, whatever the input. Items go in falling order of size, each to the shard whose residual capacity has the highest
dot product with the item, among those that can take it whole if there are any.

A group is parted only if, when its turn comes, no shard has room for it; what has room follows from the number of
shards alone. Its parts are dealt by a hash of doc_id and placed as items.

Defined cases: a null text counts as empty (size 1, no tokens); repeated rows are rows of one group, and of equal keys
and ids any order of slots is as good as another; items of one size go in the order of their numbers, equal dot products
to the lower shard; texts of any length are one row; extra columns don't matter, whatever their names; an empty table
gives no rows.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.plans.staging import Stage

BINS = 16384
#: A group is an item of its own from 1/LARGE of the corpus in any dimension on; at least 1/8 of a shard.
LARGE = 512
#: Parts of a group that fits no shard, for each shard that it would fill.
PARTS = 4
#: Rows that one task numbers at once, at most; in a small corpus 1/CELLS of it, but at least LEAST_CELL.
CELL_ROWS, CELLS, LEAST_CELL = 262_144, 512, 512
WORD = r"[^\x20\x09-\x0D]+"


def place(items: np.ndarray, shards: int, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each item, and which items fit no shard though they are groups; in that case the shard is -1.

    items: one row of bytes, tokens and rows each; groups: which of them are groups that should stay whole.
    """
    capacity = np.maximum(items.sum(axis=0) / shards, 1e-9)
    load = items / capacity
    free = np.ones((shards, items.shape[1]))
    out, over = np.full(len(items), -1, dtype=np.int32), np.zeros(len(items), dtype=bool)
    for k in np.lexsort((np.arange(len(items)), -load.max(axis=1))):
        gain = free @ load[k]
        if groups[k]:
            fits = (free >= load[k] - 1e-9).all(axis=1)
            if not fits.any():
                over[k] = True
                continue
            gain[~fits] = -np.inf
        out[k] = best = int(np.argmax(gain))
        free[best] -= load[k]
    return out, over


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    stage = Stage(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"), F.unhex(F.md5(text)).alias("key"),
    )
    slim = stage.write(slim, "slim")
    sums = (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    total = slim.agg(*sums).first()
    n_rows = total["r"]
    total = np.array([total["b"] or 0, total["t"] or 0, n_rows], dtype=float)
    least = max(LARGE, 8 * shards)
    large = slim.groupBy("key").agg(*sums).where(" or ".join(f"{c} * {least}D >= {float(max(v, 1.0))!r}D" for c, v in zip("btr", total)))
    large = [(bytes(x["key"]), [x["b"], x["t"], x["r"]]) for x in large.orderBy("key").collect()]
    bins = min(max(BINS, 16 * shards), max(shards, n_rows // 4))
    # a first placement, with the rest of the corpus in crumbs, tells which groups find no room
    groups = np.array([v for _, v in large], dtype=float).reshape(-1, 3)
    rest = np.maximum(total - groups.sum(axis=0), 0)
    crumbs = np.repeat(rest[None] / (64 * shards), 64 * shards, axis=0)
    over = place(np.concatenate([groups, crumbs]), shards, np.arange(len(groups) + len(crumbs)) < len(groups))[1]
    share = (groups / np.maximum(total, 1)).max(axis=1, initial=0)
    n_parts = [int(np.ceil(x * shards * PARTS)) + 1 for x in share.tolist()]
    parts = [n if o else 1 for n, o in zip(n_parts, over.tolist())]
    by_id = F.xxhash64(F.lit(11), "doc_id")
    while True:
        hot = spark.createDataFrame([(k, bins + i, n) for i, ((k, _), n) in enumerate(zip(large, parts))], "key binary, hot int, parts int")
        rows = slim.join(F.broadcast(hot), "key", "left").select(
            "doc_id", "size", "text_crc32", "tokens", "key", F.coalesce("hot", F.pmod(F.xxhash64("key"), F.lit(bins)).cast("int")).alias("item"),
            F.coalesce(F.pmod(by_id, F.col("parts")).cast("int"), F.lit(0)).alias("part"),
        )
        found = rows.groupBy("item", "part").agg(*sums).orderBy("item", "part").collect()
        items = np.array([[x["b"], x["t"], x["r"]] for x in found], dtype=float).reshape(-1, 3)
        at, over = place(items, shards, np.array([x["item"] >= bins and parts[x["item"] - bins] == 1 for x in found], dtype=bool))
        if not over.any():
            break
        for k in np.flatnonzero(over):  # it found room among crumbs, but not among the true items
            parts[found[k]["item"] - bins] = n_parts[found[k]["item"] - bins]
    cell_rows = min(CELL_ROWS, max(LEAST_CELL, n_rows // CELLS))
    subs = [(x["item"], x["part"], int(s), -(-x["r"] // cell_rows)) for x, s in zip(found, at)]
    cells = rows.join(F.broadcast(spark.createDataFrame(subs, "item int, part int, shard int, subs long")), ["item", "part"])
    cells = cells.withColumn("sub", F.pmod(F.xxhash64("key", "doc_id"), F.col("subs")).cast("int"))
    offsets, filled = [], [0] * shards
    if any(s[3] > 1 for s in subs):
        sizes = [(x["item"], x["part"], x["sub"], x["shard"], x["n"]) for x in cells.groupBy("item", "part", "sub", "shard").agg(F.count("*").alias("n")).orderBy("item", "part", "sub").collect()]
    else:
        sizes = [(i, p, 0, s, x["r"]) for (i, p, s, _), x in zip(subs, found)]
    for i, p, sub, s, n in sizes:
        offsets.append((i, p, sub, filled[s]))
        filled[s] += n
    cells = cells.join(F.broadcast(spark.createDataFrame(offsets, "item int, part int, sub int, begins long")), ["item", "part", "sub"])
    order = Window.partitionBy("item", "part", "sub").orderBy("key", "doc_id")
    return cells.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("begins") + F.row_number().over(order) - 1).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
