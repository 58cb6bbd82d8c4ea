"""Connected components by alternating stars, each step a written table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.staging import Stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(spark: SparkSession, edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """edges: u, v of longs. Gives id, comp for each id with an edge; comp is the smallest id that it reaches.

    The large star hangs each larger neighbour on the smallest one, the small star the smaller neighbours; both keep
    the components, and when nothing changes every id hangs on its smallest. Each round lowers some end of an edge, so it
    ends, after a number of rounds that grows with the logarithm of the longest path. Minima are taken before the shuffle
    and written, so that Spark can split the partition of a node with most edges where they meet again.
    """
    now = stage.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}_0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        near = _both(now)
        least = stage.write(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), f"{name}_{k}m")
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage.write(large, f"{name}_{k}a")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = stage.write(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}_{k}")
        for old in (f"{name}_{k}m", f"{name}_{k}a", f"{name}_{k - 1}"):
            stage.drop(old)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    # now each id other than a smallest one has one edge
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
