"""Points and rings on plain arrays: centroids, points in polygons, neighbours within a radius."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring_centroid(rings: Column) -> Column:
    """Mean of the first ring's vertices, the closing one included; null without a ring."""
    ring = F.get(rings, F.lit(0))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k], lambda a: a / F.size(ring))
    return F.when(F.size(ring) > 0, F.struct(mean(0).alias("x"), mean(1).alias("y")))


def in_rings(rings: Column, x: Column, y: Column) -> Column:
    """Parity of the edges that a ray to the right crosses, over all rings, so that holes are outside."""

    def crossings(ring: Column) -> Column:
        edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        cut = lambda e: ((e["a"][1] > y) != (e["b"][1] > y)) & (x < (e["b"][0] - e["a"][0]) * (y - e["a"][1]) / F.nullif(e["b"][1] - e["a"][1], F.lit(0.0)) + e["a"][0])
        return F.size(F.filter(edges, cut))

    return F.aggregate(rings, F.lit(0), lambda n, ring: n + crossings(ring)) % 2 == 1


def radius_join(points: DataFrame, key: str, group: str, radius: float) -> DataFrame:
    """key, other_key, distance of points of one group within the radius; a point isn't its own neighbour.

    Points meet in grid cells as wide as the radius: the left side stays in its own, the right side is copied to its own
    and to four of the eight around it, so that near points of two cells meet once; each pair is then given both ways.
    Both sides are shuffled as they are, so that Spark can split the partition of a dense cell.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    at = points.select(group, F.col(key), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    near = at.select(group, F.col(key).alias(f"other_{key}"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy", F.explode(steps).alias("s"))
    own_cell = (F.col("s.dx") == 0) & (F.col("s.dy") == 0)
    near = near.select(group, f"other_{key}", "ox", "oy", own_cell.alias("own_cell"), (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    both = at.join(near, [group, "cx", "cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    both = both.where((F.col("distance") <= radius) & (F.col(key) != F.col(f"other_{key}")) & (~F.col("own_cell") | (F.col(key) < F.col(f"other_{key}"))))
    ways = F.array(F.struct(F.col(key).alias("a"), F.col(f"other_{key}").alias("b")), F.struct(F.col(f"other_{key}").alias("a"), F.col(key).alias("b")))
    return both.select(group, "distance", F.explode(ways).alias("w")).select(group, F.col("w.a").alias(key), F.col("w.b").alias(f"other_{key}"), "distance")


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """Least distance from a point to the segments of a ring."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def to(e: Column) -> Column:
        ax, ay, dx, dy = e["a"][0], e["a"][1], e["b"][0] - e["a"][0], e["b"][1] - e["a"][1]
        long = dx * dx + dy * dy
        along = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / long))).otherwise(F.lit(0.0))
        return F.sqrt(F.pow(x - ax - along * dx, F.lit(2)) + F.pow(y - ay - along * dy, F.lit(2)))

    return F.array_min(F.transform(edges, to))


def rings_distance(rings: Column, x: Column, y: Column) -> Column:
    """0 inside, else the least distance to any ring."""
    return F.when(in_rings(rings, x, y), F.lit(0.0)).otherwise(F.array_min(F.transform(rings, lambda r: ring_distance(r, x, y))))


def point_json(x: Column, y: Column) -> Column:
    """A point as the JSON text that a feature service takes."""
    return F.to_json(F.struct(x.alias("x"), y.alias("y")))
