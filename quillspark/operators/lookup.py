"""Lookups in catalogs: cascades of tiers, routes by keyword, first matches, permission matrices."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as t


def first_tier(rows: DataFrame, query_key: str, tiers: list[Column]) -> DataFrame:
    """Rows of the first tier that has any row for the query; adds tier from 0. Rows outside all tiers go."""
    tier = F.lit(None).cast("int")
    for k in range(len(tiers) - 1, -1, -1):
        tier = F.when(tiers[k], F.lit(k)).otherwise(tier)
    rows = rows.withColumn("tier", tier).where("tier is not null")
    return rows.withColumn("_least", F.min("tier").over(Window.partitionBy(query_key))).where("tier = _least").drop("_least")


def first_match(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first in the given order."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_m")).select(key, *(F.col(f"_m.{c}").alias(c) for c in columns))


def csv_join(rows: DataFrame, csv: str, separator: str, index: DataFrame, on: str) -> DataFrame:
    """A row for each item of a separated list that the index knows; unknown items are dropped."""
    items = rows.withColumn(on, F.explode(F.transform(F.split(csv, separator), lambda x: t.strip(x))))
    return items.join(index, on)


def alternatives(codes: list[str], per_code: Column) -> Column:
    """The codes, in their order, that a map has a value for."""
    return F.filter(F.array(*map(F.lit, codes)), lambda c: F.try_element_at(per_code, c).isNotNull())


def or_alternatives(hits: DataFrame, known: DataFrame) -> DataFrame:
    """The hits, found; or, if there are none, the known rows instead, not found."""
    n = hits.agg(F.count("*").alias("_n"))  # one row
    other = known.join(F.broadcast(n)).where("_n = 0").drop("_n").withColumn("found", F.lit(False))
    return hits.withColumn("found", F.lit(True)).unionByName(other, allowMissingColumns=True)


def file_of_article(number: Column, files: dict[int, str]) -> Column:
    """The file that holds an article."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in files.items() for x in pair]), number.cast("int"))


def routed(query: Column, aliases: dict[str, list[str]], default: str | None) -> Column:
    """Facets whose alias is part of the query, or the default one; without a default none."""
    facets = list(dict.fromkeys(x for to in aliases.values() for x in to))
    flag = {f: F.lit(False) for f in facets}
    for alias, to in aliases.items():
        for f in to:
            flag[f] = flag[f] | F.contains(query, F.lit(alias))
    found = F.array_compact(F.array(*(F.when(flag[f], F.lit(f)) for f in facets)))
    return found if default is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def jurisdiction(inside: Column, extended: Column, inside_failed: Column, extended_failed: Column) -> Column:
    return F.when(inside, "inside").when(extended, "extended").when(inside_failed & extended_failed, "unknown").otherwise("outside")
