"""Texts as numbered lines, and slices from heading to heading."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as t


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, lineno from 1, line. A closing line break adds no line, and an empty text has none."""
    return docs.select(key, F.posexplode(line_array(F.col(text))).alias("_i", "line")).select(key, (F.col("_i") + 1).cast("long").alias("lineno"), "line")


def line_array(text: Column) -> Column:
    """The lines of a text; null for an empty one. Plain replacements only, as patterns cost more than the rest."""
    one = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    one = F.when(F.contains(text, F.lit("\r")), one).otherwise(text)
    return F.when(text != "", F.split(F.when(F.endswith(one, F.lit("\n")), F.substring(one, F.lit(1), F.length(one) - 1)).otherwise(one), "\n"))


def window_text(key: str, radius: int) -> tuple[Column, Column]:
    """The joined lines around each line, and the same as an array."""
    around = Window.partitionBy(key).orderBy("lineno").rowsBetween(-radius, radius)
    near = F.collect_list("line").over(around)
    return F.array_join(near, " "), near


def lines_kept(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """lines() that keeps the empty line after a closing line break, so that a text is its lines joined again."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return docs.select(key, F.posexplode(parts).alias("_i", "line")).select(key, (F.col("_i") + 1).cast("long").alias("lineno"), "line")


def slice_ends(rows: DataFrame, keys: list[str], order: str, boundary: Column) -> DataFrame:
    """Adds next_start: the place of the next boundary after each row, null at the last. One pass, from below."""
    below = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("next_start", F.min(F.when(boundary, F.col(order))).over(below))


def level_slice_ends(rows: DataFrame, keys: list[str], order: str, level: Column, levels: range, own: Column | None = None) -> DataFrame:
    """Adds next_start: the next heading of the row's own level or a higher one; level is null for body lines.

    own: the level that a row counts as itself, if it isn't ``level``.
    """
    below, own = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1), level if own is None else own
    end = F.lit(None).cast("long")
    for k in levels:
        end = F.when(own == k, F.min(F.when(level <= k, F.col(order))).over(below)).otherwise(end)
    return rows.withColumn("next_start", end)


def slice_text(all_lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end - 1 of an array, joined; an end of null is the last line."""
    stop = F.coalesce(end, F.size(all_lines) + 1)
    return F.array_join(F.slice(all_lines, start.cast("int"), (stop - start).cast("int")), "\n")


def bodies(hits: DataFrame, ends: DataFrame, key: str = "file") -> DataFrame:
    """Adds body to hits (key, line_start, ...): the lines from line_start to next_start of ends (key, lineno, line, next_start).

    A file's lines become one array, so that hits are not multiplied by them.
    """
    own = ends.join(hits.select(key).distinct(), key, "left_semi")
    whole = own.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]).alias("_all"))
    at = own.select(key, F.col("lineno").alias("line_start"), F.col("next_start").alias("_end"))
    out = hits.join(at, [key, "line_start"]).join(whole, key)
    return out.withColumn("body", t.strip(slice_text(F.col("_all"), F.col("line_start"), F.col("_end")))).select(*hits.columns, "body")
