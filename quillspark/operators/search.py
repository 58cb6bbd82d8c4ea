"""Full-text search over lines: windows, greedy proximity deduplication, first-n with the rest counted."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as t
from quillspark.operators.corpus import line_array, window_text


def line_search(lines: DataFrame, query: str, n: int = 150) -> DataFrame:
    """Lines that hold all words."""
    return lines.where(t.all_words(F.col("line"), query)).withColumn("snippet", t.snippet(F.col("line"), n)).drop("line")


def window_search(lines: DataFrame, key: str, query: str, radius: int = 2, n: int = 300) -> DataFrame:
    """key, lineno, snippet for each line whose surrounding lines together hold all words."""
    joined, near = window_text(key, radius)
    found = lines.select(key, "lineno", "line", joined.alias("_joined"), near.alias("_near")).where(t.all_words(F.col("_joined"), query))
    clean = F.filter(F.transform("_near", t.strip), lambda x: x != "")
    return found.select(key, "lineno", t.snippet(F.array_join(clean, " "), n).alias("snippet"))


def greedy_kept(linenos: Column, gap: int) -> Column:
    """Of rising numbers, each that is gap or more from the last one kept."""
    return F.aggregate(linenos, F.array().cast("array<bigint>"), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.try_element_at(kept, F.lit(-1)) >= gap), F.concat(kept, F.array(x))).otherwise(kept))


def greedy_dedup(hits: DataFrame, keys: list[str], gap: int = 5) -> DataFrame:
    """Hits in line order of each key, without those closer than gap lines to the last one kept.

    A key's hits are one array, read once: the fold gives the line numbers to keep, which are looked up in it.
    """
    rest = [c for c in hits.columns if c not in keys]
    own = F.struct("lineno", *(c for c in rest if c != "lineno"))
    all_ = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(own)).alias("_h"))
    kept = greedy_kept(F.transform("_h", lambda h: h["lineno"]), gap)
    all_ = all_.select(*keys, "_h", kept.alias("_k")).select(*keys, F.explode(F.filter("_h", lambda h: F.array_contains("_k", h["lineno"]))).alias("_h"))
    return all_.select(*(F.col(c) if c in keys else F.col(f"_h.{c}").alias(c) for c in hits.columns))


def lines_with(low: Column, word: Column | str) -> Column:
    """Of an array of lower-case lines, the numbers (from 1) of those that hold a word."""
    word = F.lit(word) if isinstance(word, str) else word
    return F.filter(F.transform(low, lambda x, i: F.when(F.contains(x, word), (i + 1).cast("long"))), lambda n: n.isNotNull())


def window_hits(low: Column, found: list[str], radius: int) -> Column:
    """Numbers of the lines whose surrounding lines together hold all words; low: lower-case lines.

    A word has no blanks, so it never spans two lines.
    """
    n = F.size(low).cast("long")
    near = [F.flatten(F.transform(lines_with(low, w), lambda k: F.sequence(F.greatest(F.lit(1).cast("long"), k - radius), F.least(n, k + radius)))) for w in found]
    out = near[0]
    for other in near[1:]:
        out = F.array_intersect(out, other)
    return F.array_sort(F.array_distinct(out))


def document_search(docs: DataFrame, key: str, query: str, text: str = "text", radius: int = 2, n: int = 300, gap: int = 5) -> DataFrame:
    """key, lineno, snippet: window_search() and greedy_dedup() of whole documents, without a shuffle.

    Documents that lack a word are left out before they are split.
    """
    found = list(dict.fromkeys(t.words(query)))
    # explode() of one row keeps what was computed from being computed again for each use
    rows = docs.where(t.all_words(F.col(text), query)).select(key, F.explode(F.array(line_array(F.col(text)))).alias("_lines"))
    rows = rows.select(key, "_lines", F.explode(F.array(F.transform("_lines", F.lower))).alias("_low"))
    rows = rows.select(key, "_lines", F.explode(F.array(window_hits(F.col("_low"), found, radius))).alias("_k"))
    rows = rows.select(key, "_lines", F.explode(greedy_kept(F.col("_k"), gap)).alias("lineno"))
    begin = F.greatest(F.lit(1).cast("long"), F.col("lineno") - radius)
    near = F.slice("_lines", begin.cast("int"), (F.col("lineno") + radius - begin + 1).cast("int"))
    clean = F.filter(F.transform(near, t.strip), lambda x: x != "")
    return rows.select(key, "lineno", t.snippet(F.array_join(clean, " "), n).alias("snippet"))


def document_search_or_wider(docs: DataFrame, asked: list[tuple[int, list[str]]], key: str, text: str = "text", n: int = 150) -> DataFrame:
    """query_id, key, lineno, snippet: lines that hold all words of a query; for a query of several words that no line of
    any document holds, lines whose neighbourhood of three does.

    A first reading tells which queries any line answers; the second gives the lines.
    """

    def holds(ws: list[str]):
        return lambda x: F.forall(F.array(*map(F.lit, ws)), lambda w: F.contains(x, w))

    def numbers(ws: list[str]) -> Column:
        single = F.transform("_low", lambda x, i: F.when(holds(ws)(x), (i + 1).cast("long")))
        return F.filter(single, lambda k: k.isNotNull())

    def hits(q: int, ws: list[str]) -> Column:
        wide = window_hits(F.col("_low"), list(dict.fromkeys(ws)), 1) if len(ws) > 1 else F.array().cast("array<bigint>")
        return F.transform(F.when(F.col(f"_{q}"), numbers(ws)).otherwise(wide), lambda k: F.struct(F.lit(q).alias("query_id"), k.alias("lineno")))

    able = F.lit(False)
    for _, ws in asked:
        able = able | t.all_words(F.col(text), " ".join(ws))
    lines = docs.where(able).select(key, F.explode(F.array(line_array(F.col(text)))).alias("_lines"))
    lines = lines.select(key, "_lines", F.explode(F.array(F.transform("_lines", F.lower))).alias("_low"))
    flags = lines.agg(*(F.coalesce(F.max(F.exists("_low", holds(ws))), F.lit(False)).alias(f"_{q}") for q, ws in asked))
    rows = lines.join(F.broadcast(flags))  # one row
    parts = [hits(q, ws) for q, ws in asked]
    rows = rows.select(key, "_lines", F.explode(F.flatten(F.array(*parts))).alias("_h"))
    return rows.select("_h.query_id", key, "_h.lineno", t.snippet(F.get("_lines", (F.col("_h.lineno") - 1).cast("int")), n).alias("snippet"))


def first_n(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group, with the number of rows beyond.

    The ranks keep n rows a group before the shuffle and the counts are partial sums, so no group meets in one task; a
    count beside the rank would shuffle them all.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    counts = rows.groupBy(group).agg(F.greatest(F.count("*") - n, F.lit(0)).cast("long").alias("n_more"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r").join(counts, group)


def with_fallback(single: DataFrame, wide: DataFrame, group: str) -> DataFrame:
    """single, and of wide only what belongs to groups without a row in single."""
    return single.unionByName(wide.join(single.select(group).distinct(), group, "left_anti"))


def tagged_union(**parts: DataFrame) -> DataFrame:
    out = None
    for name, part in parts.items():
        part = part.withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
