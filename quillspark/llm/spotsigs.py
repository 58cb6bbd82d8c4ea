"""SpotSigs fingerprints in DataFrame operations only.

Anchors are common words of four languages, sentence ends, line breaks and the start of a text. The chain of up to
``CHAIN`` content words that follows an anchor is a signature; a text's fingerprint is the sorted set of the signatures'
32-bit hashes.

near_pairs() partitions sets by their length: sets of similarity t or more differ in length by a factor of at most 1/t, so
they lie in the same partition or in neighbouring ones, and only there are they compared. Within a partition sets meet by
the signatures of their prefix, the rarest first, of which sets at the threshold must share one; a pair whose lengths alone
hold it below the threshold is dropped before its Jaccard similarity is computed. Equal fingerprints are one set.

A text's neighbour is found without a global sort: ids fall into at most ``BUCKETS`` ranges of about as many rows, each
sorted on its own, and the first row of a range is added to the range before it.

Defined cases: a null text is empty; texts without words have one signature, of their characters, and an empty text has
none; texts of any length are read whole; equal fingerprints have likeness 1, an empty and another one 0; repeated ids
follow each other by text; null ids come last; the only row of a table is its own neighbour; an empty table gives no rows;
extra columns don't matter, whatever their names.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHAIN = 3
#: Hexadecimal digits of a signature.
DIGITS = 8
#: Ranges of ids: a bound of what the driver collects, and the rows that a range aims at.
BUCKETS, RANGE_ROWS = 65_536, 2_048
#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui sa se ses son sur un une "
    "als auch auf aus bei das dem den der die ein eine einen einer er es für im ist mit nach nicht sich sie und von wie zu zum zur "
    "al como con del el ella era las lo los más no o para pero por si su sus una uno y"
).split()
MARK = "\u0001"


def _anchor_pattern() -> str:
    """The anchors by first letter, so that a word is tried against few of them."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(ANCHORS)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


def marked_words(text: Column) -> Column:
    """The content words of a text; one that follows an anchor starts with MARK. Without words, the marked text itself."""
    s = F.regexp_replace(F.lower(F.replace(text, F.lit(MARK), F.lit(" "))), r"[.!?\r\n]+", f" {MARK} ")
    s = F.regexp_replace(s, rf"[^\p{{L}}\p{{N}}{MARK}]+", " ")
    s = F.regexp_replace(F.concat(F.lit(f" {MARK} "), s, F.lit(" ")), f" (?:{_anchor_pattern()})(?= )", f" {MARK}")
    s = F.regexp_replace(s, f"{MARK}[ {MARK}]*", MARK)
    words = F.filter(F.split(s, " "), lambda w: (w != "") & (w != MARK))
    # the lambda's argument is computed once, however often it is read
    either = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, w).when(text != "", F.array(F.concat(F.lit(MARK), text))).otherwise(w))
    return F.element_at(either, 1)


def signatures(words: Column) -> Column:
    """Sorted distinct hashes; words: a column that is computed already, as it is read several times."""
    n = F.lit(1 << 30)
    columns = [words, *(F.slice(words, F.lit(k + 1), n) for k in range(1, CHAIN))]
    plain = lambda w: F.ltrim(w, F.lit(MARK))
    chains = F.filter(F.arrays_zip(*(c.alias(f"w{k}") for k, c in enumerate(columns))), lambda z: F.startswith(z["w0"], F.lit(MARK)))
    return F.sort_array(F.array_distinct(F.transform(chains, lambda z: F.substring(F.md5(F.concat_ws(" ", *(plain(z[f"w{k}"]) for k in range(CHAIN)))), 1, DIGITS))))


def spelled(sigs: Column) -> Column:
    return F.array_join(sigs, " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; sets without a common size bound are not intersected."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(high == 0, F.lit(1.0)).when(low == 0, F.lit(0.0)).otherwise(common / (low + high - common)).cast("double")


def near_pairs(prints: DataFrame, threshold: float = 0.8, sigs: str = "sigs", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of different fingerprints that reach the threshold, and the members (id, fingerprint) of each.

    a and b are fingerprints; empty ones pair with nothing.
    """
    step = math.log(1 / threshold)
    members = prints.select(F.col(id_col).alias(id_col), spelled(F.col(sigs)).alias("fingerprint"))
    sets = prints.where(F.size(sigs) > 0).select(spelled(F.col(sigs)).alias("fp"), F.col(sigs).alias("s")).groupBy("fp").agg(F.first("s").alias("s"))
    each = sets.select("fp", F.explode("s").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count("*").alias("df"))
    ordered = each.join(rarity, "sig").groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("o"))
    n = F.size("o")
    prefix = F.slice("o", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    part = F.floor(F.log(n) / step + 1e-9).cast("int")
    keyed = ordered.select("fp", n.alias("n"), part.alias("part"), F.explode(prefix).alias("p")).select("fp", "n", "part", F.col("p.sig").alias("sig"))
    right = keyed.select(F.col("fp").alias("b"), F.col("n").alias("nb"), "sig", F.col("part").alias("own"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    left = keyed.select(F.col("fp").alias("a"), F.col("n").alias("na"), "sig", "part")
    # b is in a's partition or in the one below; inside one partition each pair is taken once
    near = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    pairs = left.join(right, ["part", "sig"]).where(near & ((F.col("own") < F.col("part")) | (F.col("a") < F.col("b")))).select("a", "b").distinct()
    own = lambda end: sets.select(F.col("fp").alias(end), F.col("s").alias(f"s{end}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return both.where(F.col("likeness") >= threshold), members


def with_neighbours(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """id, text, ghost, next_text in falling order of ids, and the window that holds their order; ghosts are borrowed rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # null ids take the place below the smallest
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    n, low = ids.agg(F.count("*"), F.min("i")).first()
    low = (0 if low is None else low) - 1
    place = F.coalesce("doc_id", F.lit(low))
    # Spark's own ranges, by a sample, hold about as many rows each, however the ids are spread
    n_ranges = max(1, min(BUCKETS, n // RANGE_ROWS))
    ends = ids.select(F.coalesce("i", F.lit(low)).alias("i")).repartitionByRange(n_ranges, "i").groupBy(F.spark_partition_id().alias("k")).agg(F.max("i").alias("end")).collect()
    ends = sorted(r["end"] for r in ends)  # at most as many as ranges
    # the range of an id is the number of ends before it, found by bisection
    table = F.from_json(F.lit(str(ends[:-1])), "array<bigint>")
    bits = [1 << k for k in reversed(range(len(ends).bit_length()))]
    range_of = F.aggregate(F.array(*map(F.lit, bits)), F.lit(0), lambda at, bit: F.when(F.get(table, at + bit - 1) < place, at + bit).otherwise(at)).cast("long")
    firsts = [{"part": k, "place": end} for k, end in reversed(list(enumerate(ends)))]
    lend = [(b["place"], a["part"]) for a, b in zip(firsts, firsts[1:])] + [(firsts[0]["place"], firsts[-1]["part"]) for _ in firsts[:1]]
    lend = spark.createDataFrame(lend, "place long, to long")  # a row for each range
    rows = rows.select("doc_id", "text", place.alias("place"), range_of.alias("part")).join(F.broadcast(lend), "place", "left")
    homes = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost")), F.struct(F.col("to").alias("part"), F.lit(True).alias("ghost")))
    rows = rows.select("doc_id", "text", "place", F.explode(F.filter(homes, lambda h: h["part"].isNotNull())).alias("home"))
    rows = rows.select("doc_id", "text", "place", F.col("home.part").alias("part"), F.col("home.ghost").alias("ghost"))
    order = Window.partitionBy("part").orderBy("ghost", F.desc("place"), "text")
    return rows.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit(""))), order


def fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures."""
    rows, order = with_neighbours(spark, docs, id_col, text_col)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    # explode() of one row keeps what was computed from being computed again for each use
    rows = rows.select("doc_id", "place", "part", "ghost", "text", n.cast("long").alias("n_chars"), F.explode(F.array(F.struct(edited.alias("edited"), marked_words(F.col("text")).alias("words"), marked_words(edited).alias("edited_words")))).alias("u"))
    rows = rows.select("doc_id", "place", "part", "ghost", "text", "n_chars", F.sha2("u.edited", 256).alias("edited_sha256"), signatures(F.col("u.words")).alias("sigs"), signatures(F.col("u.edited_words")).alias("edited_sigs"))
    rows = rows.withColumn("next_sigs", F.lead("sigs").over(order)).where(~F.col("ghost"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("sigs")).alias("fingerprint"), spelled(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), F.size("sigs").cast("long").alias("n_signatures"),
    )


def _oracle() -> str:
    """Words one by one instead of by patterns on the text."""
    words = r"list_filter(string_split(regexp_replace(regexp_replace(lower(replace({0}, chr(1), ' ')), '[.!?\r\n]+', ' ' || chr(1) || ' ', 'g'), '[^\p{{L}}\p{{N}}\x01]+', ' ', 'g'), ' '), lambda w: w <> '')"
    anchors = "[" + ", ".join(f"'{w}'" for w in sorted(set(ANCHORS))) + "]"
    prints = lambda text, name: f"""
  {name}_w as (select doc_id, {text} as x, list_prepend(chr(1), list_transform({words.format(text)}, lambda w: case when list_contains({anchors}, w) then chr(1) else w end)) as w from d),
  {name}_m as (select doc_id, x, list_filter(list_transform(range(1, len(w) + 1), lambda i: case when w[i] <> chr(1) then {{'w': w[i], 'a': w[i - 1] = chr(1)}} end), lambda z: z is not null) as m from {name}_w),
  {name}_s as (select doc_id, case when len(m) = 0 then case when x = '' then [] else [substring(md5(x), 1, 8)] end
    else list_sort(list_distinct(list_transform(list_filter(range(1, len(m) + 1), lambda i: m[i].a), lambda i: substring(md5(concat_ws(' ', m[i].w, m[i + 1].w, m[i + 2].w)), 1, 8)))) end as {name} from {name}_m)"""  # noqa: E731
    like = "case when greatest(len({0}), len({1})) = 0 then 1.0 when least(len({0}), len({1})) = 0 then 0.0 else len(list_intersect({0}, {1}))::double / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) end::double"
    return f"""
with o as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, lead(coalesce(text, '')) over w as after, lead(doc_id) over w as next_id, first_value(coalesce(text, '')) over w as head, first_value(doc_id) over w as head_id from documents window w as (order by doc_id desc)),
  d as (select doc_id, text, n, left(text, n - n // 3) || left(coalesce(after, head), n // 3) as edited, coalesce(next_id, head_id) as next_id from o),
  {prints('text', 'fa')}, {prints('edited', 'fb')}
select d.doc_id, n::bigint as n_chars, sha256(edited) as edited_sha256, array_to_string(fa_s.fa, ' ') as fingerprint, array_to_string(fb, ' ') as edited_fingerprint,
  {like.format('fa_s.fa', 'fb')} as near_edited, {like.format('fa_s.fa', 'x.fa')} as near_next, len(fa_s.fa)::bigint as n_signatures
from d join fa_s using (doc_id) join fb_s using (doc_id) join fa_s x on x.doc_id = d.next_id
"""


ORACLE = _oracle()


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
