"""Jobs that clean extracted text and build section indices."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as t
from quillspark.operators.corpus import slice_text


def clean_lines(lines: DataFrame, key: str, drop: str) -> DataFrame:
    """Without lines that match drop, and of each run of blank lines only the first; lines lose white space at their ends."""
    rows = lines.where(~F.regexp_like("line", F.lit(drop))).withColumn("line", F.regexp_replace(F.replace(F.col("line"), F.lit("\f"), F.lit("")), r"\s+$", ""))
    before = F.lag("line").over(Window.partitionBy(key).orderBy("lineno"))
    return rows.withColumn("_before", before).where((F.col("line") != "") | (F.coalesce("_before", F.lit("")) != "")).drop("_before")


def renumber(lines: DataFrame, key: str, heading: str, per_heading: int = 3, offset: int = 7) -> DataFrame:
    """Adds line_start: where a line lands when each heading becomes per_heading lines below a front matter."""
    size = F.when(F.regexp_like("line", F.lit(heading)), per_heading).otherwise(1)
    before = Window.partitionBy(key).orderBy("lineno").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("line_start", (F.coalesce(F.sum(size).over(before), F.lit(0)) + offset + 1).cast("long"))


def heading_index(lines: DataFrame, key: str, pattern: str) -> DataFrame:
    """key, lineno, section, title of heading lines; pattern has two groups. A title that ends in a comma is body text."""
    found = lines.where(F.regexp_like("line", F.lit(pattern)))
    found = found.select(key, "lineno", F.regexp_extract("line", pattern, 1).alias("section"), t.clean_title(F.regexp_extract("line", pattern, 2)).alias("title"))
    return found.where(~F.endswith("title", F.lit(",")))


def sections(lines: DataFrame, key: str, marker: str) -> DataFrame:
    """Adds section: the number of markers up to the line; lines before the first marker are section 0."""
    upto = Window.partitionBy(key).orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(F.regexp_like("line", F.lit(marker)).cast("int")).over(upto).cast("long"))


def _bare(line: Column) -> Column:
    return F.replace(line, F.lit("\f"), F.lit(""))


def section_starts(lines: DataFrame, key: str, sections: list[str]) -> DataFrame:
    """key, section, start, place of each section that a file has, in the given order.

    A section is searched behind the start of the one before it: the first left-aligned "SECTION name" is its body, the
    first indented one, a cover, only stands in for it. The markers of a file are few, so they are one array.
    """
    bare = _bare(F.col("line"))
    marks = lines.where(t.strip(bare).isin(*(f"SECTION {s}" for s in sections)))
    marks = marks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("lineno", F.substring(t.strip(bare), 9, 100).alias("section"), (~F.startswith(bare, F.lit(" "))).alias("body")))).alias("_m"))
    kind = "struct<upto:bigint,found:array<struct<section:string,start:bigint,place:int>>>"
    names = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(k).alias("place")) for k, s in enumerate(sections)))

    def step(state: Column, name: Column) -> Column:
        own = F.filter("_m", lambda m: (m["section"] == name["section"]) & (m["lineno"] > state["upto"]))
        start = F.coalesce(F.get(F.filter(own, lambda m: m["body"]), F.lit(0))["lineno"], F.get(own, F.lit(0))["lineno"])
        hit = F.struct(name["section"].alias("section"), start.alias("start"), name["place"].alias("place"))
        return F.when(start.isNull(), state).otherwise(F.struct(start.alias("upto"), F.concat(state["found"], F.array(hit)).alias("found"))).cast(kind)

    first = F.struct(F.lit(0).cast("long").alias("upto"), F.array().alias("found")).cast(kind)
    return marks.select(key, F.explode(F.aggregate(names, first, step)["found"]).alias("f")).select(key, "f.*")


def end_markers(lines: DataFrame, key: str) -> DataFrame:
    """key, section, end: the last line that says END OF SECTION."""
    pattern = r"^END OF SECTION ([IVXLC]+)$"
    found = lines.select(key, "lineno", F.regexp_extract(t.strip(_bare(F.col("line"))), pattern, 1).alias("section")).where("section <> ''")
    return found.groupBy(key, "section").agg(F.max("lineno").alias("end"))


def section_bodies(lines: DataFrame, key: str, sections: list[str]) -> DataFrame:
    """key, section, place, first_line, last_line, body: what follows a section's start, up to its end marker, else to the
    next section's start, else to the end of the file."""
    starts = section_starts(lines, key, sections).join(end_markers(lines, key), [key, "section"], "left")
    after = F.lead("start").over(Window.partitionBy(key).orderBy("place"))
    starts = starts.withColumn("_end", F.coalesce("end", after))
    whole = lines.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]).alias("_all"))
    out = starts.join(whole, key).withColumn("_end", F.coalesce("_end", F.size("_all") + 1))
    return out.select(key, "section", "place", (F.col("start") + 1).alias("first_line"), (F.col("_end") - 1).cast("long").alias("last_line"), slice_text(F.col("_all"), F.col("start") + 1, F.greatest(F.col("start") + 1, "_end")).alias("body"))


def provisions(lines: DataFrame, key: str) -> DataFrame:
    """key, lineno, number, title, level of numbered provisions and of items; fixed values: the forms of both headings.

    A title that ends in a comma is body text.
    """
    header, item = r"^(\d{1,2}\.0|\d{1,2}(?:\.\d{2}){1,3})\s+([A-Za-z].*)$", r"^ITEM ([A-Z])\)\s*(.*)$"
    line = t.strip(F.col("line"))
    number, letter = F.regexp_extract(line, header, 1), F.regexp_extract(line, item, 1)
    rows = lines.select(
        key, "lineno", F.when(number != "", number).when(letter != "", F.concat(F.lit("Item "), letter)).alias("number"),
        F.when(number != "", t.clean_title(F.regexp_extract(line, header, 2))).otherwise(t.unquoted(t.clean_title(F.regexp_extract(line, item, 2)))).alias("title"),
        F.when(number != "", t.heading_level(number)).otherwise(3).alias("level"), ((number != "") & F.endswith(line, F.lit(","))).alias("_body"),
    )
    return rows.where("number is not null and not _body").drop("_body")
