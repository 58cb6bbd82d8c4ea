"""Readers and writers of corpora and datasets."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def corpus(spark: SparkSession, pattern: str, name: str | None = None) -> DataFrame:
    """file, text of whole files; with a name pattern of groups, also part_1, part_2 ... of the file name."""
    df = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    if name:
        import re

        df = df.where(F.regexp_like("file", F.lit(name)))
        for k in range(1, re.compile(name).groups + 1):
            df = df.withColumn(f"part_{k}", F.regexp_extract("file", name, k))
    return df


def records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON array or of JSON objects, with the given types."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """ord, key and the fields of a JSON object of objects, or of one in a field; ord is the order in the file. value: a struct type."""
    kind = f"map<string, {value}>"
    entries = F.from_json("value", f"struct<`{field}`: {kind}>")[field] if field else F.from_json("value", kind)
    one = spark.read.text(path, wholetext=True)
    return one.select(F.posexplode(F.map_entries(entries)).alias("ord", "e")).select("ord", "e.key", "e.value.*")


INDEX = "section string, title string, summary string, line_start int"
#: The named datasets of a rule corpus and their columns; (field, value type) of objects that are keyed.
RECORDS = {
    "permitted_uses": "use string, category string, naics string, special_requirements string, discrepancy_note string, districts map<string,string>",
    "special_requirements_index": INDEX,
    "general_provisions_index": INDEX,
    "ordinances_index": "chapter string, chapter_name string, filename string, section string, title string, line_start int",
    "personnel_index": "section string, section_name string, number string, id string, title string, filename string, line_start int",
}
STANDARDS = {
    "principal_structures": "district string, use_type string, density string, min_lot_size string, min_width_ft int, min_width_alley_ft int, min_street_frontage_ft int, setback_front_ft int, setback_front_max_ft int, setback_side_min_ft int, setback_side_max_ft int, setback_side_interior_note string, setback_rear_ft int, max_height_ft int",
    "accessory_structures": "district string, setback_side_interior_ft int, setback_side_interior_note string, setback_side_corner string, setback_rear_ft int, setback_rear_note string",
}
DISTRICT = "name string, section string, intent string, character string, key_rules array<string>"
SUBDIVISION = {
    "types": "section string, name string, summary string, criteria array<string>, all_criteria_required boolean, any_criteria_triggers boolean, preliminary_plat_required boolean, engineering_drawings string, approval_authority string, process_section string, process_steps array<string>, preliminary_plat_validity string, final_plat_recording string",
    "improvement_requirements": "section string, detail_sections array<string>, summary string",
    "plat_requirements": "section string, required_for string, summary string",
    "general_procedures": "section string, summary string",
}


def dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A named dataset of a folder, with ord, the place in its file."""
    if name in RECORDS:
        return listed(spark, f"{folder}/{name}.json", RECORDS[name])
    if name in STANDARDS:
        return listed(spark, f"{folder}/dimensional_standards.json", STANDARDS[name], name)
    if name == "districts":
        return keyed(spark, f"{folder}/districts.json", "", f"struct<{DISTRICT.replace(' ', ':').replace(',:', ', ')}>")
    return keyed(spark, f"{folder}/subdivision_index.json", name, f"struct<{SUBDIVISION[name].replace(' ', ':').replace(',:', ', ')}>")


def listed(spark: SparkSession, path: str, schema: str, field: str = "") -> DataFrame:
    """ord and the fields of a JSON array of objects, or of the array in a field of an object."""
    kind = f"array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>"
    one = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", f"struct<`{field}`:{kind}>")[field] if field else F.from_json("value", kind)
    return one.select(F.posexplode(rows).alias("ord", "e")).select("ord", "e.*")


def features(spark: SparkSession, path: str, attributes: str) -> DataFrame:
    """Attributes and rings of recorded answers of a feature service; attributes: their columns and types."""
    kind = f"struct<features: array<struct<attributes: struct<{attributes}>, geometry: struct<rings: array<array<array<double>>>>>>>"
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    return one.select("f.attributes.*", F.col("f.geometry.rings").alias("rings"))


def extracted(spark: SparkSession, pattern: str, extract: Callable[[bytes], str]) -> DataFrame:
    """file, text of whole files that another program turns into text; extract runs on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array([extract(x) for x in b.column("content").to_pylist()], pa.string())], ["file", "text"])

    rows = spark.read.format("binaryFile").load(pattern)
    return rows.select(F.substring_index("path", "/", -1).alias("file"), "content").mapInArrow(run, "file string, text string")


def first_file(files: DataFrame, prefix: str) -> DataFrame:
    """The first file, by name, that starts with the prefix."""
    return files.where(F.startswith("file", F.lit(prefix))).orderBy("file").limit(1)


def datasets(spark: SparkSession, paths: dict[str, tuple[str, StructType | str]]) -> None:
    """Registers named datasets as views, so that SQL reaches them."""
    for name, (path, schema) in paths.items():
        records(spark, path, schema).createOrReplaceTempView(name)


def write_sections(df: DataFrame, path: str) -> None:
    """One file for each row, named by its column file; rows of one name share it."""
    df.select("file", "text").write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path)
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    new = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path(*parts)
    for folder in fs.listStatus(root):
        at = folder.getPath()
        if at.getName().startswith("file="):
            # rows of one name were dealt to one partition only if one task held them; names are unique in an index
            parts = [p.getPath() for p in fs.listStatus(at)]
            name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(at.getName()[5:])
            if len(parts) != 1:
                raise ValueError(f"several rows for the file {name}")
            fs.rename(parts[0], new(root, name))
            fs.delete(at, True)


def write_index(df: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON array of the rows, in the order of a column; an index is small, as each row points to a section."""
    columns = [c for c in df.columns if c != order]
    row = F.struct(F.col(order) if order else F.monotonically_increasing_id().alias("_i"), F.to_json(F.struct(*columns)).alias("j"))
    one = df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["j"]), ",\n").alias("v"))
    one.select(F.concat(F.lit("["), "v", F.lit("]"))).coalesce(1).write.mode("overwrite").text(path)
