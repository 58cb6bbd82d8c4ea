"""The corpus pipeline: toxicity, near-duplicates, secrets, source weights, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again for the next one.
All but the last give the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.mixing import mixed
from quillspark.llm.near_dedup import without_copies
from quillspark.llm.packing import pack
from quillspark.llm.secrets import mask_secrets
from quillspark.llm.toxicity import without_toxic
from quillspark.plans.staging import Stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return without_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose shingles of five words are alike by 0.8 or more."""
    return without_copies(spark, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in each text."""
    return mask_secrets(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and shortens documents so that each source has its share of the words."""
    return mixed(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_weights", source_weights),
    ("packing", packing),
]
#: The stages learn, hash and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stage(spark, "pipeline")
    for k, (name, apply) in enumerate(STAGES):
        docs = stage.write(apply(spark, docs, sf_dir), f"{k}_{name}")
    return docs
