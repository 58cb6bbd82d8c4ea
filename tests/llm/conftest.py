import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, u bigint"


@pytest.fixture
def docs_of(spark):
    """Documents of texts, with extra columns whose names operators use themselves."""

    def make(texts, ids=None, sources=None):
        ids = range(len(texts)) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, None if t is None else len(t), 0.5, "x", 7) for i, t, s in zip(ids, texts, sources)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def texts_of(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
