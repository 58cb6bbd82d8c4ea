import pytest

from oracle import spark_rows, sql_rows
from quillspark.plans import catalog, tools  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, data, name):
    assert spark_rows(catalog.QUERIES[name](spark, data)) == sql_rows(catalog.ORACLES[name], data)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "lineno", "snippet"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
