"""Queries whose rows SQL gives too, and the registry."""

import pytest

from oracle import spark_rows, sql_rows
from quillspark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    assert spark_rows(registry.QUERIES[name](spark, data)) == sql_rows(registry.ORACLES[name], data)


def test_ten_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 11))
