"""Rows of a query and of its SQL, in a form that can be compared."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=found.columns.__getitem__)
    return sorted(found.columns), sorted(repr(tuple(r[k] for k in order)) for r in found.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(repr(tuple(r[n] for n in names)) for r in df.select(*names).collect())
