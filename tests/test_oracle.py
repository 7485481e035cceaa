"""The registered core queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from millrace import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(found, names):
    order = sorted(names)
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(value(r[names.index(n)]) for n in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    rel = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(rel.fetchall(), rel.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20 and set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
