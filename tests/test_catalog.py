"""Every catalog query with SQL gives the rows DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from seqtables import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def test_every_oracle_has_a_query():
    assert catalog.oracle_sql().keys() <= catalog.queries().keys()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, sf, name):
    frame = catalog.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    relation = duck.sql(catalog.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS[t] for c, t in frame.dtypes} == kinds
    order = [relation.columns.index(c) for c in columns]
    expected = sorted(repr([plain(r[i]) for i in order]) for r in relation.fetchall())
    found = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    assert found == expected


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows[0]["n"] >= rows[-1]["n"] >= 5
