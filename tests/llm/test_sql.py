"""Corpus queries with SQL give the rows DuckDB gives on the same tables."""

import pytest

from seqtables.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, sf, name):
    frame = catalog.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    relation = duck.sql(catalog.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    expected = sorted(repr([r[i] for i in order]) for r in relation.fetchall())
    found = sorted(repr([r[c] for c in columns]) for r in frame.collect())
    assert found == expected


def test_every_operator_has_one_query():
    names = list(catalog.queries())
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
    assert catalog.oracle_sql().keys() <= set(names)
