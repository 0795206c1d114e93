"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import pytest
from conftest import DATA

from tamis import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


def plain(x) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float):
        return repr(x + 0.0 if x else 0.0)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark.catalog.clearCache()
    result = oracle.execute(ORACLES[name])
    theirs = rows_of([c[0] for c in result.description], result.fetchall())
    assert ours == theirs


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100
