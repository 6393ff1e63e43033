"""Every registered audit query with a SQL form against DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from kinweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "None"
    if isinstance(value, (bool, int)):
        return repr(int(value))
    return repr(float(value)) if isinstance(value, float) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    expected = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, expected.fetchall())


@pytest.mark.parametrize("name", ["m15_group_split", "a17_permutation_null", "m13_permutation_p"])
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
