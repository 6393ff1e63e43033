"""The registered training-data queries with a SQL form against DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

from kinweave.llm import oracles, queries
from tests.test_queries import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, duck, name):  # noqa: F811
    got = queries.QUERIES[name](spark, SF)
    expected = duck.execute(oracles.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in expected.description], expected.fetchall())
