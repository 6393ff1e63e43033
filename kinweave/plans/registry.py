"""The registered queries of the audit operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.plans import extraction_queries, field_queries, graph_queries, run_queries, source_queries

_ALL = {**graph_queries.REGISTERED, **field_queries.REGISTERED, **run_queries.REGISTERED, **source_queries.REGISTERED, **extraction_queries.REGISTERED}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a18_homophily"](spark, sf_dir)
