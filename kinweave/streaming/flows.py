"""Streaming forms: attachment to a fixed training graph, windowed measurements, flow sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.values import valid_value
from kinweave.operators.graph import attach


def attach_stream(arriving: DataFrame, positions: DataFrame, relations: list[str], budget: int, seed: int) -> DataFrame:
    """Edges train -> new for a stream of rows: joins with static tables only, so there is no state
    and no watermark; new rows never see each other."""
    return attach(arriving, positions, relations, budget, seed)


def windowed_coverage(stream: DataFrame, time: str, column: str, width: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Rows, valid values and their distinct number (by a sketch, exact up to 4,096) in tumbling windows; rows later than the
    watermark are dropped."""
    v = valid_value(F.col(column))
    t = stream.withWatermark(time, late).groupBy(F.window(time, width))
    return t.agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_valid"), F.theta_sketch_estimate(F.theta_sketch_agg(v)).alias("n_values")).select(F.col("window.start").alias("start"), "n", "n_valid", "n_values")


def session_flows(stream: DataFrame, time: str, key: str, amount: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of a key without a longer pause as one flow."""
    t = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")
