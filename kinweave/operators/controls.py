"""Transforms that take one property out of a graph or a field and leave the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.values import is_valid, seeded_hash
from kinweave.operators.ranking import position_by_hash, position_by_order


def mask_cross_partition(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Only edges within a split; edges that carry their ends are not joined with rows."""
    if {"src_split", "dst_split"} <= set(edges.columns):
        return edges.where("src_split = dst_split").select("relation", "src", "dst")
    ends = df.select("id", "split")
    t = edges.join(ends.select(F.col("id").alias("src"), F.col("split").alias("a")), "src")
    return t.join(ends.select(F.col("id").alias("dst"), F.col("split").alias("b")), "dst").where("a = b").select("relation", "src", "dst")


def revert_tokens(df: DataFrame, column: str, tokens: tuple[str, ...]) -> DataFrame:
    """Fillers become missing values; an error if none occurs."""
    hit = F.coalesce(F.trim(F.col(column).cast("string")).isin(*tokens), F.lit(False))
    if not df.where(hit).take(1):
        raise ValueError(f"{column} has none of {tokens}")
    return df.withColumn(column, F.when(~hit, F.col(column)))


def permute_values(df: DataFrame, columns: list[str], seed: int, joint: bool = False) -> DataFrame:
    """Shuffles values among the rows that hold one; who holds one stays as it is.

    Each column has its own shuffle, or all have one, among rows that hold all of them. Rows are
    matched by position in id order and in hash order.
    """
    out = df
    for group in [columns] if joint else [[c] for c in columns]:
        holds = F.lit(True)
        for c in group:
            holds = holds & is_valid(F.col(c))
        rows = df.where(holds)
        to = position_by_order(rows.select("id"), [], ["id"]).select("id", "pos")
        order = seeded_hash(f"{seed}:{'+'.join(group)}", F.col("id"))
        source = position_by_hash(rows.select(F.lit(0).alias("all"), "id", *group), ["all"], order, "id").select("pos", *[F.col(c).alias(f"_{c}") for c in group])
        moved = to.join(source, "pos").drop("pos")
        out = out.join(moved, "id", "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in group}).drop(*[f"_{c}" for c in group])
    return out
