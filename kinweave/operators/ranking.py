"""Positions and running sums within groups that do not need a group to fit into one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.operators.lookup import lookup_join

#: Groups over this many rows are ranked in pieces.
PIECE_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    Only on one machine (a local master) a temporary folder takes its place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="spark-kinweave-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` on reliable storage: the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def large_groups(df: DataFrame, keys: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(keys, _big): the groups over ``piece_rows`` rows and their sizes, at most one for each ``piece_rows`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_big")).where(F.col("_big") > piece_rows)


def position_by_hash(df: DataFrame, keys: list[str], digest: Column, tie: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds ``n`` (group size) and ``pos`` (from 0, by digest, then tie).

    Without large groups, one shuffle and sort by group do. The digest's first 32 bits are uniform, so a large group is cut into even pieces along its
    order. Rows are dealt by group and piece; a piece's offset is the number of rows before it. Only
    groups over ``piece_rows`` and their pieces are broadcast, at most one for each ``piece_rows`` rows.
    """
    mine = [f"_k{i}" for i in range(len(keys))]
    same = lambda t: [t[a].eqNullSafe(F.col(b)) for a, b in zip(keys, mine, strict=True)]
    named = [F.col(k).alias(m) for k, m in zip(keys, mine, strict=True)]
    if not large_groups(df, keys, piece_rows).take(1):
        group = Window.partitionBy(*keys).orderBy("_h", tie)
        t = df.repartition(*keys).withColumn("_h", digest) if keys else df.withColumn("_h", digest)
        whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return t.withColumns({"n": F.count(F.lit(1)).over(whole), "pos": (F.row_number().over(group) - 1).cast("long")}).drop("_h")
    big = large_groups(df, keys, piece_rows).select(*named, "_big")
    t = df.withColumn("_h", digest)
    t = t.join(F.broadcast(big), same(t), "left").drop(*mine)
    share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    pieces = F.coalesce(F.ceil(F.col("_big") / piece_rows), F.lit(1))
    t = t.withColumn("_piece", F.floor(share * pieces).cast("int")).repartition(*keys, "_piece")
    counts = t.where(F.col("_big").isNotNull()).groupBy(*named, F.col("_piece").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*mine).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    group = Window.partitionBy(*keys, "_piece")
    t = t.withColumns({"_rank": F.row_number().over(group.orderBy("_h", tie)) - 1, "_rows": F.count(F.lit(1)).over(group)})
    t = t.join(F.broadcast(offsets), [*same(t), t["_piece"] == F.col("_p")], "left")
    t = t.withColumns({"n": F.coalesce("_big", "_rows"), "pos": F.col("_rank") + F.coalesce("_before", F.lit(0))})
    return t.drop(*mine, "_h", "_big", "_piece", "_p", "_rank", "_rows", "_before")


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds ``n`` (sum of the group) and ``pos`` (sum of the rows before, in the order of columns, the
    last of which should break ties); each row counts ``weight``, or 1.

    Groups of at most ``piece_rows`` rows are summed by a window. Larger tables are range-partitioned
    by keys and order, summed within each range, and shifted by the sums of earlier ranges.
    """
    one = F.col(weight) if weight else F.lit(1).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long" if weight is None else "double" if dict(df.dtypes)[weight] == "double" else "long")
    if keys:
        most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
        if most <= piece_rows:
            group = Window.partitionBy(*keys)
            before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            return df.withColumns({"n": F.sum(one).over(group), "pos": zero(F.sum(one).over(before))})
    p, group = f"_p{uuid.uuid4().hex[:6]}", keys or [F.lit(0)]
    t = kept(df.repartitionByRange(*keys, *order).withColumn(p, F.spark_partition_id()))
    sums = t.groupBy(*keys, p).agg(F.sum(one).alias("_s"))  # one row for each key and range
    before = Window.partitionBy(*group).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": zero(F.sum("_s").over(before)), "n": F.sum("_s").over(Window.partitionBy(*group))}).drop("_s")
    within = Window.partitionBy(*keys, p).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    mine = [f"_k{i}" for i in range(len(keys))]
    sums = sums.withColumnsRenamed({**dict(zip(keys, mine, strict=True)), p: "_range"})
    t = t.withColumn("_within", zero(F.sum(one).over(within)))
    same = [t[p] == sums["_range"], *[t[a].eqNullSafe(sums[b]) for a, b in zip(keys, mine, strict=True)]]
    t = t.join(sums if keys else F.broadcast(sums), same).withColumn("pos", F.col("_within") + F.col("_before"))
    return t.drop(p, "_within", "_before", "_range", *mine)


def position_by_order(df: DataFrame, keys: list[str], order: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds ``n`` and ``pos`` (from 0) in the order of columns; the last one should break ties."""
    return running_total(df, keys, order, None, piece_rows)


def average_rank(df: DataFrame, keys: list[str], value: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds ``avg_rank``: ties share the mean of their ranks; from counts by distinct value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running_total(counts, keys, [value], "_c", piece_rows)
    ranks = ranks.withColumn("avg_rank", F.col("pos") + (F.col("_c") + 1) / 2.0).select(*keys, value, "avg_rank")
    return lookup_join(df, ranks, [*keys, value])  # a frequent value's rows stay where they are
