"""Helpers that several operators use: the shared folder, staging, words, row keys and joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as a character class: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of slim rows are broadcast up to this number of rows; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
ARROW_ROWS = 2_000
#: A key with more rows than this, and more than one in HOT_KEYS of all, is hot. So there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1_000, 100_000
#: Tables of up to this number of keys are broadcast whole by ``spread_join``.
FEW_KEYS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, taken from ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-kinweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage in a way that survives the loss of any executor. Meanwhile Python tasks get
    at most ARROW_ROWS rows a batch, as rows may hold whole texts.
    """
    spark = df.sparkSession
    path, setting = new_dir(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """At the end of a Python task: memory that Arrow and the C library hold for later goes back to
    the system, as the worker lives on and serves other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; other characters stay."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def pick(df: DataFrame, **needed: str) -> DataFrame:
    """The named columns under the operator's own names, so that further columns can't clash."""
    return df.select(*[F.col(f"`{have}`").alias(name) for name, have in needed.items()])


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows; filters on them are not pushed below.

    Catalyst would put the expressions of computed arrays into such a filter, inside lambdas even,
    and compute them again for every element. A projection that is not deterministic stops that.
    """
    return df.select(*[F.when(F.monotonically_increasing_id() >= 0, F.col(f"`{c}`")).alias(c) for c in df.columns])


def text_hash(text: Column) -> Column:
    """With the id, the key of a row: rows that repeat an id are told apart by their texts."""
    return F.xxhash64(text)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` (with doc_id and text) without the rows whose (doc_id, text_hash) is in ``dropped``.

    A null id equals a null id. Texts are not shuffled while the list is short.
    """
    drop = staged(dropped.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).distinct(), "dropped")
    drop = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    same = docs["doc_id"].eqNullSafe(drop["id"]) & (text_hash(docs["text"]) == drop["h"])
    return docs.join(drop, same, "left_anti")


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, how: str = "inner", total: int | None = None, few: int | None = None) -> DataFrame:
    """Joins rows with a table that has one row a key; ``n`` is its column with the number of rows.

    A table of at most ``few`` (FEW_KEYS) keys is broadcast. Of a larger one hot keys, at most
    HOT_KEYS, are broadcast, so that their rows stay where they are; the others are shuffled, each of a
    bounded number of rows. Rows with a null key match nothing and are not shuffled. ``n`` is dropped.
    Both inputs are read more than once and should be staged.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if table.count() <= (FEW_KEYS if few is None else few):
        return rows.join(F.broadcast(table.drop(n)), key, how)
    if total is None:
        total = int(table.agg(F.sum(n)).first()[0] or 0)
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot, rest = F.broadcast(table.where(F.col(n) > bound).drop(n)), table.where(F.col(n) <= bound).drop(n)
    there = rows.where(F.col(key).isNotNull())
    cold = there.join(hot.select(key), key, "left_anti").join(rest, key, how)
    out = cold.unionByName(there.join(hot, key).select(*cold.columns))
    if how == "inner":
        return out
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rest.schema if f.name != key]
    return out.unionByName(rows.where(F.col(key).isNull()).select(*rows.columns, *nothing))
