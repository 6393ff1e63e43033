"""Joins with tables of one row a key that hold up where a few keys have most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than HOT_ROWS rows that are also more than one in HOT_KEYS of all, so there are
#: at most HOT_KEYS. A sketch of TRACKED counters finds all of them, being off by less than 3.5 / TRACKED.
HOT_ROWS, HOT_KEYS, TRACKED = 100_000, 512, 8192


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(rows: DataFrame, keys: list[str]) -> tuple[list[int], int]:
    """Hashes of the hot keys, at most HOT_KEYS, and the number of rows with a null key; by one pass that
    shuffles nothing but counter sketches."""
    key = F.when(F.expr(" and ".join(f"`{k}` is not null" for k in keys)), key_hash(keys))
    sums = F.expr(f"approx_top_k(_k, {HOT_KEYS}, {TRACKED})").alias("top"), F.count("_k").alias("n"), F.count(F.lit(1)).alias("rows")
    found = rows.select(key.alias("_k")).agg(*sums).first()
    top = [x for x in found["top"] or [] if x["item"] is not None]
    return [x["item"] for x in top if x["count"] > max(HOT_ROWS, found["n"] // HOT_KEYS)], found["rows"] - found["n"]


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key.

    Rows of hot keys stay where they are and meet a broadcast of these keys' entries, at most HOT_KEYS;
    the others are shuffled, each key with a bounded share. Rows with a null key match nothing and, if
    kept, stay where they are as well. ``rows`` is read twice, or more if there are hot keys.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    hot, nulls = hot_keys(rows, keys)
    if not hot and (how == "inner" or nulls <= HOT_ROWS):
        return rows.join(table, keys, how)
    there = " and ".join(f"`{k}` is not null" for k in keys)
    known, is_hot = rows.where(there), key_hash(keys).isin(hot)
    cold = known.where(~is_hot).join(table.where(~is_hot), keys, how)
    out = cold.unionByName(known.where(is_hot).join(F.broadcast(table.where(is_hot)), keys, how))
    if how == "inner":
        return out
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in keys]
    return out.unionByName(rows.where(f"not ({there})").select(*rows.columns, *nothing))
