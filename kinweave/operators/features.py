"""Feature columns from rows, from metadata counts and from neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.values import log_count, tuple_text, valid_value
from kinweave.operators.lookup import lookup_join
from kinweave.operators.ranking import kept, position_by_order
from kinweave.operators.splits import folds


def rates(duration: Column, bytes_: Column, packets: Column) -> dict[str, Column]:
    """Bytes and packets a second and mean packet size; a duration or packet count of 0 counts as 1."""
    d = F.coalesce(F.nullif(duration.cast("double"), F.lit(0.0)), F.lit(1.0))
    p = F.coalesce(F.nullif(packets.cast("double"), F.lit(0.0)), F.lit(1.0))
    return {"bytes_rate": bytes_ / d, "packets_rate": packets / d, "mean_packet": bytes_ / p}


def packet_rates(first: Column, last: Column, bytes_: Column, packets: Column) -> dict[str, Column]:
    """The same from packet times: a duration of a millisecond and one packet at least."""
    d, p = F.greatest(last - first, F.lit(1e-3)), F.greatest(packets, F.lit(1))
    return {"duration": d, "bytes_rate": bytes_ / d, "packets_rate": packets / d, "mean_packet": bytes_ / p}


def one_hot(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """0/1 columns for the values of a column with at most ``most`` of them."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has over {most} values")
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(values, key=str)})


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinities become 0."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c).cast("double")) for c in columns})


def numeric_columns(df: DataFrame, meta: tuple[str, ...]) -> list[str]:
    """The columns that are features: numeric and not metadata."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, k in df.dtypes if c not in meta and (k in kinds or k.startswith("decimal"))]


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit deviation by the statistics of train; a deviation of 0 counts as 1."""
    stats = df.where("split = 'train'").agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(z).select(*df.columns)


def _value_counts(values: DataFrame) -> DataFrame:
    """(relation, value, size, all_train, by_fold): one entry a value; of training rows, those that have a fold, also by fold."""
    c = values.where("value is not null").groupBy("relation", "value", "fold").agg(F.count(F.lit(1)).alias("c"))
    own = F.collect_list(F.when(F.col("fold").isNotNull(), F.struct("fold", "c")))
    return c.groupBy("relation", "value").agg(F.sum("c").alias("size"), F.sum(F.when(F.col("fold").isNotNull(), F.col("c"))).alias("all_train"), F.map_from_entries(own).alias("by_fold"))


def _out_of_fold() -> Column:
    """The training rows of a value but those of the row's own fold."""
    own = F.when(F.col("fold").isNotNull(), F.try_element_at("by_fold", "fold"))
    return F.coalesce("all_train", F.lit(0)) - F.coalesce(own, F.lit(0))


def _of_relations(df: DataFrame, relations: list[str]) -> DataFrame:
    """(relation, value, id, fold) of every row and relation, also without a value."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), valid_value(F.col(r)).alias("value")) for r in relations]))
    return df.select("id", "fold", each.alias("r")).select("r.relation", "r.value", "id", "fold")


def metadata_counts(df: DataFrame, relations: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """(id, relation, present, train_freq, seen, group_size): log counts of a row's value.

    Training rows are counted out of fold: all training rows but those of their own fold.
    """
    values = _of_relations(kept(folds(df, k, seed).select("id", "fold", *relations)), relations)
    v = lookup_join(values, _value_counts(values), ["relation", "value"], "left")
    freq = _out_of_fold()
    return v.select(
        "id", "relation", F.col("value").isNotNull().cast("int").alias("present"), F.round(log_count(freq), 6).alias("train_freq"),
        F.coalesce((freq > 0).cast("int"), F.lit(0)).alias("seen"), F.round(log_count(F.col("size")), 6).alias("group_size"),
    )


def metadata_columns(df: DataFrame, relations: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with train_freq and group_size of ``metadata_counts`` as <relation>_freq and <relation>_size, on
    reliable storage. Rows stay whole: each relation's counts are looked up by its value, and nothing is
    joined by id."""
    out = kept(folds(df, k, seed))
    counts = kept(_value_counts(_of_relations(out, relations)))
    for r in relations:
        entries = counts.where(F.col("relation") == r).select(F.col("value").alias("_v"), "size", "all_train", "by_fold")
        out = lookup_join(out.withColumn("_v", valid_value(F.col(r))), entries, ["_v"], "left")
        out = out.withColumns({f"{r}_freq": F.round(log_count(_out_of_fold()), 6), f"{r}_size": F.round(log_count(F.col("size")), 6)})
        out = kept(out.drop("_v", "size", "all_train", "by_fold"))
    return out.drop("fold")


def class_weights(df: DataFrame) -> DataFrame:
    """n / (classes * rows of the class) on train."""
    return balanced(df.where("split = 'train'").groupBy("label").agg(F.count(F.lit(1)).alias("c")))


def balanced(c: DataFrame) -> DataFrame:
    """(label, weight) from (label, c): n / (classes * rows of the class)."""
    s = c.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    return c.join(F.broadcast(s)).select("label", F.round(F.col("n") / (F.col("k") * F.col("c")), 6).alias("weight"))


def neighbour_mean(df: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """(relation, id, mean of each column over the row's neighbours)."""
    f = df.select(F.col("id").alias("src"), *columns)
    return edges.join(f, "src").groupBy("relation", F.col("dst").alias("id")).agg(*[F.avg(c).alias(f"nbr_{c}") for c in columns])


def convolved(df: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Neighbours and the row itself, weighted by 1 / sqrt(degree product), degrees counting the row itself.

    ``pairs`` has both directions, each once, and is read once: a row's pairs meet the row where they are
    counted, and each then brings its part to its other end. Ids must be unique.
    """
    parts = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]
    own = df.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("_own"), *parts)
    sent = pairs.select("src", "dst", F.lit(False).alias("_own"), *[F.lit(None).cast("double").alias(f"_v{i}") for i in range(len(columns))])
    mine = Window.partitionBy("src")
    e = own.unionByName(sent).withColumns({"_d": F.count(F.lit(1)).over(mine).cast("double"), "_there": F.max("_own").over(mine), **{f"_v{i}": F.max(f"_v{i}").over(mine) for i in range(len(columns))}}).where("_there")
    d = F.max(F.when(F.col("_own"), F.col("_d")))
    e = e.groupBy(F.col("dst").alias("id")).agg(d.alias("_d"), *[F.sum(F.col(f"_v{i}") / F.sqrt("_d")).alias(f"_v{i}") for i in range(len(columns))])
    return e.where("_d is not null").select("id", *[(F.col(f"_v{i}") / F.sqrt("_d")).alias(f"conv_{c}") for i, c in enumerate(columns)])


def endpoint_means(ends: DataFrame, df: DataFrame, column: str, exclude_self: bool = True) -> DataFrame:
    """The mean of the rows at each endpoint, without the row itself; its own value if it is alone."""
    out = t = kept(ends.join(df.select("id", column), "id"))
    for side in ("src_node", "dst_node"):
        s = t.groupBy(side).agg(F.sum(column).alias(f"_s_{side}"), F.count(F.lit(1)).alias(f"_n_{side}"))
        out = lookup_join(out, s, [side])
        total, n = F.col(f"_s_{side}"), F.col(f"_n_{side}")
        mean = F.when(n > 1, (total - F.col(column)) / (n - 1)).otherwise(F.col(column)) if exclude_self else total / n
        out = out.withColumn(f"{side}_mean", mean).drop(f"_s_{side}", f"_n_{side}")
    return out.select("id", "src_node_mean", "dst_node_mean")


def row_identity(df: DataFrame, order: list[str], candidates) -> DataFrame:
    """Adds ``row_hash``: a digest of the tuple columns the table has (at least three).

    Rows that repeat a tuple are numbered in the order of columns, so that each has its own digest.
    """
    t = df.withColumn("_tuple", tuple_text(df.columns, candidates))
    t = position_by_order(t, ["_tuple"], order)
    again = F.when(F.col("pos") > 0, F.concat(F.lit("#"), F.col("pos").cast("string"))).otherwise("")
    return t.withColumn("row_hash", F.md5(F.concat("_tuple", again))).drop("_tuple", "n", "pos")
