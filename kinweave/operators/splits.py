"""Train, validation and test splits of an entity table, all reproducible from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.values import decode_variant, hash_number, seeded_hash, valid_value
from kinweave.operators.ranking import kept, position_by_hash, position_by_order, running_total
from kinweave.spec import SPLITS

TEST, VAL = 0.2, 0.1


def _named(train: Column, val: Column) -> Column:
    """The split of position ``pos``: the first ``train``, the next ``val``, then test."""
    return F.when(F.col("pos") < train, SPLITS[0]).when(F.col("pos") < train + val, SPLITS[1]).otherwise(SPLITS[2])


def by_time_in_class(df: DataFrame, test: float = TEST, val: float = VAL) -> DataFrame:
    """Each class in time order: the last part tests. Sizes round half to even, one at least; a class of under three rows trains."""
    t = position_by_order(df, ["label"], ["ts", "id"])
    n_test = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(test), 0).cast("long"))
    n_val = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(val), 0).cast("long"))
    split = F.when(F.col("n") < 3, SPLITS[0]).otherwise(_named(F.col("n") - n_test - n_val, n_val))
    return t.withColumn("split", split).drop("n", "pos")


def by_time(df: DataFrame, test: float = TEST, val: float = VAL) -> DataFrame:
    """The whole table in time order; sizes are cut off to whole rows."""
    t = position_by_order(df, [], ["ts", "id"])
    n_test, n_val = F.floor(F.col("n") * F.lit(test)), F.floor(F.col("n") * F.lit(val))
    return t.withColumn("split", _named(F.col("n") - n_test - n_val, n_val)).drop("n", "pos")


def at_random(df: DataFrame, seed: int, test: float = TEST, val: float = VAL) -> DataFrame:
    """Stratified: each class is shuffled by a hash of its ids and cut with exact quotas."""
    t = position_by_hash(df, ["label"], seeded_hash(seed, F.col("id")), "id")
    n_test, n_val = F.bround(F.col("n") * F.lit(test), 0).cast("long"), F.bround(F.col("n") * F.lit(val), 0).cast("long")
    return t.withColumn("split", _named(F.col("n") - n_test - n_val, n_val)).drop("n", "pos")


def first_fit(groups: DataFrame, goal: int) -> tuple[DataFrame, int]:
    """(_g) of the groups (_g, size, at) that fit into ``goal`` one after another in the order of ``at``,
    and their rows; the first group is taken whatever its size.

    Equal to walking through the groups, in few rounds: each takes a whole run of groups, up to the
    first that does not fit; after it, only groups that fit into what is left can follow.
    """
    first = groups.orderBy("at").limit(1).first()
    if first is None:
        return groups.select("_g").limit(0), 0
    taken, filled, at = groups.where(F.col("at") == first["at"]).select("_g"), first["size"], first["at"]
    while filled < goal:
        could = groups.where((F.col("at") > at) & (F.col("size") <= goal - filled))
        run = kept(running_total(could, [], ["at"], "size"))
        ends = F.col("pos") + F.col("size")
        over = run.where(ends > goal - filled).agg(F.min("at")).first()[0]
        fits = run if over is None else run.where(F.col("at") < over)
        s = fits.agg(F.sum("size").alias("size"), F.max("at").alias("at")).first()
        if s["size"] is None:
            break
        taken, filled, at = taken.unionByName(fits.select("_g")), filled + s["size"], s["at"]
        if over is None:
            break
    return kept(taken), filled


def by_group(df: DataFrame, column: str, seed: int, test: float = TEST, val: float = VAL) -> DataFrame:
    """No value of a column in two splits: groups in hash order go first-fit to test, then val.

    Missing values are one group. With fewer than two valid groups it is a random split.
    """
    t = df.drop("split").withColumn("_g", F.coalesce(valid_value(F.col(column)), F.lit("")))
    groups = t.groupBy("_g").agg(F.count(F.lit(1)).alias("size")).withColumn("order", seeded_hash(seed, F.col("_g")))
    groups = kept(position_by_order(groups, [], ["order", "_g"]).select("_g", "size", F.col("pos").alias("at")))
    if groups.where("_g <> ''").limit(2).count() < 2:
        return at_random(df, seed, test, val)
    n = groups.agg(F.sum("size")).first()[0]
    tested, _ = first_fit(groups, int(n * test))
    validated, _ = first_fit(groups.join(tested, "_g", "left_anti"), int(n * val))
    named = tested.withColumn("split", F.lit("test")).unionByName(validated.withColumn("split", F.lit("val")))
    return t.join(named, "_g", "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("_g")


def variants(df: DataFrame, seeds: list[int]) -> DataFrame:
    """The random split under each seed as one long table (variant, id, label, split)."""
    each = F.explode(F.array(*[F.lit(s) for s in seeds]))
    t = df.select("id", "label").withColumn("split_seed", each)
    t = position_by_hash(t, ["split_seed", "label"], F.md5(F.concat_ws("|", F.col("split_seed").cast("string"), F.col("id").cast("string"))), "id")
    n_test, n_val = F.bround(F.col("n") * F.lit(TEST), 0).cast("long"), F.bround(F.col("n") * F.lit(VAL), 0).cast("long")
    t = t.withColumn("split", _named(F.col("n") - n_test - n_val, n_val)).drop("n", "pos")
    return t.withColumn("variant", F.concat(F.lit("random_s"), F.col("split_seed").cast("string")))


def cutoffs(df: DataFrame, sizes: list[float]) -> DataFrame:
    """The in-class time split under each test size as one long table."""
    t = position_by_order(df.select("id", "label", "ts"), ["label"], ["ts", "id"])
    t = t.withColumn("test_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    n_test = F.greatest(F.lit(1), F.bround(F.col("n") * F.col("test_size"), 0).cast("long"))
    n_val = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(VAL), 0).cast("long"))
    split = F.when(F.col("n") < 3, SPLITS[0]).otherwise(_named(F.col("n") - n_test - n_val, n_val))
    tag = F.concat(F.lit("cutoff_t"), F.lpad(F.bround(F.col("test_size") * 1000, 0).cast("int").cast("string"), 4, "0"))
    return t.withColumn("split", split).withColumn("variant", tag).drop("n", "pos")


def protocol(variants_table: DataFrame, edge_seed: int | None = None) -> DataFrame:
    """What each variant ran with: the split seed varies, the edge seed is pinned or was coupled to it (legacy)."""
    t = variants_table.select("variant", "split_seed").distinct()
    pinned = F.lit(edge_seed).cast("int")
    return t.select("variant", "split_seed", F.coalesce(pinned, F.col("split_seed")).alias("edge_seed"), pinned.isNotNull().alias("edge_seed_recorded"), pinned.isNull().alias("legacy_coupled_seed"))


def restore_protocol(variants_table: DataFrame, exact: DataFrame, edge_records: DataFrame, base_seed: int = 42, base_test: float = TEST) -> DataFrame:
    """What variants of an old run (variant) ran with, and where that is known from.

    Precedence: a record written by the run itself (``exact``: variant, mode, split_seed, test_size,
    edge_seed); then the variant's name with the record of an edge rebuild (``edge_records``: variant,
    edge_seed); then the name alone. A random split whose seed is not the base seed and that has no such
    record may have coupled both seeds: it is marked, not guessed.
    """
    tag = decode_variant(F.col("variant"))
    t = variants_table.select("variant").distinct()
    e = exact.select("variant", F.struct("mode", "split_seed", "test_size", "edge_seed").alias("_e"))
    r = edge_records.select("variant", F.col("edge_seed").alias("_r"))
    t = t.join(F.broadcast(e), "variant", "left").join(F.broadcast(r), "variant", "left").withColumns({f"_{k}": c for k, c in tag.items()})
    split_seed = F.coalesce(F.when(F.col("_mode") == "random", F.col("_split_seed")), F.lit(base_seed).cast("long"))
    coupled = (F.col("_mode") == "random") & (split_seed != base_seed)
    named = F.when(F.col("_mode") == "edgeseed", F.coalesce("_edge_seed", "_split_seed")).when(coupled, F.coalesce("_r", split_seed)).otherwise(F.lit(base_seed).cast("long"))
    source = F.when(F.col("_e").isNotNull(), "run record").when(coupled & F.col("_r").isNotNull(), "edge record").when(coupled, "none").otherwise("name")
    mode = F.when(F.col("_mode") == "random", "random").otherwise("time_in_class")
    size = F.coalesce(F.when(F.col("_mode") == "cutoff", F.col("_test_size")), F.lit(base_test))
    return t.select(
        "variant", F.coalesce("_e.mode", mode).alias("mode"), F.coalesce("_e.split_seed", split_seed).alias("split_seed"),
        F.coalesce("_e.test_size", size).alias("test_size"), F.coalesce("_e.edge_seed", named).alias("edge_seed"), source.alias("edge_seed_source"),
        (F.col("_e").isNull() & coupled & F.col("_r").isNull()).alias("legacy_coupled_seed"),
    )


def class_quota(df: DataFrame, most: int, seed: int, least: int = 50) -> DataFrame:
    """At most about ``most`` rows, by class shares, ``least`` of a class (or all it has)."""
    t = position_by_hash(df, ["label"], seeded_hash(seed, F.col("id")), "id")
    total = df.count()
    quota = F.least(F.col("n"), F.greatest(F.lit(least), F.bround(F.col("n") * F.lit(most / max(total, 1)), 0).cast("long")))
    return t.where(F.col("pos") < (F.col("n") if total <= most else quota)).drop("n", "pos")


def folds(df: DataFrame, k: int, seed: int) -> DataFrame:
    """A random fold for each training row, null elsewhere."""
    return df.withColumn("fold", F.when(F.col("split") == "train", F.pmod(hash_number(seed, F.col("id")), F.lit(k)).cast("int")))
