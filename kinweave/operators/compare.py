"""Scores of runs in long form (dataset, arm, variant, seed, metric, value), compared.

A failed run has the value -1 and counts nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.presence import f1_of
from kinweave.operators.ranking import average_rank, kept


def clean(scores: DataFrame) -> DataFrame:
    return scores.where("value is not null and value >= 0 and not isnan(value)")


def metrics(predictions: DataFrame, keys: list[str], classes: int | None = None) -> DataFrame:
    """Accuracy, macro, weighted and minority F1 and minority recall of each group of (label, prediction).

    From confusion counts; a class without hits has F1 0; the macro mean is over ``classes`` if
    given, else over the classes seen.
    """
    c = predictions.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("c"))
    true = c.groupBy(*keys, F.col("label").alias("y")).agg(F.sum("c").alias("n_true"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("c")).otherwise(0)).alias("tp"))
    said = c.groupBy(*keys, F.col("prediction").alias("y")).agg(F.sum("c").alias("n_said"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    t = true.join(said, [*keys, "y"], "full").select(*keys, "y", zero("n_true").alias("n_true"), zero("tp").alias("tp"), zero("n_said").alias("n_said"))
    t = t.withColumn("f1", f1_of(F.col("tp"), F.col("n_said") - F.col("tp"), F.col("n_true") - F.col("tp")))
    there = F.col("n_true") > 0
    small = lambda x: F.min_by(x, F.when(there, F.struct("n_true", "y")))
    r = lambda x: F.round(x, 6)
    return t.groupBy(*keys).agg(
        F.sum("n_true").alias("n"), r(F.sum("tp") / F.sum("n_true")).alias("accuracy"), r(F.sum("f1") / (F.lit(classes) if classes else F.count(F.lit(1)))).alias("macro_f1"),
        r(F.sum(F.col("f1") * F.col("n_true")) / F.sum("n_true")).alias("weighted_f1"), r(small("f1")).alias("minority_f1"), r(small(F.try_divide(F.col("tp"), F.col("n_true")))).alias("minority_recall"),
    )


def seed_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, both deviations, number and sorted values over the seeds."""
    return clean(scores).groupBy(*keys).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.round(F.stddev_samp("value"), 6).alias("std_sample"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.round("value", 4))), lambda x: F.format_number(x, 4)), ",").alias("values_sorted"))


def paired(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Differences of two arms by dataset and seed; datasets with unequal numbers of seeds drop out."""
    side = lambda arm, name: clean(scores).where(F.col("arm") == arm).select("dataset", "seed", F.col("value").alias(name))
    x, y = side(a, "x"), side(b, "y")
    n = x.groupBy("dataset").agg(F.count(F.lit(1)).alias("nx")).join(y.groupBy("dataset").agg(F.count(F.lit(1)).alias("ny")), "dataset").where("nx = ny")
    return x.join(y, ["dataset", "seed"]).join(n.select("dataset"), "dataset").withColumn("d", F.col("x") - F.col("y"))


def sign_summary(pairs: DataFrame) -> DataFrame:
    share = lambda when: F.avg(when.cast("double"))
    return pairs.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("d"), 6).alias("mean_diff"), F.round(F.greatest(share(F.col("d") > 0), share(F.col("d") < 0)), 6).alias("sign_consistency"))


def bootstrap(pairs: DataFrame, resamples: int, seed: int, independent: bool = False) -> DataFrame:
    """95 % interval of the mean difference by dataset; both arms share the drawn seeds, or not.

    Draws come from a hash of dataset, resample and place, so any partitioning gives the same.
    """
    lists = pairs.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("seed", "x", "y"))).alias("v"))
    t = lists.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))

    def draw(stream: str, i: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}:{stream}"), F.col("dataset"), F.col("r").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
        return F.get("v", F.pmod(h, F.size("v")).cast("int"))

    places = F.sequence(F.lit(0), F.size("v") - 1)
    other = "b" if independent else "a"
    mean = F.aggregate(F.transform(places, lambda i: draw("a", i)["x"] - draw(other, i)["y"]), F.lit(0.0), lambda a, x: a + x) / F.size("v")
    t = t.select("dataset", mean.alias("m"))
    p = lambda q: F.round(F.percentile("m", F.lit(q)), 6)
    return t.groupBy("dataset").agg(p(0.025).alias("low"), p(0.975).alias("high")).withColumn("includes_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


def permutation_observation(scores: DataFrame, arm: str, training_seeds: int = 5) -> DataFrame:
    """One observation for each permutation: the mean over its training seeds, if all of them ran."""
    t = clean(scores).where(F.col("arm") == arm).groupBy("dataset", "variant").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("k"))
    return t.where(F.col("k") == training_seeds).select("dataset", "variant", F.round("value", 6).alias("value"))


#: Scores are summed as whole numbers of a millionth, so that sums do not depend on their order.
UNIT = 1_000_000
TERMS = {"architecture": ("loop", "plain"), "availability": ("permuted", "loop"), "value_semantics": ("full", "permuted")}


def _whole(c: str = "value") -> Column:
    return F.bround(F.col(c) * UNIT, 0).cast("long")


def decomposition(scores: DataFrame, plain: str, loop: str, permuted: str, full: str) -> DataFrame:
    """The margin of ``full`` over ``plain`` in three terms and their shares; no shares of a margin of 0.

    Differences of means are formed over common denominators and divided once.
    """
    arms = {"plain": plain, "loop": loop, "permuted": permuted, "full": full}
    of = lambda arm, x: F.when(F.col("arm") == arm, x)
    sums = {f"s_{a}": F.sum(of(arm, _whole())) for a, arm in arms.items()} | {f"k_{a}": F.count(of(arm, F.lit(1))) for a, arm in arms.items()}
    t = clean(scores).groupBy("dataset").agg(*[c.alias(n) for n, c in sums.items()])
    over = lambda a, b: F.col(f"s_{a}") * F.col(f"k_{b}") - F.col(f"s_{b}") * F.col(f"k_{a}")
    under = lambda a, b: F.col(f"k_{a}") * F.col(f"k_{b}")
    mean = lambda a, b: F.round(F.try_divide(over(a, b), under(a, b) * UNIT), 6)
    share = lambda a, b: F.round(F.try_divide(over(a, b) * under("full", "plain"), under(a, b) * over("full", "plain")), 6)
    out = {"margin": mean("full", "plain")} | {n: mean(*x) for n, x in TERMS.items()} | {f"{n}_share": share(*x) for n, x in TERMS.items()}
    return t.select("dataset", *[c.alias(n) for n, c in out.items()])


def decomposition_interval(scores: DataFrame, plain: str, loop: str, permuted: str, full: str, resamples: int, seed: int, least: int = 100) -> DataFrame:
    """95 % intervals of the three terms and of their shares of the margin: seeds of the arms are
    drawn together, the permuted arm apart. Shares need enough draws with a margin that is not 0;
    ``low`` and ``high`` are the value-semantics share. Arms without a run give nulls."""
    t = clean(scores).where(F.col("arm").isin(plain, loop, permuted, full)).withColumn("whole", _whole())
    arms = {"plain": plain, "loop": loop, "permuted": permuted, "full": full}
    each = lambda arm: F.array_sort(F.collect_list(F.when(F.col("arm") == arm, F.struct("seed", "variant", "whole"))))
    lists = t.groupBy("dataset").agg(*[each(arm).alias(f"v_{a}") for a, arm in arms.items()])
    t = lists.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))

    def total(column: str, stream: str) -> Column:
        def pick(i: Column) -> Column:
            text = F.concat_ws("|", F.lit(f"{seed}:{stream}"), F.col("dataset"), F.col("r").cast("string"), i.cast("string"))
            h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
            return F.get(column, F.pmod(h, F.size(column)).cast("int"))["whole"]

        places = F.when(F.size(column) > 0, F.sequence(F.lit(0), F.size(column) - 1))
        return F.aggregate(F.transform(places, pick), F.lit(0).cast("long"), lambda a, x: a + x)

    t = t.select("dataset", *[total(f"v_{a}", "permuted" if a == "permuted" else "arms").alias(f"s_{a}") for a in arms], *[F.size(f"v_{a}").cast("long").alias(f"k_{a}") for a in arms])
    over = lambda a, b: F.col(f"s_{a}") * F.col(f"k_{b}") - F.col(f"s_{b}") * F.col(f"k_{a}")
    under = lambda a, b: F.col(f"k_{a}") * F.col(f"k_{b}")
    usable = over("full", "plain") != 0
    t = t.select("dataset", usable.alias("is_usable"), *[F.try_divide(over(*x), under(*x) * UNIT).alias(n) for n, x in TERMS.items()], *[F.when(usable, F.try_divide(over(*x) * under("full", "plain"), under(*x) * over("full", "plain"))).alias(f"{n}_share") for n, x in TERMS.items()])
    ends = {f"{c}_{end}": F.percentile(c, F.lit(q)) for k in TERMS for c in (k, f"{k}_share") for end, q in (("low", 0.025), ("high", 0.975))}
    t = t.groupBy("dataset").agg(F.count(F.when(F.col("is_usable"), 1)).alias("usable"), *[c.alias(k) for k, c in ends.items()])
    out = {k: F.round(F.when(F.col("usable") >= least, F.col(k)) if "_share_" in k else F.col(k), 6) for k in ends}
    out = {k.replace("value_semantics_share_", ""): c for k, c in out.items()}
    return t.select("dataset", "usable", *[c.alias(k) for k, c in out.items()])


def noise_threshold(scores: DataFrame, arm: str, permuted: str) -> DataFrame:
    """Deviation of the permutation means plus that of the arm."""
    means = clean(scores).where(F.col("arm") == permuted).groupBy("dataset", "variant").agg(F.avg("value").alias("m"))
    a = means.groupBy("dataset").agg(F.stddev_pop("m").alias("sp"))
    b = clean(scores).where(F.col("arm") == arm).groupBy("dataset").agg(F.stddev_pop("value").alias("sa"))
    return a.join(b, "dataset").select("dataset", F.round(F.col("sp") + F.col("sa"), 6).alias("threshold"))


def share_range(scores: DataFrame, plain: str, permuted: str, full: str) -> DataFrame:
    """Range of the value-semantics share over variants; variants without a positive margin are skipped."""
    t = clean(scores).groupBy("dataset", "variant").pivot("arm", [plain, permuted, full]).agg(F.avg("value"))
    t = t.withColumn("margin", F.col(full) - F.col(plain)).where("margin > 0").withColumn("s", (F.col(full) - F.col(permuted)) / F.col("margin"))
    r = lambda c: F.round(c, 6)
    return t.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_variants"), r(F.min("s")).alias("min_share"), r(F.max("s")).alias("max_share"), r(F.avg("s")).alias("mean_share"), r(F.stddev_pop("s")).alias("std_share"))


def tau(ranks: DataFrame) -> DataFrame:
    """Kendall's tau-a between all pairs of variants of (dataset, variant, item, score); ties count 0.

    Items are few (relations), so pairs of items are joined; rows that are no pairs never meet.
    """
    a = ranks.select("dataset", "variant", F.col("item").alias("i"), F.col("score").alias("si"))
    b = ranks.select("dataset", "variant", F.col("item").alias("j"), F.col("score").alias("sj"))
    sign = a.join(b, ["dataset", "variant"]).where("i < j").select("dataset", "variant", "i", "j", F.signum(F.col("si") - F.col("sj")).alias("s"))
    x, y = sign.withColumnsRenamed({"variant": "a", "s": "sa"}), sign.withColumnsRenamed({"variant": "b", "s": "sb"})
    return x.join(y, ["dataset", "i", "j"]).where("a < b").groupBy("dataset", "a", "b").agg(F.round(F.avg(F.col("sa") * F.col("sb")), 6).alias("tau"))


def ranking_agreement(ranks: DataFrame) -> DataFrame:
    """Mean tau between variants, and how often each item leads, alone or tied."""
    top = ranks.withColumn("best", F.max("score").over(Window.partitionBy("dataset", "variant"))).where("score = best")
    lead = top.groupBy("dataset", "variant").agg(F.count(F.lit(1)).alias("k"))
    s = top.groupBy("dataset").agg(F.countDistinct("item").alias("ever_top")).join(lead.groupBy("dataset").agg(F.sum((F.col("k") == 1).cast("long")).alias("unique_top"), F.sum((F.col("k") > 1).cast("long")).alias("tied")), "dataset")
    return tau(ranks).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("tau"), 6).alias("mean_tau")).join(s, "dataset")


def consensus_tau(ranks: DataFrame, group: str) -> DataFrame:
    """Tau between the mean rankings of groups of variants."""
    r = average_rank(ranks, ["dataset", "variant"], "score").groupBy("dataset", group, "item").agg(F.avg("avg_rank").alias("score"))
    return tau(r.withColumnRenamed(group, "variant"))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _unit(c: Column) -> Column:
    """An array centred and scaled to length 1; one without spread becomes zeros."""
    mean = _sum(c) / F.size(c)
    length = F.sqrt(_sum(F.transform(c, lambda x: (x - mean) * (x - mean))))
    return F.transform(c, lambda x: F.when(length > 0, (x - mean) / length).otherwise(0.0))


def _array_ranks(c: Column) -> Column:
    """Average ranks of an array's values."""
    less = lambda x: F.size(F.filter(c, lambda y: y < x))
    same = lambda x: F.size(F.filter(c, lambda y: y == x))
    return F.transform(c, lambda x: less(x) + (same(x) + 1) / 2.0)


def _dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def _signs(x: Column, y: Column) -> Column:
    """Mean product of the signs of all pairs' differences."""
    n = F.size(x)
    places = F.sequence(F.lit(0), n - 1)
    row = lambda i: _sum(F.transform(places, lambda j: F.when(j > i, F.signum(x[i] - x[j]) * F.signum(y[i] - y[j])).otherwise(0.0)))
    return F.try_divide(_sum(F.transform(places, row)), n * (n - 1) / 2)


#: Statistics of two arrays: what is done to each array once, and the value of each permutation.
STATISTICS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "pearson": (_unit, _dot),
    "spearman": (lambda c: _unit(_array_ranks(c)), _dot),
    "kendall": (lambda c: c, _signs),
}


def unranked(k: Column, n: Column) -> Column:
    """The k-th permutation of 0 .. n - 1 in lexicographic order, from k's digits to the base of factorials; n at most 20."""
    start = F.struct(k.cast("long").alias("k"), F.sequence(F.lit(0), n - 1).alias("rest"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, left: Column) -> Column:
        f = F.factorial(left)
        digit = F.floor(a["k"] / f).cast("int")
        rest = F.filter(a["rest"], lambda x, i: i != digit)
        return F.struct((a["k"] % f).alias("k"), rest.alias("rest"), F.array_append(a["out"], F.get(a["rest"], digit)).alias("out"))

    return F.aggregate(F.reverse(F.sequence(F.lit(0), n - 1)), start, step, lambda a: a["out"])


def permutation_p(pairs: DataFrame, statistic: str = "pearson", seed: int = 0, draws: int = 100_000, exhaustive: int = 40_320) -> DataFrame:
    """By data set: the statistic of (x, y) and the share of permutations of y that reach its size.

    All permutations are numbered and tried while there are at most ``exhaustive``; else ``draws``, each
    the order of a digest of data set, number and place. Input rows are a few aggregates a data set;
    permutations are rows that are dealt over tasks.
    """
    prepare, value = STATISTICS[statistic]
    v = pairs.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("v"))
    t = v.select("dataset", prepare(F.transform("v", lambda p: p["x"])).alias("x"), prepare(F.transform("v", lambda p: p["y"])).alias("y"), F.size("v").alias("n"))
    t = kept(t.withColumn("observed", value(F.col("x"), F.col("y"))))
    every = (F.col("n") <= 20) & (F.factorial(F.least("n", F.lit(20))) <= exhaustive)
    many = F.when(every, F.factorial(F.least("n", F.lit(20)))).otherwise(F.lit(draws))
    t = t.withColumn("exact", every).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).repartition("dataset", "k")
    places = F.sequence(F.lit(0), F.col("n") - 1)
    drawn = F.array_sort(F.transform(places, lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "dataset", F.col("k").cast("string"), i.cast("string"))).alias("h"), i.alias("i"))))
    order = F.when(F.col("exact"), unranked(F.col("k"), F.col("n"))).otherwise(F.transform(drawn, lambda p: p["i"]))
    moved = F.transform("order", lambda i: F.get("y", i))
    hit = F.abs(value(F.col("x"), F.col("moved"))) >= F.abs("observed") - 1e-12
    t = t.withColumn("order", order).withColumn("moved", moved).withColumn("hit", hit.cast("long"))
    s = t.groupBy("dataset").agg(F.max("observed").alias("observed"), F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"), F.max("exact").alias("exact"))
    return s.select("dataset", F.round("observed", 6).alias("r"), F.round(F.col("hits") / F.col("n"), 6).alias("p_value"), F.col("n").alias("n_permutations"), "exact")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    t = average_rank(average_rank(df, keys, x).withColumnRenamed("avg_rank", "_rx"), keys, y)
    return t.groupBy(*keys).agg(F.round(F.corr("_rx", "avg_rank"), 6).alias("rho"))


def select_smallest(configs: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """By dataset: the smallest realised set within the tolerance of the best validation score, and
    ties at the top over distinct realised sets. ``configs``: dataset, used array, val, test."""
    t = configs.withColumn("key", F.array_join(F.array_sort("used"), "+")).withColumn("size", F.size(F.array_distinct("used")))
    t = t.groupBy("dataset", "key", "size").agg(F.max("val").alias("val"), F.max_by("test", "val").alias("test"))
    best = t.groupBy("dataset").agg(F.max("val").alias("best"), F.count(F.lit(1)).alias("n_realised"))
    t = t.join(best, "dataset")
    ties = t.groupBy("dataset").agg(F.sum((F.col("val") == F.col("best")).cast("long")).alias("ties_at_top"))
    near = t.where(F.col("val") >= F.col("best") - tolerance)
    chosen = near.groupBy("dataset").agg(F.min_by(F.struct("key", "size", "val", "test", "best", "n_realised"), F.struct("size", -F.col("val"), "key")).alias("c"))
    return chosen.join(ties, "dataset").select("dataset", F.col("c.key").alias("selected"), F.col("c.size").alias("size"), F.col("c.val").alias("val"), F.col("c.test").alias("test"), F.col("c.best").alias("best_val"), F.col("c.n_realised").alias("n_realised"), "ties_at_top")


def top_by_size(configs: DataFrame) -> DataFrame:
    """For each size, whether the best set by validation is the best by test."""
    t = configs.withColumn("key", F.array_join(F.array_sort("used"), "+")).withColumn("size", F.size(F.array_distinct("used")))
    s = t.groupBy("dataset", "size").agg(F.max_by("key", F.struct("val", "key")).alias("by_val"), F.max_by("key", F.struct("test", "key")).alias("by_test"))
    return s.withColumn("agree", F.col("by_val") == F.col("by_test"))


def realised_sets(configs: DataFrame) -> DataFrame:
    """(dataset, key): the distinct graphs that the configurations of each data set come to; different
    requests with the same relations in use are one."""
    return configs.select("dataset", F.array_join("used", "+").alias("key")).distinct()


def saturation(configs: DataFrame) -> DataFrame:
    """Best score by number of distinct relations."""
    return configs.groupBy("dataset", F.size(F.array_distinct("used")).alias("size")).agg(F.max("test").alias("best"))


def check_claims(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Stated against recomputed values: PASS, FAIL, or SKIP if nothing was recomputed."""
    t = claims.join(found, "claim", "left")
    status = F.when(F.col("value").isNull(), "SKIP").when(F.abs(F.col("stated") - F.col("value")) <= F.col("tolerance"), "PASS").otherwise("FAIL")
    return t.select("claim", "stated", "value", status.alias("status"))
