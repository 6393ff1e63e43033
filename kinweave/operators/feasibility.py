"""Can whole groups be dealt to train, validation and test without losing a class?

Rows collapse to groups with class counts first. Searches and folds order that table and sum it as
it lies, in ranges dealt over tasks; only the three largest groups reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.values import seeded_hash, valid_value
from kinweave.operators.ranking import kept, position_by_order, running_total

SHARES = (0.7, 0.1, 0.2)


def collapse(df: DataFrame, column: str) -> DataFrame:
    """(value, size, negatives, positives) of each valid group."""
    t = df.withColumn("value", valid_value(F.col(column))).where("value is not null")
    return t.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.sum((F.col("label") == 0).cast("long")).alias("negatives"), F.sum((F.col("label") != 0).cast("long")).alias("positives"))


def axis_report(df: DataFrame, column: str, least_groups: int = 3) -> DataFrame:
    """Missing rows, groups, the largest share, classes without rows or with too few groups."""
    g = collapse(df, column)
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count(valid_value(F.col(column))).alias("n_usable"))
    s = g.agg(F.count(F.lit(1)).alias("n_groups"), F.max("size").alias("largest"), F.sum((F.col("negatives") > 0).cast("long")).alias("groups_0"), F.sum((F.col("positives") > 0).cast("long")).alias("groups_1"))
    t = n.join(s).withColumn("axis", F.lit(column))
    smallest = F.floor(F.col("n_usable") * min(SHARES))
    starved = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"groups_{y}"), F.lit(0)) < least_groups, str(y)) for y in (0, 1)])), ",")
    return t.select("axis", "n", (F.col("n") - F.col("n_usable")).alias("n_missing"), "n_groups", "largest", F.round(F.try_divide(F.col("largest"), F.col("n_usable")), 6).alias("largest_share"), F.coalesce("groups_0", F.lit(0)).alias("groups_0"), F.coalesce("groups_1", F.lit(0)).alias("groups_1"), starved.alias("starved"), F.coalesce(F.col("largest") > smallest, F.lit(False)).alias("dominates"))


def search(df: DataFrame, column: str, restarts: int, seed: int, tolerance: float = 0.1) -> DataFrame:
    """(restart, covered, deviation, feasible) of random assignments of whole groups.

    The three largest groups go first, each to the part that is furthest below its target. The others
    fill what the parts still lack, in the order of a hash of restart and value: a group belongs to
    the part that the middle of its stretch of rows falls into.
    """
    g = kept(collapse(df, column))
    all_ = g.agg(F.sum("size").alias("n"), F.sum("negatives").alias("neg"), F.sum("positives").alias("pos")).first()
    target, filled = [share * max(all_["n"] or 0, 1) for share in SHARES], [[0, 0] for _ in SHARES]
    first = g.orderBy(F.desc("size"), "value").limit(3).collect()
    for r in first:
        lack = [t - sum(f) for t, f in zip(target, filled, strict=True)]
        part = filled[lack.index(max(lack))]
        part[0], part[1] = part[0] + r["negatives"], part[1] + r["positives"]
    lack = [max(t - sum(f), 0.0) for t, f in zip(target, filled, strict=True)]
    rest = (all_["n"] or 0) - sum(r["size"] for r in first)
    scale = rest / (sum(lack) or 1.0)
    restart = F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart")
    tail = g.where(~F.col("value").isin(*[r["value"] for r in first])).select("*", restart)
    tail = tail.withColumn("h", seeded_hash(seed, F.col("restart"), F.col("value")))
    tail = running_total(tail, ["restart"], ["h", "value"], "size").withColumn("middle", F.col("pos") + F.col("size") / 2)
    part = F.when(F.col("middle") < lack[0] * scale, 0).when(F.col("middle") < (lack[0] + lack[1]) * scale, 1).otherwise(2)
    tail = tail.withColumn("part", part)
    sums = {f"{c}_{i}": F.sum(F.when(F.col("part") == i, F.col(c)).otherwise(0)) for i in range(3) for c in ("negatives", "positives")}
    t = g.sparkSession.range(restarts).select(F.col("id").alias("restart"))
    t = t.join(tail.groupBy("restart").agg(*[x.alias(k) for k, x in sums.items()]), "restart", "left")
    have = lambda c, i: F.coalesce(f"{c}_{i}", F.lit(0)) + F.lit(filled[i][c == "positives"])
    classes = [c for c, k in (("negatives", "neg"), ("positives", "pos")) if all_[k]]
    covered = F.lit(True)
    for i in range(3):
        for c in classes:
            covered = covered & (have(c, i) > 0)
    off = F.greatest(*[F.abs(have("negatives", i) + have("positives", i) - F.lit(target[i])) / F.lit(target[i]) for i in range(3)])
    t = t.select("restart", covered.alias("covered"), off.alias("deviation"))
    return t.withColumn("feasible", F.col("covered") & (F.col("deviation") <= tolerance))


def verdict(attempts: DataFrame, report: DataFrame) -> DataFrame:
    """The best attempt, how many covered every class, and the obstacles in words."""
    best = attempts.agg(F.count(F.lit(1)).alias("restarts"), F.sum(F.col("covered").cast("long")).alias("n_covered"), F.max_by(F.struct("covered", "deviation"), F.struct(F.col("covered"), -F.col("deviation"))).alias("b"))
    t = report.join(F.broadcast(best))
    reasons = F.array_compact(F.array(
        F.when(F.col("starved") != "", F.concat(F.lit("classes in too few groups: "), F.col("starved"))),
        F.when(F.col("dominates"), "one group is larger than the smallest part"),
        F.when(F.col("n_covered") == 0, "no assignment kept every class"),
        F.when((F.col("n_covered") > 0) & (F.col("b.deviation") > 0.1), "no covered assignment meets the sizes"),
    ))
    return t.select("axis", "restarts", "n_covered", F.col("b.covered").alias("best_covered"), F.round("b.deviation", 6).alias("best_deviation"), F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("feasible"))


def _fill(levels: list[int], rows: list[int], step: int, size: int, m: int) -> list[int]:
    """How many of m equal groups each fold gets, if one after another goes to the lowest level (then to
    the fewest rows, then to the first fold) and lifts it by ``step``: the m smallest of all levels to come."""
    k = range(len(levels))
    if step == 0:
        first = min(k, key=lambda i: (levels[i], rows[i], i))
        return [m if i == first else 0 for i in k]
    below = lambda limit: [max(0, -(-(limit - h) // step)) for h in levels]
    low, high = min(levels), min(levels) + (m + 1) * step
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= m else (low, middle)
    out = below(low)
    ties = sorted((i for i in k if low >= levels[i] and (low - levels[i]) % step == 0), key=lambda i: (rows[i] + out[i] * size, i))
    for i in ties[: m - sum(out)]:
        out[i] += 1
    return out


SEGMENTS = "negatives long, positives long, fold int, low long, high long"


def profile_folds(groups: DataFrame, k: int) -> DataFrame:
    """(negatives, positives, fold, low, high): of the groups with these counts, those from place ``low``
    to before ``high`` go to the fold.

    Groups go, those with the largest squared class shares first, to the fold in which they add least
    to the sum of squared class shares. Groups of equal counts are dealt at once, so the walk is over
    distinct counts; these pass through one task in order, which holds nothing but the folds' sums.
    """
    totals = groups.agg(F.sum("negatives").alias("_tn"), F.sum("positives").alias("_tp"))
    profiles = groups.groupBy("negatives", "positives").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(totals))
    share = lambda c, t: F.col(c).cast("double") / F.greatest(F.col(t), F.lit(1))
    weight = share("negatives", "_tn") * share("negatives", "_tn") + share("positives", "_tp") * share("positives", "_tp")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [[0, 0] for _ in range(k)]
        for batch in batches:
            out = []
            for n, p, m, tn, tp in batch[["negatives", "positives", "m", "_tn", "_tp"]].itertuples(index=False):
                n, p, a, b = int(n), int(p), int(n) * max(1, int(tp)) ** 2, int(p) * max(1, int(tn)) ** 2
                counts = _fill([a * x + b * y for x, y in held], [x + y for x, y in held], a * n + b * p, n + p, int(m))
                at = 0
                for i, c in enumerate(counts):
                    if c:
                        out.append((n, p, i, at, at + c))
                        held[i], at = [held[i][0] + c * n, held[i][1] + c * p], at + c
            yield pd.DataFrame(out, columns=["negatives", "positives", "fold", "low", "high"])

    order = [F.desc("weight"), F.desc("negatives"), F.desc("positives")]
    return profiles.withColumn("weight", weight).repartition(1).sortWithinPartitions(*order).mapInPandas(walk, SEGMENTS)


def group_folds(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """(value, fold): folds of whole groups that differ little in classes; refused if a class has under k groups."""
    starved = axis_report(df, column, k).first()["starved"]
    if starved:
        raise ValueError(f"classes {starved} are in under {k} groups of {column}")
    groups = kept(collapse(df, column))
    return _dealt(groups, kept(profile_folds(groups, k)))


def _dealt(groups: DataFrame, segments: DataFrame) -> DataFrame:
    placed = position_by_order(groups, ["negatives", "positives"], ["value"])
    return placed.join(segments, ["negatives", "positives"]).where("low <= pos and pos < high").select("value", "fold")


REALISED = "axis string, fold int, n_groups long, negatives long, positives long, missing_classes string, refusal string"


def _refused(df: DataFrame, column: str, k: int, columns: str) -> DataFrame | None:
    """One row with the refusal, if a class has under k groups."""
    starved = axis_report(df, column, k).first()["starved"]
    if not starved:
        return None
    empty = [None] * (columns.count(",") - 1)
    return df.sparkSession.createDataFrame([(column, *empty, f"classes {starved} are in under {k} groups")], columns)


def _realised(segments: DataFrame, column: str, k: int) -> DataFrame:
    s = segments.withColumn("m", F.col("high") - F.col("low"))
    total = lambda c: F.sum(F.col(c) * F.col("m")).alias(c)
    s = s.groupBy("fold").agg(F.sum("m").alias("n_groups"), total("negatives"), total("positives"))
    t = segments.sparkSession.range(k).select(F.col("id").cast("int").alias("fold")).join(s, "fold", "left").fillna(0, ["n_groups", "negatives", "positives"])
    missing = F.array_join(F.array_compact(F.array(F.when(F.col("negatives") == 0, "0"), F.when(F.col("positives") == 0, "1"))), ",")
    return t.select(F.lit(column).alias("axis"), "fold", "n_groups", "negatives", "positives", missing.alias("missing_classes"), F.lit(None).cast("string").alias("refusal"))


def fold_report(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """(axis, fold, n_groups, negatives, positives, missing_classes, refusal): what each fold got, or one
    row with the refusal, if a class has under k groups."""
    refused = _refused(df, column, k, REALISED)
    return _realised(profile_folds(kept(collapse(df, column)), k), column, k) if refused is None else refused


def fold_members(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """(axis, value, fold, n_groups, negatives, positives, missing_classes, refusal): every group with its fold and
    what that fold got, or one row with the refusal, if a class has under k groups."""
    columns = REALISED.replace("fold int", "value string, fold int")
    refused = _refused(df, column, k, columns)
    if refused is not None:
        return refused
    groups = kept(collapse(df, column))
    segments = kept(profile_folds(groups, k))
    folds = _realised(segments, column, k)  # k rows; a fold without groups keeps its row
    return _dealt(groups, segments).join(folds, "fold", "right").select(*[c.split()[0] for c in columns.split(", ")])
