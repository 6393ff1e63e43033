"""Rules that predict the class from a field being present, and their permutation null.

Everything follows from counts by (field, split, present, label); rows are never scanned again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.values import is_valid


def contingency(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, split, present, label, c) with labels as 0 and 1."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), is_valid(F.col(f)).cast("int").alias("present")) for f in fields]))
    t = df.select("split", (F.col("label") != 0).cast("int").alias("label"), each.alias("f"))
    return t.groupBy("f.field", "split", "f.present", "label").agg(F.count(F.lit(1)).alias("c"))


def usable_fields(cells: DataFrame) -> DataFrame:
    """Fields whose presence is constant neither on train nor on test."""
    t = cells.where(F.col("split").isin("train", "test")).groupBy("field", "split").agg(F.countDistinct("present").alias("k"))
    return t.groupBy("field").agg(F.sum((F.col("k") == 2).cast("int")).alias("both")).where("both = 2").select("field")


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def macro_of_cells(present_is: int) -> Column:
    """Macro F1 over the cells of a group, when presence means that class."""
    n = lambda p, y: F.coalesce(F.sum(F.when((F.col("present") == p) & (F.col("label") == y), F.col("c"))), F.lit(0))
    hit = lambda y: n(1 if y == present_is else 0, y)
    return (f1_of(hit(1), hit_wrong(n, present_is, 1), n(0 if present_is == 1 else 1, 1)) + f1_of(hit(0), hit_wrong(n, present_is, 0), n(1 if present_is == 1 else 0, 0))) / 2


def hit_wrong(n, present_is: int, y: int) -> Column:
    """Rows that are said to be class y and are not."""
    return n(1 if y == present_is else 0, 1 - y)


def rules(cells: DataFrame) -> DataFrame:
    """By field: the direction that scores better on train, and both directions' test scores."""
    t = cells.join(usable_fields(cells), "field").groupBy("field", "split").agg(macro_of_cells(1).alias("positive"), macro_of_cells(0).alias("negative"))
    side = lambda s: t.where(F.col("split") == s).select("field", F.col("positive").alias(f"{s}_positive"), F.col("negative").alias(f"{s}_negative"))
    t = side("train").join(side("test"), "field")
    # The direction tried first on equal scores is the one where presence means the majority of test.
    major = cells.where("split = 'test'").groupBy("label").agg(F.sum("c").alias("c")).agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("major"))
    t = t.join(F.broadcast(major))
    up = F.when(F.col("major") == 1, F.col("train_positive") >= F.col("train_negative")).otherwise(F.col("train_positive") > F.col("train_negative"))
    return t.select(
        "field", F.when(up, "present_positive").otherwise("present_negative").alias("polarity"),
        F.when(up, F.col("test_positive")).otherwise(F.col("test_negative")).alias("macro_f1"), "test_positive", "test_negative",
    )


def best_rule(scores: DataFrame) -> DataFrame:
    """The field with the best score (first by name on ties) and how many reach it."""
    t = scores.agg(F.max("macro_f1").alias("best"))
    return scores.join(F.broadcast(t)).where(F.col("macro_f1") == F.col("best")).agg(F.min("field").alias("field"), F.max("best").alias("macro_f1"), F.count(F.lit(1)).alias("n_ties"))


def scoped_rules(cells: DataFrame, polarity: str = "train_agreement") -> DataFrame:
    """Scores on test, on val and test, and on all rows; the direction is fixed on train by
    agreement, or presence means the majority class of train ('present_majority')."""
    agree = cells.where("split = 'train'").groupBy("field").agg((F.sum(F.when(F.col("present") == F.col("label"), F.col("c")).otherwise(0)) / F.sum("c")).alias("agree"), F.sum(F.when(F.col("label") == 1, F.col("c")).otherwise(0)).alias("pos"), F.sum("c").alias("n"))
    up = F.col("agree") >= 0.5 if polarity == "train_agreement" else 2 * F.col("pos") > F.col("n")
    scopes = F.when(F.col("split") == "test", F.array(F.lit("test"), F.lit("val_and_test"), F.lit("all"))).when(F.col("split") == "val", F.array(F.lit("val_and_test"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    t = cells.withColumn("scope", F.explode(scopes)).groupBy("field", "scope").agg(macro_of_cells(1).alias("positive"), macro_of_cells(0).alias("negative"))
    return t.join(agree, "field").select("field", "scope", up.alias("present_is_positive"), F.when(up, F.col("positive")).otherwise(F.col("negative")).alias("macro_f1"))


def class_mix(cells: DataFrame) -> DataFrame:
    """Share of positives with and without the field, over all rows."""
    t = cells.groupBy("field", "present").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("label") == 1, F.col("c")).otherwise(0)).alias("positives"))
    return t.withColumn("positive_rate", F.round(F.col("positives") / F.col("n"), 6))


def permutation_null(df: DataFrame, fields: list[str], permutations: int, seed: int) -> DataFrame:
    """(permutation, score): the best field's test score after permuting labels over all rows.

    Rows collapse to cells (split, presence of every field); a permutation of labels is a
    multivariate hypergeometric draw of the positives over the cells, so its cost does not
    depend on the rows. Permutations are dealt over tasks. Permutation -1 is the observation.
    """
    if len(fields) > 16:
        raise ValueError("cells are kept for 2**fields patterns: at most 16 fields")
    cells = contingency(df, fields)
    use = [r["field"] for r in usable_fields(cells).collect()]
    fields = [f for f in fields if f in use]
    bits = sum((is_valid(F.col(f)).cast("int") * F.lit(1 << i) for i, f in enumerate(fields)), F.lit(0))
    rows = df.groupBy("split", bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") != 0).cast("long")).alias("k")).orderBy("split", "bits").toPandas()
    n, k, test = rows["n"].to_numpy(), rows["k"].to_numpy(), (rows["split"] == "test").to_numpy()
    train, has = (rows["split"] == "train").to_numpy(), [(rows["bits"].to_numpy() >> i & 1).astype(bool) for i in range(len(fields))]
    major = int(2 * k[test].sum() > n[test].sum())

    def macro(n, k, here, present, up):
        said = present if up else ~present
        tp, fp = k[here & said].sum(), (n - k)[here & said].sum()
        fn, tn = k[here & ~said].sum(), (n - k)[here & ~said].sum()
        one = lambda t: 2 * t / (2 * t + fp + fn) if t else 0.0
        return (one(tp) + one(tn)) / 2

    def best(k):
        out = -1.0
        for p in has:
            first, second = macro(n, k, train, p, bool(major)), macro(n, k, train, p, not major)
            out = max(out, macro(n, k, test, p, bool(major) if first >= second else not major))
        return out

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i) + 1])
                scores.append(best(k) if i < 0 else best(rng.multivariate_hypergeometric(n, int(k.sum()))))
            yield pd.DataFrame({"permutation": b["id"], "score": scores})

    if not fields:
        return df.sparkSession.createDataFrame([], "permutation long, score double")
    return df.sparkSession.range(-1, permutations).mapInPandas(draw, "permutation long, score double")


def null_summary(null: DataFrame) -> DataFrame:
    obs = F.max(F.when(F.col("permutation") < 0, F.col("score")))
    t = null.groupBy().agg(obs.alias("observed"))
    n = null.where("permutation >= 0").join(F.broadcast(t))
    s = n.agg(F.first("observed").alias("observed"), F.avg("score").alias("null_mean"), F.stddev_pop("score").alias("null_std"), F.percentile("score", F.lit(0.95)).alias("null_p95"), F.max("score").alias("null_max"), F.avg((F.col("score") >= F.col("observed")).cast("double")).alias("p_value"))
    return s.withColumn("exceeds_p95", F.col("observed") > F.col("null_p95"))


