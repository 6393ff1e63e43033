"""Learners of Spark ML on feature columns, and comparisons over feature sets."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.values import hash_number, index_like_names
from kinweave.operators import compare
from kinweave.operators.features import balanced, finite
from kinweave.operators.ranking import kept


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(finite(df, columns))


#: Iterations of boosting at most; it ends before if the held-out rows' loss no longer falls by TOLERANCE
#: (relative to the loss, or absolute below 0.01). One in HELD_OUT of the fitted rows is held out for that.
ITERATIONS, TOLERANCE, HELD_OUT = 400, 0.001, 10


def _learner(model: str, weight: str, seed: int, iterations: int, early: bool):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    args = {"featuresCol": "features", "labelCol": "y", "weightCol": weight, "predictionCol": "said"}
    if model != "boosting":
        return LogisticRegression(maxIter=20, **args)
    learner = GBTClassifier(maxIter=iterations, maxDepth=3, seed=seed, checkpointInterval=10, validationTol=TOLERANCE, **args)
    return learner.setValidationIndicatorCol("held_out") if early else learner


def fit(df: DataFrame, columns: list[str], model: str = "boosting", fit_on: tuple[str, ...] = ("train",), seed: int = 42, iterations: int = ITERATIONS, early: bool = True) -> tuple[DataFrame, int]:
    """(id, label, split, prediction) of a class-weighted learner fitted on some splits, and the number of
    boosting iterations used (the sum over classes, if there are more than two).

    Labels 0 and others make two classes; with more than two labels there is one learner for each, against
    the rest, and the one that is surest decides (the smallest label, if equally sure).

    ``df`` is read once to count, once by each learner, which holds its rows itself, and once to predict, so
    rows that are not read cheaply should be ``kept``. Labels, weights and held-out rows come from one count.
    """
    spark, held = df.sparkSession, F.pmod(hash_number(f"{seed}:held", F.col("id")), F.lit(HELD_OUT)) == 0
    counts = df.groupBy("label", "split", held.alias("held_out")).agg(F.count(F.lit(1)).alias("c")).collect()
    fitted_on = [r for r in counts if r["split"] in fit_on]
    labels = sorted({r["label"] for r in fitted_on})
    trained = spark.createDataFrame([(r["label"], r["c"]) for r in counts if r["split"] == "train"], df.select("label", F.lit(0).cast("long").alias("c")).schema)
    weights = {r["label"]: r["weight"] for r in balanced(trained.groupBy("label").agg(F.sum("c").alias("c"))).collect()}
    weight = F.coalesce(*[F.when(F.col("label") == y, F.lit(w)) for y, w in weights.items()], F.lit(1.0))
    t = _assembled(df, columns).select("id", "label", "split", "features", weight.alias("weight"), held.alias("held_out"))
    train, used, out = t.where(F.col("split").isin(*fit_on)), 0, t
    early = early and {r["held_out"] for r in fitted_on} == {True, False}
    targets = labels if len(labels) > 2 else [None]
    sure = []
    for i, y in enumerate(targets):
        positive = (F.col("label") != 0) if y is None else (F.col("label") == y)
        fitted = _learner(model, "weight", seed, iterations, early).fit(train.withColumn("y", positive.cast("double")))
        used += fitted.getNumTrees if model == "boosting" else 0
        out = fitted.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("said", "probability", "rawPrediction")
        sure.append(F.struct(F.col(f"_p{i}").alias("p"), F.lit(-i).alias("first")))
    if targets == [None]:
        return out.select("id", "label", "split", (F.col("_p0") > 0.5).cast("int").alias("prediction")), used
    best = -F.greatest(*sure)["first"]
    return out.select("id", "label", "split", F.get(F.array(*[F.lit(y) for y in labels]), best).alias("prediction")), used


def fit_predict(df: DataFrame, columns: list[str], model: str = "boosting", fit_on: tuple[str, ...] = ("train",), seed: int = 42) -> DataFrame:
    """(id, label, split, prediction) of ``fit``."""
    return fit(df, columns, model, fit_on, seed)[0]


def feature_set_comparison(df: DataFrame, sets: dict[str, list[str]], model: str = "boosting", fits=(("train",), ("train", "val"))) -> DataFrame:
    """Test metrics of each feature set under each choice of fitted splits; ``df`` should be ``kept``."""
    out, used = None, []
    for name, columns in sets.items():
        for fit_on in fits:
            p, n = fit(df, columns, model, fit_on)
            used.append((name, "+".join(fit_on), n))
            p = p.where("split = 'test'").select(F.lit(name).alias("feature_set"), F.lit("+".join(fit_on)).alias("fit_on"), F.col("label"), "prediction")
            out = p if out is None else out.unionByName(p)
    rounds = df.sparkSession.createDataFrame(used, "feature_set string, fit_on string, iterations int")
    return compare.metrics(out, ["feature_set", "fit_on"], 2).join(F.broadcast(rounds), ["feature_set", "fit_on"])


def index_ablation(df: DataFrame, columns: list[str], ports: list[str]) -> DataFrame:
    """Scores with all columns, without index-like ones, and without ports too; and what is lost."""
    index = index_like_names(columns)
    kept = [c for c in columns if c not in index]
    sets = {"keep": columns, "drop": kept, "drop_ports": [c for c in kept if c not in ports]}
    t = feature_set_comparison(df, {k: v for k, v in sets.items() if v}, fits=(("train",),))
    base = t.where("feature_set = 'drop'").select(F.col("macro_f1").alias("base"))
    return t.join(F.broadcast(base)).withColumn("inflation", F.round(F.col("macro_f1") - F.col("base"), 6)).drop("base")


def relation_sets(df: DataFrame, neighbours: DataFrame, columns: list[str], sets: str) -> DataFrame:
    """Test metrics on own and averaged neighbour features of relation sets like ``a+b;c``.

    ``neighbours``: (relation, id, nbr_<column>).
    """
    chosen = [text.split("+") for text in sets.split(";")]
    every = list(dict.fromkeys(r for relations in chosen for r in relations))
    n = neighbours.where(F.col("relation").isin(*every)).groupBy("id").agg(*[F.max(F.when(F.col("relation") == r, F.col(f"nbr_{c}"))).alias(f"{r}_{c}") for r in every for c in columns])
    t, out = kept(df.select("id", "label", "split", *columns).join(n, "id", "left")), None  # neighbours are made once for all sets
    for relations in chosen:
        text, used = "+".join(relations), [*columns, *[f"{r}_{c}" for r in relations for c in columns]]
        p = fit_predict(t, used, "linear").where("split = 'test'").select(F.lit(text).alias("relations"), "label", "prediction")
        out = p if out is None else out.unionByName(p)
    return compare.metrics(out, ["relations"], 2)
