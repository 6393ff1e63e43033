"""Entities from tables, and reading and writing of flows, edges, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.values import epoch_seconds, time_bin, valid_value
from kinweave.operators.splits import by_time_in_class
from kinweave.spec import EntitySpec, RelationSpec

EVENTS = EntitySpec(features=("value",), relations=(RelationSpec("via_user", "user_id"), RelationSpec("via_prop", "prop"), RelationSpec("via_timebin", "ts", "timebin")))
RELATIONS = [r.name for r in EVENTS.relations]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entities: an error is positive; related by user, property and five-minute bin."""
    t = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), epoch_seconds(F.col("ts")).alias("ts"), (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("event_type").alias("category"), "value", "user_id", F.get_json_object("props", "$.k").alias("prop"),
    )
    return t.withColumns({"via_user": valid_value(F.col("user_id")), "via_prop": valid_value(F.col("prop")), "via_timebin": time_bin(F.col("ts"))})


def split_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with their split; with some columns only, if named, and those that make the split."""
    t = events(spark, sf_dir)
    return by_time_in_class(t.select(*dict.fromkeys(["id", "label", "ts", *columns])) if columns else t)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities: toxic is positive, none is negative; quality is there only if labelled."""
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    t = d.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    t = t.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("double").alias("ts"), F.coalesce("toxic", F.lit(0)).alias("label"), F.col("source").alias("category"), "n_chars", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("via_quality"), F.col("lang").alias("via_lang"), F.col("source").alias("via_source"))
    return by_time_in_class(t)


def write_flows(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.partitionBy("relation").parquet(path)


def read_edges(spark: SparkSession, path: str, relations: list[str]) -> DataFrame:
    """The edges of some relations; other relations' files are not read."""
    return spark.read.parquet(path).where(F.col("relation").isin(*relations)).select("relation", "src", "dst")


def read_released(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A released flow table (CSV with a header, no timestamps) under a given schema, so that nothing is
    read twice to guess types; columns are matched by position and checked against the header."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    (df.write.json if form == "json" else df.write.option("header", True).csv)(path)


#: Members of a result file that hold its scores by seed (fixed values).
SETS, SEEDS = "sets", "per_seed"


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, dataset, set_name, n_sets, seeds, status) of every data set in a tree of result files.

    A file is one JSON object by data set. A data set has scores by seed itself, or has named sets that
    do; layouts may differ from file to file. Status ``ok`` has an array of seeds; ``ambiguous`` has several
    sets, of which none is taken; ``empty`` has no scores; ``broken`` is a file that is no JSON object.
    Files are read whole, each by one task, and kept as variants, so that no schema has to be agreed on.
    """
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("_v"))
    nodes = text.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer())).select("file", F.col("key").alias("dataset"), F.col("value").alias("_node"))
    t = nodes.withColumn("_sets", F.try_variant_get("_node", f"$.{SETS}", "map<string,variant>"))
    names = F.map_keys("_sets")
    t = t.withColumns({"n_sets": F.coalesce(F.size("_sets"), F.lit(-1)), "set_name": F.when(F.size("_sets") == 1, F.get(names, F.lit(0)))})
    one = F.when(F.col("n_sets") == 1, F.try_variant_get(F.element_at(F.map_values("_sets"), 1), f"$.{SEEDS}", "array<variant>"))
    own = F.when(F.col("n_sets") < 0, F.try_variant_get("_node", f"$.{SEEDS}", "array<variant>"))
    t = t.withColumn("seeds", F.coalesce(one, own))
    status = F.when(F.col("dataset").isNull(), "broken").when(F.col("n_sets") > 1, "ambiguous").when(F.coalesce(F.size("seeds"), F.lit(-1)) <= 0, "empty").otherwise("ok")
    return t.select("file", "dataset", "set_name", F.greatest("n_sets", F.lit(0)).alias("n_sets"), "seeds", status.alias("status"))


def seed_scores(results: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(file, dataset, set_name, seed, metric, value) of the data sets whose status is ``ok``.

    Members that are no numbers are left out; a seed without number has its place, from 0.
    """
    t = results.where("status = 'ok'").select("file", "dataset", "set_name", F.posexplode("seeds").alias("_i", "_s"))
    t = t.withColumns({"seed": F.coalesce(F.try_variant_get("_s", "$.seed", "long"), F.col("_i").cast("long")), "_m": F.try_variant_get("_s", "$", "map<string,variant>")})
    t = t.select("file", "dataset", "set_name", "seed", F.explode("_m").alias("metric", "_x")).where("metric <> 'seed'")
    t = t.withColumn("value", F.try_variant_get("_x", "$", "double")).where("value is not null").drop("_x")
    return t if metrics is None else t.where(F.col("metric").isin(*metrics))


def first_scores(scores: DataFrame, candidates: DataFrame, arm: str = "arm") -> DataFrame:
    """For each arm and data set the scores of the first candidate file that has any.

    ``candidates`` has (arm, rank, pattern), a pattern being the end of a file's name.
    """
    files = scores.select("file", "dataset").distinct()
    fits = files.join(F.broadcast(candidates), F.endswith(files["file"], F.col("pattern")))
    best = fits.groupBy(arm, "dataset").agg(F.min_by("file", F.struct("rank", "file")).alias("file"))
    return scores.join(F.broadcast(best), ["file", "dataset"]).select(arm, "dataset", "set_name", "seed", "metric", "value")


SCORES = "dataset string, arm string, per_seed array<struct<seed:int,metric:string,value:double>>"


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Files of one layout as (dataset, arm, seed, metric, value); two sets for one arm are refused."""
    t = spark.read.schema(SCORES).option("multiLine", True).json(path)
    if t.groupBy("dataset", "arm").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        raise ValueError("several sets of scores for one dataset and arm")
    return t.select("dataset", "arm", F.explode("per_seed").alias("s")).select("dataset", "arm", "s.*")


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that one lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
