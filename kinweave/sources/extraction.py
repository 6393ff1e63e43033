"""Incremental extraction: only files that are new or have changed are read again.

The extracted table has one folder for each version of a source file (its path, size and time of
change). A manifest, itself a table, names the versions that count; a refresh writes the missing
versions and then a new manifest, so a refresh that is lost or repeated changes nothing that is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kinweave.operators.ranking import kept

#: Paths of one read; a refresh of more files takes several.
FILES_A_READ = 10_000
MANIFEST = "file string, size long, modified timestamp, version string"


def source_files(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """(file, size, modified, version) of the files there are now; their contents are not read."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(paths)
    t = t.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return t.withColumn("version", F.md5(F.concat_ws("|", "file", F.col("size").cast("string"), F.unix_micros("modified").cast("string"))))


def _listed(spark: SparkSession, target: str) -> DataFrame:
    """All manifests so far; each has a row without file, so that one of no files counts as well."""
    try:
        return spark.read.schema(f"{MANIFEST}, refresh int").parquet(f"{target}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], f"{MANIFEST}, refresh int")


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """The versions that count after the last refresh; none before the first."""
    t = _listed(spark, target)
    last = t.agg(F.max("refresh")).first()[0]
    return t.where(F.col("refresh") == F.lit(last).cast("int")).where("file is not null")


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(file, version, change): each file as ``new``, ``changed``, ``same`` or ``gone``."""
    a, b = now.select("file", F.col("version").alias("_a")), before.select("file", F.col("version").alias("_b"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, "file", "full").select("file", F.coalesce("_a", "_b").alias("version"), change.alias("change"))


def refresh(spark: SparkSession, sources: str | list[str], target: str, extract: Callable[[SparkSession, list[str]], DataFrame], pattern: str = "*") -> DataFrame:
    """Brings the table in ``target`` up to date; returns (change, n_files, n_rows), rows being those extracted now.

    ``extract`` reads a list of files and returns rows with their ``file``. Paths of files to be read
    pass through the driver, FILES_A_READ at a time, as a reader needs them; rows never do.
    """
    now = kept(source_files(spark, sources, pattern))
    before = manifest(spark, target)
    last = _listed(spark, target).agg(F.max("refresh")).first()[0] or 0
    state = kept(changes(now, before))
    todo = state.where("change in ('new', 'changed')").orderBy("file")
    paths = [r["file"] for r in todo.select("file").toLocalIterator()]
    for i in range(0, len(paths), FILES_A_READ):
        rows = extract(spark, paths[i : i + FILES_A_READ]).join(F.broadcast(todo.select("file", "version")), "file")
        # files of a version that an earlier, lost refresh began are replaced
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{target}/rows")
    none = spark.range(1).select(*[F.lit(None).cast(now.schema[c].dataType).alias(c) for c in now.columns])
    found = now.unionByName(none).withColumn("refresh", F.lit(last + 1))
    found.write.mode("append").partitionBy("refresh").parquet(f"{target}/manifest")
    counts = state.groupBy("change").agg(F.count(F.lit(1)).alias("n_files"))
    if not paths:
        return kept(counts.withColumn("n_rows", F.lit(0).cast("long")))
    written = spark.read.parquet(f"{target}/rows").join(F.broadcast(todo.select("version", "change")), "version")
    return kept(counts.join(written.groupBy("change").agg(F.count(F.lit(1)).alias("n_rows")), "change", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))))


def extracted(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all files that count; folders of other versions are pruned by the join with the manifest."""
    rows = spark.read.parquet(f"{target}/rows")
    return rows.join(F.broadcast(manifest(spark, target).select("version")), "version", "left_semi").drop("version")
