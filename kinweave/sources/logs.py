"""Readers of tab-separated logs with a ``#fields`` header, joins of their tables, and packets.

Files are read as lines by Spark; each file's header is found once, and columns are cut natively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.values import cipher_group, endpoints, first_of_list, issuer_bucket, validity_bucket, version_cipher_fingerprint
from kinweave.operators.lookup import lookup_join
from kinweave.operators.ranking import kept


#: Up to this number of files their headers are broadcast.
FEW_FILES = 100_000
HEAD = "#fields"


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def log_headers(lines: DataFrame) -> DataFrame:
    """(file, names): each file's own header, the last one if it has several."""
    heads = lines.where(F.col("value").startswith(HEAD)).withColumn("at", F.struct("block", F.monotonically_increasing_id()))
    last = heads.groupBy("file").agg(F.max_by("value", "at").alias("head"))
    return last.select("file", F.slice(F.split(F.regexp_replace("head", r"\s+$", ""), "\t", -1), 2, 1 << 20).alias("names"))


def read_log(spark: SparkSession, paths: str | list[str], numeric: tuple[str, ...] = (), absent: str = "-", file_column: str | None = None) -> DataFrame:
    """The rows of one or many logs, each cut by the header of its own file.

    The columns are those of all headers, in the order in which files (by name) bring them in; a column
    that a file lacks is null in its rows. ``-`` is null, numeric columns are cast, and rows with fewer
    cells than their header are dropped. A file without header has no rows; without any header it is an
    error. Only the distinct headers reach the driver, as a schema is made of them; each file's places of
    the columns are found once, and rows look them up by file.
    """
    lines = _lines(spark, paths)
    heads = kept(log_headers(lines))
    found = heads.groupBy("names").agg(F.min("file").alias("file")).orderBy("file").collect()
    if not found:
        raise ValueError(f"{paths} has no {HEAD} line")
    names = list(dict.fromkeys(n for row in found for n in row["names"]))
    place = lambda n: F.array_position("names", F.lit(n)).cast("int")
    places = heads.select("file", F.size("names").alias("_n"), F.array(*[place(n) for n in names]).alias("_at"))
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("file", F.split("value", "\t", -1).alias("_c"))
    few = heads.count() <= FEW_FILES
    t = rows.join(F.broadcast(places), "file") if few else lookup_join(rows, places, ["file"])
    t = t.where(F.size("_c") >= F.col("_n"))

    def value(i: int, n: str) -> Column:
        at = F.col("_at")[i]
        text = F.when(at > 0, F.nullif(F.get("_c", at - 1), F.lit(absent)))
        return (text.try_cast("double") if n in numeric else text).alias(n)

    return t.select(*[value(i, n) for i, n in enumerate(names)], *([F.col("file").alias(file_column)] if file_column else []))


def log_status(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, n_columns, n_rows, n_short, status) of each log: what ``read_log`` takes from it and what it drops."""
    lines = _lines(spark, paths)
    heads = log_headers(lines).select("file", F.size("names").alias("n_columns"))
    cells = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).groupBy("file", F.size(F.split("value", "\t", -1)).alias("cells")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each file and number of cells, so that a large file is counted where it lies
    files = lines.select("file").distinct().join(heads, "file", "left").join(cells, "file", "left")
    short = F.col("cells") < F.col("n_columns")
    t = files.groupBy("file", "n_columns").agg(F.coalesce(F.sum(F.when(~short, F.col("n"))), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(short, F.col("n"))), F.lit(0)).alias("n_short"))
    status = F.when(F.col("n_columns").isNull(), "no header").when(F.col("n_rows") == 0, "no rows").when(F.col("n_short") > 0, "short rows dropped").otherwise("whole")
    return t.select("file", F.coalesce("n_columns", F.lit(0)).alias("n_columns"), "n_rows", "n_short", status.alias("status"))


def write_log(df: DataFrame, path: str, absent: str = "-") -> None:
    """Rows as lines; every file starts with the header, and one of an empty table is all header."""
    head = HEAD + "\t" + "\t".join(df.columns)
    cells = F.concat_ws("\t", *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(absent)) for c in df.columns])
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # the first row of a task, which writes one file
    lines = df.select(F.when(first, F.concat(F.lit(head + "\n"), cells)).otherwise(cells).alias("value"))
    df.sparkSession.range(1).select(F.lit(head).alias("value")).unionByName(lines).write.text(path)


def read_labelled(spark: SparkSession, path: str, schema: str, label: Column, **options) -> DataFrame:
    """Files of many folders in one read; ``label`` is an expression over the column ``path``."""
    t = spark.read.options(**options).csv(path, schema=schema)
    return t.withColumn("path", F.col("_metadata.file_path")).withColumn("label", label)


def file_manifest(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """(path, size) of the files of a table, to compare with an earlier extraction."""
    t = spark.read.format(form).load(path)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()


def manifest_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new, changed or gone."""
    return now.exceptAll(before).withColumn("change", F.lit("new")).unionByName(before.exceptAll(now).withColumn("change", F.lit("gone")))


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order."""
    t = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return t.where("_r = 1").drop("_r")


def join_sessions(conn: DataFrame, sessions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Connections with their session row; of repeated session keys the first counts."""
    return conn.join(first_row(sessions, [key], order), key, "left")


def keep_secure(conn: DataFrame, sessions: DataFrame | None, key: str, port: str = "dport") -> DataFrame:
    """Connections with a session, or by port 443 if there is no session log."""
    return conn.where(F.col(port) == 443) if sessions is None else conn.join(sessions.select(key).distinct(), key, "left_semi")


def with_certificate(sessions: DataFrame, chain: str, certificates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds subject, issuer and validity of the chain's first certificate; of repeated certificates the last counts."""
    value = F.struct(*[F.col(c) for c in certificates.columns if c != key])
    last = certificates.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("_c")).select(F.col(key).alias("_key"), "_c.*")
    return sessions.withColumn("_key", first_of_list(F.col(chain))).join(last, "_key", "left").drop("_key")


#: Names that certificate and session logs give their columns, in order of preference (fixed values).
CERTIFICATE_NAMES = {
    "key": ("fingerprint", "id"),
    "subject": ("certificate.subject", "subject"),
    "issuer": ("certificate.issuer", "issuer"),
    "begin": ("certificate.not_valid_before", "not_valid_before"),
    "end": ("certificate.not_valid_after", "not_valid_after"),
}
CHAIN_NAMES = ("cert_chain_fps", "cert_chain_fuids")


def first_named(columns: list[str], names) -> str | None:
    """The first of the names that is a column."""
    return next((n for n in names if n in columns), None)


def named_certificates(certificates: DataFrame) -> DataFrame:
    """A certificate log under the names key, subject, issuer, begin, end; columns it lacks are null."""
    found = {to: first_named(certificates.columns, names) for to, names in CERTIFICATE_NAMES.items()}
    if found["key"] is None:
        raise ValueError(f"no identifier among {certificates.columns}")
    none = F.lit(None)
    return certificates.select(*[(F.col(f"`{c}`") if c else none).cast("string").alias(to) for to, c in found.items()])


def with_named_certificate(sessions: DataFrame, certificates: DataFrame) -> DataFrame:
    """``with_certificate`` for logs of either column naming; of repeated certificates that which
    becomes valid last counts. Sessions without a chain column get null columns."""
    chain = first_named(sessions.columns, CHAIN_NAMES)
    if chain is None:
        nothing = {c: F.lit(None).cast("string") for c in CERTIFICATE_NAMES if c != "key"}
        return sessions.withColumns(nothing)
    order = ["begin", "end", "subject", "issuer"]
    return with_certificate(sessions, chain, named_certificates(certificates), "key", order)


def tls_columns(t: DataFrame, version: str, cipher: str, issuer: str, begin: str, end: str) -> DataFrame:
    """Adds the derived metadata columns."""
    return t.withColumns({"cipher_group": cipher_group(F.col(version), F.col(cipher)), "fingerprint": version_cipher_fingerprint(F.col(version), F.col(cipher)), "issuer_bucket": issuer_bucket(F.col(issuer)), "validity": validity_bucket(F.col(begin), F.col(end))})


def fold_packets(packets: DataFrame) -> DataFrame:
    """Packets (src, sport, dst, dport, proto, ts, bytes, name) as flows of both directions.

    The endpoint of the first packet counts as the client; the earliest name given is kept.
    """
    t = packets.withColumn("ends", endpoints(F.col("src"), F.col("sport"), F.col("dst"), F.col("dport")))
    forward = (F.col("src") == F.col("ends.low.ip")) & (F.col("sport") == F.col("ends.low.port"))
    t = t.withColumn("from_low", forward)
    total = lambda when, c: F.sum(F.when(when, c).otherwise(0))
    f = t.groupBy("ends", "proto").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.min_by("from_low", F.struct("ts", ~F.col("from_low"))).alias("low_began"),
        total(F.col("from_low"), F.lit(1)).alias("packets_low"), total(~F.col("from_low"), F.lit(1)).alias("packets_high"),
        total(F.col("from_low"), F.col("bytes")).alias("bytes_low"), total(~F.col("from_low"), F.col("bytes")).alias("bytes_high"),
        F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("ts", "name"))).alias("name"),
    )
    side = lambda a, b: F.when(F.col("low_began"), F.col(a)).otherwise(F.col(b))
    return f.select(
        side("ends.low.ip", "ends.high.ip").alias("client"), side("ends.low.port", "ends.high.port").alias("client_port"), side("ends.high.ip", "ends.low.ip").alias("server"), side("ends.high.port", "ends.low.port").alias("server_port"),
        "proto", "first", "last", side("packets_low", "packets_high").alias("packets_out"), side("packets_high", "packets_low").alias("packets_in"), side("bytes_low", "bytes_high").alias("bytes_out"), side("bytes_high", "bytes_low").alias("bytes_in"), "name",
    )
