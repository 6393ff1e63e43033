"""Queries on folders of logs and results whose files differ, on incremental extraction, and on streamed packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import values as V
from kinweave.operators.ranking import scratch
from kinweave.sources import extraction, logs
from kinweave.sources.tables import first_scores, read, read_results, seed_scores
from kinweave.streaming import packets

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _order_logs(spark, sf: str) -> str:
    """Orders as logs: two orders of the columns, one log without prices, one without a header."""
    path = scratch(spark, "logs")
    t = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    kind = lambda k: t.where(F.col("o_orderkey") % 4 == k)
    logs.write_log(kind(0), f"{path}/a")
    logs.write_log(kind(1).select("o_totalprice", "o_orderkey", "o_orderpriority"), f"{path}/b")
    logs.write_log(kind(2).select("o_orderpriority", "o_orderkey"), f"{path}/c")
    kind(3).select(F.concat_ws("\t", "o_orderkey", "o_orderpriority").alias("value")).write.text(f"{path}/d")
    short = kind(3).select(F.col("o_orderkey").cast("string").alias("value"))
    head = spark.range(1).select(F.lit("#fields\to_orderkey\to_orderpriority").alias("value"))
    head.unionByName(short).coalesce(1).write.text(f"{path}/e")
    return path


@query("""SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 4 < 2 THEN o_totalprice END AS o_totalprice,
  CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS folder FROM orders WHERE o_orderkey % 4 < 3""")
def r1_log_headers(spark, sf):
    """Logs of three headers in one read, each cut by its own; the label comes from the folder."""
    path = _order_logs(spark, sf)
    t = logs.read_log(spark, [f"{path}/{x}" for x in "abc"], numeric=("o_totalprice",), file_column="file")
    return t.select("o_orderkey", "o_orderpriority", "o_totalprice", V.folder(F.col("file")).alias("folder"))


@query("""SELECT CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'e' END AS folder, CASE WHEN o_orderkey % 4 = 2 THEN 2 WHEN o_orderkey % 4 = 3 THEN 2 ELSE 3 END AS n_columns,
  count(*) FILTER (o_orderkey % 4 < 3) AS n_rows, count(*) FILTER (o_orderkey % 4 = 3) AS n_short, CASE WHEN o_orderkey % 4 = 3 THEN 'no rows' ELSE 'whole' END AS status FROM orders GROUP BY ALL
  UNION ALL SELECT 'd', 0, 0, 0, 'no header' FROM orders WHERE o_orderkey % 4 = 3 HAVING count(*) > 0""")
def r2_log_status(spark, sf):
    """What a read takes from each log and what it drops, and why."""
    path = _order_logs(spark, sf)
    t = logs.log_status(spark, [f"{path}/{x}" for x in "abcde"]).withColumn("folder", V.folder(F.col("file")))
    rows = t.groupBy("folder").agg(F.max("n_columns").alias("n_columns"), F.sum("n_rows").alias("n_rows"), F.sum("n_short").alias("n_short"), F.max("status").alias("status"))
    return rows.select("folder", "n_columns", "n_rows", "n_short", "status")


def _results_tree(spark, sf: str) -> str:
    """Mean values by user group as result files: bare scores, one set, two sets, and a broken file."""
    path = scratch(spark, "results")
    t = read(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.round(F.avg("value"), 4).alias("value"))
    seeds = F.array_sort(F.collect_list(F.struct("seed", F.col("value").alias("macro_f1"), F.lit("x").alias("note"))))
    t = t.groupBy("event_type").agg(seeds.alias("s"))
    bare, one = F.struct(F.col("s").alias("per_seed")), F.struct(F.create_map(F.lit("full"), F.struct(F.col("s").alias("per_seed"))).alias("sets"))
    two = F.struct(F.create_map(F.lit("full"), F.struct(F.col("s").alias("per_seed")), F.lit("other"), F.struct(F.col("s").alias("per_seed"))).alias("sets"))
    node = lambda x: F.to_json(F.create_map("event_type", x)).alias("value")
    of = lambda kind, x, at: t.where(F.col("event_type") == kind).select(x).write.text(f"{path}/{at}")
    of("view", node(bare), "han/view")
    of("click", node(one), "han/click")
    of("error", node(two), "han/error")
    of("signup", F.substring(node(bare), 1, 40).alias("value"), "han/signup")
    of("view", node(one), "older/view")
    return path


SCORED = "SELECT event_type, (user_id % 5)::BIGINT AS seed, round(avg(value), 4) AS value FROM events GROUP BY 1, 2"


@query(f"""WITH s AS ({SCORED}) SELECT arm, dataset, set_name, status, seed, value FROM (
  SELECT 'han' AS arm, event_type AS dataset, CASE event_type WHEN 'click' THEN 'full' END AS set_name, 'ok' AS status, seed, value FROM s WHERE event_type IN ('view', 'click')
  UNION ALL SELECT 'older', event_type, 'full', 'ok', seed, value FROM s WHERE event_type = 'view'
  UNION ALL SELECT DISTINCT 'han', event_type, NULL, 'ambiguous', NULL::BIGINT, NULL::DOUBLE FROM s WHERE event_type = 'error'
  UNION ALL SELECT DISTINCT 'han', NULL, NULL, 'broken', NULL::BIGINT, NULL::DOUBLE FROM s WHERE event_type = 'signup')""")
def r8_results_tree(spark, sf):
    """Scores of files of both layouts, and a row for each ambiguous or broken one."""
    results = read_results(spark, f"{_results_tree(spark, sf)}/*/*").where("not (status = 'broken' and file like '%_SUCCESS')")
    arm = V.folder(F.col("file"), 2).alias("arm")
    good = seed_scores(results, ["macro_f1"]).select(arm, "dataset", "set_name", F.lit("ok").alias("status"), "seed", "value")
    none = [F.lit(None).cast("long").alias("seed"), F.lit(None).cast("double").alias("value")]
    return good.unionByName(results.where("status <> 'ok'").select(arm, "dataset", "set_name", "status", *none))


@query(f"WITH s AS ({SCORED}) SELECT 'HAN' AS arm, event_type AS dataset, seed, value FROM s WHERE event_type IN ('view', 'click')")
def r8_first_scores(spark, sf):
    """Of several candidate files the first that has scores of a data set."""
    results = read_results(spark, f"{_results_tree(spark, sf)}/*/*")
    files = results.where("status = 'ok'").select("file", V.folder(F.col("file"), 2).alias("folder")).distinct()
    ranked = files.select(F.lit("HAN").alias("arm"), F.when(F.col("folder") == "han", 0).otherwise(1).alias("rank"), F.col("file").alias("pattern"))
    return first_scores(seed_scores(results, ["macro_f1"]), ranked).select("arm", "dataset", "seed", "value")


def _event_log(t: DataFrame, path: str) -> str:
    t.select(F.concat_ws("\t", "event_id", "event_type").alias("value")).write.text(path)
    return path


def _extract(spark, files: list[str]) -> DataFrame:
    cells = F.split("value", "\t")
    return spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), cells[0].cast("long").alias("event_id"), cells[1].alias("event_type"))


#: A rewritten file has another name here, so it counts as gone and new.
ROUNDS = """SELECT round, change, n_files, sum(n)::BIGINT AS n_rows FROM (
  SELECT 1 AS round, 'new' AS change, 3 AS n_files, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error')
  UNION ALL SELECT 2, 'new', 2, sum(CASE event_type WHEN 'click' THEN 2 ELSE 1 END) FROM events WHERE event_type IN ('signup', 'click')
  UNION ALL SELECT 2, 'same', 2, 0 UNION ALL SELECT 2, 'gone', 1, 0 UNION ALL SELECT 3, 'same', 3, 0 UNION ALL SELECT 3, 'gone', 1, 0 UNION ALL SELECT 4, 'same', 3, 0) GROUP BY ALL"""


def _rounds(spark, sf: str) -> tuple[str, list[DataFrame]]:
    """Four refreshes: three sources; one rewritten with twice its rows and one more; one gone; nothing new."""
    root, target, events = scratch(spark, "captures"), scratch(spark, "extracted"), read(spark, sf, "events")
    of = lambda kind: events.where(F.col("event_type") == kind).coalesce(1)
    for kind in ("view", "click", "error"):
        _event_log(of(kind), f"{root}/{kind}")
    at = lambda *kinds: [f"{root}/{k}" for k in kinds]
    done = [extraction.refresh(spark, at("view", "click", "error"), target, _extract, "part-*")]
    again = of("click").unionByName(of("click").withColumn("event_id", -F.col("event_id") - 1)).coalesce(1)
    again.select(F.concat_ws("\t", "event_id", "event_type").alias("value")).write.mode("overwrite").text(f"{root}/click")
    _event_log(of("signup"), f"{root}/signup")
    for kinds in (("view", "click", "error", "signup"), ("view", "click", "signup"), ("view", "click", "signup")):
        done.append(extraction.refresh(spark, at(*kinds), target, _extract, "part-*"))
    return target, done


@query("""SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'signup')
  UNION ALL SELECT -event_id - 1, event_type FROM events WHERE event_type = 'click'""")
def r5_incremental_extraction(spark, sf):
    """After four refreshes the table is what one extraction of the last state gives."""
    target, _ = _rounds(spark, sf)
    return extraction.extracted(spark, target).select("event_id", "event_type")


@query(ROUNDS)
def r5_rows_read(spark, sf):
    """Files by what became of them, and the rows that each refresh extracted: those of new and changed files alone."""
    out = None
    for i, counts in enumerate(_rounds(spark, sf)[1]):
        t = counts.select(F.lit(i + 1).alias("round"), "change", "n_files", "n_rows")
        out = t if out is None else out.unionByName(t)
    return out


PAUSE, LATE = 6 * 3600, 600
PACKETS = """pk AS (SELECT CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE '-1' END AS src, CASE WHEN event_id % 2 = 0 THEN '-1' ELSE user_id::VARCHAR END AS dst,
  epoch_us(ts) // 1000 AS ms, value AS bytes, CASE WHEN event_type = 'view' THEN event_type END AS name FROM events)"""


@query(f"""WITH {PACKETS}, f AS (SELECT *, least(src, dst) AS lo, greatest(src, dst) AS hi FROM pk),
b AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY lo, hi ORDER BY ms) <= {PAUSE * 1000} THEN 0 ELSE 1 END AS begins FROM f),
s AS (SELECT *, sum(begins) OVER (PARTITION BY lo, hi ORDER BY ms) AS k FROM b), m AS (SELECT max(ms) - {LATE * 1000} AS w FROM pk),
g AS (SELECT lo, hi, k, arg_min(src, (ms, src <> lo)) AS client, min(ms) AS first, max(ms) AS last, arg_min(name, (ms, name)) FILTER (name IS NOT NULL) AS name FROM s GROUP BY ALL)
SELECT g.client, CASE WHEN g.client = lo THEN hi ELSE lo END AS server, round(any_value(first) / 1000.0, 3) AS first, round(any_value(last) / 1000.0, 3) AS last,
  count(*) FILTER (s.src = g.client) AS packets_out, count(*) FILTER (s.src <> g.client) AS packets_in, round(coalesce(sum(s.bytes) FILTER (s.src = g.client), 0), 2) AS bytes_out,
  any_value(g.name) AS name FROM g JOIN s USING (lo, hi, k), m GROUP BY lo, hi, k, g.client, w HAVING any_value(last) + {PAUSE * 1000} <= w""")
def x3_stream_packets(spark, sf):
    """Packets of a stream folded to flows; those still open at its end are not given out."""
    from kinweave.plans.graph_queries import _drained, _stream

    even = F.col("event_id") % 2 == 0
    user = F.col("user_id").cast("string")
    name = F.when(F.col("event_type") == "view", F.col("event_type")).alias("name")
    s = _stream(spark, sf).select(F.when(even, user).otherwise("-1").alias("src"), F.lit(1).alias("sport"), F.when(even, "-1").otherwise(user).alias("dst"), F.lit(1).alias("dport"), F.lit("tcp").alias("proto"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("bytes"), name)
    with packets.state_store(spark):
        f = _drained(packets.fold_stream(s, PAUSE, f"{LATE} seconds"))
    return f.select("client", "server", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "packets_out", "packets_in", F.round("bytes_out", 2).alias("bytes_out"), "name")
