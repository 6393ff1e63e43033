"""Queries on log sources, lookup joins, scalar functions and sinks, over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import values as V
from kinweave.operators import audit
from kinweave.operators.ranking import kept, scratch
from kinweave.plans import sql as S
from kinweave.plans.graph_queries import edges_of
from kinweave.sources import logs
from kinweave.sources.tables import RELATIONS, events, read, read_edges, read_released, read_scores, split_events, write_edges, write_flows, write_report

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, o_totalprice FROM orders")
def r1_log_round_trip(spark, sf):
    path = scratch(spark, "log")
    logs.write_log(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    return logs.read_log(spark, path, numeric=("o_totalprice",))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def r2_session_log(spark, sf):
    path = scratch(spark, "log")
    logs.write_log(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), path)
    return logs.read_log(spark, path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, value, CASE event_type WHEN 'error' THEN 'attack' ELSE 'benign' END AS label FROM events")
def r4_labels_from_paths(spark, sf):
    path = scratch(spark, "captures")
    t = read(spark, sf, "events").select("event_id", "value", F.when(F.col("event_type") == "error", "attack_flows").otherwise("normal").alias("kind"))
    t.write.partitionBy("kind").option("header", True).csv(path)
    label = V.label_by_substring(F.col("path"), (("attack", "attack"),), "benign")
    return logs.read_labelled(spark, f"{path}/*", "event_id long, value double", label, header=True).select("event_id", "value", "label")


@query("SELECT event_id, value FROM events")
def r3_released_csv(spark, sf):
    path = scratch(spark, "csv")
    write_report(read(spark, sf, "events").select("event_id", "value"), path, "csv")
    return read_released(spark, path, "event_id long, value double")


@query("SELECT 'gone' AS change, count(DISTINCT event_type) AS n_files FROM events UNION ALL SELECT 'new', 2 * count(DISTINCT event_type) FROM events")
def r5_extraction_manifest(spark, sf):
    """A cached extraction by type, of which each type's file is then rewritten with more columns (a
    file gone, a new one) and gets another one beside it (new)."""
    path = scratch(spark, "extraction")
    t = read(spark, sf, "events").select("event_type", "event_id").repartition("event_type")
    t.write.partitionBy("event_type").parquet(path)
    before = kept(logs.file_manifest(spark, path))
    one = t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("event_id"))
    rewritten = t.withColumn("twice", F.col("event_id") * 2).where(F.col("event_id") >= 0)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rewritten.write.mode("overwrite").partitionBy("event_type").parquet(path)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    one.repartition("event_type").write.mode("append").partitionBy("event_type").parquet(path)
    spark.catalog.refreshByPath(path)
    return logs.manifest_changes(logs.file_manifest(spark, path), before).groupBy("change").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"WITH {S.ENT} SELECT split, count(*) AS n, sum(label)::BIGINT AS positives FROM ent GROUP BY 1")
def r6_r9_flow_sink(spark, sf):
    path = scratch(spark, "flows")
    write_flows(split_events(spark, sf).select("id", "label", "split"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query(f"WITH {S.EDGES} SELECT * FROM edges WHERE relation = 'via_prop'")
def r7_edge_files(spark, sf):
    path = scratch(spark, "edges")
    write_edges(edges_of(split_events(spark, sf)), path)
    return read_edges(spark, path, ["via_prop"])


@query(
    "SELECT event_type AS dataset, 'full' AS arm, (user_id % 5)::INT AS seed, 'mean' AS metric, round(avg(value), 4) AS value FROM events "
    "GROUP BY 1, 3"
)
def r8_score_files(spark, sf):
    path = scratch(spark, "scores")
    t = read(spark, sf, "events").groupBy(F.col("event_type").alias("dataset"), (F.col("user_id") % 5).cast("int").alias("seed")).agg(F.round(F.avg("value"), 4).alias("value"))
    t = t.groupBy("dataset").agg(F.collect_list(F.struct("seed", F.lit("mean").alias("metric"), "value")).alias("per_seed")).withColumn("arm", F.lit("full"))
    t.repartition(4, "dataset").write.option("maxRecordsPerFile", 1).json(path)
    return read_scores(spark, path)


@query(f"WITH {S.ENT} SELECT split, label, count(*) AS n FROM ent GROUP BY 1, 2")
def r10_report_sinks(spark, sf):
    path = scratch(spark, "report")
    write_report(split_events(spark, sf).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("split string, label int, n long").json(path)


PACKETS = """pk AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE -1 END AS src, CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS dst, epoch_us(ts) / 1e6 AS ts, value AS bytes, CASE WHEN event_type = 'view' THEN event_type END AS name FROM events)"""


@query(f"""WITH {PACKETS}, f AS (SELECT *, CASE WHEN src < dst THEN src ELSE dst END AS lo, CASE WHEN src < dst THEN dst ELSE src END AS hi FROM pk),
g AS (SELECT lo, hi, min(ts) AS first, max(ts) AS last, arg_min(src, ts) AS client, count(*) AS n, sum(bytes) AS b FROM f GROUP BY 1, 2)
SELECT client, CASE WHEN client = lo THEN hi ELSE lo END AS server, round(first, 3) AS first, round(last, 3) AS last, count(*) FILTER (f.src = client) AS packets_out, count(*) FILTER (f.src <> client) AS packets_in,
round(coalesce(sum(f.bytes) FILTER (f.src = client), 0), 2) AS bytes_out, arg_min(name, f.ts) FILTER (name IS NOT NULL) AS name FROM g JOIN f USING (lo, hi) GROUP BY lo, hi, client, first, last""")
def r12_packet_fold(spark, sf):
    e = read(spark, sf, "events")
    even = F.col("event_id") % 2 == 0
    t = e.select(F.when(even, F.col("user_id")).otherwise(-1).cast("long").alias("src"), F.lit(1).alias("sport"), F.when(even, -1).otherwise(F.col("user_id")).cast("long").alias("dst"), F.lit(1).alias("dport"), F.lit("tcp").alias("proto"), V.epoch_seconds(F.col("ts")).alias("ts"), F.col("value").alias("bytes"), F.when(F.col("event_type") == "view", F.col("event_type")).alias("name"))
    f = logs.fold_packets(t)
    return f.select("client", "server", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "packets_out", "packets_in", F.round("bytes_out", 2).alias("bytes_out"), "name")


def conn(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("uid"), "l_linenumber", "l_partkey", F.when(F.col("l_suppkey") % 2 == 0, 443).otherwise(80).alias("dport"))


def sessions(spark, sf):
    """Orders under half of their keys, so that keys repeat."""
    return read(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("uid"), "o_orderkey", "o_orderpriority", F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("chain"))


CONN = (
    "cn AS (SELECT l_orderkey AS uid, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 443 ELSE 80 END AS dport "
    "FROM lineitem), se AS (SELECT o_orderkey // 2 AS uid, o_orderkey, o_orderpriority, o_custkey FROM orders)"
)


@query(
    f"WITH {CONN}, u AS (SELECT uid, arg_min(o_orderpriority, o_orderkey) AS p FROM se GROUP BY 1) "
    "SELECT p AS o_orderpriority, dport, count(*) AS n FROM cn LEFT JOIN u USING (uid) GROUP BY 1, 2"
)
def j1_session_join(spark, sf):
    t = logs.join_sessions(conn(spark, sf), sessions(spark, sf), "uid", ["o_orderkey"])
    return t.groupBy("o_orderpriority", "dport").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CONN} SELECT uid, l_linenumber, l_partkey FROM cn WHERE uid IN (SELECT uid FROM se)")
def j2_session_semi_join(spark, sf):
    return logs.keep_secure(conn(spark, sf), sessions(spark, sf), "uid").select("uid", "l_linenumber", "l_partkey")


@query(f"WITH {CONN} SELECT uid, l_linenumber, l_partkey FROM cn WHERE dport = 443")
def w2_secure_port(spark, sf):
    return logs.keep_secure(conn(spark, sf), None, "uid").select("uid", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j3_certificate_lookup(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("fp"), "c_name", "c_mktsegment", "c_acctbal")
    t = logs.with_certificate(sessions(spark, sf), "chain", c, "fp", ["c_acctbal", "c_name"])
    return t.select("o_orderkey", "c_name", "c_mktsegment")


CERTIFICATES = """ce AS (SELECT c_custkey::VARCHAR AS key, c_name AS subject, c_mktsegment AS issuer,
(1000000 + c_nationkey)::VARCHAR AS begin FROM customer)"""


@query(f"WITH {CERTIFICATES} SELECT o_orderkey, subject, issuer, begin, NULL::VARCHAR AS \"end\" FROM orders LEFT JOIN ce ON o_custkey::VARCHAR = key")
def j3_certificate_names(spark, sf):
    """A certificate log with names of both kinds and without an end of validity."""
    certificates = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("certificate.subject"),
        F.col("c_mktsegment").alias("issuer"),
        (1000000 + F.col("c_nationkey")).alias("certificate.not_valid_before"),
    )
    t = sessions(spark, sf).withColumnRenamed("chain", "cert_chain_fuids")
    return logs.with_named_certificate(t, certificates).select("o_orderkey", "subject", "issuer", "begin", "end")


@query(
    f"WITH {S.ENT}, lv AS ({S.long()}), tr AS (SELECT DISTINCT relation, value FROM lv WHERE split = 'train') SELECT relation, count(*) AS n_seen "
    "FROM lv JOIN tr USING (relation, value) WHERE split = 'test' GROUP BY 1"
)
def j5_value_membership(spark, sf):
    return audit.seen_values(split_events(spark, sf), RELATIONS).where("n_seen > 0").select("relation", "n_seen")


@query(
    f"WITH {S.ENT}, a AS (SELECT DISTINCT via_prop AS v FROM ent WHERE split = 'test' AND via_prop IS NOT NULL), "
    "b AS (SELECT DISTINCT via_prop AS v FROM ent WHERE split = 'train' AND via_prop IS NOT NULL) SELECT (SELECT count(*) FROM (FROM a INTERSECT "
    "FROM b)) AS n_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n_only_test"
)
def t2_value_sets(spark, sf):
    return audit.value_sets(split_events(spark, sf), "via_prop").select("n_both", "n_only_test")


@query("""SELECT scenario, class, count(*) AS n_sessions, count(DISTINCT CASE WHEN server <> '0' THEN server END) AS n_servers, CASE WHEN count(DISTINCT CASE WHEN server <> '0' THEN server END) <= 1 THEN 'one server' ELSE 'usable' END AS finding FROM
(SELECT o_orderpriority AS scenario, coalesce(CASE WHEN n_regionkey = 0 THEN 'infected' WHEN n_regionkey = 1 THEN 'normal' END, 'background') AS class, (o_orderkey % 97)::VARCHAR AS server FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1, 2""")
def a27_host_suitability(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("scenario"), F.col("o_custkey").alias("host"), (F.col("o_orderkey") % 97).cast("string").alias("server"))
    n = read(spark, sf, "nation").where("n_regionkey in (0, 1)").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") == 0, "infected").otherwise("normal").alias("class"))
    h = read(spark, sf, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("host"), "class")
    hosts = o.select("scenario", "host").distinct().join(h, "host")
    return audit.host_suitability(o, hosts)


@query(f"SELECT event_id, ({S.valid('user_id')}) IS NOT NULL AS valid FROM events")
def w1_valid_values(spark, sf):
    return read(spark, sf, "events").select("event_id", V.is_valid(F.col("user_id")).alias("valid"))


ISSUERS = ("CN=R3,O=Let''s Encrypt", "CN=DigiCert TLS", "Sectigo RSA", "cloudflare inc", "amazon rsa ca", "Self-Signed host", "O=Example", "plain", "-")
ISSUER_OF = ("PublicCA_LetsEncrypt", "PublicCA_DigiCert", "PublicCA_Sectigo", "PublicCA_Cloudflare", "PublicCA_Amazon", "SelfSigned", "PublicCA_Other", "Private_or_Unknown", "")


@query(f"SELECT c_custkey, ({list(ISSUER_OF)})[(c_custkey % 9 + 1)::INT] AS bucket FROM customer")
def f1_issuer_bucket(spark, sf):
    names = F.array(*[F.lit(x.replace("''", "'")) for x in ISSUERS])
    return read(spark, sf, "customer").select("c_custkey", V.issuer_bucket(F.get(names, (F.col("c_custkey") % 9).cast("int"))).alias("bucket"))


SUITES = (("TLSv13", "TLS_AES_256_GCM_SHA384", "TLSv13_AES_GCM"), ("TLSv12", "ECDHE_RSA_AES_CBC", "TLSv12_ECDHE_CBC_Legacy"), ("TLS-1.2", "X", "Unknown"), ("TLSv10", "RSA", "TLSv1x_Legacy_Deprecated"), ("SSLv3", "RC4", "SSL_Deprecated"), ("", "", ""))


@query(
    f"SELECT c_custkey, ({[s[2] for s in SUITES]})[(c_custkey % 6 + 1)::INT] AS bucket, md5(({[s[0] for s in SUITES]})[(c_custkey % 6 + 1)::INT] || "
    f"'|' || ({[s[1] for s in SUITES]})[(c_custkey % 6 + 1)::INT]) AS fingerprint FROM customer"
)
def f2_f4_cipher_group(spark, sf):
    at = (F.col("c_custkey") % 6).cast("int")
    v, c = (F.get(F.array(*[F.lit(s[i]) for s in SUITES]), at) for i in (0, 1))
    return read(spark, sf, "customer").select("c_custkey", V.cipher_group(v, c).alias("bucket"), V.version_cipher_fingerprint(v, c).alias("fingerprint"))


@query("""SELECT l_orderkey, md5(concat(l_orderkey % 5 + 769, ',', string_agg(l_partkey, '-' ORDER BY l_linenumber, l_partkey, l_suppkey), ',',
string_agg(l_suppkey, '-' ORDER BY l_linenumber, l_partkey, l_suppkey), ',,',
coalesce(string_agg(l_linenumber, '-' ORDER BY l_linenumber) FILTER (l_linenumber > 1), ''))) AS fingerprint
FROM lineitem GROUP BY 1""")
def f4_handshake_fingerprint(spark, sf):
    """An order's lines as a handshake's lists, one of which is missing and one often empty."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    t = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(lines.alias("x"))
    later = F.filter("x.l_linenumber", lambda n: n > 1)
    none = F.lit(None).cast("array<int>")
    found = V.handshake_fingerprint(F.col("l_orderkey") % 5 + 769, F.col("x.l_partkey"), F.col("x.l_suppkey"), none, later)
    return t.select("l_orderkey", found.alias("fingerprint"))


@query("""SELECT o_orderkey, CASE WHEN d <= 0 THEN 'unknown' WHEN d <= 7 THEN 'validity_0_7d' WHEN d <= 30 THEN 'validity_8_30d' WHEN d <= 90 THEN 'validity_31_90d' WHEN d <= 398 THEN 'validity_91_398d' WHEN d <= 825 THEN 'validity_399_825d' ELSE 'validity_long_2y_plus' END AS bucket
FROM (SELECT o_orderkey, o_orderkey % 1000 AS d FROM orders)""")
def f3_validity_bucket(spark, sf):
    d = F.col("o_orderkey") % 1000
    return read(spark, sf, "orders").select("o_orderkey", V.validity_bucket(F.lit("1000000"), F.when(d <= 0, F.lit("-")).otherwise((F.lit(1000000) + d * 86400).cast("string"))).alias("bucket"))


@query(f"WITH {S.ENTITIES} SELECT id, via_timebin FROM e0")
def f5_time_bin(spark, sf):
    return events(spark, sf).select("id", "via_timebin")


@query("SELECT event_id, epoch_us(ts) / 1e6 AS from_iso, CASE WHEN event_id % 2 = 0 THEN event_id::DOUBLE ELSE 0.0 END AS from_text FROM events")
def f6_time_parse(spark, sf):
    t = read(spark, sf, "events")
    return t.select("event_id", V.parse_time(F.col("ts").cast("string")).alias("from_iso"), V.parse_time(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("soon")).alias("from_text"))


@query(
    "SELECT event_id, md5(concat_ws('|', '42', event_type, event_id)) AS h, ('0x' || substr(md5(concat_ws('|', '42', event_id)), 1, "
    "8))::BIGINT AS k, round(ln(1 + user_id), 6) AS log_count FROM events"
)
def f7_f8_hash_and_log(spark, sf):
    return read(spark, sf, "events").select("event_id", V.seeded_hash(42, F.col("event_type"), F.col("event_id")).alias("h"), V.hash_number(42, F.col("event_id")).alias("k"), F.round(V.log_count(F.col("user_id")), 6).alias("log_count"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS first FROM orders")
def f9_first_of_list(spark, sf):
    return sessions(spark, sf).select("o_orderkey", V.first_of_list(F.col("chain")).alias("first"))


@query("SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem")
def f10_endpoint_order(spark, sf):
    e = V.endpoints(F.col("l_partkey"), F.lit(1), F.col("l_suppkey"), F.lit(1))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", e["low"]["ip"].alias("low"), e["high"]["ip"].alias("high"))


@query(
    "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'a') THEN 'has_a' WHEN contains(lower(p_name), 'e') THEN 'has_e' END AS by_substring, "
    "CASE WHEN contains(lower(p_name), 'part') THEN 'part' WHEN contains(lower(p_name), 'p') THEN 'p' END AS by_longest, "
    "CASE WHEN starts_with(p_name, 'P') THEN 'upper' WHEN starts_with(p_name, 'p') THEN 'lower' END AS family FROM part"
)
def f12_f15_f19_labels(spark, sf):
    n = F.col("p_name")
    return read(spark, sf, "part").select("p_partkey", V.label_by_substring(n, (("a", "has_a"), ("e", "has_e"))).alias("by_substring"), V.label_by_longest(n, ("p", "part")).alias("by_longest"), V.family(n, (("P", "upper"), ("p", "lower"))).alias("family"))


@query("""SELECT event_id, CASE WHEN event_type LIKE '%e%' THEN 'kind_e' WHEN event_type LIKE '%i%' THEN 'kind_i' ELSE 'kind_other' END AS category
FROM events""")
def f13_file_name_label(spark, sf):
    path = F.concat(F.lit("/line/in/"), F.upper("event_type"))
    label = V.label_by_file_name(path, ("kind_e", "kind_i"), "kind_other")
    return read(spark, sf, "events").select("event_id", label.alias("category"))


@query("""SELECT event_id, event_type AS label, (event_type <> 'view')::INT AS positive,
CASE WHEN starts_with(event_type, 'e') THEN 'E' WHEN starts_with(event_type, 'c') THEN 'C' END AS family
FROM events WHERE event_id % 5 > 1""")
def w7_labelled_rows(spark, sf):
    """Rows whose label is not blank; every fifth one is blank, every fifth missing."""
    raw = F.when(F.col("event_id") % 5 > 1, F.concat(F.lit(" "), F.upper("event_type"))).when(F.col("event_id") % 5 == 1, "  ")
    t = read(spark, sf, "events").select("event_id", V.clean_label(raw).alias("label")).where("label is not null")
    positive = V.binary_label(F.col("label"), negative=("view",)).alias("positive")
    return t.select("event_id", "label", positive, V.family(F.col("label"), (("e", "E"), ("c", "C"))).alias("family"))


@query(
    "SELECT event_id, 'random' AS mode, user_id AS split_seed, NULL::BIGINT AS edge_seed, NULL::DOUBLE AS test_size, event_type AS folder, "
    "(event_type IN ('error', 'view'))::INT AS positive, (event_type NOT IN ('view'))::INT AS not_view FROM events"
)
def f14_f16_f18_decode(spark, sf):
    t = read(spark, sf, "events")
    d = V.decode_variant(F.concat(F.lit("random_s"), F.col("user_id").cast("string")))
    path = F.concat(F.lit("/data/"), F.col("event_type"), F.lit("/file.log"))
    return t.select("event_id", *[c.alias(k) for k, c in d.items()], V.folder(path).alias("folder"), V.binary_label(F.col("event_type"), positive=("error", "view")).alias("positive"), V.binary_label(F.col("event_type"), negative=("view",)).alias("not_view"))


@query("SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS code, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def f17_f20_label_map(spark, sf):
    from kinweave.operators.ranking import position_by_order

    t = read(spark, sf, "events")
    codes = position_by_order(t.select("event_type").distinct(), [], ["event_type"]).select("event_type", F.col("pos").cast("int").alias("code"))
    return t.join(codes, "event_type").select("event_id", "code", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY o_orderkey) - 1 AS occurrence FROM orders"
)
def v4_occurrence_index(spark, sf):
    from kinweave.operators.ranking import position_by_order

    return position_by_order(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "n", F.col("pos").alias("occurrence"))


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderdate) - 1) / 2.0 AS avg_rank FROM orders")
def v5_average_rank(spark, sf):
    from kinweave.operators.ranking import average_rank

    return average_rank(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [], "o_orderdate").select("o_orderkey", "avg_rank")


@query(
    "SELECT o_orderpriority, o_custkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_custkey) AS r "
    "FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r <= 10"
)
def v6_top_values(spark, sf):
    return audit.top_values(read(spark, sf, "orders"), "o_orderpriority", "o_custkey").drop("share")


@query("SELECT md5(concat(c_custkey, '|', c_name, '|', c_mktsegment)) AS row_hash FROM customer")
def p10_row_identity(spark, sf):
    return read(spark, sf, "customer").select(F.md5(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")).alias("row_hash"))


@query("""SELECT event_id, md5(key || CASE WHEN k > 0 THEN '#' || k ELSE '' END) AS row_hash FROM
(SELECT event_id, key, row_number() OVER (PARTITION BY key ORDER BY event_id) - 1 AS k FROM
(SELECT event_id, concat_ws('|', user_id % 50, event_type, event_id % 3) AS key FROM events))""")
def p10_repeated_identity(spark, sf):
    """Identity by the three tuple columns that are there; rows that repeat a tuple are numbered."""
    from kinweave.operators.features import row_identity

    t = read(spark, sf, "events").select(
        "event_id",
        (F.col("user_id") % 50).alias("src_ip"),
        F.col("event_type").alias("dst_ip"),
        (F.col("event_id") % 3).alias("dport"),
    )
    return row_identity(t, ["event_id"], ("src_ip", "sport", "dst_ip", "dport", "ts")).select("event_id", "row_hash")
