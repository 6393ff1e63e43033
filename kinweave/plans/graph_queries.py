"""Queries on splits and relation graphs of the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import audit, controls, graph, splits
from kinweave.operators.ranking import kept, scratch
from kinweave.plans import sql as S
from kinweave.sources.tables import RELATIONS, events, labelled_documents, read, split_events, union_frames
from kinweave.streaming import flows

REGISTERED: dict = {}
E_ = S.ENT
r = lambda x: f"round({x}, 6)"


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def rows_with_ends(spark, sf):
    """What graphs need of the split rows, and edges that carry both ends' label and split."""
    t = kept(split_events(spark, sf, *RELATIONS).select("id", "label", "split", *RELATIONS))
    return t, graph.build_with_ends(t, RELATIONS, S.BUDGET, S.SEED)


def edges_of(t, degree=S.BUDGET, seed=S.SEED):
    return graph.build(t, RELATIONS, degree, seed)


@query(f"WITH {E_} SELECT id, label, split FROM ent")
def v1_time_split_in_class(spark, sf):
    return split_events(spark, sf).select("id", "label", "split")


@query(f"""WITH {S.ENTITIES}, p AS (SELECT id, row_number() OVER (ORDER BY ts, id) - 1 AS pos, count(*) OVER () AS n FROM e0)
SELECT id, {S.cut("n - floor(n * 0.2)::BIGINT - floor(n * 0.1)::BIGINT", "floor(n * 0.1)::BIGINT")} AS split FROM p""")
def v2_time_split(spark, sf):
    return splits.by_time(events(spark, sf)).select("id", "split")


def _random(seed: str, extra: str = "") -> str:
    return f"""SELECT id, label, {extra} {S.cut("n - round_even(n * 0.2, 0)::BIGINT - round_even(n * 0.1, 0)::BIGINT", "round_even(n * 0.1, 0)::BIGINT")} AS split FROM
  (SELECT *, count(*) OVER (PARTITION BY label, {seed}) AS n, row_number() OVER (PARTITION BY label, {seed} ORDER BY md5(concat_ws('|', {seed}, id)), id) - 1 AS pos FROM e1)"""


@query(f"WITH {S.ENTITIES}, e1 AS (SELECT *, '7' AS seed FROM e0) {_random('seed')}")
def v9_random_split(spark, sf):
    return splits.at_random(events(spark, sf), 7).select("id", "label", "split")


@query(
    f"WITH {S.ENTITIES}, e1 AS (SELECT *, unnest([41, 42, 43]) AS seed FROM e0) SELECT variant, label, split, count(*) AS n "
    f"FROM ({_random('seed::VARCHAR', chr(39) + 'random_s' + chr(39) + ' || seed AS variant,')}) GROUP BY ALL"
)
def m20_random_variants(spark, sf):
    return splits.variants(events(spark, sf), [41, 42, 43]).groupBy("variant", "label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.ENTITIES} SELECT 'cutoff_t0175' AS variant, label, split, count(*) AS n FROM {S.class_split(test="0.175")} GROUP BY ALL
UNION ALL SELECT 'cutoff_t0250', label, split, count(*) FROM {S.class_split(test="0.25")} GROUP BY ALL""")
def m20_cutoff_variants(spark, sf):
    return splits.cutoffs(events(spark, sf), [0.175, 0.25]).groupBy("variant", "label", "split").agg(F.count(F.lit(1)).alias("n"))


EDGE_SEEDS = (42, 7, 1234)


@query(f"WITH {S.ENT}, " + ", ".join(S.ring(f"e{x}", S.long(), 2, x) for x in EDGE_SEEDS) + " " + " UNION ALL ".join(f"SELECT {x} AS edge_seed, * FROM e{x}" for x in EDGE_SEEDS))
def m20_edge_seeds(spark, sf):
    """Graphs of one split under three edge seeds, in one job."""
    return graph.edge_variants(split_events(spark, sf), RELATIONS, 2, list(EDGE_SEEDS))


@query("""WITH u AS (SELECT DISTINCT user_id AS u FROM events), t AS (SELECT u, CASE u % 4 WHEN 0 THEN 'random_s' || u WHEN 1 THEN 'cutoff_t0175' WHEN 2 THEN 'edgeseed_s' || u ELSE 'random_s42' END AS variant FROM u),
v AS (SELECT DISTINCT variant, CASE WHEN u % 4 IN (0, 2) THEN u END AS u, u % 4 AS k FROM t)
SELECT variant, CASE WHEN k IN (0, 3) THEN 'random' ELSE 'time_in_class' END AS mode, CASE k WHEN 0 THEN u ELSE 42 END AS split_seed, CASE k WHEN 1 THEN 0.175 ELSE 0.2 END::DOUBLE AS test_size,
  CASE WHEN k = 0 AND u <> 42 AND u % 12 = 0 THEN 5 WHEN k = 0 AND u <> 42 AND u % 8 = 0 THEN 6 WHEN k IN (0, 2) THEN u ELSE 42 END AS edge_seed,
  CASE WHEN k = 0 AND u % 12 = 0 THEN 'run record' WHEN k = 0 AND u <> 42 AND u % 8 = 0 THEN 'edge record' WHEN k = 0 AND u <> 42 THEN 'none' ELSE 'name' END AS edge_seed_source,
  k = 0 AND u <> 42 AND u % 12 <> 0 AND u % 8 <> 0 AS legacy_coupled_seed FROM v""")
def m21_restored_protocols(spark, sf):
    """Protocols of old runs from records of the run, records of an edge rebuild, or their names."""
    u = read(spark, sf, "events").select(F.col("user_id").alias("u")).distinct()
    k, n = F.col("u") % 4, F.col("u").cast("string")
    name = F.when(k == 0, F.concat(F.lit("random_s"), n)).when(k == 1, "cutoff_t0175").when(k == 2, F.concat(F.lit("edgeseed_s"), n)).otherwise("random_s42")
    t = u.withColumn("variant", name)
    exact = t.where((k == 0) & (F.col("u") % 12 == 0)).select("variant", F.lit("random").alias("mode"), F.col("u").alias("split_seed"), F.lit(0.2).alias("test_size"), F.lit(5).cast("long").alias("edge_seed"))
    rebuilt = t.where((k == 0) & (F.col("u") % 8 == 0)).select("variant", F.lit(6).cast("long").alias("edge_seed"))
    return splits.restore_protocol(t, exact, rebuilt)


@query(
    f"WITH {S.ENTITIES} SELECT 'random_s' || s AS variant, s AS split_seed, 42 AS edge_seed, true AS edge_seed_recorded, "
    "false AS legacy_coupled_seed FROM (SELECT unnest([41, 43]) AS s) WHERE (SELECT count(*) FROM e0) > 0"
)
def m21_protocol(spark, sf):
    return splits.protocol(splits.variants(events(spark, sf), [41, 43]), 42)


@query(f"""WITH {S.ENTITIES}, p AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '5', id)), id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM e0)
SELECT id, label FROM p WHERE pos < CASE WHEN total <= 2000 THEN n ELSE least(n, greatest(50, round_even(n * (2000 / greatest(total, 1)), 0)::BIGINT)) END""")
def v8_class_quota(spark, sf):
    return splits.class_quota(events(spark, sf), 2000, 5).select("id", "label")


@query()
def m15_group_split(spark, sf):
    return splits.by_group(events(spark, sf), "user_id", 3).select("id", "user_id", "split")


@query(f"WITH {E_} SELECT id, (('0x' || substr(md5(concat_ws('|', '0', id)), 1, 8))::BIGINT % 5)::INT AS fold FROM ent WHERE split = 'train'")
def v10_folds(spark, sf):
    return splits.folds(split_events(spark, sf), 5, 0).where("fold is not null").select("id", "fold")


@query(f"WITH {S.EDGES} SELECT * FROM edges")
def j8_relation_edges(spark, sf):
    return edges_of(split_events(spark, sf))


@query(f"WITH {S.ENT}, {S.ring('edges', S.long(('via_user',)), 4, 7)} SELECT src, dst FROM edges")
def j7_ring_budget_four(spark, sf):
    return graph.build(split_events(spark, sf), ["via_user"], 4, 7).select("src", "dst")


@query(f"""WITH {S.EDGES}, c AS (SELECT relation, count(*) AS n FROM edges GROUP BY 1)
SELECT t.relation, coalesce(n, 0) AS n_edges, coalesce(n, 0) > 0 AS used, CASE WHEN t.relation = 'via_sni' THEN 'column missing' WHEN coalesce(n, 0) = 0 THEN 'no shared values' END AS reason
FROM (VALUES ('via_user'), ('via_prop'), ('via_timebin'), ('via_sni')) t(relation) LEFT JOIN c USING (relation)""")
def j8_relation_status(spark, sf):
    t = split_events(spark, sf)
    return graph.relation_status(t, edges_of(t), [*RELATIONS, "via_sni"])


HOMOPHILY = """, t AS ({ends}), c AS (SELECT sum(c) AS n, sum(c * c) / pow(sum(c), 2) AS chance FROM (SELECT count(*) AS c FROM ent GROUP BY label)),
k AS (SELECT relation, count(DISTINCT src) AS covered FROM {edges} GROUP BY 1),
s AS (SELECT relation, count(*) AS m, avg((sl = dl)::INT) AS h, avg((ss <> ds)::INT) AS x, avg(((ss = 'train' AND ds = 'test') OR (ss = 'test' AND ds = 'train'))::INT) AS tt FROM t GROUP BY 1)
SELECT relation, m AS n_edges, round(h, 6) AS homophily, round(chance, 6) AS chance, round(h - chance, 6) AS lift, round((h - chance) / (1 - chance), 6) AS normalised, round(m / n, 6) AS mean_degree,
(n - covered)::BIGINT AS isolated, round(covered / n, 6) AS reach, round(x, 6) AS cross_partition, round(tt, 6) AS train_test_share FROM s JOIN k USING (relation), c"""


@query(f"WITH {S.EDGES}" + HOMOPHILY.format(ends=S.ENDS.format(edges="edges"), edges="edges"))
def a18_homophily(spark, sf):
    t = split_events(spark, sf)
    return audit.homophily(t, edges_of(t))


@query(f"WITH {S.EDGES}" + HOMOPHILY.format(ends=S.ENDS.format(edges="edges"), edges="edges"))
def a18_homophily_with_ends(spark, sf):
    """The same from edges that carry their ends, which pays once rows are too many to be broadcast."""
    return audit.homophily(*rows_with_ends(spark, sf))


@query(
    f"WITH {S.EDGES}, t AS ({S.ENDS.format(edges='edges')}) SELECT relation, ss AS src_split, ds AS dst_split, count(*) AS n_edges FROM t "
    "GROUP BY ALL"
)
def a18_edge_pairs(spark, sf):
    return audit.edge_pairs(*rows_with_ends(spark, sf))


STRUCTURE = f"""WITH {S.EDGES}, d AS (SELECT relation, src AS id, count(*) AS degree FROM edges GROUP BY 1, 2),
g AS (SELECT id, label, unnest({list(S.RELATIONS)}) AS relation FROM ent), t AS (SELECT g.*, coalesce(degree, 0) AS degree FROM g LEFT JOIN d USING (relation, id)),
v AS (SELECT relation, count(*) AS covered FROM ({S.long()}) GROUP BY 1),
s AS (SELECT relation, count(*) AS n, sum(degree)::BIGINT AS n_edges, sum((degree > 0)::INT)::BIGINT AS incident, round(avg(degree), 6) AS mean_degree, round(avg(degree) FILTER (label = 0), 6) AS degree_negative, round(avg(degree) FILTER (label <> 0), 6) AS degree_positive, max(degree) AS max_degree FROM t GROUP BY 1),
st AS (SELECT s.*, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / n, 6) AS coverage, round(incident / n, 6) AS incidence FROM s LEFT JOIN v USING (relation))"""


@query(STRUCTURE + " SELECT * FROM st")
def a19_structure(spark, sf):
    t = split_events(spark, sf)
    return audit.structure(t, edges_of(t), RELATIONS)


@query(STRUCTURE + (
    " SELECT relation, 'incident_within_covered' AS \"check\", incident <= covered AS passed FROM st UNION ALL "
    "SELECT relation, 'has_edges', n_edges > 0 FROM st UNION ALL SELECT relation, 'symmetric_count', n_edges % 2 = 0 FROM st UNION ALL "
    "SELECT relation, 'flow_count', n = (SELECT count(*) FROM events) FROM st"
))
def a28_relation_checks(spark, sf):
    t = split_events(spark, sf)
    return audit.check_relations(t, edges_of(t), RELATIONS, read(spark, sf, "events").count())


MASKED = f"WITH {S.EDGES}, masked AS (SELECT relation, src, dst FROM ({S.ENDS.format(edges='edges')}) WHERE ss = ds)"


@query(MASKED + " SELECT * FROM masked")
def w4_mask_cross_partition(spark, sf):
    t = split_events(spark, sf)
    return controls.mask_cross_partition(t, edges_of(t))


@query(MASKED + (
    ", b AS (SELECT DISTINCT relation, src AS id FROM edges), a AS (SELECT DISTINCT relation, src AS id, 1 AS k FROM masked) "
    "SELECT relation, count(*) AS nodes_before, count(k) AS nodes_after, count(*) FILTER (split = 'test') AS test_before, "
    "count(*) FILTER (split = 'test' AND k = 1) AS test_after FROM b LEFT JOIN a USING (relation, id) JOIN ent USING (id) GROUP BY 1"
))
def a25_mask_nodes(spark, sf):
    t = split_events(spark, sf)
    e = edges_of(t)
    return audit.node_reach(t, e, controls.mask_cross_partition(t, e))


@query(MASKED + (
    ", m AS (SELECT relation, src, dst, max(a) AS a, max(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM edges UNION ALL SELECT *, 0, 1 FROM masked) "
    "GROUP BY ALL) SELECT relation, sum(a * b)::BIGINT AS both, sum(a * (1 - b))::BIGINT AS only_first, sum(b * (1 - a))::BIGINT AS only_second, "
    "CASE WHEN sum(a) = 0 OR sum(b) = 0 THEN 'one side only' WHEN sum(a + b - 2 * a * b) = 0 THEN 'identical' ELSE 'different' END AS verdict "
    "FROM m GROUP BY 1"
))
def t3_graph_difference(spark, sf):
    t = split_events(spark, sf)
    e = edges_of(t)
    return graph.difference(e, controls.mask_cross_partition(t, e))


@query(f"WITH {E_}, {S.TRAIN} SELECT * FROM train_edges")
def j11_train_graph(spark, sf):
    return graph.train_only(split_events(spark, sf), RELATIONS, S.BUDGET, S.SEED)


@query(f"WITH {E_}, {S.ATTACH} SELECT * FROM attached")
def j9_inductive_attachment(spark, sf):
    return graph.inductive(split_events(spark, sf), RELATIONS, S.BUDGET, S.SEED)[1]


@query(f"""WITH {E_}, {S.ATTACH}, {S.TRAIN}, n AS (SELECT count(*) FILTER (split <> 'train') AS n_new, count(*) FILTER (split = 'test') AS n_test FROM ent),
i AS (SELECT relation, dst, 1 AS b, 0 AS a FROM train_edges UNION ALL SELECT relation, dst, 0, 1 FROM attached),
d AS (SELECT relation, split, sum(b) AS b, sum(a) AS a FROM i JOIN ent ON dst = id GROUP BY relation, dst, split)
SELECT relation, sum(b)::BIGINT AS train_edges, sum(a)::BIGINT AS attach_edges, max(a)::BIGINT AS max_in_degree, n_test - count(*) FILTER (split = 'test' AND a > 0) AS isolated_test,
  round(1 - count(*) FILTER (split = 'test' AND a > 0) / n_test, 6) AS isolated_rate, round(count(*) FILTER (split <> 'train' AND a > 0) / n_new, 6) AS attach_rate,
  round(count(*) FILTER (split = 'test' AND a > 0) / n_test, 6) AS attach_rate_test, coalesce(max(b) FILTER (split = 'train'), 0)::BIGINT AS train_in_degree_before,
  coalesce(max(a + b) FILTER (split = 'train'), 0)::BIGINT AS train_in_degree_after, coalesce(sum(a) FILTER (split = 'train'), 0) = 0 AS train_in_degree_unchanged
FROM d, n GROUP BY relation, n_new, n_test""")
def a26_attachment_report(spark, sf):
    t = split_events(spark, sf, *RELATIONS)
    return audit.attachment_report(t, *graph.inductive(t, RELATIONS, S.BUDGET, S.SEED))


@query(
    f"WITH {E_}, {S.ATTACH} SELECT relation, count(*) AS n_edges, 0::BIGINT AS src_not_train, 0::BIGINT AS dst_in_train, 0::BIGINT AS over_budget, "
    "0::BIGINT AS two_hop FROM attached GROUP BY 1"
)
def j17_attachment_violations(spark, sf):
    t = split_events(spark, sf)
    return graph.attach_violations(graph.inductive(t, RELATIONS, S.BUDGET, S.SEED)[1], t, S.BUDGET)


@query(f"""WITH {E_}, x AS (SELECT id, split, label, CASE WHEN via_user IS NOT NULL THEN 'b' || (('0x' || substr(md5(concat_ws('|', '9', id)), 1, 8))::BIGINT % 500) END AS via_random FROM ent),
{S.ring("edges", S.long(("via_random",), "x"), 2, 9)} SELECT src, dst FROM edges""")
def j12_random_edges_matched(spark, sf):
    t = graph.random_buckets(split_events(spark, sf), 500, 9, "via_user")
    return graph.build(t, ["via_random"], 2, 9).select("src", "dst")


@query("SELECT 'self' AS relation, event_id AS src, event_id AS dst FROM events")
def j13_self_loops(spark, sf):
    return graph.self_loops(events(spark, sf))


@query(f"WITH {S.EDGES} SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst")
def j14_union_graph(spark, sf):
    return graph.union_graph(edges_of(split_events(spark, sf)))


@query(f"""WITH l AS (SELECT row_number() OVER () AS k, l_suppkey, l_partkey FROM lineitem) SELECT coalesce({S.valid("l_suppkey")}, 's:' || coalesce(l_suppkey::VARCHAR, '')) AS src_node, coalesce({S.valid("l_partkey")}, 'd:' || coalesce(l_partkey::VARCHAR, '')) AS dst_node, count(*) AS n FROM l GROUP BY 1, 2""")
def j15_endpoint_graph(spark, sf):
    t = read(spark, sf, "lineitem").select(F.lit(0).alias("id"), "l_suppkey", "l_partkey")
    return graph.endpoint_graph(t, "l_suppkey", "l_partkey").groupBy("src_node", "dst_node").agg(F.count(F.lit(1)).alias("n"))


COMPONENTS = f"""WITH RECURSIVE {S.EDGES.removeprefix("WITH ")},
r(relation, v, m) AS (SELECT relation, id, id FROM ent, (SELECT unnest({list(S.RELATIONS)}) AS relation) UNION SELECT e.relation, e.dst, r.m FROM r JOIN edges e ON r.relation = e.relation AND r.v = e.src WHERE r.m < e.dst),
c AS (SELECT relation, v AS id, min(m) AS component FROM r GROUP BY 1, 2)"""


COMPONENTS_MASKED = COMPONENTS.replace("r(relation, v, m)", (
    "masked AS MATERIALIZED (SELECT e.* FROM edges e JOIN ent s ON e.src = s.id JOIN ent d ON e.dst = d.id "
    "WHERE s.split = d.split),\nr(relation, v, m)"
)).replace("r JOIN edges e", "r JOIN masked e")


@query(COMPONENTS + " SELECT * FROM c")
def m19_components(spark, sf):
    return graph.value_components(events(spark, sf), RELATIONS)


@query(COMPONENTS + (
    ", s AS (SELECT relation, count(*) AS size FROM c GROUP BY relation, component) "
    "SELECT relation, count(*) AS n_components, max(size) AS largest, quantile_cont(size, 0.5)::DOUBLE AS median_size, "
    "sum((size = 1)::INT)::BIGINT AS isolates FROM s GROUP BY 1"
))
def m19_component_sizes(spark, sf):
    return audit.component_sizes(m19_components(spark, sf), ("relation",))


@query(COMPONENTS_MASKED + " SELECT * FROM c")
def m19_masked_components(spark, sf):
    """Of the graphs without edges across splits, by runs on the rings."""
    return graph.masked_value_components(split_events(spark, sf), RELATIONS, S.BUDGET, S.SEED)


@query(f"""WITH RECURSIVE {S.EDGES.removeprefix("WITH ")}, u AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE relation IN ('via_timebin', 'via_user')),
r(id, component) USING KEY (id) AS (SELECT id, id FROM ent UNION
  (SELECT a.id, min(b.component) FROM recurring.r a JOIN u ON u.src = a.id JOIN r b ON b.id = u.dst WHERE b.component < a.component GROUP BY a.id))
SELECT id, component FROM r""")
def m19_union_components(spark, sf):
    """Of two relations together, from rows and values without making edges."""
    return graph.union_components(events(spark, sf), ["via_timebin", "via_user"])


@query(f"WITH {S.EDGES} SELECT relation, src AS id, count(*) AS degree FROM edges GROUP BY 1, 2")
def a20_degrees(spark, sf):
    return graph.degrees(edges_of(split_events(spark, sf)))


@query(f"WITH {S.EDGES} SELECT DISTINCT src, dst FROM edges WHERE src <> dst")
def w8_clean_edges(spark, sf):
    return graph.clean_edges(edges_of(split_events(spark, sf)).select("src", "dst").unionByName(graph.self_loops(events(spark, sf)).select("src", "dst")))


PERMUTED = f"""p AS (SELECT id, via_user AS v, row_number() OVER (ORDER BY id) - 1 AS pos FROM e0 WHERE via_user IS NOT NULL),
q AS (SELECT via_user AS v, row_number() OVER (ORDER BY md5(concat_ws('|', '11:via_user', id)), id) - 1 AS pos FROM e0 WHERE via_user IS NOT NULL)"""


@query(f"WITH {S.ENTITIES}, {PERMUTED} SELECT e0.id, q.v AS via_user FROM e0 LEFT JOIN p ON e0.id = p.id LEFT JOIN q ON p.pos = q.pos")
def v7_value_permutation(spark, sf):
    return controls.permute_values(events(spark, sf).select("id", "via_user"), ["via_user"], 11).select("id", "via_user")


@query(
    f"WITH {S.ENTITIES}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM e0 "
    "WHERE via_user IS NOT NULL AND via_prop IS NOT NULL), q AS (SELECT via_user AS u, via_prop AS v, "
    "row_number() OVER (ORDER BY md5(concat_ws('|', '12:via_user+via_prop', id)), id) - 1 AS pos FROM e0 "
    "WHERE via_user IS NOT NULL AND via_prop IS NOT NULL) SELECT e0.id, coalesce(q.u, via_user) AS via_user, coalesce(q.v, via_prop) AS via_prop "
    "FROM e0 LEFT JOIN p ON e0.id = p.id LEFT JOIN q ON p.pos = q.pos"
)
def v7_joint_permutation(spark, sf):
    return controls.permute_values(events(spark, sf).select("id", "via_user", "via_prop"), ["via_user", "via_prop"], 12, joint=True).select("id", "via_user", "via_prop")


@query(f"WITH {S.ENTITIES} SELECT id, CASE WHEN trim(category) NOT IN ('view', 'click') THEN category END AS category FROM e0")
def w5_token_reversion(spark, sf):
    return controls.revert_tokens(events(spark, sf), "category", ("view", "click")).select("id", "category")


@query("SELECT event_id AS id, value, NULL::VARCHAR AS lang FROM events UNION ALL SELECT doc_id, NULL, lang FROM documents")
def t1_union_missing_columns(spark, sf):
    return union_frames([events(spark, sf).select("id", "value"), labelled_documents(spark, sf).select("id", F.col("via_lang").alias("lang"))])


def _stream(spark, sf, path="events"):
    schema = read(spark, sf, path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{path}.parquet").parquet(sf)


def _drained(df, mode="append"):
    """Runs a stream over what is there now and returns what it wrote."""
    spark = df.sparkSession
    root = scratch(spark, "stream")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").format("parquet").option("path", f"{root}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/rows")


@query(f"WITH {E_}, {S.ATTACH} SELECT * FROM attached")
def x1_stream_attachment(spark, sf):
    from kinweave.functions.values import epoch_seconds, time_bin, valid_value

    t = split_events(spark, sf)
    s = _stream(spark, sf).select(F.col("event_id").alias("id"), valid_value(F.col("user_id")).alias("via_user"), valid_value(F.get_json_object("props", "$.k")).alias("via_prop"), time_bin(epoch_seconds(F.col("ts"))).alias("via_timebin"))
    s = s.join(t.where("split <> 'train'").select("id", "split"), "id")
    return _drained(flows.attach_stream(s, graph.training_positions(t, RELATIONS, S.SEED), RELATIONS, S.BUDGET, S.SEED))


@query("""WITH t AS (SELECT time_bucket(INTERVAL 300 SECONDS, ts) AS start, event_id FROM events), m AS (SELECT max(ts) - INTERVAL 10 MINUTES AS w FROM events)
SELECT start::TIMESTAMP AS start, count(*) AS n, count(*) FILTER (event_id <> 0) AS n_valid, count(DISTINCT CASE WHEN event_id <> 0 THEN event_id END) AS n_values FROM t, m GROUP BY start, w HAVING start + INTERVAL 300 SECONDS <= w""")
def x2_stream_windows(spark, sf):
    s = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(flows.windowed_coverage(s, "ts", "event_id")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "n_valid", "n_values")


@query("""WITH t AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS begins FROM events),
s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM t), m AS (SELECT max(ts) - INTERVAL 10 MINUTES AS w FROM events)
SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s, m GROUP BY user_id, k, w HAVING max(ts) + INTERVAL 30 MINUTES <= w""")
def x3_stream_sessions(spark, sf):
    s = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(flows.session_flows(s, "ts", "user_id", "value")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
