"""Properties and hand-computed cases of the audit operators."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import values as V
from kinweave.operators import audit, compare, controls, feasibility, graph, learn, presence, ranking, splits
from kinweave.sources import logs, tables

SIZES = (147, 35, 12, 3, 2, 1)


@pytest.fixture(scope="module")
def flows(spark):
    rows, i = [], 0
    for g, size in enumerate(SIZES):
        for _ in range(size):
            rows.append((i, f"v{g}", i % 2, 1000.0 + i, ("train", "val", "test")[i % 3]))
            i += 1
    rows += [(i + k, x, 0, 0.0, "train") for k, x in enumerate(("", " - ", "nan", None, "0", "(empty)", "None"))]
    return spark.createDataFrame(rows, "id long, via string, label int, ts double, split string")


def pairs(edges):
    return sorted((r.src, r.dst) for r in edges.collect())


@pytest.mark.parametrize("degree", [2, 4, 6])
def test_ring_properties(flows, degree):
    found = pairs(graph.build(flows, ["via"], degree, 42))
    assert len(found) == len(set(found)) and all(a != b for a, b in found) and {(b, a) for a, b in found} == set(found)
    count = dict(zip(*np.unique([a for a, _ in found], return_counts=True), strict=True))
    at = 0
    for size in SIZES:
        assert all(count.get(i, 0) == min(degree, size - 1) for i in range(at, at + size))
        at += size
    assert max(count) < at  # missing values are joined to nothing


def test_ring_depends_on_seed_only(flows):
    base = pairs(graph.build(flows, ["via"], 2, 42))
    assert base == pairs(graph.build(flows.repartition(7).orderBy(F.desc("id")), ["via"], 2, 42))
    assert base != pairs(graph.build(flows, ["via"], 2, 43))


@pytest.mark.parametrize("degree", [1, 3, 5, 0, -2])
def test_odd_budgets_are_refused(flows, degree):
    with pytest.raises(ValueError):
        graph.build(flows, ["via"], degree, 1)


def test_hot_groups_are_ranked_in_pieces(flows):
    digest = F.md5(F.col("id").cast("string"))
    whole = ranking.position_by_hash(flows, ["via"], digest, "id").select("id", "pos").collect()
    cut = ranking.position_by_hash(flows, ["via"], digest, "id", piece_rows=10).select("id", "pos").collect()
    assert sorted(whole) == sorted(cut)
    whole = ranking.position_by_order(flows, ["via"], ["ts", "id"]).select("id", "pos").collect()
    cut = ranking.position_by_order(flows, ["via"], ["ts", "id"], piece_rows=10).select("id", "pos").collect()
    assert sorted(whole) == sorted(cut)


def test_pieces_are_dealt_over_tasks(spark):
    """A million rows, 95 % of one value: the exchange is by piece, and no task ranks the whole value."""
    t = spark.range(1_000_000).select("id", F.when(F.col("id") % 20 == 0, F.col("id") % 100).otherwise(-1).alias("v"))
    out = ranking.position_by_hash(t, ["v"], F.md5(F.col("id").cast("string")), "id", piece_rows=50_000)
    plan = out._jdf.queryExecution().toString()
    assert "REPARTITION_BY_COL" in plan and "_piece" in plan.split("REPARTITION_BY_COL")[0].rsplit("Exchange", 1)[-1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = out.where("v = -1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 500_000
    s = out.where("v = -1").agg(F.min("pos"), F.max("pos"), F.countDistinct("pos"), F.min("n"), F.max("n")).first()
    assert tuple(s) == (0, 949_999, 950_000, 950_000, 950_000)


def test_average_rank_in_ranges(flows):
    for keys in ([], ["via"]):
        whole = ranking.average_rank(flows.where("via like 'v%'"), keys, "ts").select("id", "avg_rank").collect()
        cut = ranking.average_rank(flows.where("via like 'v%'"), keys, "ts", piece_rows=10).select("id", "avg_rank").collect()
        assert sorted(whole) == sorted(cut)
    same = ranking.average_rank(flows.where("ts = 0").select("id", "ts"), [], "ts").collect()
    assert {r.avg_rank for r in same} == {(len(same) + 1) / 2}


def test_attachment(spark):
    def attached(values, n_train):
        df = spark.createDataFrame([(i, v, "train" if i < n_train else "test") for i, v in enumerate(values)], "id long, via string, split string")
        edges = graph.inductive(df, ["via"], 2, 42)[1]
        bad = graph.attach_violations(edges, df, 2).drop("relation", "n_edges").collect()
        assert all(x == 0 for r in bad for x in r)
        return pairs(edges)

    same = attached("A" * 12, 6)
    assert all(a < 6 <= b for a, b in same) and len(same) == 12 and len(set(same)) == 12
    unseen = attached("AAABBBCCAAZZ", 6)
    assert {b for _, b in unseen} == {8, 9}
    assert {b for _, b in attached("---AAA--A", 6)} == {8}
    values = "AAAABBBBABAB"
    assert all(values[a] == values[b] for a, b in attached(values, 8))


def test_distinct_draws(spark):
    t = spark.range(200).select("id", graph.distinct_draws(F.lit(5).cast("long"), 4, 1, F.col("id")).alias("d"))
    assert all(len(set(r.d)) == 4 and set(r.d) <= set(range(5)) for r in t.collect())


def test_time_split_rounds_half_to_even(spark):
    rows = [(100 * c + i, c, 5.0) for c, n in enumerate((2, 3, 5, 25)) for i in range(n)]
    t = splits.by_time_in_class(spark.createDataFrame(rows, "id long, label int, ts double"))
    got = {(r.label, r.split): r["count"] for r in t.groupBy("label", "split").count().collect()}
    assert got == {(0, "train"): 2, (1, "train"): 1, (1, "val"): 1, (1, "test"): 1, (2, "train"): 3, (2, "val"): 1, (2, "test"): 1, (3, "train"): 18, (3, "val"): 2, (3, "test"): 5}


def test_group_split_is_disjoint(flows):
    t = splits.by_group(flows, "via", 3).groupBy("via").agg(F.countDistinct("split").alias("k"))
    assert {r.k for r in t.where("via like 'v%'").collect()} == {1}


def test_first_fit_equals_a_walk(spark):
    rng = np.random.default_rng(1)
    for goal in (0, 1, 30, 200, 10_000):
        sizes = [int(x) for x in rng.integers(1, 40, 60)]
        groups = spark.createDataFrame([(f"g{i}", n, i) for i, n in enumerate(sizes)], "_g string, size long, at long")
        filled, expected = 0, set()
        for i, n in enumerate(sizes):
            if not expected or filled + n <= goal:
                filled += n
                expected.add(f"g{i}")
        taken, rows = splits.first_fit(groups, goal)
        assert {r["_g"] for r in taken.collect()} == expected and rows == filled


def test_learners_on_separable_rows(spark):
    """Each learner, the ablation and the comparisons tell classes apart that a column tells, and only then."""
    rows = [(i, i % 2, ("train", "val", "test")[i % 3], float(i % 2) * 3 + (i % 7) / 10, float(i), float(i % 5)) for i in range(240)]
    t = spark.createDataFrame(rows, "id long, label int, split string, good double, row_id double, noise double")
    for model in ("boosting", "linear"):
        m = compare.metrics(learn.fit_predict(t, ["good"], model), ["split"], 2).where("split = 'test'").first()
        assert m.accuracy == 1.0 and m.macro_f1 == 1.0 and m.n == 80
    sets = {(r.feature_set, r.fit_on): r.macro_f1 for r in learn.feature_set_comparison(t, {"good": ["good"], "noise": ["noise"]}, "linear").collect()}
    assert sets[("good", "train")] == 1.0 == sets[("good", "train+val")] and sets[("noise", "train")] < 0.8 and len(sets) == 4
    lost = {r.feature_set: r.inflation for r in learn.index_ablation(t, ["good", "row_id", "noise"], ["noise"]).collect()}
    assert lost["drop"] == 0 and set(lost) == {"keep", "drop", "drop_ports"}
    near = t.select(F.lit("r").alias("relation"), "id", F.col("good").alias("nbr_noise")).unionByName(t.select(F.lit("s").alias("relation"), "id", F.lit(0.0).alias("nbr_noise")))
    of = {r.relations: r.macro_f1 for r in learn.relation_sets(t, near, ["noise"], "r;s;r+s").collect()}
    assert of["r"] == 1.0 == of["r+s"] and of["s"] < 0.8


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (11, 12), (12, 13), (11, 13)]
    e = spark.createDataFrame(edges, "src long, dst long")
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 11, 12, 13, 20, 21)], "id long")
    c = graph.components(v, e)
    assert {r.id: r.component for r in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 11: 11, 12: 11, 13: 11, 20: 20, 21: 21}
    s = audit.component_sizes(c).first()
    assert (s.n_components, s.largest, s.isolates) == (4, 5, 2)
    assert graph.components(v, e.limit(0)).where("id = component").count() == 10


def test_homophily_by_hand(spark):
    df = spark.createDataFrame([(0, 0, "train"), (1, 0, "train"), (2, 1, "test"), (3, 1, "val"), (4, 0, "test"), (5, 1, "train")], "id long, label int, split string")
    e = spark.createDataFrame([("r", a, b) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1))], "relation string, src long, dst long")
    h = audit.homophily(df, e).first()
    assert (h.n_edges, h.homophily, h.chance, h.isolated, h.reach, h.cross_partition, h.train_test_share) == (4, 0.5, 0.5, 3, 0.5, 0.5, 0.5)
    assert pairs(controls.mask_cross_partition(df, e)) == [(0, 1), (1, 0)]


def test_presence_rule_by_hand(spark):
    rows = [("train", 1, "x"), ("train", 1, "x"), ("train", 0, None), ("train", 0, "x"), ("test", 1, "x"), ("test", 0, None), ("test", 0, "x"), ("test", 1, None)]
    df = spark.createDataFrame([(i, s, y, f) for i, (s, y, f) in enumerate(rows)], "id long, split string, label int, f string")
    r = presence.rules(presence.contingency(df, ["f"])).first()
    assert (r.polarity, round(r.macro_f1, 6)) == ("present_positive", 0.5)


def test_permutation_null_is_centred(spark):
    df = spark.createDataFrame([(i, ("train", "val", "test")[i % 3], (i // 3) % 2, "x" if (i // 6) % 2 else None) for i in range(600)], "id long, split string, label int, f string")
    s = presence.null_summary(presence.permutation_null(df, ["f"], 300, 7)).first()
    assert abs(s.null_mean - 0.5) < 0.03 and 0 <= s.p_value <= 1


def test_values_permuted_among_holders(flows):
    before = {r.id: r.via for r in flows.collect()}
    after = {r.id: r.via for r in controls.permute_values(flows, ["via"], 1).collect()}
    assert sorted(map(str, before.values())) == sorted(map(str, after.values())) and before != after
    assert all(after[i] == v for i, v in before.items() if v in ("", " - ", "nan", None, "0"))


def test_metrics_against_plain_formula(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 3, 200), rng.integers(0, 3, 200)
    r = compare.metrics(spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p, strict=True)], "label int, prediction int").withColumn("g", F.lit(1)), ["g"], 3).first()
    f1 = [2 * ((y == c) & (p == c)).sum() / ((y == c).sum() + (p == c).sum()) for c in range(3)]
    assert r.macro_f1 == pytest.approx(np.mean(f1), abs=1e-6) and r.accuracy == pytest.approx((y == p).mean(), abs=1e-6)


def test_failed_seeds_do_not_count(spark):
    t = spark.createDataFrame([("d", "a", 1, 0.5), ("d", "a", 2, -1.0), ("d", "a", 3, 0.7), ("d", "a", 4, None)], "dataset string, arm string, seed int, value double")
    r = compare.seed_summary(t, ["dataset", "arm"]).first()
    assert (r.n, r["mean"], r.values_sorted) == (2, 0.6, "0.5000,0.7000")


def test_tau(spark):
    scores = {"u": (1, 2, 3), "v": (3, 2, 1), "w": (5, 5, 5)}
    t = spark.createDataFrame([("d", k, str(i), float(s)) for k, v in scores.items() for i, s in enumerate(v)], "dataset string, variant string, item string, score double")
    assert {(r.a, r.b): r.tau for r in compare.tau(t).collect()} == {("u", "v"): -1, ("u", "w"): 0, ("v", "w"): 0}


def test_permutation_p_is_exhaustive_for_few(spark):
    t = spark.createDataFrame([("d", float(i), float(i)) for i in range(5)], "dataset string, x double, y double")
    r = compare.permutation_p(t).first()
    assert (r.r, r.n_permutations) == (1, 120) and r.p_value == pytest.approx(2 / 120, abs=1e-6)


def test_counter_probes(spark):
    rng = np.random.default_rng(3)
    n = 2000
    columns = {"row": np.arange(n), "gaps": rng.choice(2857, n, replace=False), "sparse": rng.choice(n * 5, n, replace=False), "duration": rng.exponential(1, n), "packets": rng.integers(1, 400, n), "bytes": rng.choice(10**8, n, replace=False)}
    df = spark.createDataFrame([(float(rng.random()), *[float(c[i]) for c in columns.values()]) for i in range(n)], ["ts", *columns])
    flags = {r.feature: r.counter for r in audit.feature_audit(df, list(columns)).collect()}
    assert flags == {"row": True, "gaps": True, "sparse": True, "duration": False, "packets": False, "bytes": False}


def test_feasibility(spark):
    rows = [(i, f"g{i % 6}", int(i % 12 >= 6)) for i in range(120)]
    good = spark.createDataFrame(rows, "id long, g string, label int")
    assert feasibility.search(good, "g", 20, 1).where("covered").count() > 0
    bad = spark.createDataFrame([(i, f"g{i % 2}", i % 2) for i in range(40)], "id long, g string, label int")
    assert feasibility.search(bad, "g", 20, 1).where("covered").count() == 0
    assert feasibility.axis_report(bad, "g").first().starved == "0,1"
    with pytest.raises(ValueError):
        feasibility.group_folds(bad, "g")


def test_scalar_rules(spark):
    cases = [("TLSv1.3", "TLS_CHACHA20"), ("TLSv12", "DHE-GCM"), ("TLSv11", ""), ("weird", "x"), ("", "")]
    t = spark.createDataFrame(cases, "v string, c string").select(V.cipher_group(F.col("v"), F.col("c")).alias("x"))
    assert [r.x for r in t.collect()] == ["TLSv1x_Legacy_Deprecated", "TLSv12_DHE_AES_GCM", "TLSv1x_Legacy_Deprecated", "Unknown", ""]
    v = spark.createDataFrame([("100", "50"), ("-", "9"), ("1", str(1 + 7 * 86400)), ("x", "y")], "a string, b string").select(V.validity_bucket(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in v.collect()] == ["invalid_range", "unknown", "validity_0_7d", "unknown"]
    p = spark.createDataFrame([("12.5",), ("2024-01-01 00:00:10",), ("?",), (None,)], "t string").select(V.parse_time(F.col("t")).alias("x"))
    assert [r.x for r in p.collect()] == [12.5, 1704067210.0, 0.0, 0.0]


def test_log_reader(spark, tmp_path):
    (tmp_path / "a.log").write_text("#separator x\n#fields\tuid\tbytes\tname\nC1\t10\t-\nC2\t-\tb\nshort\t1\n#close\n")
    rows = logs.read_log(spark, str(tmp_path), numeric=("bytes",)).collect()
    assert sorted(map(tuple, rows)) == [("C1", 10.0, None), ("C2", None, "b")]


def test_reverting_an_absent_token_fails(flows):
    with pytest.raises(ValueError):
        controls.revert_tokens(flows, "via", ("nothing",))


def test_unequal_seeds_drop_out(spark):
    t = spark.createDataFrame([(d, a, s, 0.1 * s) for d, a, s in itertools.product(("x", "y"), ("p", "q"), (1, 2)) if (d, a, s) != ("y", "q", 2)], "dataset string, arm string, seed int, value double")
    assert {r.dataset for r in compare.paired(t, "p", "q").collect()} == {"x"}


def test_decomposition_interval_of_a_negative_margin(spark):
    value = {"plain": 0.8, "loop": 0.7, "permuted": 0.55, "full": 0.5}
    t = spark.createDataFrame([("x", a, "v0", s, v) for a, v in value.items() for s in range(5)], "dataset string, arm string, variant string, seed int, value double")
    r = compare.decomposition_interval(t, *value, 120, 5).first()
    assert r.usable == 120 and r.low == r.high == pytest.approx(1 / 6, abs=1e-6)
    assert r.architecture_low == pytest.approx(-0.1) and r.availability_high == pytest.approx(-0.15) and r.value_semantics_low == pytest.approx(-0.05)
    assert r.architecture_share_low == pytest.approx(1 / 3, abs=1e-6) and r.availability_share_high == pytest.approx(0.5, abs=1e-6)


def test_draws_are_those_of_the_reference(spark):
    from kinweave.plans import registry

    rows = registry.queries()["m8_decomposition_interval"](spark, "/root/testdata/sf0.001").collect()
    assert rows and max(r.usable for r in rows) > 9000


def test_components_of_all_rows_and_relations(spark):
    from kinweave.plans import graph_queries as q

    sf = "/root/testdata/sf0.001"
    t = q.split_events(spark, sf)
    ids = [r.id for r in t.select("id").collect()]
    up = {(n, i): i for n in q.RELATIONS for i in ids}

    def root(n, i):
        while up[n, i] != i:
            up[n, i] = i = up[n, up[n, i]]
        return i

    for e in q.edges_of(t).collect():
        a, b = root(e.relation, e.src), root(e.relation, e.dst)
        up[e.relation, max(a, b)] = min(a, b)
    expected = {(n, i, root(n, i)) for n in q.RELATIONS for i in ids}
    got = [(r.relation, r.id, r.component) for r in q.m19_components(spark, sf).collect()]
    assert len(got) == len(expected) and set(got) == expected
    sizes = audit.component_sizes(spark.createDataFrame(got, "relation string, id long, component long"), ("relation",)).collect()
    assert {r.relation: r.n_components for r in sizes} == {n: len({c for m, _, c in expected if m == n}) for n in q.RELATIONS}


def test_union_of_frames(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert sorted(map(str, tables.union_frames([a, b]).collect())) == ["Row(x=1, y=None)", "Row(x=None, y=2)"]


def test_certificate_names_and_missing_columns(spark):
    s = spark.createDataFrame([("a", "f1,f2"), ("b", None), ("c", "zz")], "uid string, cert_chain_fps string")
    c = spark.createDataFrame([("f1", "one"), ("f1", "two")], "fingerprint string, `certificate.subject` string")
    got = {r["uid"]: (r["subject"], r["issuer"]) for r in logs.with_named_certificate(s, c).collect()}
    assert got == {"a": ("two", None), "b": (None, None), "c": (None, None)}
    bare = logs.with_named_certificate(s.select("uid"), c)
    assert bare.columns == ["uid", "subject", "issuer", "begin", "end"] and bare.where("subject is null").count() == 3
    with pytest.raises(ValueError):
        logs.named_certificates(c.select(F.lit(1).alias("other")))


def test_row_identity_needs_three_columns_and_parts_repeats(spark):
    from kinweave.operators.features import row_identity

    t = spark.createDataFrame([(1, "a", 1, None), (2, "a", 1, None), (3, "b", 1, 2)], "id long, src_ip string, sport int, ts int")
    names = ("src_ip", "sport", "dst_ip", "dport", "ts")
    got = [r["row_hash"] for r in row_identity(t, ["id"], names).orderBy("id").collect()]
    assert got == [hashlib.md5(x.encode()).hexdigest() for x in ("a|1|nan", "a|1|nan#1", "b|1|2")]
    with pytest.raises(ValueError):
        row_identity(t.drop("ts"), ["id"], names)


def test_labels_of_files_and_blank_labels(spark):
    t = spark.createDataFrame([("/x/Chat_1.log", " A "), ("/chat/none", "  "), ("/x/p2p-chat", None)], "path string, label string")
    kind = V.label_by_file_name(F.col("path"), ("t_chat", "t_p2p"), "t_other").alias("kind")
    got = t.select(kind, V.clean_label(F.col("label")).alias("label")).collect()
    assert [tuple(r) for r in got] == [("t_chat", "a"), ("t_other", None), ("t_chat", None)]
    h = V.handshake_fingerprint(F.lit(769), F.array(F.lit(4), F.lit(5)), F.lit(None).cast("array<int>"), F.array().cast("array<int>"))
    assert spark.range(1).select(h).first()[0] == hashlib.md5(b"769,4-5,,").hexdigest()


def test_edges_that_carry_their_ends(spark):
    rows = [(i, i % 3 % 2, ("train", "val", "test")[i % 3], "hot" if i % 3 else f"v{i % 7}", None if i == 5 else str(i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, split string, via_a string, via_b string")
    plain, carried = graph.build(df, ["via_a", "via_b"], 4, 3), graph.build_with_ends(df, ["via_a", "via_b"], 4, 3)
    of = {r[0]: r for r in rows}
    found = carried.collect()
    assert sorted((e.relation, e.src, e.dst) for e in found) == sorted(map(tuple, plain.collect()))
    assert all((e.src_label, e.src_split) == of[e.src][1:3] and (e.dst_label, e.dst_split) == of[e.dst][1:3] for e in found)
    for f in (audit.homophily, audit.edge_pairs, controls.mask_cross_partition):
        assert sorted(map(tuple, f(df, carried).collect())) == sorted(map(tuple, f(df, plain).collect()))
    nothing = df.where("false")
    assert audit.homophily(nothing, graph.build_with_ends(nothing, ["via_a"], 2, 3)).count() == 0


def test_value_sets_seen_values_and_top_values(spark):
    rows = [(1, "train", "a"), (2, "test", "a"), (3, "test", "b"), (4, "test", "b"), (5, "train", "c"), (6, "val", "b"), (7, "test", None), (8, "test", "-")]
    df = spark.createDataFrame(rows, "id long, split string, via_x string")
    assert tuple(audit.value_sets(df, "via_x").first()) == (1, 1, 1)
    assert tuple(audit.value_sets(df.where("false"), "via_x").first()) == (0, 0, 0)
    assert [tuple(r) for r in audit.seen_values(df, ["via_x"]).collect()] == [("via_x", 3, 1)]
    t = spark.createDataFrame([("g", "x"), ("g", "x"), ("g", "y"), ("g", "z"), (None, "q")], "k string, v string")
    found = {(r.k, r.v, r.n, r.share) for r in audit.top_values(t, "k", "v", 2).collect()}
    assert found == {("g", "x", 2, 0.5), ("g", "y", 1, 0.25), (None, "q", 1, 1.0)}


def test_edges_of_groups_in_pieces_are_those_of_whole_groups(spark):
    """Neighbours in sorted order and by position are the same."""
    draw = random.Random(6)
    rows = [(i, draw.choice(["hot"] * 6 + [f"v{draw.randrange(12)}"])) for i in range(260)]
    values = graph.long_values(spark.createDataFrame(rows, "id long, r string"), ["r"])
    pairs = lambda t: sorted((e.src, e.dst) for e in t.collect())
    for degree in (2, 4, 6):
        assert pairs(graph.ring_edges(values, degree, 3)) == pairs(graph.ring_edges(values, degree, 3, piece_rows=7))
    plan = graph.ring_edges(values, 2, 3)._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("degree,piece_rows", [(2, 10**6), (4, 10**6), (2, 7), (4, 7), (6, 40)])
def test_masked_components_by_runs_equal_stars(spark, degree, piece_rows):
    """Rings of all sizes with masked edges, around the end and over pieces, without making edges; and the
    edges of groups in pieces are those of whole groups."""
    draw = random.Random(degree * 100 + piece_rows)
    rows = [(i, draw.choice(["train"] * 5 + ["val", "test", "test"]), draw.choice(["hot"] * 6 + [f"v{draw.randrange(12)}"]), draw.choice(["a", "b", None])) for i in range(260)]
    df = spark.createDataFrame(rows, "id long, split string, r string, s string")
    edges = graph.build(df, ["r", "s"], degree, 3)
    pieces = graph.ring_edges(graph.long_values(df, ["r", "s"]), degree, 3, piece_rows=piece_rows)
    pairs = lambda t: sorted((e.relation, e.src, e.dst) for e in t.collect())
    assert pairs(pieces) == pairs(edges)
    want = graph.components_by_relation(df, controls.mask_cross_partition(df, edges), ["r", "s"])
    got = graph.masked_value_components(df, ["r", "s"], degree, 3, piece_rows)
    key = lambda t: sorted((c.relation, c.id, c.component) for c in t.collect())
    assert key(got) == key(want)
