"""Permutation tests, folds by profile, edge seeds, sketches, restored protocols and boosting."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import values as V
from kinweave.operators import audit, compare, feasibility, graph, learn, splits


# permutation tests ----------------------------------------------------------------------------


def test_numbers_of_permutations(spark):
    for n in (1, 2, 5):
        orders = list(itertools.permutations(range(n)))
        got = spark.range(len(orders)).select("id", compare.unranked(F.col("id"), F.lit(n)).alias("o")).orderBy("id").collect()
        assert [tuple(r.o) for r in got] == orders


def ranked(v):
    return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]


def plain(statistic, x, y):
    if statistic == "kendall":
        pairs = list(itertools.combinations(range(len(x)), 2))
        return sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in pairs) / len(pairs)
    x, y = (np.array(ranked(v) if statistic == "spearman" else v, float) for v in (x, y))
    d = x.std() * y.std()
    return float(((x - x.mean()) * (y - y.mean())).mean() / d) if d else 0.0


@pytest.mark.parametrize("statistic", sorted(compare.STATISTICS))
def test_permutation_p_of_each_statistic(spark, statistic):
    """All orders of six points with ties, and of points without spread, against a plain loop."""
    points = {"a": [(1.0, 2.0), (2.0, 2.5), (2.0, 1.0), (4.0, 7.0), (5.0, 3.0), (6.5, 8.0)], "flat": [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)]}
    t = spark.createDataFrame([(d, *p) for d, v in points.items() for p in v], "dataset string, x double, y double")
    got = {r.dataset: r for r in compare.permutation_p(t, statistic).collect()}
    for d, v in points.items():
        x, y = [p[0] for p in sorted(v)], [p[1] for p in sorted(v)]
        seen = [plain(statistic, x, o) for o in itertools.permutations(y)]
        obs = plain(statistic, x, y)
        assert got[d].r == pytest.approx(obs, abs=1e-6) and got[d].exact and got[d].n_permutations == len(seen)
        assert got[d].p_value == pytest.approx(sum(abs(s) >= abs(obs) - 1e-12 for s in seen) / len(seen), abs=1e-6)


def test_drawn_permutations_are_near_the_exact_share(spark):
    draw = random.Random(3)
    t = spark.createDataFrame([("d", draw.random(), draw.random()) for _ in range(6)], "dataset string, x double, y double")
    exact, drawn = compare.permutation_p(t).first(), compare.permutation_p(t, exhaustive=10, draws=4000).first()
    assert not drawn.exact and drawn.n_permutations == 4000 and drawn.r == exact.r
    assert drawn.p_value == pytest.approx(exact.p_value, abs=0.04)


# folds ----------------------------------------------------------------------------------------


def walked(groups, k):
    """One group after another, the plain way."""
    tn, tp = max(1, sum(n for n, _ in groups)), max(1, sum(p for _, p in groups))
    order = sorted(groups, key=lambda g: (-((g[0] / tn) ** 2 + (g[1] / tp) ** 2), -g[0], -g[1]))
    held = [[0, 0, 0] for _ in range(k)]
    for n, p in order:
        f = min(range(k), key=lambda i: (n * held[i][0] * tp**2 + p * held[i][1] * tn**2, held[i][0] + held[i][1], i))
        held[f] = [held[f][0] + n, held[f][1] + p, held[f][2] + 1]
    return held


def grouped(spark, groups):
    rows = [(f"g{i}", y) for i, (n, p) in enumerate(groups) for y in [0] * n + [1] * p]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, label int")


@pytest.mark.parametrize("seed", range(3))
def test_folds_equal_a_walk_over_groups(spark, seed):
    draw = random.Random(seed)
    groups = [(draw.choice([0, 1, 1, 1, 2, 30]), draw.choice([0, 0, 1, 5])) for _ in range(150)] + [(1, 0)] * 200 + [(90, 4)]
    groups = [g for g in groups if sum(g)]
    df, k = grouped(spark, groups), 3 + seed
    report = {r.fold: [r.negatives, r.positives, r.n_groups] for r in feasibility.fold_report(df, "g", k).collect()}
    assert report == dict(enumerate(walked(groups, k)))
    fold = {r.value: r.fold for r in feasibility.group_folds(df, "g", k).collect()}
    assert len(fold) == len(groups)
    dealt = collections.defaultdict(lambda: [0, 0, 0])
    for i, (n, p) in enumerate(groups):
        f = dealt[fold[f"g{i}"]]
        f[:] = f[0] + n, f[1] + p, f[2] + 1
    assert dict(dealt) == report


def test_run_of_equal_groups_in_closed_form():
    draw = random.Random(7)
    for _ in range(300):
        k = draw.randrange(1, 6)
        levels, rows = [draw.randrange(40) for _ in range(k)], [draw.randrange(9) for _ in range(k)]
        step, size, m = draw.randrange(0, 7), draw.randrange(1, 4), draw.randrange(0, 60)
        a, b, want = list(levels), list(rows), [0] * k
        for _ in range(m):
            f = min(range(k), key=lambda i: (a[i], b[i] if step else rows[i], i))
            a[f], b[f], want[f] = a[f] + step, b[f] + size, want[f] + 1
        assert feasibility._fill(levels, rows, step, size, m) == want
    assert sum(feasibility._fill([0, 5, 10**30], [0, 0, 0], 3, 1, 10**12)) == 10**12


def test_refused_folds_are_a_row(spark):
    r = feasibility.fold_report(grouped(spark, [(3, 1), (2, 1), (5, 0), (4, 0)]), "g", 3).collect()
    assert len(r) == 1 and r[0].fold is None and "1" in r[0].refusal
    empty = feasibility.fold_report(grouped(spark, [(1, 1)] * 4).limit(0), "g", 3).collect()
    assert len(empty) == 1 and empty[0].refusal


def test_members_of_folds_are_whole(spark):
    """Every group has its fold, with the totals of that fold; a refusal is one row."""
    groups = [(3, 1), (2, 2), (5, 1), (1, 1), (1, 1), (1, 1), (1, 1), (4, 0)]
    df = grouped(spark, groups)
    r = feasibility.fold_members(df, "g", 3).collect()
    assert sorted(x.value for x in r) == sorted(f"g{i}" for i in range(len(groups)))
    for f in feasibility.fold_report(df, "g", 3).collect():
        mine = [x for x in r if x.fold == f.fold]
        assert len(mine) == f.n_groups and {(x.n_groups, x.negatives, x.positives, x.missing_classes) for x in mine} == {(f.n_groups, f.negatives, f.positives, f.missing_classes)}
        assert sum(groups[int(x.value[1:])][0] for x in mine) == f.negatives
    refused = feasibility.fold_members(grouped(spark, [(3, 1), (2, 1), (5, 0), (4, 0)]), "g", 3).collect()
    assert len(refused) == 1 and refused[0].value is None and "1" in refused[0].refusal


# edge seeds, protocols, sketches --------------------------------------------------------------


def test_edge_seeds_equal_single_builds(spark):
    df = spark.createDataFrame([(i, f"a{i % 5}", f"b{i % 17}" if i % 3 else None) for i in range(200)], "id long, r string, s string")
    found = graph.edge_variants(df, ["r", "s"], 4, [1, 2, 30]).collect()
    for seed in (1, 2, 30):
        one = sorted((e.relation, e.src, e.dst) for e in graph.build(df, ["r", "s"], 4, seed).collect())
        assert one == sorted((e.relation, e.src, e.dst) for e in found if e.edge_seed == seed)


def test_restored_protocols(spark):
    tags = spark.createDataFrame([(t,) for t in ("random_s42", "random_s7", "random_s8", "random_s9", "cutoff_t0250", "edgeseed_s5")], "variant string")
    exact = spark.createDataFrame([("random_s7", "random", 7, 0.3, 99)], "variant string, mode string, split_seed long, test_size double, edge_seed long")
    edges = spark.createDataFrame([("random_s7", 1), ("random_s8", 42)], "variant string, edge_seed long")
    got = {r.variant: (r.mode, r.split_seed, r.test_size, r.edge_seed, r.edge_seed_source, r.legacy_coupled_seed) for r in splits.restore_protocol(tags, exact, edges).collect()}
    assert got == {
        "random_s42": ("random", 42, 0.2, 42, "name", False),
        "random_s7": ("random", 7, 0.3, 99, "run record", False),
        "random_s8": ("random", 8, 0.2, 42, "edge record", False),
        "random_s9": ("random", 9, 0.2, 9, "none", True),
        "cutoff_t0250": ("time_in_class", 42, 0.25, 42, "name", False),
        "edgeseed_s5": ("time_in_class", 42, 0.2, 5, "name", False),
    }


def test_sketches_are_near_exact_counts(spark):
    """100,000 values in both splits, a quarter shared; days merge to the same; a split that is missing."""
    t = spark.range(100_000).select(F.lit("f").alias("field"), F.explode(F.array(F.struct(F.lit("train").alias("s"), F.col("id").alias("v")), F.struct(F.lit("test").alias("s"), (F.col("id") + 75_000).alias("v")))).alias("x"), (F.col("id") % 3).alias("day"))
    t = t.select("field", F.col("x.s").alias("split"), F.col("x.v").cast("string").alias("value"), "day")
    r = audit.sketch_overlap(audit.value_sketches(t)).first()
    assert r.values_a == pytest.approx(100_000, rel=0.05) and r.n_union == pytest.approx(175_000, rel=0.05)
    assert r.shared == pytest.approx(25_000, rel=0.15) and r.jaccard == pytest.approx(25 / 175, abs=0.02)
    days = audit.value_sketches(t.where("day = 0"))
    for d in (1, 2):
        days = days.unionByName(audit.value_sketches(t.where(F.col("day") == d)))
    m = audit.sketch_overlap(audit.merged_sketches(days)).first()
    assert m.values_a == pytest.approx(100_000, rel=0.05) and m.shared == pytest.approx(25_000, rel=0.15)
    one = audit.sketch_overlap(audit.value_sketches(t.where("split = 'train'"))).first()
    assert (one.values_b, one.shared, one.overlap_values) == (0, 0, None) and one.n_union == one.values_a


def test_sketches_in_pieces_are_exact(spark):
    """Far more values than a sketch holds exactly: pieces add up to the true counts, also merged from days."""
    t = spark.range(30_000).select(F.lit("f").alias("field"), F.explode(F.array(F.struct(F.lit("train").alias("s"), F.col("id").alias("v")), F.struct(F.lit("test").alias("s"), (F.col("id") + 22_222).alias("v")))).alias("x"), (F.col("id") % 3).alias("day"))
    t = t.select("field", F.col("x.s").alias("split"), F.col("x.v").cast("string").alias("value"), "day")
    pieces = audit.sketch_pieces(t)
    assert 32 <= pieces <= 128 and audit.sketch_pieces(t.where("value < 900")) == 1 and audit.sketch_pieces(t.limit(0)) == 1
    days = audit.value_sketches(t.unionByName(t), pieces=pieces, by=("day",))
    for sketches in (audit.value_sketches(t, pieces=pieces), audit.merged_sketches(days)):
        r = audit.sketch_overlap(sketches).first()
        assert (r.values_a, r.values_b, r.shared, r.n_union) == (30_000, 30_000, 7_778, 52_222)


def test_checks_name_a_wrong_source(spark):
    df = spark.createDataFrame([(i, i % 2, f"a{i % 5}") for i in range(50)], "id long, label int, r string")
    edges = graph.build(df, ["r"], 2, 1)
    verdict = lambda n: {r.check: r.passed for r in audit.check_relations(df, edges, ["r"], n).collect()}
    assert verdict(50)["flow_count"] and not verdict(49)["flow_count"] and "flow_count" not in verdict(None)


# boosting -------------------------------------------------------------------------------------


def learnable(spark, n=600):
    """Rows in order of time whose label follows a noisy column, and whose number tells the label's blocks."""
    draw = random.Random(5)
    rows = []
    for i in range(n):
        y = (i // 50) % 2
        rows.append((i, y, ("train", "train", "val", "test")[draw.randrange(4)], y + draw.gauss(0, 1.2), float(i), draw.random()))
    return spark.createDataFrame(rows, "id long, label int, split string, good double, row_id double, noise double")


def test_boosting_ends_by_itself(spark):
    df = learnable(spark)
    p, used = learn.fit(df, ["good", "noise"])
    assert 1 <= used < learn.ITERATIONS and p.count() == 600
    assert compare.metrics(p.where("split = 'test'"), ["split"], 2).first().macro_f1 > 0.55
    assert learn.fit(df, ["good"], iterations=7, early=False)[1] == 7


def test_ablation_shows_a_planted_row_number(spark):
    """The row number tells the label apart where the honest columns do not."""
    t = {r.feature_set: r for r in learn.index_ablation(learnable(spark), ["noise", "row_id"], []).collect()}
    assert t["keep"].inflation > 0.2 and t["drop"].inflation == 0 and t["keep"].iterations > 3


def test_one_learner_for_each_class(spark):
    draw = random.Random(6)
    rows = [(i, i % 3, ("train", "val", "test")[draw.randrange(3)], float(i % 3 == 0) + draw.gauss(0, 0.1), float(i % 3 == 1) + draw.gauss(0, 0.1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, split string, a double, b double")
    for model in ("boosting", "linear"):
        m = compare.metrics(learn.fit(df, ["a", "b"], model, iterations=20)[0], ["split"], 3).where("split = 'test'").first()
        assert m.macro_f1 > 0.95


def test_seed_may_be_a_column(spark):
    r = spark.range(3).select(V.seeded_hash(7, F.col("id")).alias("a"), V.seeded_hash(F.lit(7), F.col("id")).alias("b")).collect()
    assert all(x.a == x.b for x in r)
