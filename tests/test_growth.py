"""Queries that were found to grow too fast: the same results with less work."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from kinweave.operators import audit, features, graph, learn, ranking, splits
from kinweave.plans import graph_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    t = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), F.col("id") % 23)).alias("r"), F.concat(F.lit("w"), F.pmod(F.col("id") * 13, F.lit(41))).alias("s"), (F.hash("id") % 1000 / 10).alias("value"), F.col("id").cast("double").alias("ts"))
    return ranking.kept(splits.by_time_in_class(t))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def near(found, expected):
    assert found.keys() == expected.keys()
    for k, v in expected.items():
        assert found[k] is None if v is None else math.isclose(found[k], v, rel_tol=1e-9, abs_tol=1e-9)


def checkpoints(monkeypatch, *modules):
    """The number of tables that a call puts on reliable storage."""
    seen, keep = [], ranking.kept

    def counted(df):
        seen.append(df)
        return keep(df)

    for m in modules:
        monkeypatch.setattr(m, "kept", counted)
    return seen


def test_neighbour_means_need_no_join(rows):
    means = graph.neighbour_means(rows, ["r", "s"], ["value"], 2, 42)
    plain = features.neighbour_mean(rows, graph.build(rows, ["r", "s"], 2, 42), ["value"])
    near({(x.relation, x.id): x.nbr_value for x in means.collect()}, {(x.relation, x.id): x.nbr_value for x in plain.collect()})
    assert "Join" not in plan(means)


def test_relation_sets_make_neighbours_once(spark, rows):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    means = graph.neighbour_means(rows, ["r", "s"], ["value"], 2, 42)
    n = means.count()
    assert learn.relation_sets(rows, means.mapInArrow(count, means.schema), ["value"], "r;s;r+s").count() == 3
    assert made.value == n


def test_missing_values_rank_last(spark):
    """As in SQL; time and a constant have no correlation."""
    x, ts = [3.0, None, 1.0, 2.0, None, 1.0, 7.0, 5.0], [5.0, 1.0, 2.0, 2.0, 8.0, None, 4.0, 9.0]

    def ranks(v):
        key = [(1, 0) if a is None else (0, a) for a in v]
        return [sum(b < a for b in key) + (sum(b == a for b in key) + 1) / 2 for a in key]

    a, b = ([r - 4.5 for r in ranks(v)] for v in (x, ts))
    want = sum(p * q for p, q in zip(a, b)) / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b))
    df = spark.createDataFrame([(t, v, 1.0) for t, v in zip(ts, x)], "ts double, x double, same double")
    found = {r.feature: r for r in audit.feature_audit(df, ["x", "same"]).collect()}
    assert found["x"].rho_time == pytest.approx(want, abs=1e-6) and found["x"].unique_ratio == 0.625
    assert found["same"].rho_time is None and not found["same"].counter


def test_metadata_columns_equal_counts(rows, monkeypatch):
    wide = {r.id: r for r in features.metadata_columns(rows, ["r", "s"]).collect()}
    assert len(wide) == 300
    plain = features.metadata_counts(rows, ["r", "s"])
    for r in plain.collect():
        assert wide[r.id][f"{r.relation}_freq"] == r.train_freq and wide[r.id][f"{r.relation}_size"] == r.group_size
    own = {r.id: r for r in splits.folds(rows, 5, 0).collect()}
    for r in plain.where("relation = 'r'").collect():
        v = own[r.id].r
        mates = [o for o in own.values() if v is not None and o.r == v]
        trained = [o for o in mates if o.split == "train" and (own[r.id].split != "train" or o.fold != own[r.id].fold)]
        assert (r.present, r.seen) == (int(v is not None), int(bool(trained)))
        assert r.group_size == round(math.log1p(len(mates)), 6) and r.train_freq == round(math.log1p(len(trained)), 6)


def test_feature_sets_keep_no_copies(rows, monkeypatch):
    """Rows that are kept are not written again for each set and choice of splits."""
    seen = checkpoints(monkeypatch, learn)
    assert learn.feature_set_comparison(rows, {"a": ["value"], "b": ["ts"]}, "linear").count() == 4
    assert not seen


def test_convolution_reads_pairs_once(spark, rows):
    pairs = graph.union_graph(graph.build(rows, ["r", "s"], 2, 42))
    found = {r.id: r.conv_value for r in features.convolved(rows, pairs, ["value"]).collect()}
    value, near_ = {r.id: r.value for r in rows.collect()}, {i: {i} for i in found}
    for p in pairs.collect():
        near_[p.src].add(p.dst)
    near(found, {i: sum(value[j] / math.sqrt(len(near_[i]) * len(near_[j])) for j in near_[i]) for i in value})
    text = plan(features.convolved(rows, pairs, ["value"]))
    assert "Join" not in text


def test_edge_pairs_need_no_join(spark):
    assert "Join" not in plan(graph_queries.a18_edge_pairs(spark, SF))


def test_attachment_sorts_narrow_rows(spark):
    from kinweave.sources.tables import split_events

    assert split_events(spark, SF, "via_user").columns == ["id", "label", "ts", "via_user", "split"]
    whole = {(r.id, r.split) for r in split_events(spark, SF).collect()}
    assert {(r.id, r.split) for r in split_events(spark, SF, "via_user").collect()} == whole
