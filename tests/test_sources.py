"""Logs with their own headers, result trees, incremental extraction, streamed packets and joins with hot keys."""

from __future__ import annotations

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import graph, lookup
from kinweave.sources import extraction, logs
from kinweave.sources.tables import first_scores, read_results, seed_scores
from kinweave.streaming import packets


# logs -----------------------------------------------------------------------------------------


def written(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.log").write_text(text)
    return f"{folder}/*.log"


def test_each_log_has_its_own_header(spark, tmp_path):
    path = written(
        tmp_path / "logs",
        a="#separator x\n#fields\tuid\tts\tport\nC1\t1.5\t443\nC2\t-\t80\nshort\t1\n#close\n",
        b="#fields\tport\tuid\tts\n443\tC3\t2.5\n",
        c="#fields\tts\tservice\tuid\n3.5\tssl\tC4\textra\n\n",
        d="no header\tat all\n",
        e="#fields\tts\tuid\n#fields\tuid\tts\nC5\t4.5\n",
        f="#fields\tuid\tts\r\nC6\t5.5\n",
    )
    rows = {r.uid: (r.ts, r.port, r.service) for r in logs.read_log(spark, path, numeric=("ts", "port")).collect()}
    assert rows == {"C1": (1.5, 443, None), "C2": (None, 80, None), "C3": (2.5, 443, None), "C4": (3.5, None, "ssl"), "C5": (4.5, None, None), "C6": (5.5, None, None)}
    status = {r.file[-5]: (r.n_columns, r.n_rows, r.n_short, r.status) for r in logs.log_status(spark, path).collect()}
    assert status["a"] == (3, 2, 1, "short rows dropped") and status["d"] == (0, 0, 0, "no header") and status["c"] == (3, 1, 0, "whole")


def test_many_headers_without_broadcast(spark, tmp_path, monkeypatch):
    """One log has most of the rows; files are looked up instead of broadcast."""
    monkeypatch.setattr(logs, "FEW_FILES", 1)
    monkeypatch.setattr(lookup, "HOT_ROWS", 100)
    path = written(tmp_path / "logs", a="#fields\tx\ty\n" + "".join(f"{i}\t{-i}\n" for i in range(3000)), **{f"b{i}": f"#fields\ty\tx\n{i}\t{10_000 + i}\n" for i in range(20)})
    rows = logs.read_log(spark, path, numeric=("x", "y")).collect()
    assert sorted((r.x, r.y) for r in rows) == sorted([(i, -i) for i in range(3000)] + [(10_000 + i, i) for i in range(20)])


def test_no_header_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        logs.read_log(spark, written(tmp_path / "logs", a="x\ty\n"))


def test_every_file_of_a_written_log_has_its_header(spark, tmp_path):
    t = spark.range(100).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "x").alias("v")).repartition(3)
    logs.write_log(t, f"{tmp_path}/log")
    rows = logs.read_log(spark, f"{tmp_path}/log").collect()
    assert sorted(int(r.id) for r in rows) == list(range(100)) and all((r.v == "x") == (int(r.id) % 2 == 0) for r in rows)
    logs.write_log(t.limit(0), f"{tmp_path}/none")
    assert logs.read_log(spark, f"{tmp_path}/none").count() == 0


# result trees ---------------------------------------------------------------------------------


def test_result_files_of_any_layout(spark, tmp_path):
    seeds = [{"seed": 7, "macro_f1": 0.5, "note": "x"}, {"macro_f1": 0.75, "acc": 1}]
    for name, node in {
        "bare": {"d": {"per_seed": seeds, "other": {"sets": 1}}},
        "set": {"d": {"sets": {"full": {"per_seed": seeds}}}, "e": {"per_seed": []}},
        "two": {"d": {"sets": {"a": {"per_seed": seeds}, "b": {"per_seed": seeds}}}},
        "none": {"d": {"mean": 1}},
        "list": [1],
    }.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(node, indent=1))
    (tmp_path / "broken.json").write_text('{"d": ')
    results = read_results(spark, f"{tmp_path}/*.json")
    status = {(r.file.rsplit("/")[-1][:-5], r.dataset): r.status for r in results.collect()}
    assert status == {("bare", "d"): "ok", ("set", "d"): "ok", ("set", "e"): "empty", ("two", "d"): "ambiguous", ("none", "d"): "empty", ("list", None): "broken", ("broken", None): "broken"}
    scores = sorted((r.file.rsplit("/")[-1][:-5], r.set_name, r.seed, r.metric, r.value) for r in seed_scores(results).collect())
    assert scores == [(f, s, *x) for f, s in (("bare", None), ("set", "full")) for x in ((1, "acc", 1.0), (1, "macro_f1", 0.75), (7, "macro_f1", 0.5))]
    order = spark.createDataFrame([("m", 0, "two.json"), ("m", 1, "set.json"), ("m", 2, "bare.json")], "arm string, rank int, pattern string")
    first = first_scores(seed_scores(results, ["macro_f1"]), order).collect()
    assert {(r.arm, r.dataset, r.set_name) for r in first} == {("m", "d", "full")} and len(first) == 2


# incremental extraction -----------------------------------------------------------------------


def lines_of(spark, files):
    return spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), "value")


def test_only_changed_files_are_read(spark, tmp_path):
    source, target, asked = tmp_path / "in", f"{tmp_path}/out", []

    def extract(session, files):
        asked.append(sorted(f.rsplit("/")[-1] for f in files))
        return lines_of(session, files)

    def step():
        counts = extraction.refresh(spark, str(source), target, extract, "*.txt")
        got = sorted(r.value for r in extraction.extracted(spark, target).collect())
        assert got == sorted(x for f in source.glob("*.txt") for x in f.read_text().split())
        return {r.change: (r.n_files, r.n_rows) for r in counts.collect()}

    source.mkdir()
    (source / "a.txt").write_text("1\n2\n")
    (source / "b.txt").write_text("3\n")
    (source / "skip.dat").write_text("9\n")
    assert step() == {"new": (2, 3)} and asked.pop() == ["a.txt", "b.txt"]
    assert step() == {"same": (2, 0)} and not asked
    (source / "a.txt").write_text("1\n2\n4\n5\n")
    (source / "c.txt").write_text("6\n")
    assert step() == {"changed": (1, 4), "new": (1, 1), "same": (1, 0)} and asked.pop() == ["a.txt", "c.txt"]
    (source / "b.txt").unlink()
    assert step() == {"gone": (1, 0), "same": (2, 0)} and not asked
    for f in ("a.txt", "c.txt"):
        (source / f).unlink()
    assert step() == {"gone": (2, 0)}


def test_a_lost_refresh_changes_nothing(spark, tmp_path):
    """Rows of a version that were written twice, or without a manifest, are not read twice."""
    source, target = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    (source / "a.txt").write_text("1\n2\n")
    now = extraction.source_files(spark, str(source))
    for _ in range(2):
        lines_of(spark, [f"{source}/a.txt"]).join(now.select("file", "version"), "file").write.mode("append").partitionBy("version").parquet(f"{target}/rows")
    extraction.refresh(spark, str(source), target, lines_of)
    assert sorted(r.value for r in extraction.extracted(spark, target).collect()) == ["1", "2"]


# streamed packets -----------------------------------------------------------------------------

PACKET = "src string, sport int, dst string, dport int, proto string, ts double, bytes double, name string"


def streamed(spark, folder, batches, pause, late):
    """Flows of a stream that gets one batch after another."""
    source = folder / "in"
    schema = spark.createDataFrame([], PACKET).schema
    t = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{source}/*")
    flows = packets.fold_stream(t.withColumn("ts", F.timestamp_millis((F.col("ts") * 1000).cast("long"))), pause, f"{late} seconds")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, PACKET).coalesce(1).write.json(f"{source}/{i}")
        with packets.state_store(spark):
            q = flows.writeStream.option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/rows").trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.schema(flows.schema).parquet(f"{folder}/rows")


def test_stream_of_packets_equals_the_fold(spark, tmp_path):
    """On a closed input, with packets out of order within the watermark."""
    draw = random.Random(4)
    ends = [("a", 1), ("b", 2), ("c", 443)]
    rows = []
    for i in range(300):
        (s, sp), (d, dp) = draw.sample(ends, 2)
        rows.append((s, sp, d, dp, draw.choice(["tcp", "udp"]), 1000.0 + i + draw.randrange(40), float(draw.randrange(9)), draw.choice([None, None, "x", "y"])))
    end = [("z", 0, "z", 0, "end", 1e6, 0.0, None)]
    got = streamed(spark, tmp_path, [rows[:120], rows[120:], end], 5000, 100)
    want = logs.fold_packets(spark.createDataFrame(rows, PACKET))
    key = lambda t: sorted((r.client, int(r.client_port), r.server, int(r.server_port), r.proto, r.first, r.last, r.packets_out, r.packets_in, r.bytes_out, r.bytes_in, r.name or "") for r in t.collect())
    assert key(got) == key(want) and got.count() == 6


def test_late_and_parted_packets(spark, tmp_path):
    """A pause parts two flows, a packet between them within the watermark joins them, a late one is dropped."""
    p = lambda ts, size=1.0: ("a", 1, "b", 2, "tcp", float(ts), size, None)
    batches = [[p(100), p(160), p(300)], [p(130), p(240)], [p(5000)], [p(110, 50.0)], [("z", 0, "z", 0, "end", 9e5, 0.0, None)]]
    rows = sorted((r.first, r.last, r.packets_out, r.bytes_out) for r in streamed(spark, tmp_path, batches, 90, 300).collect())
    assert rows == [(100.0, 300.0, 5, 5.0), (5000.0, 5000.0, 1, 1.0)]


def test_many_flows_of_one_pair_are_folded_natively(spark, tmp_path):
    """Packets exactly the pause apart are one flow, a millisecond more parts them; no flow costs a call of Python."""
    draw, at, rows = random.Random(8), 0, []
    for _ in range(400):
        at += draw.choice([1, 89_999, 90_000, 90_001, 200_000])
        s, d = draw.sample([("a", 1), ("b", 2)], 2)
        rows.append((*s, *d, "tcp", at / 1000, float(draw.randrange(5)), draw.choice([None, "x", "y"])))
    parts = [packets.packet(int(r[5] * 1000), r[0] == "a", r[6], r[7]) for r in rows]
    want = sorted((f[0] / 1000, f[2] / 1000, f[3] + f[4], f[5] + f[6], f[7] or "") for f in packets.joined(parts, 90_000))
    draw.shuffle(rows)
    end = [("z", 0, "z", 0, "end", 1e6, 0.0, None)]
    got = streamed(spark, tmp_path, [rows, end], 90, 100)
    assert sorted((r.first, r.last, r.packets_out + r.packets_in, r.bytes_out + r.bytes_in, r.name or "") for r in got.collect()) == want
    stream = spark.readStream.schema(PACKET).json(f"{tmp_path}").withColumn("ts", F.timestamp_seconds("ts"))
    assert "TransformWithState" not in packets.fold_stream(stream)._jdf.queryExecution().analyzed().toString()


def test_parts_of_flows_merge_in_any_order():
    draw = random.Random(1)
    for _ in range(50):
        parts = [packets.packet(draw.randrange(300), draw.random() < 0.5, float(draw.randrange(5)), draw.choice([None, "x", "y"])) for _ in range(8)]
        whole = packets.joined(parts, 20)
        draw.shuffle(parts)
        assert packets.joined([*packets.joined(parts[:3], 20), *packets.joined(parts[3:], 20)], 20) == whole


# hot keys -------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_of_hot_and_null_keys(spark, monkeypatch, how):
    """Most rows have one value: they stay where they are, so that no task has over twice the mean."""
    rows = [(i, "hot" if i % 20 else ("rare" + str(i % 7) if i % 40 else None)) for i in range(8000)]
    table = [("hot", 1), ("rare0", 2), ("rare5", 3), ("other", 4), (None, 5)]
    want = sorted((i, v, dict(table).get(v) if v is not None else None) for i, v in rows if how == "left" or v in dict(table) and v is not None)
    for most in (100, 10**9):
        monkeypatch.setattr(lookup, "HOT_ROWS", most)
        t = lookup.lookup_join(spark.createDataFrame(rows, "id long, k string").repartition(4), spark.createDataFrame(table, "k string, x int"), ["k"], how)
        assert sorted((r.id, r.k, r.x) for r in t.select("id", "k", "x").collect()) == want
        if most == 100:
            sizes = [r["count"] for r in t.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) <= 2 * sum(sizes) / 4
    monkeypatch.setattr(lookup, "HOT_ROWS", 100)
    assert lookup.hot_keys(spark.createDataFrame(rows, "id long, k string"), ["k"])[1] == sum(v is None for _, v in rows)


@pytest.mark.parametrize("most", [lookup.HOT_ROWS, 20])
def test_operators_on_hot_values(spark, monkeypatch, most):
    """Attachment and components where nearly all rows share one value, by either way."""
    monkeypatch.setattr(lookup, "HOT_ROWS", most)
    rows = [(i, "train" if i % 3 else "test", "hot" if i % 20 else f"v{i % 7}", f"w{i // 50}" if i % 2 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, split string, r string, s string")
    train, attached = graph.inductive(df, ["r", "s"], 2, 1)
    counts = collections.Counter((e.relation, e.dst) for e in attached.collect())
    test = [i for i, split, *_ in rows if split == "test"]
    assert all(counts["r", i] == 2 for i in test if rows[i][2] == "hot") and max(counts.values()) == 2
    found = {(c.relation, c.id): c.component for c in graph.value_components(df, ["r", "s"]).collect()}
    edges = graph.build(df, ["r", "s"], 2, 1)
    assert found == {(c.relation, c.id): c.component for c in graph.components_by_relation(df, edges, ["r", "s"]).collect()}
    union = {c.id: c.component for c in graph.union_components(df, ["s", "r"]).collect()}
    assert union == {c.id: c.component for c in graph.components(df, edges.select("src", "dst")).collect()}


def test_union_components_equal_union_find(spark):
    """Chains over three relations, missing values, rows alone, and no rows."""
    draw = random.Random(9)
    rows = [(i, *[f"{c}{draw.randrange(n)}" if draw.random() < 0.4 else None for c, n in (("a", 60), ("b", 80), ("c", 90))]) for i in range(150)]
    parent = {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for i, *values in rows:
        for v in values:
            if v is not None:
                by[v].append(i)
    for members in by.values():
        for m in members[1:]:
            a, b = sorted((root(members[0]), root(m)))
            parent[b] = a
    df = spark.createDataFrame(rows, "id long, x string, y string, z string")
    got = {r.id: r.component for r in graph.union_components(df, ["x", "y", "z"]).collect()}
    assert got == {i: root(i) for i, *_ in rows} and 20 < len(set(got.values())) < 150
    assert graph.union_components(df.limit(0), ["x", "y"]).count() == 0
