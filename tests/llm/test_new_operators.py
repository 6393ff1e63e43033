"""Prefix trie, hard negatives and compression quality against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from kinweave.llm import goodness, lemp, neardup, queries, shared, trie

TURNS = "conv_id long, turn long, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# 11 prefix trie -------------------------------------------------------------------------------


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    built = {}
    for c in convs:
        convs[c].sort(key=lambda z: z[:3])
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = [(r, x) for _, r, _, x in [*convs.get(c - int(math.fmod(c, 100)), [])[:h], *own[h:]]]
    members = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not children[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k)))
        above = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), above, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in trie.rebuilt_trie(df).select(*NODE).collect()), key=str)


def random_turns(seed, convs=range(0, 400, 3), longest=300):
    draw = random.Random(seed)
    rows = [(c, t, draw.choice("ua"), draw.choice(["x", "yy", "zzz"])) for c in convs for t in range(draw.choice([1, 2, 3, 9]))]
    return rows + [(150, t, "u", "long") for t in range(longest)]


@pytest.mark.parametrize("few", [shared.FEW_KEYS, 0])
def test_trie_equals_a_walk(spark, monkeypatch, few):
    """Copies, prefixes of others, and a conversation of many turns over several ranges; with and without tables that are broadcast."""
    monkeypatch.setattr(shared, "FEW_KEYS", few)
    rows = random_turns(few % 7)
    assert trie_rows(spark.createDataFrame(rows, TURNS).repartition(5)) == plain_trie(rows)


def test_trie_on_odd_rows(spark):
    """Null turns, roles, texts and ids, ties, repeated rows, negative ids, missing families, turnless conversations, clashing names."""
    rows = [(1, None, "u", "a"), (1, 0, None, None), (None, 1, "u", "x"), (100, 0, "u", "a"), (101, 0, "u", "a"), (101, 0, "u", "a"), (-7, 1, "s", "t"), (0, 0, "z", "y")]
    rows += [(500_007, 0, "u", "k"), (500_008, 0, "u", "k" * 5000), (207, 3, "u", "é😀"), (207, 3, "a", "b"), (207, 1, "u", "c")]
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], TURNS + ", depth int, node string, n int")
    assert trie_rows(df) == plain_trie(rows)
    assert trie_rows(spark.createDataFrame([], TURNS)) == []


def test_trie_of_turnless_conversations(spark):
    short = [c for c in range(1, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6 > 1][:5]
    rows = [(c, 0, "u", "gone") for c in short]
    got = trie_rows(spark.createDataFrame(rows, TURNS))
    assert got == plain_trie(rows) and len(got) == 1 and got[0][5] == 1


def test_many_copies_share_a_list(spark):
    """The list of a group of copies goes over several blocks of ids."""
    rows = [(c, t, "u", "same") for c in range(0, 3 * trie.BLOCK * 100, 100) for t in range(2)]
    assert trie_rows(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_running_sums_over_ranges(spark):
    rows = [("a", i, i % 5) for i in range(3000)] + [("b", 1, 7)] * 50
    df = spark.createDataFrame(rows, "g string, i long, v long")
    from pyspark.sql import functions as F

    got = trie.running(df, "g", ["i"], sums={"s": F.col("v")}, xors={"x": F.xxhash64("i")}).collect()
    a = sorted((r for r in got if r.g == "a"), key=lambda r: r.i)
    assert [r.s for r in a] == list(np.cumsum([i % 5 for i in range(3000)]))
    assert sorted(r.s for r in got if r.g == "b") == [7 * k for k in range(1, 51)]


# 12 hard negatives ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_negatives(rows):
    t = []
    for k, (i, e, label) in enumerate(rows):
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            t.append((k, i, [math.floor(256 * x) for x in e], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    key = lambda z: (-z[0], z[1] is None, z[1] or 0, z[2])
    out = []
    for k, i, v, label in t:
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, m, n) for m, j, w, n in t if m != k]
        others = sorted((z for z in scored if z[3] != label), key=key)
        for p in sorted((z for z in scored if z[3] == label), key=key)[:5]:
            fit = [z for z in others if 80 * p[0] <= 100 * z[0] <= 100 * p[0]][:5]
            out += [(i, p[1], r + 1, z[1], p[0], z[0]) for r, z in enumerate(fit)]
    return sorted(out, key=str)


def mined(df):
    t = lemp.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r) for r in t.collect()), key=str)


@pytest.mark.parametrize("wide", [lemp.WIDE, 1.0, -1.0])
def test_negatives_equal_all_pairs(spark, monkeypatch, wide):
    """By ranges of coordinates, by whole buckets, and mixed; over several pieces and blocks."""
    for name, value in (("WIDE", wide), ("PIECE_BYTES", 20_000), ("ANCHORS", 3), ("BUCKET", 64)):
        monkeypatch.setattr(lemp, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10))
    x = centres[rng.integers(0, 12, 900)] * rng.uniform(0.2, 3, (900, 1)) + rng.normal(size=(900, 10)) * 0.1
    rows = [(i, [float(v) for v in r], int(rng.integers(0, 3))) for i, r in enumerate(x)]
    got = mined(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got == plain_negatives(rows) and len(got) > 50


def test_negatives_on_odd_rows(spark):
    """Nulls, NaN, infinity, other lengths, empty and zero vectors, equal vectors and repeated ids, negative scores, clashing names."""
    draw = random.Random(2)
    some = lambda k: [draw.choice([0.0, 0.5, -0.25, 1.0, 3.0, float("nan") if k % 17 == 0 else 0.1]) for _ in range(draw.choice([0, 3, 5]))]
    rows = [(k * 10 if k % 2 else k, some(k), draw.choice([0, 1, 2, None])) for k in range(300)]
    rows += [(None, [1.0, 2.0, 3.0], 1), (100, None, 1), (200, [None, 1.0], 0), (300, [math.inf], 0), (500, [0.0] * 3, 1), (100, [1.0] * 5, 1), (100, [1.0] * 5, 1)] * 3
    rows += [(700, [-1.0, 0.0], 5), (701, [1.0, 0.0], 6), (703, [1.0, 0.0], 5)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS + ", uid int, score string")
    assert mined(df) == plain_negatives(rows)
    assert mined(spark.createDataFrame([], VECTORS)) == []


def test_large_components_stay_exact(spark):
    rows = [(k * 50, [1e6 + k / 256, 1.0 + k], k % 3) for k in range(40)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == plain_negatives(rows)
    assert lemp._products(np.array([[1e300, 1.0]]), np.array([[1e300, 1.0], [-1e300, 1.0]])).tolist() == [[lemp.LONG[1], lemp.LONG[0] + 1]]


def test_many_equal_vectors(spark):
    """Most rows are one vector: ties go to the smallest ids, and no task returns more than the number asked for."""
    rows = [(i, [0.5, 0.25, 0.125], i % 2) for i in range(1500)]
    assert mined(spark.createDataFrame(rows, VECTORS).repartition(4)) == plain_negatives(rows)


def test_bucket_prunes_and_loses_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(2000, 12)) ** 5 * 256)  # a few coordinates make most of the length
    monkeypatch.setattr(lemp, "WIDE", 1.0)
    monkeypatch.setattr(lemp, "FOCUS", 12)
    q = np.floor(rng.normal(size=(20, 12)) ** 5 * 256)
    v = v[np.argsort(-lemp._lengths(v))]
    need, seen = np.sort(q @ v.T, axis=1)[:, -5], 0
    for i in range(0, 2000, 100):
        bucket = lemp.Bucket(v[i : i + 100], *[np.arange(100)] * 3)
        exact = q @ bucket.v.T
        whole, some = bucket.feasible(q, need)
        rows = {a: set(r) for a, r in some}
        assert not len(whole) and all(set(np.flatnonzero(exact[a] >= need[a])) <= rows.get(a, set()) for a in range(20))
        seen += sum(map(len, rows.values()))
    assert 100 <= seen < 20 * 2000 / 10


# 13 quality classifier ------------------------------------------------------------------------


def test_scores_on_held_out_rows(spark):
    """Accuracy, calibration and order on labelled rows that were not learned."""
    sf = "/root/testdata/sf0.01"
    t = queries.op13_quality_scores(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    held = t[t.held_out & t.quality.notna()]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.93
    assert (held.predicted == held.quality).mean() > 0.92 and (good >= 0.5).mean() > 0.95
    assert abs(held.score.mean() - held.quality.mean()) < 0.06


def test_scores_equal_plain_compression(spark):
    """Every score from its own text alone, chunk by chunk."""
    import zstandard

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = goodness.learn(docs, labels.where(~goodness.held_out(labels["doc_id"])))
    cost = lambda d, raw: sum(len(zstandard.ZstdCompressor(level=goodness.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(raw[i : i + goodness.CHUNK])) for i in range(0, len(raw), goodness.CHUNK))  # noqa: E731, E501
    got = {r.doc_id: r for r in goodness.score(docs.select("doc_id", "text"), model).collect()}
    for r in docs.limit(40).collect():
        raw = (r.text or "").encode()
        x = (cost(model.bad, raw) - cost(model.good, raw)) / max(1, len(raw))
        assert got[r.doc_id].difference == pytest.approx(x, abs=2e-2)
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-(model.slope * got[r.doc_id].difference + model.shift))))


def test_scores_on_odd_rows(spark):
    """Null, empty and long texts, null and repeated ids, conflicting labels, one label, no labels, no rows, clashing names."""
    docs = spark.createDataFrame(
        [(1, None, "c", 1), (2, "", "c", 1), (2, "again", "c", 1), (None, "no id", "c", 1), (3, "word " * 300_000, "c", 1), (4, "é😀" * 50, "c", 1)], "doc_id long, text string, score string, h int"
    )
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = goodness.rate(docs, none).collect()
    assert len(rows) == 6 and all(r.score == pytest.approx(0.5) and r.predicted in (0, 1) for r in rows)
    one = spark.createDataFrame([*[(i, 1, 0) for i in range(3, 20)], (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.99 for r in goodness.rate(docs, one).collect())
    both = spark.createDataFrame([(i, y, 0) for i in range(1, 20) for y in ([0, 1] if i == 2 else [i % 2])], "doc_id long, quality int, toxic int")
    rows = goodness.rate(docs, both).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.5) for r in rows)
    assert goodness.rate(docs.limit(0), both).count() == 0


def test_curve_meets_the_rate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, shift = goodness.fit_curve(x, y, np.ones(4000))
    assert slope == pytest.approx(2, abs=0.25) and shift == pytest.approx(-1, abs=0.15)
    slope, shift = goodness.fit_curve(np.array([-1.0, -2, 1, 2]), np.array([0.0, 0, 1, 1]), np.ones(4))
    assert math.isfinite(slope) and slope > 0


# 6 near-duplicates on texts of one template ----------------------------------------------------


def test_template_texts_do_not_multiply(spark, monkeypatch):
    """Texts that share a template (similarity 0.6) part from level to level, and the pairs over the threshold among them are found."""
    monkeypatch.setattr(neardup, "SMALL", 60)
    draw = random.Random(1)
    template = [f"t{i}" for i in range(150)]
    docs = [(i, " ".join(template + [f"w{draw.randrange(10**9)}" for _ in range(50)])) for i in range(500)]
    for k in range(30):
        words = docs[k][1].split()
        for j in range(5):
            words[150 + j * 8] = f"z{draw.randrange(10**9)}"
        docs.append((10_000 + k, " ".join(words)))
    seen, nodes = [], neardup._nodes

    def counted(paths, name):
        seen.append(paths.count())
        return nodes(paths, name)

    monkeypatch.setattr(neardup, "_nodes", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert max(seen) <= 2 * seen[0] and seen[-1] < seen[0]
    assert sum(got[10_000 + k] == k for k in range(30)) >= 29 and all(got[i] == i for i in range(500))
