"""The pipeline against plain versions of its stages' decisions."""

from __future__ import annotations

import collections
import hashlib
import zlib

import corpus_pipeline
import numpy as np
import zstandard
from pyspark.sql import functions as F
from tests.llm.test_operators import plain_components, plain_dictionaries, shingles, word_list

from kinweave.llm import langid, mixing, queries

SF = "/root/testdata/sf0.001"


def plain_margin(samples, text):
    """Relative margin of the smallest compressed size to the second; below 0 if there is no letter."""
    if not any(c.isalpha() for c in text or ""):
        return -1
    raw, sizes = text.lower().encode(), []
    for sample in samples.values():
        d = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        z = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(z.compress(raw[k : k + langid.CHUNK])) for k in range(0, len(raw), langid.CHUNK)))
    first, second = sorted(sizes)[:2]
    return 1 - first / second


def plain_sample(rows):
    """Ids of the documents that bounded raking takes, in NumPy."""
    topic = lambda t: next((name for name, sign in mixing.TOPICS if sign in t), mixing.OTHER)
    cell = {i: (source or "", lang or "", topic(text or "")) for i, source, lang, text in rows}
    tokens = collections.Counter()
    for i, _, _, text in rows:
        tokens[cell[i]] += len(word_list(text))
    cells = sorted(c for c in tokens if tokens[c])
    n = np.array([tokens[c] for c in cells], float)
    at, goal = [], []
    for m in range(3):
        names = sorted({c[m] for c in cells})
        at.append(np.array([names.index(c[m]) for c in cells]))
        have = np.bincount(at[m], n)
        goal.append(have**mixing.TEMPERATURE / (have**mixing.TEMPERATURE).sum() * n.sum())
    share = min([mixing.SHARE, *(mixing.NEAR * (np.bincount(a, n) / g).min() for a, g in zip(at, goal, strict=True))])
    q = np.full(len(n), share)
    for sweep in range(mixing.SWEEPS):
        if sweep and sweep % mixing.PATIENCE == 0:
            share, q = share * mixing.LESS, np.minimum(q, 1) * mixing.LESS
        off = 0
        for a, g in zip(at, goal, strict=True):
            f = g * share / np.bincount(a, n * np.minimum(q, 1))
            off, q = max(off, abs(f - 1).max()), q * f[a]
        if off < mixing.TOLERANCE:
            break
    rate = dict(zip(cells, np.round(np.minimum(q, 1), 6), strict=True))
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:13], 16) / 2**52
    return {i for i in cell if draw(i) < rate.get(cell[i], 0)}


def test_stages_with_odd_rows(spark):
    """Null and repeated ids, null, empty and long texts, repeated rows, clashing columns, no rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    stage = dict(corpus_pipeline.STAGES)
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, texts[0]), (5, texts[1]), (5, texts[1]), (5, item + " and more words here"), (6, None), (7, ""), (8, long), (None, item)]
    odd = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    clash = {c: F.lit("mine") for c in ("_language_lang_pred", "score", "accepted", "_cell", "rate", "id", "h", "w", "k", "sketch", "group", "kept")}
    odd = odd.withColumns(clash)
    near = stage["near-duplicates"](spark, odd, SF)
    assert near.columns == odd.columns
    expected = [(None, texts[0]), (5, texts[1]), (5, item + " and more words here"), (6, None), (7, ""), (8, long), (None, item)]
    got = [(r.doc_id, r.text) for r in near.collect()]
    if len(shingles(item)) / len(shingles(item + " and more words here")) >= 0.75:
        expected.remove((None, item))
    assert sorted(got, key=str) == sorted(expected, key=str)
    clean = stage["decontamination"](spark, odd, SF)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([x for x in rows if not (x[1] or "").startswith(item)], key=str)
    mixed = stage["source mixing"](spark, odd, SF)
    assert mixed.columns == odd.columns and {r.rate for r in mixed.collect()} <= {"mine"}
    spoken = stage["language ID"](spark, docs.withColumns(clash), SF)
    assert set(clash) <= set(spoken.columns) and {r.score for r in spoken.collect()} == {"mine"}
    assert stage["token files"](spark, odd, SF).count() == len(rows)
    for name, f in stage.items():
        assert f(spark, odd.limit(0), SF).collect() == [], name



def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    one = stage["language ID"](spark, docs, SF).persist()
    assert one.columns == docs.columns
    samples = plain_dictionaries([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    kept = {i for i, t in text.items() if plain_margin(samples, t) >= langid.NARROW}
    assert {r.doc_id for r in one.collect()} == kept and len(kept) > 0.9 * len(text)

    two = stage["near-duplicates"](spark, one, SF).persist()
    kept = {i for i, _, c in plain_components([(i, text[i]) for i in sorted(kept)]) if i == c}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == kept

    three = stage["decontamination"](spark, two, SF).persist()
    wanted = [shingles(t) for t in items if len(word_list(t)) >= 5]
    kept = {i for i in kept if not any(100 * len(shingles(text[i]) & s) >= 75 * len(s) for s in wanted)}
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == kept

    four = stage["source mixing"](spark, three, SF).persist()
    assert four.columns == docs.columns
    kept = plain_sample([tuple(r[c] for c in ("doc_id", "source", "lang", "text")) for r in three.collect()])
    assert {r.doc_id for r in four.collect()} == kept and 0 < len(kept)

    from tokenizers import Tokenizer

    tokenizer, at, expected = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for i in sorted(kept):
        ids = [*tokenizer.encode(text[i], add_special_tokens=False).ids, 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in stage["token files"](spark, four, SF).orderBy("doc_id").collect()] == expected
