"""Quality scores by compression.

Two raw-content Zstandard dictionaries hold text labelled good (1) and bad (0). A text is cut into
chunks that each dictionary compresses; the difference of the two sums, divided by the text's bytes, is
turned into the probability of label 1 by a logistic curve.

The fit is bounded: for each label and each of two parts at most SAMPLES documents, that with the
smallest hash of each hash bucket, of which dictionaries take SAMPLE_CHARS characters each. The curve is
fitted to the other part's whole texts, weighted by the labels' counts among all rows learned from. The
choice reads ids and labels only; scoring is row-local and reads whole texts, which are never shuffled.

Defined results: null and empty texts have difference 0; rows with a null id or label, and ids with
both labels, are not learned from; of rows that share a chosen id the smallest text counts; if a label
is missing, every score is the share of label 1 (0.5 without labels). Repeated rows are scored
separately; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import give_back, pick, staged

SAMPLES, SAMPLE_CHARS = 256, 1024
CHUNK, LEVEL = 1024, 5
#: Weight of the squared slope in the fit, which keeps it finite where the labels separate.
RIDGE = 1e-4


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


class Difference:
    """(bytes saved by the good dictionary over the bad one) / bytes of a text."""

    def __init__(self, bad: bytes, good: bytes, chunk: int = CHUNK, level: int = LEVEL):
        import zstandard

        self.chunk, self.compress = chunk, []
        for sample in (bad, good):
            d = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        chunks = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        bad, good = (sum(len(compress(c)) for c in chunks) for compress in self.compress)
        return (bad - good) / max(1, len(raw))


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the curve 1 / (1 + exp(-(slope * difference + shift)))."""

    bad: bytes
    good: bytes
    slope: float
    shift: float

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.shift, -700, 700)))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the weighted logistic curve, by Newton's method."""
    scale = float(np.abs(x).max()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    ridge, w = np.diag([RIDGE, RIDGE / 100]), weight / weight.sum()
    loss = lambda b: float(w @ np.logaddexp(0, -(2 * y - 1) * (a @ b))) + 0.5 * float(b @ ridge @ b)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -700, 700)))
        gradient = a.T @ (w * (p - y)) + ridge @ beta
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, gradient)
        t = 1.0
        while loss(beta - t * step) > loss(beta) and t > 1e-6:
            t /= 2
        beta = beta - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, samples: int = SAMPLES) -> Model:
    """From documents (doc_id, text) and labels (doc_id, quality)."""
    wanted = pick(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality in (0, 1)")
    known = wanted.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").select("doc_id", "y")
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(samples))
    keyed = known.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).alias("part"), bucket.alias("bucket"), F.xxhash64("doc_id").alias("h"))
    best = keyed.groupBy("y", "part", "bucket").agg(F.min_by("doc_id", "h").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    best = staged(best, "quality-sample")  # at most 4 * samples rows
    counts = {r["y"]: r["n"] for r in best.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        rate = counts.get(1, 0) / total if total else 0.5
        return Model(b"", b"", 0.0, float(np.log((rate + 1e-9) / (1 - rate + 1e-9))))
    texts = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(best.select("doc_id", "y", "part")), "doc_id")
    texts = staged(texts.groupBy("doc_id", "y", "part").agg(F.min("text").alias("text")), "quality-texts")
    begins = texts.where("part = 0").select("y", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    of = lambda y: "\n".join(r["text"] or "" for r in sorted(begins, key=lambda r: r["doc_id"]) if r["y"] == y).encode("utf-8", "surrogatepass")
    bad, good = of(0), of(1)
    if not bad or not good:
        return Model(b"", b"", 0.0, float(np.log(counts[1] / counts[0])))
    fit = differences(texts.where("part = 1").select("y", "text"), bad, good).select("y", "difference").collect()
    x, y = np.array([r["difference"] for r in fit]), np.array([float(r["y"]) for r in fit])
    if len(set(y)) < 2:
        return Model(bad, good, 0.0, float(np.log(counts[1] / counts[0])))
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return Model(bad, good, *fit_curve(x, y, weight))


def differences(docs: DataFrame, bad: bytes, good: bytes) -> DataFrame:
    """``docs`` with ``difference`` in the place of ``text``."""
    kept = [c for c in docs.columns if c not in ("text", "difference")]
    schema = docs.select(*kept).schema.add("difference", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Difference(bad, good) if bad and good else lambda _: 0.0
        for batch in batches:
            found = pa.array([measure(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], found], names=schema.names)
        batch = found = None
        give_back()

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score, predicted and difference in the place of ``text``."""
    t = differences(docs, model.bad, model.good)
    p = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("difference") + F.lit(model.shift))))
    return t.withColumn("score", p).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels of documents that are not held out; scores every document."""
    t = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = learn(t, labels.where(~held_out(F.col("doc_id"))))
    return score(t.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
