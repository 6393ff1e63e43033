"""Language identification by compression.

Each language has a raw-content Zstandard dictionary of sample text. A text is cut into chunks,
every chunk is compressed with each dictionary, and the language with the smallest sum wins. The
score is the relative margin to the second language; narrow margins are rejected.

The sample is bounded: at most SAMPLES documents of a language, one for each hash bucket (the
smallest hash in it), and SAMPLE_CHARS characters of each. The choice is a partial minimum over
ids, so no language's documents are gathered. Prediction is row-local and reads whole texts.

Defined results: ``und`` with score 0 if the text is null, has no letter, or nothing was learned;
equal sizes give the first name in order, with score 0; with one learned language the score is 1;
rows with a null id or language are not learned from; repeated rows are judged separately.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.shared import BROADCAST_ROWS, give_back, pick, staged

SAMPLES, SAMPLE_CHARS = 64, 2048
CHUNK, LEVEL = 2048, 5
#: A relative margin under this is narrow.
NARROW = 0.002
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries from (doc_id, text, lang); at most SAMPLES * SAMPLE_CHARS characters each.

    The choice is made on ids alone and, being small, sent to the texts, which are not shuffled.
    """
    t = labelled.where("doc_id is not null and lang is not null and text is not null")
    key = {"h": F.xxhash64("doc_id"), "bucket": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SAMPLES))}
    chosen = t.select("lang", "doc_id").withColumns(key).groupBy("lang", "bucket").agg(F.min("h").alias("h"))
    chosen = staged(chosen, "sample")
    begin = t.select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).withColumns(key)
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    rows = begin.join(few, ["lang", "bucket", "h"]).groupBy("lang", "bucket").agg(F.min("text").alias("text"))
    found: dict[str, list] = {}
    for row in rows.collect():
        found.setdefault(row["lang"], []).append((row["bucket"], row["text"]))
    return {lang: "\n".join(x for _, x in sorted(texts)).lower().encode("utf-8", "surrogatepass") for lang, texts in sorted(found.items())}


class Classifier:
    """Predicts (language, score) of a text."""

    def __init__(self, dictionaries: dict[str, bytes], chunk: int = CHUNK, level: int = LEVEL):
        import regex
        import zstandard

        self.letter, self.chunk, self.names, self.compressors = regex.compile(r"\p{L}").search, chunk, sorted(dictionaries), []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names or not self.letter(text):
            return UNKNOWN, 0.0
        raw = text.lower().encode("utf-8", "surrogatepass")
        chunks = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        sizes = [sum(len(compress(c)) for c in chunks) for compress in self.compressors]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        others = [s for i, s in enumerate(sizes) if i != best]
        return self.names[best], 1 - sizes[best] / min(others) if others else 1.0


def predict(docs: DataFrame, dictionaries: dict[str, bytes], prefix: str = "", drop_text: bool = False) -> DataFrame:
    """Adds lang_pred, score and accepted, named with the prefix, to rows that have a ``text``.

    A column of ``docs`` with one of these names is replaced.
    """
    names = [prefix + n for n in ("lang_pred", "score", "accepted")]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names and not (drop_text and f.name == "text")])
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for batch in batches:
            added = _columns([classify(t.as_py()) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns[:-3]], *added], names=columns)
        batch = added = None
        give_back()

    return docs.mapInArrow(run, schema)


def _columns(found: list[tuple[str, float]]) -> list[pa.Array]:
    accepted = [lang != UNKNOWN and score >= NARROW for lang, score in found]
    return [pa.array([x for x, _ in found], pa.string()), pa.array([float(s) for _, s in found], pa.float64()), pa.array(accepted, pa.bool_())]


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents that are not held out; predicts every document."""
    t = pick(docs, doc_id="doc_id", text="text", lang="lang")
    dictionaries = learn(t.where(~held_out(F.col("doc_id"))))
    slim = t.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(slim, dictionaries, drop_text=True)
