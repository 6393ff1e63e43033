"""From raw documents to token files: five stages, each a Spark job over its predecessor's rows.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. A
stage's result is written as Parquet and read again before the next begins, so the loss of an
executor repeats one stage at most.

Rows, not ids, are judged: rows that repeat a doc_id or have none are kept or dropped by their own
texts. Stage by stage: language ID drops null, empty and unclear texts; near-duplicates keep one row
of each group (of rows that agree in id and text, any one), and every row without words;
decontamination drops just the rows that hold an item; mixing takes rows by a hash of their id, so
rows that share an id share its draw; token files have a row for each row. Columns of any name pass
through unchanged; empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import arrowtokens, decontam, langid, mixing, neardup, queries
from kinweave.llm.shared import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown or whose margin is narrow."""
    dictionaries = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    prefix = f"_{uuid.uuid4().hex[:8]}_"  # no column of docs begins so
    return langid.predict(docs, dictionaries, prefix).where(f"{prefix}accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the smallest id."""
    return neardup.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents at their cells' rates."""
    return mixing.sample(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files; one row a document, read back from them."""
    _, rows = arrowtokens.encode_documents(spark, docs, queries.tokenizer_path())
    return rows


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token files", token_files),
]

#: Compression and the tokenizer have no SQL form; tests compare with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
