"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import arrowtokens, chat, decontam, goodness, hostrep, langid, lemp, mixing, neardup, pii, quality, trie, warc
from kinweave.llm.shared import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def mixing_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target of the mixture its share in the expected sample, whether it is met, and the share of
    all tokens that the sample has (``attained``), which the scarcest category bounds."""
    cells = mixing.cells_of(mixing.measured(table(spark, sf_dir, "documents")))
    goal = mixing.goals(cells)
    rate = mixing.rates(cells, goal)
    attained = rate.agg(F.round(F.try_divide(F.sum("weight"), F.sum("tokens")), 6).alias("attained"))  # one row
    t = mixing.margins(rate, goal).join(F.broadcast(attained))
    return t.select("margin", "category", F.round("target", 6).alias("target"), F.round("share", 6).alias("share"), "met", "attained")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all documents under policy ``web``; the bits of ``base`` give base_failed."""
    ledger = staged(quality.ledger(table(spark, sf_dir, "documents")), "ledger")
    rows = quality.apply_policy(ledger, quality.POLICIES["web"])
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality.POLICIES["base"].mask)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy ``web`` rejects, from the stored ledger's bits alone."""
    ledger = staged(quality.ledger(table(spark, sf_dir, "documents")), "ledger")
    return quality.ablation(ledger, quality.POLICIES["web"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = arrowtokens.encode_documents(spark, table(spark, sf_dir, "documents"), tokenizer_path())
    return rows


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the page with the same id: toxic or of low quality is bad."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrep.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = warc.archive(spark, table(spark, sf_dir, "pages"), min_bytes=0)
    return records


CONTROL_CASE = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    case = spark.createDataFrame([(-7, 0, "user", CONTROL_CASE), (-7, 1, "assistant", CONTROL_CASE)], turns.schema)
    turns = turns.unionByName(case).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    return chat.read_back(chat.format_turns(turns))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lemp.mine(table(spark, sf_dir, "embeddings"))


def op13_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goodness.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing, mixing_margins, op2_quality_rules, quality_ablation, op3_language_id, op4_decontamination, op5_token_files,
        op6_near_duplicates, op7_personal_data, op8_url_filter, op9_warc, op10_chat_format, op11_prefix_trie,
        op12_hard_negatives, op13_quality_scores,
    )
}
