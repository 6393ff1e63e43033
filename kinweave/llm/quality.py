"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for each document and stores its measurements and the
bits of the rules that it fails. Policies are named, versioned sets of rules; ``apply_policy``
and ``ablation`` read the bits only, so a new policy never touches the texts again. All work
is row-local (no shuffle, no Python); only ``ablation`` aggregates, by at most 2**rules keys.

Defined results: a null or empty text has no words and fails ``too_few_words``; repeated rows
are judged separately; columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import SPACE, computed_once, pick, words

#: The rules in the order of their bits. Integer arithmetic keeps verdicts exact.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BASE = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document that fails one of them is rejected."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (name, _) in enumerate(RULES) if name in self.rules)


POLICIES = {
    "base": Policy("base", 1, BASE),
    "web": Policy("web", 2, tuple(name for name, _ in RULES)),
}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each document, taken from its whole text.

    Windows of three words are compared by a 64-bit hash within a document. Documents without
    a repeated window, most of them, never sort; the others sort (hash, position) pairs and
    look at neighbours, so a document of n words costs n log n.
    """
    t = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    t = t.withColumns({"w": words(F.col("text")), "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    t = t.withColumn("n", F.size("w"))
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    t = t.withColumn("h", F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), window)))
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    t = t.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    same = lambda a, b: F.get("s", a)["x"] == F.get("s", b)["x"]
    twice = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    covered = F.flatten(F.transform(twice, lambda j: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.get("s", j)["i"] + k)))
    t = t.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    return computed_once(t)


def fail_bits() -> Column:
    """Bit i is set if rule i fails."""
    bits = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and failure bits of each document; store this table and apply policies to it."""
    return measure(docs, id_col, text_col).withColumn("fail_bits", fail_bits())


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows only it rejects, rows kept without it.

    The ledger is first summed by its bits (at most 2**rules groups, summed before the shuffle).
    """
    by_bits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [(i, name) for i, (name, _) in enumerate(RULES) if name in policy.rules]
    rule = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in chosen]))
    t = by_bits.withColumn("r", rule)
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    bits, bit = F.col("bits"), F.col("r.bit")
    return t.groupBy(F.col("r.rule").alias("rule")).agg(
        total(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        total(bits == bit).alias("n_only_this"),
        total(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )
