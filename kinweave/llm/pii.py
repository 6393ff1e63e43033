"""Personal data: exact base spans, and secrets found by weak supervision.

Base kinds (email, ip, card, phone) are regular expressions with checks. For secrets, every long
run of key characters with a digit is a candidate on which labelers vote for, against or not at
all: known key formats (regex), words that announce a key (gazetteer), and what stands around
the span or how mixed it is (context). A candidate's votes are one of at most 3**4 patterns, so
votes are summed to patterns, and expectation-maximisation over that table estimates each
labeler's reliability in both classes. The pattern posteriors are soft labels for a naive Bayes
classifier over the candidates' shapes and votes (a bounded list of features), which decides.

Everything is DataFrame and SQL functions. Texts are scanned once; base spans and candidates are
kept as a table. Only pattern and feature sums, both bounded, reach the driver.

Positions are code points, end exclusive, and follow from the lengths of the pieces between
matches, summed in blocks, so a text with any number of matches costs little more than its
length. Quantifiers are possessive and starts are anchored, so no text makes the expressions
backtrack. Defined results: null text is empty and has no spans; repeated rows are separate;
without candidates nothing is learned and only base spans are returned; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import pick, staged

#: Pattern, a sign without which a text has no match, and the check of a match.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
BLOCK = 512

#: Candidates and the words of the labelers, fixed values.
CANDIDATE = r"[A-Za-z0-9_+/=.-]{12,}+"
FORMATS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+)$"
ANNOUNCED = r"(?i)(?:pass(?:word|wd)?|secret|token|api_?key|access_?key|private_?key|credential)"
LABELERS = ("format", "gazetteer", "context", "mixture")
ROUNDS = 15


def matches(text: Column, pattern: str, sign: Column) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.transform(gaps, lambda g: F.length(g)).alias("g"))
    t = F.filter(pairs, lambda x: x["m"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + x["g"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"))).alias("out"))

    def add_block(a: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(a["at"].alias("at"), empty.alias("out")), add)
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out"))), F.lit(0))

    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(p, i + 1, BLOCK))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,match:string>>>").alias("out"))
    whole = F.get(F.transform(F.array(t), lambda p: F.flatten(F.aggregate(blocks(p), start, add_block)["out"])), F.lit(0))
    return F.when(sign, whole).otherwise(empty)


def luhn(digits: Column) -> Column:
    """The check sum of a card number."""
    n = F.length(digits)

    def step(a: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return a + F.when(i % 2 == 1, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, end, match) by kind; matches that fail their check are dropped."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    small = lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    between = lambda m, a, b: F.length(digits(m)).between(a, b)
    return {
        "email": matches(text, _EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, _IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: small(x["match"])),
        "card": F.filter(matches(text, _CARD, text.rlike(r"[0-9][\x20-]?[0-9]")), lambda x: F.when(between(x["match"], 13, 19), luhn(digits(x["match"]))).otherwise(False)),
        "phone": F.filter(matches(text, _PHONE, F.contains(text, F.lit("+"))), lambda x: between(x["match"], 9, 15)),
    }


def _candidates(text: Column) -> Column:
    """Long runs of key characters with a digit, with the key's own span and what precedes it."""
    runs = F.filter(matches(text, CANDIDATE, text.rlike("[0-9]")), lambda x: x["match"].rlike("[0-9]"))

    def parts(x: Column) -> Column:
        name = F.regexp_extract(x["match"], r"^(?:[A-Za-z_.-]*=)?", 0)
        key = F.substring(x["match"], F.length(name) + 1, F.length(x["match"]))
        return F.struct((x["start"] + F.length(name)).alias("start"), x["end"].alias("end"), key.alias("key"), F.concat(F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))), name).alias("before"))

    return F.transform(runs, parts)


def votes(c: Column) -> Column:
    """One number for each labeler: 3 j for against, 3 j + 1 for no opinion, 3 j + 2 for."""
    key, before = c["key"], c["before"]
    kinds = F.when(key.rlike("[0-9]"), 1).otherwise(0) + F.when(key.rlike("[a-z]"), 1).otherwise(0) + F.when(key.rlike("[A-Z]"), 1).otherwise(0)
    distinct = F.size(F.array_distinct(F.split(key, "")))
    vote = (
        F.when(key.rlike(FORMATS), 2).otherwise(1),
        F.when(before.rlike(ANNOUNCED), 2).otherwise(1),
        F.when(before.rlike("[=:\"'`]\\s*$"), 2).when(before.rlike(r"[A-Za-z0-9,.]\s+$"), 0).otherwise(1),
        F.when((kinds >= 2) & (distinct >= 8) & ~key.rlike(r"[.\-/]"), 2).when((kinds == 1) | (distinct < 6), 0).otherwise(1),
    )
    return F.array(*[(F.lit(3 * j) + v).cast("int") for j, v in enumerate(vote)])


def features(c: Column) -> Column:
    """The shape of a candidate as strings of a bounded list, with its votes."""
    n, key = F.length(c["key"]), c["key"]
    shape = [
        F.concat(F.lit("len:"), F.least(n / 8, F.lit(9)).cast("int").cast("string")),
        F.concat(F.lit("digits:"), (4 * F.length(F.regexp_replace(key, "[^0-9]", "")) / F.greatest(n, F.lit(1))).cast("int").cast("string")),
        F.concat(F.lit("upper:"), (4 * F.length(F.regexp_replace(key, "[^A-Z]", "")) / F.greatest(n, F.lit(1))).cast("int").cast("string")),
        F.concat(F.lit("marks:"), F.least(F.length(F.regexp_replace(key, "[A-Za-z0-9]", "")), F.lit(3)).cast("string")),
    ]
    return F.concat(F.array(*shape), F.transform(c["votes"], lambda v: F.concat(F.lit("vote:"), v.cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base spans by kind, candidates with votes and features) of each document."""
    t = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    t = t.withColumns({**base_spans(F.col("text")), "found": _candidates(F.col("text"))}).drop("text")
    taken = F.concat(*[F.col(k) for k in BASE])
    t = t.withColumn("found", F.when(F.size("found") > 0, F.filter("found", lambda c: (F.length(c["key"]) >= 12) & ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))).otherwise(F.col("found")))
    t = t.withColumn("found", F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["key"].alias("key"), votes(c).alias("votes"))))
    t = t.withColumn("found", F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["votes"].alias("votes"), features(c).alias("features"))))
    bare = {k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in BASE}
    return t.select("doc_id", *[c.alias(k) for k, c in bare.items()], "found")


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row: class share ``p`` and the vote chances ``t1``, ``t0`` of the two classes, by EM.

    ``patterns``: votes and their number ``n``. The whole iteration is one expression over the
    at most 3**len(LABELERS) patterns.
    """
    n = 3 * len(LABELERS)
    first, other = "0.1D, 0.3D, 0.6D", "0.4D, 0.5D, 0.1D"
    start = f"named_struct('p', 0.3D, 't1', array({', '.join([first] * len(LABELERS))}), 't0', array({', '.join([other] * len(LABELERS))}))"
    expected = "transform(pats, x -> named_struct('k', x.votes, 'n', x.n, 'r', 1D / (1D + (1D - s.p) / s.p * aggregate(x.votes, 1D, (a, j) -> a * s.t0[j] / s.t1[j]))))"
    weight = {"t1": "y.n * y.r", "t0": "y.n * (1D - y.r)"}
    chance = lambda t: f"transform(sequence(0, {n - 1}), c -> (1D + aggregate(q, 0D, (a, y) -> a + if(array_contains(y.k, c), {weight[t]}, 0D))) / (3D + aggregate(q, 0D, (a, y) -> a + {weight[t]})))"
    share = "(1D + aggregate(q, 0D, (a, y) -> a + y.n * y.r)) / (2D + aggregate(q, 0D, (a, y) -> a + y.n))"
    step = f"transform(array({expected}), q -> named_struct('p', {share}, 't1', {chance('t1')}, 't0', {chance('t0')}))[0]"
    pats = patterns.select(F.struct("votes", F.col("n").cast("double").alias("n")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("pats"))
    return pats.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})").alias("s")).select("s.*")


def train(scanned: DataFrame) -> dict[str, float]:
    """Log-odds of each feature (and of the class, under the empty name) from soft labels."""
    c = scanned.select(F.explode("found").alias("c")).select("c.votes", "c.features")
    patterns = staged(c.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "patterns")
    if not patterns.take(1):
        return {}
    s = reliabilities(patterns).first()
    t1, t0 = (F.array(*[F.lit(float(x)) for x in s[k]]) for k in ("t1", "t0"))
    odds = F.aggregate("votes", F.lit((1 - s["p"]) / s["p"]), lambda a, j: a * F.get(t0, j) / F.get(t1, j))
    soft = c.groupBy("votes", "features").agg(F.count(F.lit(1)).alias("n")).withColumn("r", 1 / (1 + odds))
    rows = soft.select("n", "r", F.explode("features").alias("f")).groupBy("f").agg(F.sum(F.col("n") * F.col("r")).alias("yes"), F.sum(F.col("n") * (1 - F.col("r"))).alias("no")).collect()
    total = soft.agg(F.sum(F.col("n") * F.col("r")).alias("yes"), F.sum(F.col("n") * (1 - F.col("r"))).alias("no")).first()
    import math

    weights = {r["f"]: math.log((r["yes"] + 0.5) / (total["yes"] + 1)) - math.log((r["no"] + 0.5) / (total["no"] + 1)) for r in rows}
    return {"": math.log((total["yes"] + 1) / (total["no"] + 1)), **weights}


def classify(scanned: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds the spans that the classifier takes for secrets."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    if not weights:
        return scanned.withColumn("secret", empty)
    table = F.create_map(*[F.lit(x) for item in sorted(weights.items()) for x in item])
    score = lambda c: F.aggregate(c["features"], F.lit(weights[""]), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    found = F.transform(F.filter("found", lambda c: score(c) > 0), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    return scanned.withColumn("secret", found)


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind, then start."""

    def named(kind: str) -> Column:
        return F.transform(F.array_sort(kind), lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans and all spans of each document."""
    scanned = staged(scan(docs), "spans")
    t = classify(scanned, train(scanned))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return t.select("doc_id", *counts[:4], F.sha2(F.encode(joined(BASE), "UTF-8"), 256).alias("base_sha256"), joined(KINDS).alias("spans"), counts[4], F.expr(" + ".join(f"size({k})" for k in KINDS)).cast("long").alias("n_spans"))
