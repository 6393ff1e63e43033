"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) of token counts before anything else. The
cells' token weights are raked, margin by margin, until source, language and topic have their target
shares: a cell's sampling rate is min(1, product of one factor a category), so weights are calibrated
under the bound that no document is taken twice. SHARE is the most of all tokens that is sampled;
where the rarest category has too few tokens for it, the share starts lower, and while the margins
do not settle it is lowered by LESS every PATIENCE sweeps, so the sample gets smaller, never off its
targets. ``margins`` says of each target whether it is met; targets that contradict each other are
not. A seeded hash of the id decides, so the sample does not depend on partitions and can be repeated.

Up to MOST_CELLS cells the whole iteration is one expression over arrays in one row, linear in the
cells a sweep; beyond that the same sweeps run on distributed tables, each
written to the shared folder. Both stop by the same rule. Sampling is this operator's purpose; nothing else drops rows.

The topic is a given column, or else the first fitting sign of TOPICS in the text.

Defined results: a null source, language or topic counts as the empty one; a null or empty text has
no tokens and topic ``prose``; cells without tokens have rate 0 and their documents are not
sampled; categories without tokens drop out of the targets, which are normalised again; a null
id is sampled as the empty id; repeated rows share their id's decision; no rows give none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.shared import pick, spread_join, staged, words

MARGINS = ("source", "lang", "topic")
SHARE, TEMPERATURE, SEED = 0.5, 0.5, "mix-1"
#: Relative error allowed, sweeps in all, sweeps before the share is lowered, and by what.
TOLERANCE, SWEEPS, PATIENCE, LESS = 1e-3, 64, 16, 0.8
#: Share of the scarcest category's bound that is tried first.
NEAR = 0.95
#: Cells that are fitted in one row.
MOST_CELLS = 100_000
#: Topics as (name, text that shows it), the first that fits.
TOPICS = (("legal", "icense"), ("contact", "@"), ("table", " | "), ("code", "="))
OTHER = "prose"


def topic_of(text: Column) -> Column:
    topic = F.lit(OTHER)
    for name, sign in reversed(TOPICS):
        topic = F.when(F.contains(text, F.lit(sign)), F.lit(name)).otherwise(topic)
    return topic


def cell_of(topic: str | None = None) -> Column:
    """The cell of a document; ``topic`` names a column that has it."""
    none = F.lit("")
    topic = F.coalesce(F.col(topic), none) if topic else topic_of(F.coalesce("text", none))
    return F.struct(F.coalesce("source", none).alias("source"), F.coalesce("lang", none).alias("lang"), topic.alias("topic"))


def measured(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """doc_id, cell and n_tokens of each document."""
    return docs.select("doc_id", cell_of(topic).alias("cell"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"))


def cells_of(slim: DataFrame) -> DataFrame:
    """cell, its margins, tokens and number of documents."""
    t = slim.groupBy("cell").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    return staged(t.select("cell", "cell.*", "tokens", "n"), "cells")


def goals(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(margin, category, have, goal): tokens of each category that has some, and those wanted if all
    tokens were sampled.

    ``targets`` maps a margin to (category, share), which need not sum to 1; margins without one get
    the tokens' shares to the power TEMPERATURE, which lifts small categories.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("category")) for m in MARGINS])).alias("c")
    have = cells.where("tokens > 0").select(each, "tokens").groupBy("c.margin", "c.category").agg(F.sum("tokens").cast("double").alias("have"))
    weight = F.pow("have", F.lit(TEMPERATURE))
    for m, target in (targets or {}).items():
        wanted = target.select(F.lit(m).alias("margin"), "category", F.col("share").alias(f"share_{m}"))
        have = have.join(wanted, ["margin", "category"], "left")
        weight = F.when(F.col("margin") == m, F.coalesce(f"share_{m}", F.lit(0.0))).otherwise(weight)
    have = have.select("margin", "category", "have", weight.alias("weight"))
    sums = have.groupBy("margin").agg(F.sum("weight").alias("all"), F.sum("have").alias("total"))  # three rows
    goal = F.coalesce(F.try_divide(F.col("weight") * F.col("total"), F.col("all")), F.lit(0.0)).alias("goal")
    return staged(have.join(F.broadcast(sums), "margin").select("margin", "category", "have", goal), "goals")


def first_share(goal: DataFrame, share: float) -> float:
    """The share that is tried first: at most a little under what the scarcest category allows."""
    bound = goal.where("goal > 0").agg(F.min(F.col("have") / F.col("goal"))).first()[0]
    return min(share, NEAR * bound) if bound else share


def _with_goals(cells: DataFrame, goal: DataFrame) -> DataFrame:
    t = cells.where("tokens > 0").select(*MARGINS, "tokens")
    for m in MARGINS:
        t = t.join(goal.where(F.col("margin") == m).select(F.col("category").alias(m), F.col("goal").alias(f"g_{m}")), m)
    return t


def _in_one_row(cells: DataFrame, goal: DataFrame, share: float, sweeps: int) -> DataFrame:
    """The rates by one expression over arrays: cells, and for each margin its categories' members."""
    t = _with_goals(cells, goal)
    t = t.withColumn("i", F.row_number().over(Window.orderBy(*MARGINS)) - 1)  # at most MOST_CELLS rows
    t = t.withColumns({f"k_{m}": F.dense_rank().over(Window.orderBy(m)) - 1 for m in MARGINS})
    t = staged(t, "numbered")
    row = t.select(F.lit("cell").alias("part"), "i", F.struct(*MARGINS, "tokens", *[f"k_{m}" for m in MARGINS]).alias("cell"), F.lit(None).cast("double").alias("goal"), F.array().cast("array<int>").alias("ids"))
    for m in MARGINS:
        members = t.groupBy(F.col(f"k_{m}").alias("i"), F.col(f"g_{m}").alias("goal")).agg(F.array_sort(F.collect_list("i")).alias("ids"))
        row = row.unionByName(members.withColumn("part", F.lit(m)), allowMissingColumns=True)
    ordered = lambda part, *names: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("i", *names)))), lambda x: F.struct(*[x[n].alias(n) for n in names]))
    row = row.agg(F.transform(ordered("cell", "cell"), lambda x: x["cell"]).alias("cells"), *[ordered(m, "goal", "ids").alias(m) for m in MARGINS])

    def sweep(m: str, s: str) -> str:
        """State after margin m: rates q, and the largest error of the sweep so far."""
        got = f"transform({m}, c -> aggregate(c.ids, 0D, (a, i) -> a + cells[i].tokens * least(1D, {s}.q[i])))"
        factor = f"transform({got}, (x, k) -> if(x > 0, {m}[k].goal * {s}.share / x, 0D))"
        q = f"transform({s}.q, (x, i) -> x * f[cells[i].k_{m}])"
        off = f"aggregate(f, {s}.off, (a, x) -> greatest(a, if(x > 0, abs(x - 1D), 0D)))"
        return f"transform(array({factor}), f -> named_struct('q', {q}, 'share', {s}.share, 'off', {off}, 'n', {s}.n))[0]"

    lowered = f"if(s.n > 0 and s.n % {PATIENCE} = 0, {LESS}D, 1D)"
    begun = f"transform(array({lowered}), l -> named_struct('q', transform(s.q, x -> if(l < 1D, least(1D, x) * l, x)), 'share', s.share * l, 'off', 0D, 'n', s.n + 1))[0]"
    step = begun
    for m in MARGINS:
        step = f"transform(array({step}), s{m} -> {sweep(m, f's{m}')})[0]"
    state = f"named_struct('q', transform(cells, c -> {share!r}D), 'share', {share!r}D, 'off', 1D, 'n', 0)"
    row = row.withColumn("s", F.expr(f"aggregate(sequence(1, {sweeps}), {state}, (s, r) -> if(s.off < {TOLERANCE}D, s, {step}))"))
    t = row.select(F.explode(F.expr("transform(cells, (c, i) -> named_struct('c', c, 'q', s.q[i]))")).alias("x"))
    return t.select(*[F.col(f"x.c.{m}").alias(m) for m in MARGINS], F.least(F.lit(1.0), "x.q").alias("rate"))


def _in_tables(cells: DataFrame, goal: DataFrame, share: float, sweeps: int) -> DataFrame:
    """The same rates by windows over the table of cells."""
    t = staged(_with_goals(cells, goal), "bounded").withColumns({"q": F.lit(share), "off": F.lit(1.0)})
    for n in range(sweeps):
        if n and n % PATIENCE == 0:
            share, t = share * LESS, t.withColumn("q", F.least(F.lit(1.0), "q") * F.lit(LESS))
        t = t.withColumn("off", F.lit(0.0))
        for m in MARGINS:
            t = t.withColumn("got", F.sum(F.col("tokens") * F.least(F.lit(1.0), "q")).over(Window.partitionBy(m)))
            t = t.withColumn("f", F.when(F.col("got") > 0, F.col(f"g_{m}") * F.lit(share) / F.col("got")).otherwise(F.lit(0.0)))
            off = F.greatest("off", F.when(F.col("f") > 0, F.abs(F.col("f") - 1)).otherwise(F.lit(0.0)))
            t = t.withColumns({"off": off, "q": F.col("q") * F.col("f")}).drop("got", "f")
        t = staged(t, "bounded")
        if (t.agg(F.max("off")).first()[0] or 0.0) < TOLERANCE:
            break
    return t.select(*MARGINS, F.least(F.lit(1.0), "q").alias("rate"))


def rates(cells: DataFrame, goal: DataFrame, share: float = SHARE, sweeps: int = SWEEPS) -> DataFrame:
    """Every cell with its sampling rate in [0, 1] and calibrated weight (expected tokens)."""
    fit = _in_one_row if cells.count() <= MOST_CELLS else _in_tables
    rate = fit(cells, goal, first_share(goal, share), sweeps)
    t = cells.join(rate, list(MARGINS), "left").withColumn("rate", F.round(F.coalesce("rate", F.lit(0.0)), 6))
    return staged(t.withColumn("weight", F.col("tokens") * F.col("rate")), "rates")


def margins(rate: DataFrame, goal: DataFrame) -> DataFrame:
    """margin, category, target share, share of the expected sample, and whether the target is met."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("category")) for m in MARGINS])).alias("c")
    got = rate.select(each, "weight").groupBy("c.margin", "c.category").agg(F.sum("weight").alias("got"))
    all_got = F.broadcast(rate.agg(F.sum("weight").alias("all_got")))  # one row
    all_goal = F.broadcast(goal.groupBy("margin").agg(F.sum("goal").alias("all_goal")))  # three rows
    t = goal.join(got, ["margin", "category"], "left").join(all_goal, "margin").join(all_got)
    t = t.select("margin", "category", F.try_divide("goal", "all_goal").alias("target"), F.try_divide("got", "all_got").alias("share"))
    return t.withColumn("met", F.coalesce(F.abs(F.col("share") - F.col("target")) <= 5 * TOLERANCE * F.col("target"), F.lit(False)))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id, from 52 bits of a digest."""
    text = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _with_rate(rows: DataFrame, rate: DataFrame, key: str) -> DataFrame:
    """Rows with the rate of their cell (column ``key``); rates are broadcast while they are few."""
    rate = rate.select(F.col("cell").alias(key), F.col("rate").alias(f"{key}_rate"), F.col("n").alias(f"{key}_n"))
    if rate.count() <= MOST_CELLS:
        return rows.join(F.broadcast(rate.drop(f"{key}_n")), key)
    return spread_join(rows, rate, key, f"{key}_n")


def mix(docs: DataFrame, share: float = SHARE, targets: dict[str, DataFrame] | None = None, topic: str | None = None) -> DataFrame:
    """doc_id, margins, n_tokens, rate and kept of each document."""
    slim = staged(measured(pick(docs, doc_id="doc_id", source="source", lang="lang", text="text", **({topic: topic} if topic else {})), topic), "margins")
    cells = cells_of(slim)
    t = _with_rate(slim, rates(cells, goals(cells, targets), share), "cell")
    kept = uniform(F.col("doc_id")) < F.col("cell_rate")
    return t.select("doc_id", "cell.*", "n_tokens", F.col("cell_rate").alias("rate"), kept.alias("kept"))


def sample(docs: DataFrame, share: float = SHARE, targets: dict[str, DataFrame] | None = None, topic: str | None = None) -> DataFrame:
    """The sampled documents with all their columns; texts are not shuffled while rates are few."""
    cells = cells_of(measured(docs, topic))
    key = f"_cell_{uuid.uuid4().hex[:8]}"  # no column of docs has this name
    t = _with_rate(docs.withColumn(key, cell_of(topic)), rates(cells, goals(cells, targets), share), key)
    return t.where(uniform(F.col("doc_id")) < F.col(f"{key}_rate")).select(*docs.columns)
