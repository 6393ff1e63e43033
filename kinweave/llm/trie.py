"""Prefix trie of conversations by whole-sequence collapse.

Turns are told apart by role and the text's MD5. Identical conversations collapse to one weighted
sequence with the list of its members; sequences that are proper prefixes of others are dropped by an
anti-join, the rest are the leaves; weighted prefixes of the distinct sequences are aggregated to nodes.

A node is known by its depth and a 128-bit running xor of its turns' hashes, each taken with the
turn's place. So it can be summed along a conversation in pieces: no conversation, first turn or group
of copies has to fit into one task. Texts are not shuffled. A subtree's sum is cut along the paths of
the nodes' smallest members: nodes with the same smallest member are the end of its path, so a sum from
the end of that path and the whole sums of the other sequences through a node give its subtree.

The digest of a list of members is sequential by its definition. Members are joined to texts in blocks
of ids first; only these texts pass through the task of a list, in order and with constant memory.

Defined results: rows with a null conv_id take no part; a null role or text is empty; equal turn
numbers follow in order of role, then of the text's MD5; repeated rows are turns of their own; an empty
table has no nodes, a table without rebuilt turns only the root. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.shared import pick, spread_join, staged

#: A conversation takes up to HEADS - 1 turns of the first conversation of its FAMILY.
FAMILY, HEADS = 100, 6
#: Ids of a block of a list.
BLOCK = 512
EMPTY = hashlib.sha256().hexdigest()


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and xors, the own row included, along each group; equal rows follow in any order.

    Rows are dealt by ranges of group and order, so a group may cover many of them. Fewer groups than
    there are ranges do; what they have before a range is broadcast.
    """
    how = {**{c: F.sum for c in sums or {}}, **{c: F.bit_xor for c in xors or {}}}
    t = df.withColumns({**(sums or {}), **(xors or {}), "_row": F.monotonically_increasing_id()})
    t = staged(t.repartitionByRange(group, *order, "_row").withColumn("_range", F.spark_partition_id()), "ranges")
    wide = t.groupBy(group).agg(F.min("_range").alias("_a"), F.max("_range").alias("_b")).where("_a < _b").select(group)
    parts = t.join(F.broadcast(wide), group).groupBy(group, "_range").agg(*[f(c).alias(f"_{c}") for c, f in how.items()])
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_range", *[f(f"_{c}").over(before).alias(f"_{c}") for c, f in how.items()])
    within = Window.partitionBy(group, "_range").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({c: f(c).over(within) for c, f in how.items()}).join(F.broadcast(parts), [group, "_range"], "left")
    plus = {c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in sums or {}}
    other = {c: F.col(c).bitwiseXOR(F.coalesce(F.col(f"_{c}"), F.lit(0).cast("long"))) for c in xors or {}}
    return t.withColumns({**plus, **other}).drop("_row", "_range", *[f"_{c}" for c in how])


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, role, digest, n_chars) from (conv_id, turn, role, text); staged."""
    t = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null")
    text = F.coalesce("text", F.lit(""))
    slim = t.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(text).alias("digest"), F.length(text).cast("long").alias("n_chars"))
    placed = running(slim, "conv_id", ["turn", "role", "digest"], sums={"pos": F.lit(1).cast("long")})
    return staged(placed.select("conv_id", "pos", "role", "digest", "n_chars"), "turns")


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.pmod(F.crc32(F.encode(conv_id.cast("string"), "UTF-8")), F.lit(HEADS)).cast("int")


def rebuild(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id, n turns), and their turns (conv_id, depth from 1, role, digest, n_chars).

    From ``ordered`` turns: the head of the family's first conversation, then the own turns after as many.
    """
    own = t.groupBy("conv_id").agg(F.max("pos").alias("n_own"))
    own = own.select("conv_id", "n_own", head_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"))
    first = t.where(F.col("conv_id") % FAMILY == 0).where(F.col("pos") < HEADS)
    heads = first.groupBy(F.col("conv_id").alias("family")).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "digest", "n_chars"))).alias("head"))
    convs = own.join(heads, "family", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")))
    convs = staged(convs, "conversations")
    missing = (F.col("h") - F.size("head")).alias("missing")
    short = convs.select("conv_id", missing, F.col("n_own").alias("n")).where("missing > 0")
    rest = spread_join(t.where(F.col("pos") > head_turns(F.col("conv_id"))), short, "conv_id", "n", "left")
    rest = rest.select("conv_id", (F.col("pos") - F.coalesce("missing", F.lit(0))).alias("depth"), "role", "digest", "n_chars")
    taken = convs.select("conv_id", F.posexplode("head").alias("i", "x")).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "x.role", "x.digest", "x.n_chars")
    n = F.size("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    return convs.select("conv_id", n.cast("long").alias("n")), taken.unionByName(rest)


def _node(depth: str | Column, a: str | Column, b: str | Column) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(to) for c, to in ((depth, "depth"), (a, "a"), (b, "b"))])


def chained(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n_chars, node, parent) of every prefix of every conversation, the root's excepted; staged."""
    own = [F.xxhash64(F.lit(seed), "depth", "role", "digest") for seed in (1, 2)]
    t = running(turns, "conv_id", ["depth"], xors={"a": own[0], "b": own[1]})
    parent = _node(F.col("depth") - 1, F.col("a").bitwiseXOR(own[0]), F.col("b").bitwiseXOR(own[1]))
    return staged(t.select("conv_id", "depth", "n_chars", _node("depth", "a", "b").alias("node"), parent.alias("parent")), "prefixes")


def sequences(convs: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the node that they end in, and distinct sequences (node, smallest member
    conv_id, weight, n turns); both staged."""
    ends = chain.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    zero = F.lit(0).cast("long")
    members = staged(convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("node", _node(zero, zero, zero)).alias("node")), "members")
    found = members.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
    return members, staged(found.withColumn("n", F.col("node.depth")), "sequences")


LISTS = "depth long, a long, b long, ends_sha256 string"


def list_digests(members: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): the digest of the comma-joined ids, in ascending order, that end in a node."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for *node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if node != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _lists(done)
            done = []
        if now is not None:
            yield _lists([(*now, state.hexdigest())])

    ids = F.array_sort(F.collect_list("conv_id"))
    blocks = members.groupBy("node", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(ids.cast("array<string>"), ",").alias("ids"))
    t = blocks.select("node.*", "block", "ids").repartition("depth", "a", "b")
    return t.sortWithinPartitions("depth", "a", "b", "block").mapInArrow(digest, LISTS)


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["depth", "a", "b", "ends_sha256"])


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, n) with turns (conv_id, depth, role, digest, n_chars).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.
    """
    chain = chained(turns)
    members, found = sequences(convs, chain)
    paths = spread_join(chain, found.where("n > 0").select("conv_id", "weight", "n", F.col("n").alias("rows")), "conv_id", "rows")
    paths = staged(paths, "paths")
    inner = paths.where("depth < n").select("node").distinct()
    leaves = staged(found.where("n > 0").join(inner, "node", "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"), "n"), "leaves")

    nodes = spread_join(paths.withColumnRenamed("n", "length"), leaves, "conv_id", "n", "left").groupBy("node", "parent").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.max("n_chars").alias("n_chars")
    )
    nodes = staged(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars")), "nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes_with = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    steps = nodes.select("node", "conv_id", (-F.col("node.depth")).alias("up"), "saved")
    below = running(steps, "conv_id", ["up"], sums={"below": F.col("saved")}).select("node", "below")
    totals = nodes.groupBy("conv_id").agg(F.sum("saved").alias("total"))
    totals = staged(totals.join(found.select("conv_id", "n"), "conv_id"), "totals")
    through = spread_join(paths.select("conv_id", "node"), totals, "conv_id", "n").groupBy("node").agg(F.sum("total").alias("through"))

    full = nodes_with.join(below, "node").join(through, "node")
    full = spread_join(staged(full, "sums"), totals, "conv_id", "n")
    full = staged(full.withColumn("saved_tokens", F.col("through") - F.col("total") + F.col("below")), "trie")
    parents = full.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"), "n_children")
    start = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("conv_id is not null")
    out = spread_join(full.withColumnRenamed("n_children", "fanout"), parents, "parent", "n_children", "left")
    out = out.crossJoin(F.broadcast(start.select(F.col("conv_id").alias("root"))))
    columns = ["conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "depth", "a", "b"]
    out = out.select("*", F.coalesce("above", F.when(F.col("node.depth") == 1, F.col("root"))).alias("parent_conv_id"), F.col("fanout").alias("n_children"), "node.*").select(*columns)

    one = F.col("node.depth") == 1
    sums = full.agg(F.count(F.when(one, 1)).alias("n_children"), F.sum(F.when(one, F.col("n_leaves"))).alias("leaves"), F.sum(F.when(one, F.col("saved_tokens"))).alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    root = start.crossJoin(sums).withColumns({"parent_conv_id": F.lit(None).cast("long"), "depth": zero, "a": zero, "b": zero})
    root = root.withColumns({"n_leaves": F.coalesce("leaves", F.lit(1)), "saved_tokens": F.coalesce("saved_tokens", zero)}).select(*columns)

    key = ["depth", "a", "b"]
    out = out.unionByName(root).join(list_digests(members), key, "left").drop("a", "b")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    convs, rows = rebuild(ordered(turns))
    return prefix_trie(convs, rows)
