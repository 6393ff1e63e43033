"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its 5-word shingles (64-bit hashes). Each set gets a signature of
SIGNATURE minwise values. In every one of TREES independent trees a set follows ROOT_BRANCH
chosen coordinates to its first nodes, keyed by the minwise token there. Nodes with one set
end; nodes of at most SMALL sets are compared exhaustively. In a larger node every set is
compared with PIVOTS members, which settles large groups of near copies; the sets that are unlike
all of them go on and, if they are still many, branch again by one coordinate drawn from the node's
key, and in one of SECOND nodes by a second one. So a pair at the threshold keeps 4/3 * 0.75 = 1
common branch on average, of the 12 that it starts with, while texts that share less, such as pages of
one template, shrink in number from level to level.

Nodes only propose: they link sets whose signatures agree enough (a bound far under the
threshold), which gives candidate groups. Every candidate's full set is then fetched once and
links are confirmed on full sets within its group. Pairs that are connected already need no
comparison. A group whose sets exceed GROUP_SHINGLES is cut into blocks; pairs of blocks are
separate tasks, and only blocks that are not yet one component are compared. Joins on sets, nodes,
roots and centres of stars deal the rows of hot keys by broadcast (``spread_join``).

At a similarity of 0.75 the chance that a link is missed is about 2e-6 (signature bound), and
under 1e-9 by the trees; ``test_recall_at_the_threshold`` measures it.

Equal sets form one class first, so a text with any number of copies is one vertex. Defined
results: null text, empty text and texts without words have n_shingles 0 and are linked with
nothing; fewer than five words are one shingle, the whole sequence; rows that repeat a doc_id
are judged by their own texts; a row with a null doc_id is linked like any other, but its group is
named by the smallest id that is not null, and by null only if it has none (``kept`` is: the own id
is the group's, null being equal to null); empty tables give no rows. ``survivors`` leaves exactly
one row of each group: of the smallest id, null last, then of the smallest hash of the text; which
of the rows with both in common is not defined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import BROADCAST_ROWS, give_back, pick, spread_join, staged, text_hash, without

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
SIGNATURE, TREES, ROOT_BRANCH, SECOND = 64, 8, 2, 3
SMALL, PIVOTS = 1000, 16
#: Shares of agreeing minwise values that make a candidate, in small nodes and with pivots, and
#: that settle a set with a pivot.
AGREE, AGREE_PIVOT, AGREE_NEAR = 0.5, 0.25, 0.75
GROUP_SHINGLES = 2_000_000
_SETS = "doc_id long, text_hash long, n_shingles long, set_id binary, keys array<long>, mins binary"
#: Words whose hashes are kept; a worker's table stays under ten MB.
_MANY = 1 << 16
#: Large nodes whose pivots, about a kilobyte each, are broadcast.
MANY_PIVOTS = 20_000
#: Graphs of more edges than this treat centres of stars as hot keys.
LARGE_GRAPH = 100_000


class Shingler:
    """Sorted distinct shingle hashes of texts; hashes of words are kept while there is room."""

    def __init__(self, k: int = SHINGLE):
        import xxhash

        class Words(dict):
            def __missing__(self, word):
                if len(self) > _MANY:
                    self.clear()
                self[word] = found = xxhash.xxh3_64_intdigest(word)
                return found

        self.k, self.of_word = k, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        n, k = len(words), self.k
        if not n:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.of_word.__getitem__, words), np.uint64, n)
        take = min(n, k)
        out = np.full(n - take + 1, take, np.uint64)
        for i in range(take):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += w[i : n - take + 1 + i]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The signature of a set."""
    out = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(out, np.multiply.outer(by, shingles[i : i + 4096]).min(axis=1), out=out)
    return out


def set_id(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, by = Shingler(), _multipliers()
    tree = np.arange(TREES * ROOT_BRANCH, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for batch in batches:
        sizes, ids, keys, mins = [], [], [], []
        for text in batch.column("text"):
            s = shingler(text.as_py())
            sizes.append(len(s))
            if len(s):
                m = minwise(s, by)
                ids.append(set_id(s))
                keys.append((m[: len(tree)] ^ tree).view(np.int64))
                mins.append(((m * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes())
            else:
                ids.append(None)
                keys.append(None)
                mins.append(None)
        made = [pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(mins, pa.binary())]
        names = ["doc_id", "text_hash", "n_shingles", "set_id", "keys", "mins"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], names=names)
    give_back()


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """Runs of equal keys in sorted batches, joined over the borders of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        column = batch.column(key)
        if not len(column):
            continue
        values = np.asarray(column)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and values[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8).reshape(len(table), -1)


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links each set of a small node to the first one it agrees with, through which all meet."""
    for _, table in _groups(batches, "node"):
        ids, m = np.asarray(table.column("id").combine_chunks()), _matrix(table, "mins")
        a, b = [], []
        left = np.arange(len(ids))
        group = np.arange(len(ids))
        for i in range(len(ids) - 1):
            left = np.flatnonzero((np.arange(len(ids)) > i) & (group != group[i]))
            if not len(left):
                continue
            for j in left[(m[left] == m[i]).mean(axis=1) >= AGREE]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    a.append(ids[i])
                    b.append(ids[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _nodes(paths: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Paths in nodes of two to SMALL sets, paths in larger ones, and the number of the latter."""
    sizes = staged(paths.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{name}-sizes")
    t = staged(spread_join(paths, sizes.withColumn("rows", F.col("n")), "node", "rows"), name)
    large = t.where(F.col("n") > SMALL)
    return t.where(F.col("n") <= SMALL).drop("n"), large, large.count()


def _by_pivots(large: DataFrame, many: int, mins: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Links to the pivots of each node, and the paths that go on.

    A set within AGREE_NEAR of a pivot stops here: whatever is similar enough to it is within
    AGREE_PIVOT of the same pivot, and is linked to that. A set is linked to its smallest pivot, and
    pivots that share a set to each other, once a task.
    """
    # The same pivots in every node of a level, so that the same links come from all; others on the next.
    order = F.xxhash64("id", F.lit(level))
    cut = F.lit(2.0**64) * (PIVOTS / F.col("n")) - F.lit(2.0**63)
    t = staged(large.join(mins, "id"), "large-nodes")
    pivots = F.collect_list(F.struct("id", "mins")).alias("pivots")
    chosen = staged(t.where(order <= cut).groupBy("node").agg(pivots, F.first("n").alias("n")), "chosen")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = set()
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("node", "id", "mins", "pivots"))
            for node, i, m, pivots in zip(*columns, strict=True):
                p = np.frombuffer(b"".join(x["mins"] for x in pivots or []), np.uint8).reshape(-1, SIGNATURE)
                share = (p == np.frombuffer(m, np.uint8)).mean(axis=1)
                hit = sorted(pivots[j]["id"] for j in np.flatnonzero(share >= AGREE_PIVOT))
                new = [(hit[0], x) for x in hit[1:] if (node, hit[0], x) not in told]
                told.update((node, *x) for x in new)
                links = [x for x in ([(i, hit[0])] if hit else []) + new if x[0] != x[1]]
                rows.append((node, i, bool(len(p) == 0 or share.max() < AGREE_NEAR), [x for x, _ in links], [x for _, x in links]))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            made = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=["node", "id", "goes_on", "a", "b"])

    t = spread_join(t.drop("n"), chosen, "node", "n", "left", many, MANY_PIVOTS).select("node", "id", "mins", "pivots")
    t = staged(t.mapInArrow(compare, "node long, id long, goes_on boolean, a array<long>, b array<long>"), "pivots")
    links = t.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b")
    return links, t.where("goes_on").select(F.xxhash64("node").alias("node"), "id")


def propose_links(classes: DataFrame) -> DataFrame:
    """Candidate links (a, b) between classes (id, keys, mins)."""
    mins = classes.select("id", "mins")
    paths = classes.select("id", F.explode("keys").alias("node"))
    found, level = None, 0
    while True:
        level += 1
        small, large, many = _nodes(paths, f"nodes-{level}")
        small = small.join(mins, "id").repartition("node").sortWithinPartitions("node", "id")
        links = small.mapInArrow(_propose, "a long, b long")
        found = links if found is None else found.unionByName(links)
        if not many:
            return staged(found.distinct(), "links")
        if level % 2:
            linked, paths = _by_pivots(large, many, mins, level)
            found = found.unionByName(linked)
            continue
        drawn = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(n)).cast("int") for i, n in ((0, SIGNATURE), (1, SIGNATURE), (2, SECOND))]
        coordinates = F.array_compact(F.array(drawn[0], F.when((drawn[2] == 0) & (drawn[1] != drawn[0]), drawn[1])))
        t = large.select("node", "id").join(mins, "id").withColumn("c", F.explode(coordinates))
        token = F.substring("mins", F.col("c") + 1, F.lit(1))
        paths = staged(t.select("id", F.xxhash64("node", "c", token).alias("node")).distinct(), f"paths-{level}")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, label): the smallest vertex reachable over edges (a, b), by alternating stars.

    Each round is written to the shared folder; rounds grow with the logarithm of the size. A centre
    with very many edges is a hot key of its join, so its edges stay dealt over tasks.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = staged(e, name), None
    many = e.count()

    def with_least(pairs: DataFrame, low: DataFrame) -> DataFrame:
        if many > LARGE_GRAPH:
            return spread_join(pairs, low, "u", "n", total=2 * many)
        return pairs.join(low.drop("n"), "u")

    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        low = low.select("u", F.least("u", "m").alias("m"), "n")
        e = with_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        star = with_least(e, low)
        star = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        e = staged(star.where("u <> v").distinct(), name)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)


_VERIFIED = "a long, b long"


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirms links on full sets in each task group; emits a star for each component.

    Rows carry ``side``: groups of one block compare all rows, groups of two blocks only rows of
    different sides. ``now`` is the component known before; rows that share it are connected.
    """
    shingler = Shingler()
    for _, table in _groups(batches, "task"):
        side, ids = (np.asarray(table.column(c).combine_chunks()) for c in ("side", "id"))
        wanted = table.column("set_id").to_pylist()
        sets = [shingler(x.as_py()) for x in table.column("text")]
        rows = [i for i, s in enumerate(sets) if len(s) and set_id(s) == wanted[i]]
        if len(rows) < 2:
            continue
        ids, side, sets = ids[rows], side[rows], [sets[i] for i in rows]
        known = np.asarray(table.column("now").combine_chunks())[rows].tolist()
        del table
        first = {}
        group = np.array([first.setdefault(k, i) for i, k in enumerate(known)])
        sizes = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        mark = np.zeros(int(flat.max()) + 1, bool)
        cross = len(set(side.tolist())) > 1
        order = np.argsort(-sizes, kind="stable")
        for at, i in enumerate(order):
            left = order[at + 1 :]
            left = left[(group[left] != group[i]) & (DENOMINATOR * sizes[left] >= NUMERATOR * sizes[i])]
            if cross:
                left = left[side[left] != side[i]]
            if not len(left):
                continue
            mine = flat[starts[i] : starts[i] + sizes[i]]
            mark[mine] = True
            if 3 * len(left) > len(sets):
                both = np.add.reduceat(mark[flat].astype(np.int64), starts)[left]
            else:
                both = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j] + sizes[j]]]) for j in left])
            mark[mine] = False
            for j in left[DENOMINATOR * both >= NUMERATOR * (sizes[left] + sizes[i] - both)]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
        pairs = [(ids[g], ids[j]) for j, g in enumerate(group) if j != g]
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    give_back()


def _star_labels(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
    return stars.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(roots)


def confirm_links(docs: DataFrame, members: DataFrame, repeats: bool) -> DataFrame:
    """(id, root): components of links that were confirmed on full sets, of two sets or more.

    The stars of a group that is one task are its components; only groups of several blocks need
    them joined.

    ``members``: id, doc_id, text_hash, set_id, n_shingles and the candidate group of each class's
    representative row; ``repeats``: some rows agree in id and text, so that one of them is taken.
    """
    sizes = members.groupBy("label").agg(F.sum("n_shingles").alias("total"), F.count(F.lit(1)).alias("n"))
    m = spread_join(members.drop("n_shingles"), sizes, "label", "n")
    m = m.withColumn("blocks", F.ceil(F.col("total") / GROUP_SHINGLES)).drop("total")
    m = staged(m.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long"))), "blocks")

    def confirmed(tasks: DataFrame) -> DataFrame:
        t = tasks.select("task", "side", "id", "set_id", "now", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        t = staged(t, "tasks")
        t = F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
        same = docs["doc_id"].eqNullSafe(t["_id"]) & (docs["text_hash"] == t["_hash"])
        rows = docs.join(t, same).select("task", "side", "id", "set_id", "now", "text")
        if repeats:
            rows = rows.dropDuplicates(["task", "id"])
        return staged(rows.repartition("task").sortWithinPartitions("task", "id").mapInArrow(_confirm, _VERIFIED), "confirmed")

    one = m.where("blocks = 1").withColumns({"task": F.col("label"), "side": F.lit(0), "now": F.col("id")})
    done = _star_labels(confirmed(one))
    large = m.where("blocks > 1")
    if not large.take(1):
        return done
    links, now = None, large.withColumn("now", F.col("id"))
    for turn in ("first", "rest"):
        by_block = now.groupBy("label", "block").agg(F.min("now").alias("low"), F.max("now").alias("high"))
        one_side = by_block.select("label", F.col("block").alias("i"), F.col("low").alias("li"), F.col("high").alias("hi"))
        pairs = by_block.join(one_side, "label").where("i <= block and not (low = high and li = hi and low = li)")
        pairs = pairs.where("i = 0" if turn == "first" else "i > 0").select("label", "i", F.col("block").alias("j"))
        sides = "array(struct(i as block, 0 as side))", "array(struct(i as block, 0 as side), struct(j as block, 1 as side))"
        sides = F.explode(F.expr(f"if(i = j, {sides[0]}, {sides[1]})")).alias("s")
        pairs = pairs.select("label", F.xxhash64("label", "i", "j").alias("task"), sides)
        more = confirmed(now.join(pairs.select("label", "task", "s.block", "s.side"), ["label", "block"]))
        links = more if links is None else links.unionByName(more)
        if turn == "first":
            known = components(links, "known").withColumnRenamed("label", "known")
            now = large.join(known, "id", "left").withColumn("now", F.coalesce("known", "id")).drop("known")
            now = staged(now, "now")
    return done.unionByName(components(links, "linked").withColumnRenamed("label", "root"))


def _least() -> Column:
    """The row that stands for a group: of the smallest id, null last, then of the smallest hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    return F.struct(first["doc_id"].alias("doc_id"), first["text_hash"].alias("text_hash"))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """doc_id, text_hash, n_shingles and ``group`` (doc_id and text_hash of the row that stands for
    it; null for a row that is alone) of each row of (doc_id, text); the keys (doc_id, text_hash) of
    rows with words that occur more than once; and whether there are such keys."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text")
    sets = staged(t.mapInArrow(_signatures, _SETS), "sets")
    known = sets.where("n_shingles > 0")
    repeated = known.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = staged(repeated, "repeated")
    repeats = bool(repeated.take(1))
    first = [F.first(c).alias(c) for c in ("n_shingles", "keys", "mins")]
    classes = known.groupBy("set_id").agg(_least().alias("row"), F.count(F.lit(1)).alias("copies"), *first)
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    groups = components(propose_links(classes), "candidates")
    members = classes.join(groups, "id").select("id", "row.doc_id", "row.text_hash", "set_id", "n_shingles", "label")
    members = staged(members, "members")
    linked = confirm_links(t, members, repeats).join(members.select("id", "doc_id", "text_hash"), "id")
    linked = staged(linked, "confirmed-groups")
    roots = staged(linked.groupBy("root").agg(_least().alias("group"), F.count(F.lit(1)).alias("n")), "roots")
    linked = spread_join(linked.select("id", "root"), roots, "root", "n").select("id", "group")
    changed = classes.select("id", "set_id", "row", "copies").join(linked, "id", "left").where("copies > 1 or group is not null")
    changed = staged(changed.select("set_id", F.coalesce("group", "row").alias("group"), "copies"), "changed")
    rows = sets.select("doc_id", "text_hash", "n_shingles", "set_id")
    return spread_join(rows, changed, "set_id", "copies", "left").drop("set_id"), repeated, repeats


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    rows, _, _ = grouped(pick(docs, doc_id=id_col, text=text_col))
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("group.doc_id"))
    out = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns; ``docs`` has doc_id and text."""
    rows, repeated, repeats = grouped(pick(docs, doc_id="doc_id", text="text"))
    stays = F.col("doc_id").eqNullSafe(F.col("group.doc_id")) & (F.col("text_hash") == F.col("group.text_hash"))
    left = without(docs, rows.where(F.col("group").isNotNull() & ~stays))
    if not repeats:
        return left
    key = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    same = left["doc_id"].eqNullSafe(key["doc_id"]) & (text_hash(left["text"]) == key["text_hash"])
    once = left.join(key, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return without(left, repeated).unionByName(once)
