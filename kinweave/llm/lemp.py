"""Hard negatives by exact inner-product search in length buckets with sorted coordinate lists.

Every row with usable components is compared through its integer vector floor(SCALE * x). Rows are
stored in order of length, so the batches of a task are buckets of similar length. For each bucket
and coordinate there is a sorted list of the unit vectors' values. An anchor with threshold t asks a
bucket of longest length l for rows of at least the cosine c = t / (|anchor| l): none if c > 1;
otherwise a row's value in a coordinate in which the unit anchor has q lies in
q c +- sqrt((1 - q^2)(1 - c^2)), and only rows in the ranges of all focus coordinates (the anchor's
largest) are verified. Where even the narrowest range holds more than WIDE of the bucket, the ranges
prune nothing that pays and the whole bucket is verified by one product of matrices.

Rows stay where they are. Anchors, the stated query set, are written to the shared folder in blocks,
and every task passes over them for each piece of its rows (at most PIECE_BYTES), keeping the best of
one block at a time: memory is bounded by a piece and a block, and nothing is collected. A first pass
over one row in SEED_SHARE gives every anchor a lower bound of its last positive's score, so that tasks
return few candidates; they keep at most the number asked for, and a ranking window ends it.

Scores are exact: sums of products below 2^53 are taken in doubles, others in Python's integers, and
those beyond a long count as its ends.

Defined results: rows with a null label, a null vector, or a null, NaN or infinite component take no
part, nor have those with one that SCALE makes infinite; a shorter vector counts as padded with zeros; empty vectors have score 0; rows are told apart even
if they share an id (an anchor's other rows are all rows but itself), and rows with a null id come
last among equal scores and are no anchors; negative positive scores admit no negatives, as
80 p > 100 p. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.shared import give_back, new_dir, pick, staged

SCALE, ANCHOR_EVERY, NOISE_EVERY, LABELS = 256.0, 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 80, 100
BUCKET, ANCHORS, PIECE_BYTES = 2048, 1024, 32 << 20
FOCUS, WIDE = 3, 0.125
SEED_SHARE = 64
#: Room for rounding in the ranges; rows are verified exactly afterwards.
SLACK = 1e-6
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(embeddings: DataFrame) -> DataFrame:
    """(uid, vec_id, label, v) of the rows that take part, with every seventh id's label moved on; staged in order of length."""
    t = pick(embeddings, vec_id="vec_id", label="label", embedding="embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & ((F.abs(x * SCALE) < float("inf"))))
    t = t.where("label is not null and embedding is not null").where(good)
    moved = F.when(F.col("vec_id") % NOISE_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    t = t.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), F.col("embedding").alias("v"), length.alias("length"))
    t = t.repartitionByRange(F.col("length").desc(), "uid").sortWithinPartitions(F.col("length").desc(), "uid")
    return staged(t.drop("length"), "vectors")


def _matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of floor(SCALE * x), padded with zeros; objects of Python where doubles are not exact."""
    at, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at, sizes = at - at[0], np.diff(at)
    out = np.zeros((len(column), max(int(sizes.max(initial=0)), dims or 0)))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(at[:-1], sizes)] = np.floor(flat * SCALE)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return a @ b.T
    whole = lambda m: [[int(x) for x in r] for r in m]
    x, y = whole(a), whole(b)
    return np.array([[min(max(sum(map(mul, r, s)), LONG[0] + 1), LONG[1]) for s in y] for r in x], np.int64).reshape(len(x), len(y))


def _lengths(v: np.ndarray) -> np.ndarray:
    most = np.abs(v).max(axis=1, initial=0)
    return most * np.sqrt(((v / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))


def _pad(a: np.ndarray, dims: int) -> np.ndarray:
    return a if a.shape[1] == dims else np.pad(a, ((0, 0), (0, dims - a.shape[1])))


class Bucket:
    """Rows of similar length with a sorted list for each coordinate, made when it is first asked for."""

    def __init__(self, v: np.ndarray, label: np.ndarray, vec_id: np.ndarray, uid: np.ndarray):
        self.v, self.label, self.vec_id, self.uid = v, label, vec_id, uid
        length = _lengths(v)
        self.longest = float(length.max(initial=0))
        self.unit = v / np.where(length > 0, length, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows in order of the coordinate, and its values in that order."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def feasible(self, q: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """For anchors q and the scores they need: those that must see the whole bucket, and (anchor, rows) of the others.

        Anchors that no row can satisfy are in neither. Where a, x and c are cosines of the angles A, X
        and C, a x + sqrt((1 - a^2)(1 - x^2)) >= c says that A and X differ by C at most.
        """
        size = _lengths(q)
        reach = size * self.longest
        c = np.divide(need, reach, out=np.where(need > 0, 2.0, -1.0), where=reach > 0) - SLACK
        # below a threshold under 0 shorter rows may have any smaller cosine
        whole = [np.flatnonzero((need < 0) | (reach == 0) & (need <= 0))]
        able = np.flatnonzero((need >= 0) & (reach > 0) & (c <= 1))
        if not len(able):
            return whole[0], []
        unit = q[able] / size[able][:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        angle = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1))
        most = np.arccos(np.clip(c[able], -1, 1))[:, None]
        low, high = np.cos(np.minimum(np.pi, angle + most)) - SLACK, np.cos(np.maximum(0, angle - most)) + SLACK
        first, last = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            here, values = focus == f, self.coordinate(int(f))[1]
            first[here], last[here] = np.searchsorted(values, low[here], "left"), np.searchsorted(values, high[here], "right")
        narrowest = (last - first).min(axis=1)
        wide, some = narrowest > WIDE * len(self.v), []
        whole.append(able[wide])
        for i in np.flatnonzero(~wide & (narrowest > 0)):
            rows = None
            for k in np.argsort(last[i] - first[i], kind="stable"):
                found = self.coordinate(int(focus[i, k]))[0][first[i, k] : last[i, k]]
                rows = found if rows is None else rows[np.isin(rows, found, assume_unique=True)]
            if len(rows):
                some.append((int(able[i]), rows))
        return np.concatenate(whole), some

    def at_least(self, q: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose exact score reaches the anchor's need."""
        whole, some = self.feasible(q, need)
        found = []
        if len(whole):
            scores = _products(q[whole], self.v)
            i, rows = np.nonzero(scores >= need[whole][:, None])
            found.append((whole[i], rows, scores[i, rows]))
        for anchor, rows in some:
            scores = _products(q[anchor : anchor + 1], self.v[rows])[0]
            good = np.flatnonzero(scores >= need[anchor])
            found.append((np.full(len(good), anchor), rows[good], scores[good]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


def _at_most(score: np.ndarray) -> np.ndarray:
    """Doubles that are not above the integers."""
    x = score.astype(np.float64)
    return np.where(np.abs(x) < EXACT, x, np.nextafter(x, -np.inf))


class Best:
    """The best rows of each (anchor, slot) of a block: by score, then id, then row."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.empty((0, 5), np.int64)  # anchor, slot, score, vec_id, uid

    def add(self, *columns: np.ndarray) -> None:
        t = np.concatenate([self.rows, np.stack(columns, axis=1)])
        t = t[np.lexsort((t[:, 4], t[:, 3], -t[:, 2], t[:, 1], t[:, 0]))]
        begins = np.flatnonzero(np.r_[True, (t[1:, :2] != t[:-1, :2]).any(axis=1)]) if len(t) else np.empty(0, np.int64)
        place = np.arange(len(t)) - np.repeat(begins, np.diff(np.r_[begins, len(t)]))
        self.rows, self.last = t[place < self.k], t[place == self.k - 1]


class Positives:
    """Rows of the anchor's label, the anchor excepted."""

    slots = 1

    def __init__(self, block: dict, k: int):
        self.block, self.best, self.need = block, Best(k), block["need"].copy()

    def see(self, bucket: Bucket) -> None:
        anchor, row, score = bucket.at_least(self.block["v"], self.need)
        good = (self.block["label"][anchor] == bucket.label[row]) & (self.block["uid"][anchor] != bucket.uid[row])
        anchor, row, score = anchor[good], row[good], score[good]
        self.best.add(anchor, np.zeros_like(anchor), score, bucket.vec_id[row], bucket.uid[row])
        full = self.best.last
        self.need[full[:, 0]] = np.maximum(self.need[full[:, 0]], _at_most(full[:, 2]))


class Negatives:
    """For each positive (a slot), rows of another label within the range of its score."""

    def __init__(self, block: dict, k: int):
        self.block, self.best = block, Best(k)
        scores = block["positives"].tolist()  # anchors x slots; unused slots are negative; of Python's integers, as 100 times a score may not fit
        self.low = np.array([[-(-LOW * p // 100) if p >= 0 else LONG[1] for p in x] for x in scores], np.int64).reshape(-1, POSITIVES)
        self.high = np.array([[HIGH * p // 100 for p in x] for x in scores], np.int64).reshape(-1, POSITIVES)
        self.need = _at_most(self.low.min(axis=1))

    def see(self, bucket: Bucket) -> None:
        anchor, row, score = bucket.at_least(self.block["v"], self.need)
        good = self.block["label"][anchor] != bucket.label[row]
        anchor, row, score = anchor[good], row[good], score[good]
        for slot in range(self.high.shape[1]):
            fits = np.flatnonzero((score >= self.low[anchor, slot]) & (score <= self.high[anchor, slot]))
            a, r = anchor[fits], row[fits]
            self.best.add(a, np.full_like(a, slot), score[fits], bucket.vec_id[r], bucket.uid[r])
        full = self.best.last
        self.low[full[:, 0], full[:, 1]] = np.maximum(self.low[full[:, 0], full[:, 1]], full[:, 2])
        self.need = _at_most(self.low.min(axis=1))


def _numbers(column: pa.Array, null: int) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def _buckets(batch: pa.RecordBatch) -> Iterator[Bucket]:
    for i in range(0, len(batch), BUCKET):
        b = batch.slice(i, BUCKET)
        yield Bucket(_matrix(b.column("v")), _numbers(b.column("label"), 0), _numbers(b.column("vec_id"), LONG[1]), _numbers(b.column("uid"), 0))


def _blocks(files: list[str], dims: int) -> Iterator[dict]:
    """The anchors, ANCHORS at a time, from the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    held: list[pa.RecordBatch] = []

    def block() -> dict:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        out = {"v": _matrix(t.column("v"), dims), "uid": _numbers(t.column("uid"), 0), "label": _numbers(t.column("label"), 0)}
        if "need" in t.schema.names:
            need = t.column("need")
            out["need"] = np.where(need.is_null().to_numpy(zero_copy_only=False), -np.inf, _at_most(_numbers(need, 0)))
        else:
            out["positives"] = np.array([(x + [-1] * POSITIVES)[:POSITIVES] for x in t.column("positives").to_pylist()], np.int64)
        held.clear()
        return out

    for uri in files:
        system, at = fs.FileSystem.from_uri(uri)
        with system.open_input_file(at) as source:
            for batch in pq.ParquetFile(source).iter_batches(ANCHORS):
                while len(batch):
                    room = ANCHORS - sum(map(len, held))
                    held.append(batch.slice(0, room))
                    batch = batch.slice(room)
                    if sum(map(len, held)) == ANCHORS:
                        yield block()
    if held:
        yield block()


FOUND = "anchor long, slot int, score long, vec_id long, uid long"


def search(rows: DataFrame, anchors: DataFrame, kind: type, k: int) -> DataFrame:
    """The best k rows of each (anchor uid, slot) over ``rows``, ranked; staged."""
    spark, folder = rows.sparkSession, new_dir(rows.sparkSession, "anchors")
    anchors.repartition(max(1, anchors.count() >> 16)).write.parquet(folder)
    files = spark.read.schema(anchors.schema).parquet(folder).inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, size = [], 0
        for batch in batches:
            for bucket in _buckets(batch):
                piece.append(bucket)
                size += bucket.v.nbytes
            if size >= PIECE_BYTES:
                yield from _piece(piece, files, kind, k)
                piece, size = [], 0
        if piece:
            yield from _piece(piece, files, kind, k)
        piece = batch = bucket = None
        give_back()

    t = staged(rows.mapInArrow(run, FOUND), "found")
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return staged(t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")


def _piece(piece: list[Bucket], files: list[str], kind: type, k: int) -> Iterator[pa.RecordBatch]:
    dims = max(b.v.shape[1] for b in piece)
    for block in _blocks(files, dims):
        wide = block["v"].shape[1]
        for b in piece:
            if b.v.shape[1] < wide:
                b.v, b.unit = _pad(b.v, wide), _pad(b.unit, wide)
        state = kind(block, k)
        for b in sorted(piece, key=lambda b: -b.longest):
            state.see(b)
        t = state.best.rows
        ids = pa.array(t[:, 3], mask=t[:, 3] == LONG[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(block["uid"][t[:, 0]]), pa.array(t[:, 1].astype(np.int32)), pa.array(t[:, 2]), ids, pa.array(t[:, 4])], names=["anchor", "slot", "score", "vec_id", "uid"]
        )


def mine(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, embedding)."""
    rows = usable(embeddings)
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    seed = rows.where(F.pmod(F.xxhash64("uid"), F.lit(SEED_SHARE)) == 0)
    none = F.lit(None).cast("long").alias("need")
    first = search(seed, anchors.select("uid", "label", "v", none), Positives, POSITIVES)
    need = first.groupBy(F.col("anchor").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("need"))
    bound = anchors.join(need.where(F.col("n") == POSITIVES).select("uid", "need"), "uid", "left").select("uid", "label", "v", "need")
    positives = search(rows, bound, Positives, POSITIVES)
    lists = positives.groupBy(F.col("anchor").alias("uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("positives"))
    negatives = search(rows, anchors.join(lists, "uid").select("uid", "label", "v", "positives"), Negatives, NEGATIVES)
    p = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    t = negatives.join(p, ["anchor", "slot"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return t.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
