"""Benchmark decontamination: size-partitioned MinHash containment search.

Items and documents are sets of 5-word shingles. A fixed-length MinHash of a long document says
nothing about a ten-shingle item, so the signature sits on the short side: an item of n shingles,
of which a document must contain ``need`` (75 %), keeps its n - need + 1 smallest hashes, and a
document that contains the item must have one of them. That is certain for items of up to 124
shingles. Longer ones keep SIGNATURE = 32 hashes, which a document that contains the item misses
with a chance under 0.25 ** 32 (5e-20). So a signature never grows with the item. Shingles that
more than COMMON items share come last in the order, as they would select too much.

Items are partitioned by size (powers of two). Each partition has a bitmap of its signatures'
hashes. A document's sketch is its hashes that are set in the bitmap of a partition whose items
fit its size; ``sketch_share`` says what share of all shingles that is. A sketch hash that equals a
signature's makes a candidate. Only the item's first signature hash in the sketch counts, so a
pair appears once without a shuffle. Candidates are verified on the shingles themselves.

Signatures and item shingles are broadcast while all items together have at most
BROADCAST_SHINGLES shingles; beyond that the same joins shuffle slim (row, hash) pairs, where the
documents' rows of a frequent hash stay where they are (``spread_join``). Bitmaps are of bounded size, so
they fill up as items get many. Therefore only hashes that some signature really has are shuffled: sketches
meet the signatures' distinct hashes, broadcast in blocks of BLOCK_HASHES, and one pass over the documents
is made for each block. What is written grows with true hits then, however many items there are.

Defined results: items and documents with fewer than five words have no shingle and match
nothing; null texts are empty; rows that repeat an item_id are separate items under that id and the
one found with most shingles is reported (then the shorter one); rows that repeat a doc_id are
searched and dropped separately and reported once; a null item_id or doc_id is an id like any other;
all this holds for both sizes of the items; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import ascii_lower, computed_once, pick, spread_join, staged, text_hash, without, words

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
SIGNATURE, COMMON = 32, 16
BROADCAST_SHINGLES = 500_000
#: Bits of a bitmap for each hash of the largest partition, and its most bits.
BITS_EACH, MOST_BITS = 64, 1 << 18
#: Hashes of signatures that are broadcast at a time, 8 bytes each and some 50 in a task's hash table.
BLOCK_HASHES = 2_000_000


def with_shingles(t: DataFrame) -> DataFrame:
    """Adds the words ``w`` and the distinct shingle hashes ``h`` of each text."""
    t = t.withColumn("w", words(ascii_lower(F.col("text"))))
    one = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(SHINGLE)])
    each = F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), one)
    return t.withColumn("h", F.array_distinct(F.when(F.size("w") >= SHINGLE, each).otherwise(F.array().cast("array<long>"))))


def shingle_texts(w: str) -> Column:
    """The distinct shingles of an array of words, as texts."""
    starts = F.sequence(F.lit(1), F.size(w) - SHINGLE + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))


def signatures(items: DataFrame) -> DataFrame:
    """k (a number of its own), item_id, n_item, need, part (of size), sig and grams of each item.

    The table is on the shared folder, so k does not change.
    """
    t = computed_once(with_shingles(pick(items, item_id="item_id", text="text"))).where("size(h) > 0")
    t = t.withColumns({"grams": shingle_texts("w"), "n_item": F.size("h").cast("long")})
    t = t.withColumn("need", F.ceil(F.col("n_item") * NUMERATOR / DENOMINATOR))
    t = staged(t.select(F.monotonically_increasing_id().alias("k"), "item_id", "n_item", "need", "grams", "h"), "items")
    each = t.select("k", "n_item", "need", F.explode("h").alias("x"))
    shared = each.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("x", F.lit(1).alias("late"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("late", F.lit(0)).alias("late"), "x")))
    keep = F.least(F.first("n_item") - F.first("need") + 1, F.lit(SIGNATURE)).cast("int")
    sig = each.join(shared, "x", "left").groupBy("k").agg(F.transform(F.slice(order, F.lit(1), keep), lambda s: s["x"]).alias("sig"))
    part = F.floor(F.log2("n_item")).cast("int").alias("part")
    return staged(t.drop("h").join(sig, "k").select("k", "item_id", "n_item", "need", part, "sig", "grams"), "signatures")


def _bitmaps(sig: DataFrame) -> tuple[int, list[tuple[int, Column]]]:
    """Number of bits, and least need and bitmap of each size partition, of which there are at most 64."""
    s = sig.select("part", "need", F.explode("sig").alias("s"))
    parts = s.groupBy("part").agg(F.min("need").alias("need"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    bits = 64
    while bits < min(BITS_EACH * max((p["n"] for p in parts), default=0), MOST_BITS):
        bits *= 2
    at = F.pmod("s", F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    cells = s.groupBy("part", F.floor(at / 64).cast("int").alias("i")).agg(F.bit_or(bit).alias("b")).collect()
    found = {(r["part"], r["i"]): r["b"] for r in cells}
    text = lambda part: ",".join(str(found.get((part, i), 0)) for i in range(bits // 64))
    return bits, [(p["need"], F.from_json(F.lit(f"[{text(p['part'])}]"), "array<bigint>")) for p in parts]


def with_sketch(t: DataFrame, sig: DataFrame) -> DataFrame:
    """Adds ``sketch``: the hashes of ``h`` that may be in a signature of an item that fits."""
    bits, maps = _bitmaps(sig)

    def may_be(x: Column) -> Column:
        hit, at = F.lit(False), F.pmod(x, F.lit(bits)).cast("int")
        for need, bitmap in maps:
            bit = F.getbit(F.get(bitmap, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63)))
            hit = hit | ((F.size("h") >= need) & (bit == 1))
        return hit

    return t.withColumn("sketch", F.filter("h", may_be))


def true_hits(hits: DataFrame, sig: DataFrame) -> DataFrame:
    """The rows of ``hits`` whose hash ``s`` is in a signature, by broadcasts of bounded size."""
    known = staged(sig.select(F.explode("sig").alias("s")).distinct(), "signature-hashes")
    blocks = max(1, -(-known.count() // BLOCK_HASHES))
    block = lambda t, b: t.where(F.pmod(F.xxhash64("s"), F.lit(blocks)) == b) if blocks > 1 else t
    each = [block(hits, b).join(F.broadcast(block(known, b)), "s", "left_semi") for b in range(blocks)]
    return reduce(DataFrame.unionByName, each)


def sketch_share(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row: shingles of all documents, those in their sketches, those in a signature, and their shares."""
    sig = signatures(items)
    t = with_sketch(with_shingles(pick(docs, text="text")), sig)
    n = t.agg(F.sum(F.size("h")).alias("n_shingles"), F.sum(F.size("sketch")).alias("n_sketch"))
    n = n.join(true_hits(t.select(F.explode_outer("sketch").alias("s")), sig).agg(F.count(F.lit(1)).alias("n_hits")))
    share = lambda c: F.try_divide(F.col(c), F.col("n_shingles"))
    return n.withColumns({"share": share("n_sketch"), "hit_share": share("n_hits")})


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, n_item and n_found of each row and item with enough shingles."""
    sig = signatures(items)
    small = int(sig.agg(F.sum("n_item")).first()[0] or 0) <= BROADCAST_SHINGLES
    keys = sig.select("k", "need", F.posexplode("sig").alias("pos", "s"), "sig")
    keys = keys.select("k", "need", "s", F.expr("slice(sig, 1, pos)").alias("earlier"))
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text_hash", text_hash(F.col("text")))
    t = with_sketch(with_shingles(rows).drop("text"), sig).withColumn("n_doc", F.size("h"))
    grams = sig.select("k", "item_id", "n_item", "grams")
    fits = (F.col("n_doc") >= F.col("need")) & ~F.arrays_overlap("sketch", "earlier")
    # The outer form, as a filter on the sketch's size would be pushed down and split texts again for every shingle.
    each = F.explode_outer("sketch").alias("s")
    if small:
        hits = t.select("doc_id", "text_hash", "w", "n_doc", "sketch", each)
        pairs = hits.join(F.broadcast(keys), "s").where(fits).select("doc_id", "text_hash", "w", "k").join(F.broadcast(grams), "k")
    else:
        hits = staged(true_hits(t.select("doc_id", "text_hash", "n_doc", each), sig), "sketches")
        keyed = hits.groupBy("s").agg(F.count(F.lit(1)).alias("n")).join(keys.groupBy("s").agg(F.collect_list(F.struct("k", "need")).alias("items")), "s")
        keyed = staged(keyed, "keyed")
        pairs = spread_join(hits, keyed, "s", "n").withColumn("i", F.explode("items"))
        pairs = pairs.select("doc_id", "text_hash", "n_doc", "i.*").where("n_doc >= need").select("doc_id", "text_hash", "k")
        pairs = staged(pairs.distinct().withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), "candidates")
        same = pairs["_id"].eqNullSafe(t["doc_id"]) & (pairs["_hash"] == t["text_hash"])
        pairs = t.select("doc_id", "text_hash", "w").join(pairs, same).select("doc_id", "text_hash", "w", "k").join(grams, "k")
    found = pairs.withColumn("n_found", F.size(F.array_intersect("grams", shingle_texts("w"))).cast("long"))
    found = found.where(F.col("n_found") * DENOMINATOR >= F.col("n_item") * NUMERATOR)
    return found.select("doc_id", "text_hash", "item_id", "n_item", "n_found")


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item and n_found of each pair with enough of the item's shingles."""
    best = F.max_by(F.struct("n_item", "n_found"), F.struct(F.col("n_found"), -F.col("n_item"))).alias("best")
    return matches(docs, items).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item", "best.n_found")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that contain no benchmark item, with all their columns; whole texts are not shuffled
    while few rows contain one."""
    return without(docs, matches(docs, items))
