"""Token ids as Arrow stream files with fixed-size batches.

Documents are sorted by id over range partitions; each task encodes its documents, appends the
end id and packs them one after another into sequences of LENGTH ids. A file is an Arrow stream
whose batches all have ROWS sequences of fixed-size lists: ``input_ids`` (16-bit if the
vocabulary allows) and the bit masks ``mask`` (a real id) and ``starts`` (first id of a
document). As all batches have one size, sequence k lies at a computed offset and is read
without copying (``read_sequence``). A second stream after it lists the documents, and the last
16 bytes say where the streams begin, so each file is complete in itself.

Only pieces between blanks are encoded by the tokenizer; as its own pre-tokenizer always splits
there, ids are those of the whole text. Known pieces are looked up; new ones are encoded together,
parted by line feeds, and the whole text is encoded where it holds an added token of the tokenizer
(like ``<|endoftext|>``), which the library then reads as that token.

The number of files follows from the bytes and documents of the table (FILE_BYTES, FILE_DOCS). A
task's memory is bounded by one Arrow batch of documents, the lookup table (MANY pieces), one batch of
sequences, and the list of its file's documents (24 bytes each).

Files go to the shared folder under the attempt's own name; the manifest of the attempts that
count is a table there. Offsets over all files come from the manifest's sums (one row a file).

Defined results: null text is empty and has only the end id; a null doc_id sorts first; rows
that repeat a doc_id are separate documents, in the order of their texts; without rows there are
no files.
"""

from __future__ import annotations

import itertools
import re
import struct
import sys
import types
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.shared import give_back, new_dir, pick, staged

LENGTH, ROWS = 2048, 32
END_ID = 2
MANY, LONG = 400_000, 64
#: Letters of the Latin script, all white space, as character classes; the mark of cuts.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SPACES = r"\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x01"
CUT = "\x01"
#: New pieces that are encoded as one text.
TOGETHER = 2_000
#: Text and documents of a file, at most about.
FILE_BYTES, FILE_DOCS = 32 << 20, 500_000
#: Bytes of text that are split at a time.
PORTION = 3 << 20
#: A blank at the end or before white space (as Python or the tokenizer counts it), or odd control characters.
UNEVEN = r"[\x1c-\x1f]| $| [\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
MANIFEST = "file string, first long, n_ids long, n_docs long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def worker_cache() -> dict:
    """Lives as long as the Python worker, over its tasks."""
    return sys.modules.setdefault("kinweave_worker_cache", types.ModuleType("kinweave_worker_cache")).__dict__


class Encoder:
    """Ids of whole texts, by the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core; more threads would only spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.pieces = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        #: Texts with the mark of cuts, with what Python counts as white space and the tokenizer does
        #: not, or with an added token are encoded whole.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([f"[{CUT}\x1c-\x1f]", *added])
        self.feed = self._ids(["\n"])[0]
        self.plain = re.compile(r" ?\S+").fullmatch

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = "HI"[self.dtype.itemsize // 4]
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space but for a blank before them: encoded as one text, with a
        line feed, which is a token of its own, between them."""
        out, width = [], self.dtype.itemsize
        parts = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        texts = ["\n".join(x) for x in parts]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.dtype)
            cuts = np.flatnonzero(ids == np.frombuffer(self.feed, self.dtype)[0])
            if len(self.feed) != width or len(cuts) != len(part) - 1:
                out += self._ids(part)
                continue
            raw, ends = ids.tobytes(), [*(cuts * width).tolist(), len(ids) * width]
            out += [raw[i:j] for i, j in zip([0, *(cuts * width + width).tolist()], ends, strict=True)]
        return out

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each of which the tokenizer parts from what is around it."""
        found = list(map(self.known.get, pieces))
        missing = {pieces[i] for i, x in enumerate(found) if x is None}
        if missing:
            plain = list(filter(self.plain, missing))
            new = dict(zip(plain, self._together(plain), strict=True))
            if len(plain) < len(missing):
                other = list(missing - new.keys())
                new.update(zip(other, self._ids(other), strict=True))
            found = [new[p] if x is None else x for p, x in zip(pieces, found, strict=True)]
            # The table keeps what came first, which holds the frequent pieces; long ones never stay.
            room = MANY - len(self.known)
            if room > 0:
                self.known.update([x for x in new.items() if len(x[0]) <= LONG][:room])
        return found

    def _even(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of texts in which each blank stands before a character that is no white space.

        They are cut before blanks, between a letter and a comma or full stop, and around single line
        feeds, all of which are bounds of the tokenizer's own pieces. Equal pieces are found by Arrow
        and looked up once.
        """
        cut = pc.replace_substring(texts, " ", CUT + " ")
        cut = pc.replace_substring_regex(cut, f"([{LETTERS}])([.,])", f"\\1{CUT}\\2")
        cut = pc.replace_substring_regex(cut, f"([^{SPACES}])\n([^{SPACES}])", f"\\1{CUT}\n{CUT}\\2")
        cut = pc.split_pattern(cut, CUT)
        starts = np.asarray(cut.offsets)
        coded = cut.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        table = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // self.dtype.itemsize
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        flat = np.frombuffer(b"".join(table), self.dtype)
        flat = flat[np.repeat(begins[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[starts - starts[0]]
        for i, j in zip(bounds, bounds[1:], strict=False):
            yield flat[i:j]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        cuts = [0, *np.flatnonzero(np.diff(size // PORTION)) + 1, len(texts)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            some = texts.slice(i, j - i)
            whole = pc.match_substring_regex(some, self.whole)
            odd = pc.or_(whole, pc.match_substring_regex(some, UNEVEN))
            even = self._even(some.filter(pc.invert(odd)))
            for k, (other, all_of_it) in enumerate(zip(odd.to_pylist(), whole.to_pylist(), strict=True)):
                if other:
                    t = some[k].as_py()
                    yield np.frombuffer(b"".join(self._ids([t]) if all_of_it else self._lookup(self.pieces(t))), self.dtype)
                else:
                    yield next(even)


def encoder(path: str) -> Encoder:
    cache = worker_cache()
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def _schema(ids: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(ids, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH)), ("starts", pa.list_(pa.bool_(), LENGTH))])


DOCS = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])


class TokenFile:
    """Writes one file of equal-length sequences."""

    def __init__(self, out, dtype: np.dtype):
        self.out, self.dtype = out, dtype
        self.schema = _schema(pa.from_numpy_dtype(dtype))
        self.stream = pa.ipc.new_stream(out, self.schema)
        self.ids, self.held, self.n = [], 0, 0
        self.begins: list[int] = []
        #: Ids (0 for null, of which ``nulls`` tells), places and lengths of the documents.
        self.docs, self.nulls, self.first = (array("q"), array("q"), array("q")), array("b"), None

    def add(self, doc_id, ids: np.ndarray) -> None:
        if not self.docs[0]:
            self.first = doc_id
        for column, x in zip(self.docs, (doc_id or 0, self.n, len(ids)), strict=True):
            column.append(x)
        self.nulls.append(doc_id is None)
        self.begins.append(self.held)
        self.ids.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= LENGTH * ROWS:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        size = LENGTH * ROWS
        ids, begins = np.concatenate(self.ids), np.zeros(self.held, bool)
        begins[self.begins] = True
        full = self.held // size * size if not last else -(-self.held // size) * size
        mask = np.ones(self.held, bool)
        if last:
            ids, begins, mask = (np.concatenate([x, np.zeros(full - self.held, x.dtype)]) for x in (ids, begins, mask))
        for a in range(0, full, size):
            part = [pa.FixedSizeListArray.from_arrays(pa.array(x[a : a + size]), LENGTH) for x in (ids, mask, begins)]
            self.stream.write_batch(pa.RecordBatch.from_arrays(part, schema=self.schema))
        self.ids, self.held = [ids[full:]], max(0, self.held - full)
        self.begins = np.flatnonzero(begins[full:]).tolist()

    def close(self) -> None:
        if self.held:
            self._write(last=True)
        self.stream.close()
        at = self.out.tell()
        columns = [np.frombuffer(x, np.int64) for x in self.docs]
        columns = [pa.array(columns[0], mask=np.frombuffer(self.nulls, bool)), *map(pa.array, columns[1:])]
        with pa.ipc.new_stream(self.out, DOCS) as s:
            for i in range(0, len(columns[0]), 1 << 16):
                s.write_batch(pa.RecordBatch.from_arrays([x.slice(i, 1 << 16) for x in columns], schema=DOCS))
        self.out.write(struct.pack("<QQ", at, self.n))


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files, of about ``file_bytes`` of text, in ascending doc_id order; returns their manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode = file = None
        for batch in batches:
            if not len(batch):
                continue
            if file is None:
                encode = encoder(tokenizer_path)
                system, at = fs.FileSystem.from_uri(folder)
                system.create_dir(at, recursive=True)
                name = f"tokens-{uuid.uuid4().hex}.arrows"
                out = system.open_output_stream(f"{at}/{name}", compression=None)
                file, end = TokenFile(out, encode.dtype), np.array([end_id], encode.dtype)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                file.add(doc_id, np.concatenate((ids, end)))
        if file is not None:
            file.close()
            out.close()
            first = [file.first]
            row = [pa.array([name]), *(pa.array(x, pa.int64()) for x in (first, [file.n], [len(file.docs[1])]))]
            yield pa.RecordBatch.from_arrays(row, names=["file", "first", "n_ids", "n_docs"])
        encode = file = batch = ids = None
        give_back()

    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("docs")).first()
    files = max(1, -(-(size["bytes"] or 0) // file_bytes), -(-size["docs"] // FILE_DOCS))
    t = docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(t.mapInArrow(write, MANIFEST), "token-manifest")


def read_documents(source) -> Iterator[tuple]:
    """(doc_id, at, ids) of each document of an open file, in order; at counts from the file's start."""
    size = source.size()
    docs_at, n = struct.unpack("<QQ", source.read_at(16, size - 16))
    source.seek(docs_at)
    docs = pa.ipc.open_stream(source).read_all()
    source.seek(0)
    held, at = np.empty(0, np.uint16), 0
    batches = iter(pa.ipc.open_stream(source))
    each = (row for part in docs.to_batches() for row in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True))
    for doc_id, begin, length in each:
        parts, have = [held], len(held)
        while have < length:
            batch = next(batches)
            ids, mask = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            parts.append(ids[: int(mask.sum())])
            have += len(parts[-1])
        held = np.concatenate(parts) if len(parts) > 1 else held
        if at != begin:
            raise ValueError("documents and sequences differ")
        yield doc_id, begin, held[:length]
        held, at = held[length:], at + length
    if at != n:
        raise ValueError("file is not complete")


def read_sequence(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence k of a local file, by its computed offset in a memory map."""
    source = pa.memory_map(path)
    schema = pa.ipc.read_schema(source)
    head = source.tell()
    pa.ipc.read_message(source)
    stride = source.tell() - head
    source.seek(head + k // ROWS * stride)
    batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    return batch.column(0)[k % ROWS].values.to_numpy(), batch.column(1)[k % ROWS].values.to_numpy(zero_copy_only=False)


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a document from the files, with its offset among the ids of all of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with system.open_input_file(f"{at}/{name}") as source:
                    rows = ((d, start + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, a, ids in read_documents(source))
                    while some := list(itertools.islice(rows, 10_000)):
                        columns = [pa.array(x, pa.int64()) for x in zip(*some, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
        give_back()

    before = Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    t = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return staged(t, "token-offsets").repartition(max(1, manifest.count()), "file").mapInArrow(read, TOKENS)


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Writes the files and reads them back; returns manifest and documents."""
    folder = folder or new_dir(spark, "tokens")
    t = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    manifest = write_files(t, folder, tokenizer_path, end_id, file_bytes)
    return manifest, read_files(manifest, folder)
