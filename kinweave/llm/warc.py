"""WARC archives as seekable Zstandard bundles.

Each task writes bundles of up to about BUNDLE_BYTES: a ``warcinfo`` record in a frame of its own, then
WARC records grouped into independent Zstandard frames of about FRAME_BYTES, and a seek table in the
public seekable format, which ends the file. The index
maps a record to its bundle, the frame's offset in the file and the record's offset within the
frame, so one record is read by decompressing one frame. Bundles go to the folder that the
cluster shares, under a name of the task's attempt; the index, which names the attempt that
counted, is written as a table, so a repeated task leaves no doubt.

Record ids are unique whatever the page ids are (repeated or null), as they are made from the bundle's
name and the record's number; page ids have a header of their own. The block of a response is an HTTP
message, head and payload; that of a revisit is the head alone, and it names the target and date of the
response, which is what readers look records up by. Pages have no status, so all heads say 200.

Payloads are compared by SHA-1 and length. Digests that occur more than once are joined back to slim
rows of ids, where those of frequent payloads (empty and error pages) stay dealt over tasks; html is
shuffled only if there are more than BROADCAST_ROWS revisits.

Defined results: null html is an empty payload; records with equal page_id and payload are all
responses if theirs is the smallest page_id; a null page_id is a response and is never referred
to; null urls are written as an empty target, also where a revisit refers to one; of responses that repeat
the page id a revisit names the smallest url; ids have all 64 bits; further columns are not read;
no pages give no records. Pages have no time of fetching, so ``date`` is the same for all records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.shared import BROADCAST_ROWS, new_dir, pick, spread_join, staged

FRAME_BYTES = 1 << 20
#: Compressed bytes after which a task goes on in a new bundle.
BUNDLE_BYTES = 1 << 30
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, bundle string, frame int, frame_offset long, frame_bytes long, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Date of records, for want of a time of fetching.
DATE = "1970-01-01T00:00:00Z"
#: Headers that hold the table's ids.
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to and refers_url: of the page with the smallest id whose payload is equal, null for that page."""
    html = F.coalesce("html", F.lit(""))
    p = pages.withColumn("sha", F.concat(F.sha1(F.encode(html, "UTF-8")), F.lit("-"), F.octet_length(html).cast("string")))
    ids = p.where(F.col("page_id").isNotNull() & (F.octet_length(html) >= min_bytes)).select("page_id", "sha", "url")
    ids = staged(ids, "digests")
    first = ids.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    first = staged(first.where("last > refers_to").drop("last"), "repeated-payloads")
    same = spread_join(ids, first, "sha", "n")
    # Only revisited pages' urls are looked up, one row a payload.
    urls = same.where("page_id = refers_to").groupBy("sha").agg(F.min(F.coalesce("url", F.lit(""))).alias("refers_url"))
    urls = staged(urls.join(first.select("sha", "n"), "sha"), "revisited-urls")
    again = same.where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()
    again = spread_join(staged(again, "revisit-ids"), urls, "sha", "n")
    again = staged(again, "revisits")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    return p.join(again, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to", "refers_url")


def _uri(url: str | None) -> str:
    return quote(url or "", safe=":/?#[]@!$&()*+,;=%")


def _info(bundle: str, record_id: str, date: str = DATE) -> bytes:
    """The record that begins a bundle."""
    block = b"software: kinweave\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}", f"WARC-Filename: {bundle}",
        "Content-Type: application/warc-fields", f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _record(
    record_id: str, page_id: int | None, url: str | None, html: str | None, refers_to: int | None, refers_url: str | None = None, date: str = DATE
) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"{PAGE}: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}"]
        head += [f"WARC-Refers-To-Date: {date}", f"{REFERS}: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class BundleWriter:
    """Writes one bundle; records become readable through the returned index rows."""

    def __init__(self, out, path: str, level: int = 3, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.path, self.frame_bytes = out, path, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.at, self.frames, self.rows = 0, [], []
        self.buffer, self.waiting = bytearray(), []

    def begin(self, record: bytes) -> None:
        """Writes a record that the index does not have as a frame of its own."""
        self._frame(record)

    def add(self, page_id, record: bytes) -> None:
        self.waiting.append((page_id, len(self.buffer), len(record)))
        self.buffer += record
        if len(self.buffer) >= self.frame_bytes:
            self.flush()

    def taken(self) -> list[tuple]:
        """Index rows of the frames written since the last call."""
        rows, self.rows = self.rows, []
        return rows

    def flush(self) -> None:
        if self.waiting:
            place, size = self.at, self._frame(bytes(self.buffer))
            self.rows += [(p, self.path, len(self.frames) - 1, place, size, o, n) for p, o, n in self.waiting]
            self.buffer, self.waiting = bytearray(), []

    def _frame(self, plain: bytes) -> int:
        frame = self.compress(plain)
        self.out.write(frame)
        self.frames.append((len(frame), len(plain)))
        self.at += len(frame)
        return len(frame)

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, read from the end of the bundle."""
    size = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw, at, out = file.read_at(8 * n, size - 9 - 8 * n), 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, 8 * i)
        out.append((at, packed, plain))
        at += packed
    return out


def _fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])


def parse_record(record: bytes) -> tuple:
    """A row of RECORD; the payload of a response is compared with its digest and its HTTP head."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size, digest, kind = int(_fields(http)["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload differs from its digest")
    number = lambda x: None if x is None else int(x)
    return number(fields.get(PAGE)), size, digest, kind, number(fields.get(REFERS))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [x.split() for x in schema.split(", ")]
    of = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, of[kind]) for x, (_, kind) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def write_bundles(pages: DataFrame, folder: str, date: str = DATE, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the bundles and returns their index, kept as a table in the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        writer = out = bundle = None
        number = 0
        for batch in batches:
            ids = (batch.column(c).to_pylist() for c in ("page_id", "refers_to"))
            texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("url", "html", "refers_url"))
            for page_id, refers_to, url, html, refers_url in zip(*ids, *texts, strict=True):
                if writer is None:
                    system, at = fs.FileSystem.from_uri(folder)
                    system.create_dir(at, recursive=True)
                    bundle, number = uuid.uuid4(), 0
                    name = f"bundle-{bundle.hex}.warc.zst"
                    out = system.open_output_stream(f"{at}/{name}", compression=None)
                    writer = BundleWriter(out, name)
                    writer.begin(_info(name, str(bundle), date))
                number += 1
                writer.add(page_id, _record(str(uuid.uuid5(bundle, str(number))), page_id, url, html, refers_to, refers_url, date))
                if writer.at >= bundle_bytes:
                    writer.close()
                    out.close()
                    yield _rows(writer.taken(), INDEX)
                    writer = None
            if writer is not None:
                yield _rows(writer.taken(), INDEX)
        if writer is not None:
            writer.close()
            out.close()
            yield _rows(writer.taken(), INDEX)

    return staged(pages.mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Reads every indexed record through the frame-relative offsets, one frame at a time.

    Frames, not bundles, are dealt out, so a large bundle is read by many tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        plain = zstandard.ZstdDecompressor()
        key = bundle = file = table = frame = None
        for batch in batches:
            rows = []
            for name, k, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
                if bundle != name:
                    file = system.open_input_file(f"{at}/{name}")
                    bundle, table = name, read_seek_table(file)
                if key != (name, k):
                    place, packed, size = table[k]
                    key, frame = (name, k), plain.decompress(file.read_at(packed, place), max_output_size=size)
                rows.append(parse_record(frame[offset : offset + length]))
            yield _rows(rows, RECORD)

    t = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return t.mapInArrow(read, RECORD)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Writes pages as WARC records; returns the index and the records read back."""
    folder = folder or new_dir(spark, "warc")
    index = write_bundles(resolve_revisits(pick(pages, page_id="page_id", url="url", html="html"), min_bytes), folder)
    return index, read_bundles(index, folder)
