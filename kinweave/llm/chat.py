"""Chat formatting with typed content parts.

A turn's content is an array of parts (type, text, ref, amount). A visitor has one method for
each type: text is escaped and kept, images, audio and documents become ordered placeholders,
their references are recorded with the number of tokens that the placeholder expands to.
``format_turns`` is row-local; ``read_back`` streams each conversation's turns in order through
one task with constant memory (a running digest), so a conversation of any length is never
gathered.

Control strings are escaped inside texts, and so are their beginnings at the end of a text part that
another follows, so that none forms across parts.

Defined results: null text is empty, null role is empty, a part of unknown type becomes a
``document`` placeholder with no tokens; a turn without parts is empty; turns with equal numbers are
ordered by role, then text; rows with a null conversation form one conversation, and ids have all 64
bits; repeated rows are turns of their own; further columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings that may not appear inside texts; the first character is escaped.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|image|>", "<|audio|>", "<|document|>", "<s>", "</s>", "[INST]", "[/INST]")
LOSS_ROLES = ("assistant",)
PART = "struct<type:string,text:string,ref:string,amount:long>"


def escape(text: Column, more: Column | None = None) -> Column:
    """Reversible: every & becomes &amp;, then the first character of a control string an entity.

    ``more``: another text follows, so the beginning of a control string at the end is escaped too.
    """
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "&", "&amp;")
    for first, entity in (("<", "&lt;"), ("[", "&#91;")):
        tails = [c[1:] for c in CONTROLS if c[0] == first]
        pattern = lambda x: f"{re.escape(first)}(?={x})"  # noqa: B023, E731
        inside = "|".join(map(re.escape, tails))
        begun = "|".join(re.escape(x) for x in sorted({t[:i] for t in tails for i in range(1, len(t))}))
        whole = F.regexp_replace(out, pattern(inside), entity)
        out = whole if more is None else F.when(more, F.regexp_replace(whole, pattern(rf"(?:{begun})?\z"), entity)).otherwise(whole)
    return out


def unescape(text: str) -> str:
    """Undoes ``escape``."""
    return text.replace("&lt;", "<").replace("&#91;", "[").replace("&#10;", "\n").replace("&amp;", "&")


class PartVisitor:
    """What each type of part becomes: rendered text and number of expanded tokens."""

    def __init__(self, image_tokens: int = 576, audio_tokens_a_second: int = 25, document_tokens_a_page: int = 512):
        self.tokens = {"image": (image_tokens, False), "audio": (audio_tokens_a_second, True), "document": (document_tokens_a_page, True)}

    def text(self, part: Column, more: Column) -> tuple[Column, Column]:
        return escape(part["text"], more), F.lit(0).cast("long")

    def attachment(self, kind: str, part: Column) -> tuple[Column, Column]:
        unit, by_amount = self.tokens[kind]
        amount = F.coalesce(part["amount"], F.lit(0)) if by_amount else F.lit(1)
        return F.lit(f"<|{kind}|>"), (F.lit(unit) * amount).cast("long")

    def visit(self, part: Column, more: Column) -> Column:
        """``more``: the next part is a text."""
        rendered, tokens = self.text(part, more)
        text, n = F.when(part["type"] == "text", rendered), F.when(part["type"] == "text", tokens)
        for kind in self.tokens:
            rendered, tokens = self.attachment(kind, part)
            text, n = text.when(part["type"] == kind, rendered), n.when(part["type"] == kind, tokens)
        return F.struct(
            text.otherwise(F.lit("<|document|>")).alias("rendered"),
            F.when(part["type"] == "text", F.lit(None)).otherwise(part["ref"]).alias("ref"),
            F.coalesce(part["type"] != "text", F.lit(True)).alias("attached"),
            n.otherwise(F.lit(0).cast("long")).alias("tokens"),
        )


def text_parts(text: Column) -> Column:
    """A plain text as the only part of a turn."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("amount")))


def format_turns(turns: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """From (conv_id, turn, role, parts) the formatted segment of each turn.

    The segments of a conversation, in order, are its formatted text. ``loss_start`` and
    ``loss_end`` are the code points of the segment under the loss mask, null if it has none.
    """
    v = visitor or PartVisitor()
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts)
    after = lambda i: F.coalesce(F.get("parts", i + 1)["type"] == "text", F.lit(False))
    t = t.withColumn("p", F.transform("parts", lambda part, i: v.visit(part, after(i))))
    t = t.withColumn("body", F.array_join(F.transform("p", lambda x: x["rendered"]), ""))
    t = t.withColumn("head", F.concat(F.lit(OPEN), F.regexp_replace(escape(F.col("role")), "\n", "&#10;"), F.lit("\n")))
    masked = F.col("role").isin(*LOSS_ROLES)
    return t.select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(CLOSE + "\n")).alias("segment"),
        F.when(masked, F.length("head")).cast("long").alias("loss_start"),
        F.when(masked, F.length("head") + F.length("body")).cast("long").alias("loss_end"),
        F.transform(F.filter("p", lambda x: x["attached"]), lambda x: x["ref"]).alias("attachments"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SEGMENT = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE) + "\n", re.S)


class _Reader:
    """The running digests of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start, end) -> None:
        role, body = _SEGMENT.fullmatch(segment).groups()
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
        if start is not None:
            text = unescape(segment[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        done = []
        for conv, segment, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Reader(conv)
            now.add(segment, start, end)
        yield _rows(done)
    if now is not None:
        yield _rows([now.row()])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in READ_BACK.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    made = [pa.array(x, pa.int64() if kind == "long" else pa.string()) for x, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=[n for n, _ in fields])


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses the formatted conversations and returns counts and digests of what they hold."""
    t = formatted.select("conv_id", "turn", "segment", "loss_start", "loss_end")
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(_read, READ_BACK)
