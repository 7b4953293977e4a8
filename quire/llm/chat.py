"""Chat formatting of conversations with typed content parts.

A visitor walks a turn's parts and flattens them into one text: text parts
with control strings escaped, image, audio and document parts as ordered
placeholders, each recorded with its reference, place and the number of model
tokens it expands to. Turns are marked ``<|im_start|>role`` ... ``<|im_end|>``.

Escaping is reversible: a backslash is put into every ``<`` + backslashes +
``|``, so that ``<|`` never occurs in escaped text; reading back takes one out.

Turns are put in order by conversation and formatted as they stream through
one task (attachment numbers, text and digest of a conversation are
sequential); a conversation is never held whole, so a very long one costs
time and no memory.

Defined cases: null text, role or part fields count as empty; turns are
ordered by (turn, role, parts as given), null turns first, so ties and
repeated rows have a fixed order and all stay; attachments are numbered
through the whole conversation; sizes and lengths that are no positive finite
number count as the least (one tile, one audio token, one page); a null
conv_id is a conversation of its own; an empty table gives only the extra
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import shuffle_partitions

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
IMAGE_TILE = 28          # pixels a side that one image token covers
AUDIO_RATE = 25          # audio tokens a second
PAGE_TOKENS = 256        # tokens of a document page

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN_SCHEMA = ("conv_id long, turn long, formatted string, loss array<struct<start:int,end:int>>, "
               "attachments array<struct<n:int,kind:string,ref:string,at:int,tokens:long>>")

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _units(x: float) -> int:
    """Whole units that ``x`` begins, at least one; one also where ``x`` is
    no number or has no end."""
    return max(1, math.ceil(x)) if math.isfinite(x) else 1


class PartVisitor:
    """Flattens one turn's parts; ``visit`` dispatches on a part's kind."""

    def __init__(self, attached: int = 0):
        self.out, self.size, self.written, self.attachments = [], 0, [], []
        self.attached = attached        # attachments of earlier turns

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_text)(part)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit_text(self, part: dict) -> None:
        text = escape(part.get("text") or "")
        self.written.append((self.size, self.size + len(text)))
        self._put(text)

    def visit_image(self, part: dict) -> None:
        side = [_units((part.get(k) or 0) / IMAGE_TILE) for k in ("width", "height")]
        self._attach("image", part, side[0] * side[1])

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, _units((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, _units(part.get("pages") or 0) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        n = self.attached + len(self.attachments) + 1
        self.attachments.append({"n": n, "kind": kind, "ref": part.get("ref") or "", "at": self.size,
                                 "tokens": tokens})
        self._put(f"<|{kind}_{n}|>")


def format_turn(role: str, parts: list[dict], attached: int = 0) -> dict:
    """One turn as text, with the spans under the loss mask and the
    attachments' places in it; ``attached`` attachments came before it."""
    head = f"{START}{escape_role(role)}\n"
    v = PartVisitor(attached)
    for p in parts:
        v.visit(p)
    shift = len(head)
    return {"formatted": f"{head}{''.join(v.out)}{END}\n",
            "loss": [{"start": a + shift, "end": b + shift} for a, b in v.written] if role == LOSS_ROLE else [],
            "attachments": [a | {"at": a["at"] + shift} for a in v.attachments]}


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn (placeholders stay in the text)."""
    end = formatted.index(END)
    head = formatted.index("\n")
    return unescape_role(formatted[len(START):head]), unescape(formatted[head + 1:end])


def escape_role(role: str) -> str:
    """Roles are one line: line breaks and backslashes are written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def _format(batches):
    now, attached = object(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            done = []
            for conv_id, role, parts in zip(*(part.column(i).to_pylist() for i in (0, 2, 3))):
                if conv_id != now:
                    now, attached = conv_id, 0
                done.append(format_turn(role or "", [p or {} for p in parts or []], attached))
                attached += len(done[-1]["attachments"])
            loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            att = pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("ref", pa.string()),
                                      ("at", pa.int32()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([d["formatted"] for d in done], pa.string()),
                 pa.array([d["loss"] for d in done], loss), pa.array([d["attachments"] for d in done], att)],
                names=["conv_id", "turn", "formatted", "loss", "attachments"])


def text_parts(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, parts)`` from rows that hold plain text."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
                    *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"),
                                                                ("seconds", "double"), ("pages", "int"))])
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.array(part).alias("parts"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted turns of ``turns(conv_id, turn, role, parts)``, in order
    within each conversation: the concatenation of a conversation's
    ``formatted`` is its training text."""
    ordered = (turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts")
               .repartition(shuffle_partitions(turns.sparkSession), "conv_id")
               .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "parts"))
    return ordered.mapInArrow(_format, TURN_SCHEMA)


DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long")


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        role, text = read_turn(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        for s in loss:
            part = unescape(formatted[s["start"]:s["end"]])
            self.loss.update(part.encode())
            self.loss_chars += len(part)
        self.n += 1
        self.chars += len(formatted)

    def row(self) -> tuple:
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _read_back(batches):
    now, rows = None, []
    for batch in batches:
        for conv_id, formatted, loss in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    rows.append(now.row())
                now = _Digest(conv_id)
            now.add(formatted, loss)
        if len(rows) > 10_000:
            yield _digest_rows(rows)
            rows = []
    if now is not None:
        rows.append(now.row())
    yield _digest_rows(rows)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of whole conversations, read back from the output
    of ``format_conversations``."""
    return formatted.mapInArrow(_read_back, DIGEST_SCHEMA)
