"""Operator 6: chat formatting by event-sourced reconstruction.

A log has one row per event: (conv_id, message, seq, kind, role, text). Logs are partitioned by
conversation and sorted by message and sequence; each task folds the events into final
messages and renders them one by one:

* ``message`` opens a new message with its text;
* ``delta`` appends to the open message, or opens it if there is none;
* ``edit`` replaces the open message's text (and its role, if one is given);
* ``regenerate`` throws the open message's text away; deltas that follow fill it anew.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts every ``<`` that could begin
a control string, one followed by backslashes and ``|``, gets one more backslash, so no text can
forge a mark and unescaping gives the text back.

Only one message is held at a time, so a conversation of any length streams through its task.
Null texts and roles count as empty, a null conv_id is a conversation of its own, null
sequences come first. Events alike in conversation, message and sequence go by kind, role and
text; repeated rows stay. An empty log gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
_FORGE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
RENDERED = "conv_id long, position long, piece string, loss_from long, loss_to long"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)
EVENT_COLUMNS = ("conv_id", "message", "seq", "kind", "role", "text")


def escape(text: str) -> str:
    return _FORGE.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    """A role fills one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    plain = unescape(role)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain, flags=re.DOTALL)


@dataclass
class Message:
    """A message under reconstruction."""

    key: int | None
    role: str
    parts: list[str] = field(default_factory=list)


def fold(events: Iterable[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """Final (conv_id, role, text) of sorted events, in order."""
    current: tuple[int | None, Message] | None = None

    def done() -> Iterator[tuple[int | None, str, str]]:
        if current is not None:
            yield current[0], current[1].role, "".join(current[1].parts)

    for conv, key, kind, role, text in events:
        same = current is not None and current[0] == conv and current[1].key == key
        if kind == "message" or not same:
            yield from done()
            current = (conv, Message(key, role, [] if kind == "regenerate" else [text]))
            continue
        message = current[1]
        if kind == "delta":
            message.parts.append(text)
        else:
            message.parts = [text] if kind == "edit" else []
            message.role = role or message.role
    yield from done()


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted text and the part of it under the loss mask."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    trained = len(body) if role == TRAINED_ROLE else 0
    return f"{head}{body}{END}\n", len(head), len(head) + trained


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class Digest:
    """Running digests of one conversation, read back from its formatted pieces."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, loss_from: int, loss_to: int) -> None:
        for role, text in read_turns(piece):
            self.turns += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode())
        trained = unescape(piece[loss_from:loss_to])
        self.loss_chars += len(trained)
        self.loss_hash.update(trained.encode())
        self.chars += len(piece)

    def row(self) -> tuple:
        return (self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars)


def _sorted(events: DataFrame) -> DataFrame:
    empty = F.lit("")
    rows = events.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("message").cast("long").alias("message"),
        F.col("seq").cast("long").alias("seq"),
        "kind",
        F.coalesce(F.col("role"), empty).alias("role"),
        F.coalesce(F.col("text"), empty).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions(*EVENT_COLUMNS)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    def events() -> Iterator[tuple]:
        for batch in batches:
            names = ("conv_id", "message", "kind", "role", "text")
            yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)

    for conv, role, text in fold(events()):
        yield (conv, *render(role, text))


def render_conversations(events: DataFrame) -> DataFrame:
    """One row per final message: its formatted piece and loss span, in order of position."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last, position, held = object(), 0, 0
        for conv, piece, begin, end in _pieces(batches):
            position = position + 1 if conv == last else 0
            last = conv
            rows.append((conv, position, piece, begin, end))
            held += len(piece)
            if held > 4 << 20:
                yield _batch(rows, RENDERED)
                rows, held = [], 0
        if rows:
            yield _batch(rows, RENDERED)

    return _sorted(events).mapInArrow(run, RENDERED)


def conversation_digests(events: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted text as read back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last, digest = None, None
        for conv, piece, begin, end in _pieces(batches):
            if digest is None or conv != last:
                if digest is not None:
                    rows.append((last, *digest.row()))
                last, digest = conv, Digest()
                if len(rows) >= 4096:
                    yield _batch(rows, DIGESTS)
                    rows = []
            digest.add(piece, begin, end)
        if digest is not None:
            rows.append((last, *digest.row()))
        if rows:
            yield _batch(rows, DIGESTS)

    return _sorted(events).mapInArrow(run, DIGESTS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])


def turn_events(turns: DataFrame) -> DataFrame:
    """The log of a table (conv_id, turn, role, text): each row is a whole message."""
    return turns.select(
        "conv_id",
        F.col("turn").alias("message"),
        F.col("turn").alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )
