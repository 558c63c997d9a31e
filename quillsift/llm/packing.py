"""Operator 8: hierarchical packing of documents into windows of several lengths.

A document's ids, closed by an end id, are cut into full windows of the longest tier; what
remains is routed to the shortest tier that holds it. Each tier is packed from the longest to
the shortest: a piece opens a window of its tier and shorter pieces fill the gap, the largest
that fits first; if none fits, the smallest is cut, so a window closes exactly at its tier's
length. ``balanced_steps`` numbers the windows of each tier over all tasks (counts per task and
tier, then offsets) and deals them into as few step groups of at most ``STEP_TOKENS`` as hold them,
whose sizes differ by at most one window. Step groups count from 0, longer tiers first.

Packing is local to a task and holds at most ``POOL_TOKENS`` waiting ids beside the current
document. Pieces still waiting at the end of a task go, cut freely, into windows of falling
length; only the last of them may need padding, to the longest tier.

A null text counts as empty and gives the end id alone. Null or repeated ids are packed like
any other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from quillsift.llm.arrow_text import id_and_text, slices
from quillsift.llm.pretoken import TextEncoder, WordSplitter
from quillsift.session import broadcast_if_small, checkpointed

#: Fixed value: the splitting pattern of the byte-level vocabulary.
BYTE_LEVEL_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
)
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 64 * 2048
POOL_TOKENS = 1 << 18
END_ID = 1
#: A window's number is its task's partition above these bits.
TASK_SHIFT = 40
COLUMNS = {
    "id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long",
    "sequence_id": "long", "offset": "long", "context": "int", "tier_window": "long",
}

#: Words whose ids a worker keeps; packing holds little else.
ENCODER_WORDS = 250_000
_encoders: dict[str, TextEncoder] = {}


def byte_level_encoder(path: str) -> TextEncoder:
    """The worker's encoder of a byte-level file, built once."""
    if path not in _encoders:
        tokenizer = Tokenizer.from_file(path)
        model = tokenizer.model

        def encode(word: str) -> bytes:
            return np.array([t.id for t in model.tokenize(word)], dtype="<u4").tobytes()

        _encoders[path] = TextEncoder(
            WordSplitter(tokenizer, BYTE_LEVEL_PATTERN, False), encode, ENCODER_WORDS
        )
    return _encoders[path]


class TierPacker:
    """Packs the documents of one task; ``rows`` collects one tuple per placed piece."""

    def __init__(
        self, first_id: int, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS
    ) -> None:
        self.tiers = tuple(sorted(tiers))
        self.longest = self.tiers[-1]
        self.pool_tokens = pool_tokens
        #: Waiting pieces of each tier, by length: (length, arrival, document, start).
        self.waiting: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.waiting_tokens = 0
        self.arrivals = 0
        self.next_sequence = first_id
        #: Of each tier: the windows closed so far.
        self.closed = dict.fromkeys(self.tiers, 0)
        self.rows: list[tuple] = []

    def add(self, key: int | None, ids: bytes) -> None:
        document = (key, ids, len(ids) // 4)
        full = document[2] // self.longest * self.longest
        for start in range(0, full, self.longest):
            self._close([(self.longest, 0, document, start)], self.longest)
        if full < document[2]:
            self._wait(document, full, document[2] - full)
            if self.waiting_tokens >= self.pool_tokens:
                self.pack()

    def _wait(self, document: tuple, start: int, length: int) -> None:
        tier = self.tiers[bisect.bisect_left(self.tiers, length)]
        self.arrivals += 1
        bisect.insort(self.waiting[tier], (length, self.arrivals, document, start), key=lambda p: p[:2])
        self.waiting_tokens += length

    def _take(self, gap: int, limit: int) -> tuple | None:
        """The longest waiting piece within ``gap``, from tiers up to ``limit``."""
        for tier in reversed(self.tiers):
            pool = self.waiting[tier]
            if tier <= limit and pool and pool[0][0] <= gap:
                piece = pool.pop(bisect.bisect_right(pool, gap, key=lambda p: p[0]) - 1)
                self.waiting_tokens -= piece[0]
                return piece
        return None

    def _cut(self, gap: int, limit: int) -> tuple | None:
        """The front of the shortest waiting piece, cut to ``gap``; the rest waits on."""
        for tier in self.tiers:
            if tier <= limit and self.waiting[tier]:
                length, _, document, start = self.waiting[tier].pop(0)
                self.waiting_tokens -= length
                self._wait(document, start + gap, length - gap)
                return (gap, 0, document, start)
        return None

    def pack(self) -> None:
        """Close every window that the waiting pieces can fill; the rest waits on."""
        for tier in reversed(self.tiers):
            while self.waiting[tier]:
                held = [self.waiting[tier].pop()]
                gap = tier - held[0][0]
                self.waiting_tokens -= held[0][0]
                while gap:
                    piece = self._take(gap, tier) or self._cut(gap, tier)
                    if piece is None:
                        break
                    held.append(piece)
                    gap -= piece[0]
                if gap:
                    for length, _, document, start in held:
                        self._wait(document, start, length)
                    break
                self._close(held, tier)

    def finish(self) -> None:
        self.pack()
        left = [p for tier in reversed(self.tiers) for p in self.waiting[tier]]
        self.waiting = {t: [] for t in self.tiers}
        total, self.waiting_tokens = self.waiting_tokens, 0
        for tier in reversed(self.tiers):
            while total >= tier:
                held, gap = [], tier
                while gap:
                    length, _, document, start = left.pop(0)
                    taken = min(length, gap)
                    held.append((taken, 0, document, start))
                    if taken < length:
                        left.insert(0, (length - taken, 0, document, start + taken))
                    gap -= taken
                self._close(held, tier)
                total -= tier
        if left:
            self._close(left, self.longest)

    def _close(self, pieces: list[tuple], tier: int) -> None:
        window = self.closed[tier]
        self.closed[tier] += 1
        offset = 0
        for length, _, (key, ids, tokens), start in pieces:
            crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
            self.rows.append(
                (key, start, length, crc, tokens, self.next_sequence, offset, tier, window)
            )
            offset += length
        self.next_sequence += 1

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            kinds = {"long": pa.int64(), "int": pa.int32()}
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kinds[k]) for c, k in zip(columns, COLUMNS.values(), strict=True)],
                list(COLUMNS),
            )
            self.rows = []


def pack_documents(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
) -> DataFrame:
    """One row per piece: where it begins in its document and in which window it lies.

    No exchange: each task packs its own documents. Window numbers carry the task's
    partition, so a task run again gives the same numbers; ``tier_window`` counts the windows
    of one tier in one task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(path)
        end = END_ID.to_bytes(4, "little")
        packer = TierPacker(TaskContext.get().partitionId() << TASK_SHIFT, tiers)
        for part in slices(batches):
            for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                packer.add(key, encode(text) + end)
            yield from packer.drain()
        packer.finish()
        yield from packer.drain()

    schema = ", ".join(f"`{name}` {kind}" for name, kind in COLUMNS.items())
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def balanced_steps(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces with their ``step_group``; of one tier all groups are equal to within one window.

    The pieces, numbers alone, are fixed once by a checkpoint, so that counts and rows agree also
    when a task runs again. Counts are one row per task and tier; texts are not read again.
    """
    fixed = checkpointed(pieces.withColumn("_task", F.shiftright("sequence_id", TASK_SHIFT)))
    counts = fixed.groupBy("context", "_task").agg((F.max("tier_window") + 1).alias("_n"))
    before = Window.partitionBy("context").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    per_step = F.greatest(F.floor(F.lit(step_tokens) / F.col("context")), F.lit(1))
    longer = Window.orderBy(F.col("context").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tiers = (
        counts.groupBy("context")
        .agg(F.sum("_n").alias("_windows"))
        .withColumn("_groups", F.ceil(F.col("_windows") / per_step).cast("long"))
        .withColumn("_first", F.coalesce(F.sum("_groups").over(longer), F.lit(0)))
    )
    placed = offsets.join(F.broadcast(tiers), "context").drop("_n")
    # Whole-number division; the product of windows and groups stays far below 2**63.
    group = F.expr("(_offset + tier_window) * _groups div _windows")
    return (
        fixed.join(broadcast_if_small(placed), ["context", "_task"])
        .withColumn("step_group", F.col("_first") + group)
        .select(*[c for c in pieces.columns if c != "tier_window"], "step_group")
    )
