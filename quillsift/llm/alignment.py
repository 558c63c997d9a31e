"""Operator 12: alignment of two tokenizers' tokens, as an Arrow pipeline.

A document's tokens of A (byte-level) and B (pieces) both spell one space and the text. For a slice of
documents the nested ids are flattened with their parent indices, token lengths are summed by
segment to byte ends, and an Acero hash join on (document, end) finds where tokens of both end
together: the links. They cut the text into groups. ``Table.group_by`` counts the linked id pairs
of a task, and Spark merges the counts of all tasks.

The first scan writes every document's links beside the partial counts (two small ids a link), so
texts are encoded once. The merged counts are broadcast if counted to be at most ``SHARED_PAIRS``
pairs; otherwise the links' pairs are combined by document and joined with the counts.

A text that is null or empty, or that a tokenizer does not spell byte by byte (B replaces some
characters), has no tokens: zeros and an empty digest column. Repeated rows count each; null ids are
handed on. An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from quillsift.llm.arrow_text import id_and_text, slices, string_bytes
from quillsift.llm.packing import BYTE_LEVEL_PATTERN
from quillsift.llm.pretoken import byte_letters
from quillsift.session import checkpointed

#: Pairs of which counts are broadcast: 20 bytes each.
SHARED_PAIRS = 2_000_000
#: Distinct pairs a task holds before it hands their counts on.
HELD_PAIRS = 400_000
SLICE = 1 << 20
_END_BITS = 40


class Vocabulary:
    """Bytes of every id as one binary array, and their lengths."""

    def __init__(self, entries: list[bytes]) -> None:
        self.bytes = pa.array(entries, pa.large_binary())
        self.lengths = pa.array([len(e) for e in entries], pa.int64())
        self.size = len(entries)

    def spelled(self, ids: pa.Array) -> np.ndarray:
        """Bytes of all ids, one after the other."""
        return string_bytes_of(self.bytes.take(ids))


def string_bytes_of(array: pa.Array) -> np.ndarray:
    """Value bytes of a large binary array that starts at its buffers' begin."""
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64, count=len(array) + 1)
    data = array.buffers()[2]
    if data is None:
        return np.zeros(0, dtype=np.uint8)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]


class ByteLevel:
    """Encoder of a byte-level file whose ids rank their merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        of_letter = {letter: byte for byte, letter in enumerate(byte_letters())}
        spelled = {entry: bytes(of_letter[c] for c in entry) for entry in model["vocab"]}
        entries = [b""] * (max(model["vocab"].values()) + 1)
        for entry, key in model["vocab"].items():
            entries[key] = spelled[entry]
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            if model["vocab"][left + right] != 256 + rank:
                raise ValueError(f"{path}: ids do not rank merges")
        pattern = BYTE_LEVEL_PATTERN.format(L=r"\p{L}", N=r"\p{N}").replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
        ranks = {spelled[entry]: key for entry, key in model["vocab"].items()}
        self.encode = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.vocabulary = Vocabulary(entries)


class Pieces:
    """Encoder of a piece file; a piece shows a space as U+2581 and a byte as <0xHH>."""

    def __init__(self, path: str) -> None:
        model = SentencePieceProcessor(model_file=path)
        entries = []
        for key in range(model.get_piece_size()):
            piece = model.id_to_piece(key)
            if model.is_byte(key):
                entries.append(bytes([int(piece[3:-1], 16)]))
            else:
                entries.append(piece.replace("▁", " ").encode())
        self.encode = lambda texts: model.encode(texts, num_threads=1)
        self.vocabulary = Vocabulary(entries)


_loaded: dict[tuple[type, str], ByteLevel | Pieces] = {}


def loaded(kind: type, path: str) -> ByteLevel | Pieces:
    """The worker's encoder of a file, built once."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def nested(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


class Tokens:
    """Tokens of the documents of a slice: id, document and byte end in the document of each."""

    def __init__(self, lists: pa.ListArray, vocabulary: Vocabulary) -> None:
        self.ids = pc.list_flatten(lists)
        self.parents = pc.list_parent_indices(lists)
        self.counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        firsts = np.cumsum(self.counts) - self.counts
        lengths = vocabulary.lengths.take(self.ids)
        running = np.concatenate([[0], pc.cumulative_sum(lengths).to_numpy()])
        #: Segmented sums: the running one less what stood before the document.
        self.sizes = running[firsts + self.counts] - running[firsts]
        self.ends = running[1:] - np.repeat(running[firsts], self.counts)

    def keys(self) -> pa.Array:
        return pa.array((self.parents.to_numpy().astype(np.int64) << _END_BITS) | self.ends)


def spelled_as(lists: pa.ListArray, vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each document's ids spell its bytes ``data[starts[n]:starts[n + 1]]``."""
    ids = pc.list_flatten(lists)
    counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
    running = np.concatenate([[0], np.cumsum(vocabulary.lengths.take(ids).to_numpy())])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    own = running[bounds]
    sizes = np.diff(starts)
    same = np.diff(own) == sizes
    spelled = vocabulary.spelled(ids)
    if same.all():
        wrong = np.concatenate([[0], np.cumsum(spelled != data)])
        return wrong[starts[1:]] == wrong[starts[:-1]]
    for n in np.flatnonzero(same).tolist():
        same[n] = np.array_equal(spelled[own[n] : own[n + 1]], data[starts[n] : starts[n + 1]])
    return same


def pair_links(a: Tokens, b: Tokens) -> pa.Table:
    """(key, place_a, a, place_b, b) of the tokens that end together, by document and end."""
    sides = []
    for name, tokens in (("a", a), ("b", b)):
        places = pa.array(np.arange(len(tokens.ids), dtype=np.int64))
        sides.append(pa.table({"key": tokens.keys(), f"place_{name}": places, name: tokens.ids}))
    return sides[0].join(sides[1], keys="key", join_type="inner", use_threads=False).sort_by("key")


class GroupText:
    """Spells ``a1,a2|b1;a3|b2,b3``: numbers and the marks behind them, taken from one table."""

    def __init__(self, a: Vocabulary, b: Vocabulary) -> None:
        self.size_a, self.size_b = a.size, b.size
        texts = [str(n).encode() for n in range(max(a.size, b.size))]
        parts = [[t + mark for t in texts[:size]] for size, mark in ((a.size, b","), (a.size, b"|"), (b.size, b","), (b.size, b";"))]
        self.table = pa.array([t for part in parts for t in part], pa.large_binary())

    def digests(self, a: Tokens, b: Tokens, links: pa.Table, documents: int) -> list[str]:
        """Hex digest of each document's groups; empty for one without tokens."""
        count_a, count_b = len(a.ids), len(b.ids)
        closes_a, closes_b = np.zeros(count_a, dtype=bool), np.zeros(count_b, dtype=bool)
        closes_a[links["place_a"].to_numpy()] = True
        closes_b[links["place_b"].to_numpy()] = True
        # A group's tokens of A stand before its tokens of B, documents after each other.
        groups_a = np.cumsum(closes_a) - closes_a
        groups_b = np.cumsum(closes_b) - closes_b
        groups = int(closes_a.sum())
        of_a = np.bincount(groups_a, minlength=groups)
        of_b = np.bincount(groups_b, minlength=groups)
        before_b = np.cumsum(of_b) - of_b
        after_a = np.cumsum(of_a)
        codes = np.zeros(count_a + count_b, dtype=np.int64)
        ids_a, ids_b = a.ids.to_numpy().astype(np.int64), b.ids.to_numpy().astype(np.int64)
        codes[np.arange(count_a) + before_b[groups_a]] = ids_a + closes_a * self.size_a
        codes[np.arange(count_b) + after_a[groups_b]] = ids_b + closes_b * self.size_b + 2 * self.size_a
        spelled = self.table.take(pa.array(codes))
        offsets = np.frombuffer(spelled.buffers()[1], dtype=np.int64, count=len(codes) + 1)
        data = memoryview(string_bytes_of(spelled)) if len(codes) else memoryview(b"")
        bounds = offsets[np.concatenate([[0], np.cumsum(a.counts + b.counts)])].tolist()
        # The last mark of a document is not part of it.
        return [
            hashlib.sha256(data[begin : end - 1]).hexdigest() if end > begin else ""
            for begin, end in zip(bounds[:-1], bounds[1:], strict=True)
        ]


_DOCUMENT = "id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
_COUNT = "a int, b int, k long"


def aligned(rows: DataFrame, path_a: str, path_b: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """One row per document with its links, and rows (a, b, k) of partial pair counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = loaded(ByteLevel, path_a), loaded(Pieces, path_b)
        spell = GroupText(first.vocabulary, second.vocabulary)
        held: list[pa.Table] = []
        for part in slices(batches, limit=SLICE):
            out, links = _slice_rows(part, first, second, spell)
            yield out
            held.append(_counted(links.select(["a", "b"]).append_column("k", pa.array(np.ones(len(links), dtype=np.int64)))))
            if sum(map(len, held)) > held_pairs:
                held = [_counted(pa.concat_tables(held))]
                if len(held[0]) > held_pairs // 2:
                    yield from _count_rows(held.pop())
        if held:
            yield from _count_rows(_counted(pa.concat_tables(held)))

    return rows.mapInArrow(run, f"{_DOCUMENT}, {_COUNT}")


def _counted(pairs: pa.Table) -> pa.Table:
    return pairs.group_by(["a", "b"], use_threads=False).aggregate([("k", "sum")]).rename_columns(["a", "b", "k"])


def _count_rows(counts: pa.Table) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    names = [c.split()[0] for c in _DOCUMENT.split(", ")]
    for batch in counts.combine_chunks().to_batches():
        columns = [pa.nulls(batch.num_rows, kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays([*columns, *batch.columns], [*names, "a", "b", "k"])


def _slice_rows(
    part: pa.RecordBatch, first: ByteLevel, second: Pieces, spell: GroupText
) -> tuple[pa.RecordBatch, pa.Table]:
    texts = part.column("text").to_pylist()
    lists_a = nested([first.encode(" " + t) if t else [] for t in texts])
    lists_b = nested(second.encode(texts))
    data, offsets = string_bytes(part.column("text"))
    sizes = np.diff(offsets)
    # One space before every text that is not empty.
    starts = offsets + np.concatenate([[0], np.cumsum(sizes > 0)])
    spaced = np.insert(data, offsets[:-1][sizes > 0], 0x20)
    fits = spelled_as(lists_a, first.vocabulary, spaced, starts) & spelled_as(lists_b, second.vocabulary, spaced, starts)
    if not fits.all():
        lists_a = _emptied(lists_a, fits)
        lists_b = _emptied(lists_b, fits)
    a, b = Tokens(lists_a, first.vocabulary), Tokens(lists_b, second.vocabulary)
    links = pair_links(a, b)
    digests = spell.digests(a, b, links, len(texts))
    bounds = np.searchsorted(links["key"].to_numpy(), np.arange(len(texts) + 1, dtype=np.int64) << _END_BITS)
    packed = pack_links(links["a"].to_numpy(), links["b"].to_numpy(), first.vocabulary.size, second.vocabulary.size)
    cuts = bounds.tolist()
    columns = [
        part.column("id"),
        pa.array(a.counts),
        pa.array(b.counts),
        pa.array(np.diff(bounds)),
        pa.array(digests, pa.string()),
        pa.array([packed[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        pa.nulls(len(texts), pa.int32()),
        pa.nulls(len(texts), pa.int32()),
        pa.nulls(len(texts), pa.int64()),
    ]
    names = [c.split()[0] for c in f"{_DOCUMENT}, {_COUNT}".split(", ")]
    return pa.RecordBatch.from_arrays(columns, names), links


def _emptied(lists: pa.ListArray, kept: np.ndarray) -> pa.ListArray:
    return nested([own if keep else [] for own, keep in zip(lists.to_pylist(), kept.tolist(), strict=True)])


def link_type(size_a: int, size_b: int) -> np.dtype:
    """A pair of ids in as few bytes as the vocabularies allow."""
    kinds = ["<u2" if size <= 1 << 16 else "<u4" for size in (size_a, size_b)]
    return np.dtype([("a", kinds[0]), ("b", kinds[1])])


def pack_links(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> np.ndarray:
    out = np.zeros(len(a), dtype=link_type(size_a, size_b))
    out["a"], out["b"] = a, b
    return out


def codes_of(packed: bytes, kind: np.dtype) -> np.ndarray:
    """(b, a) of links in one number each."""
    links = np.frombuffer(packed, dtype=kind)
    return (links["b"].astype(np.int64) << 32) | links["a"]


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shared_pairs: int = SHARED_PAIRS,
    held_pairs: int = HELD_PAIRS,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per document."""
    found = checkpointed(aligned(id_and_text(docs, id_col, text_col), path_a, path_b, held_pairs))
    documents = found.where("a is null").select("id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    counts = pair_counts(found.where("a is not null"))
    kind = link_type(loaded(ByteLevel, path_a).vocabulary.size, loaded(Pieces, path_b).vocabulary.size)
    if counts.limit(shared_pairs + 1).count() <= shared_pairs:
        return _with_shared_counts(documents, counts, kind)
    return _with_joined_counts(documents, counts, kind)


def pair_counts(partial: DataFrame) -> DataFrame:
    """(code, k, best) of every linked id pair; ``best`` if no pair of its B id counts more."""
    merged = checkpointed(partial.groupBy("a", "b").agg(F.sum("k").alias("k")))
    highest = merged.groupBy("b").agg(F.max("k").alias("highest"))
    code = F.shiftleft(F.col("b").cast("long"), 32).bitwiseOR(F.col("a").cast("long"))
    return merged.join(highest, "b").select(code.alias("code"), "k", (F.col("k") == F.col("highest")).alias("best"))


_ANSWER = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _with_shared_counts(documents: DataFrame, counts: DataFrame, kind: np.dtype) -> DataFrame:
    table = counts.toArrow().sort_by("code")
    arrays = tuple(table[c].to_numpy() for c in ("code", "k", "best"))
    shared = documents.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, best = shared.value
        for part in slices(batches, "links", SLICE):
            links = part.column("links")
            codes = codes_of(b"".join(links.to_pylist()), kind)
            places = np.searchsorted(keys, codes)
            bounds = np.concatenate([[0], np.cumsum(pc.binary_length(links).to_numpy() // kind.itemsize)])
            sums = []
            for values in (best, times):
                running = np.concatenate([[0], np.cumsum(values[places].astype(np.int64))])
                sums.append(pa.array(running[bounds[1:]] - running[bounds[:-1]]))
            columns = [part.column(c) for c in ("id", "n_a", "n_b", "n_groups")]
            columns += [pa.array(np.diff(bounds)), *sums, part.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ANSWER.split(", ")])

    return documents.mapInArrow(run, _ANSWER)


def _with_joined_counts(documents: DataFrame, counts: DataFrame, kind: np.dtype) -> DataFrame:
    """As with shared counts, for more pairs than may be broadcast: distinct pairs of each row are joined."""
    keyed = checkpointed(documents.withColumn("row", F.monotonically_increasing_id()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "links", SLICE):
            for row, links in zip(part.column("row").to_pylist(), part.column("links").to_pylist(), strict=True):
                codes, times = np.unique(codes_of(links, kind), return_counts=True)
                columns = [pa.array([row] * len(codes), pa.int64()), pa.array(codes), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "code", "times"])

    pairs = keyed.select("row", "links").mapInArrow(run, "row long, code long, times long")
    sums = (
        pairs.join(counts, "code")
        .groupBy("row")
        .agg(
            F.sum("times").alias("n_links"),
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("k")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return keyed.join(sums, "row", "left").select(
        "id", "n_a", "n_b", "n_groups",
        *(F.coalesce(c, zero).alias(c) for c in ("n_links", "n_best", "count_sum")),
        "groups_sha256",
    )
