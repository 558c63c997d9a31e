"""Operator 1: BPE encoding and decoding.

Merges of a word come from a priority queue of merge ranks over a doubly linked list of
symbols; entries made stale by an earlier merge are skipped when they surface. A word of n
symbols takes O(n log n), however long it is. Decoding concatenates vocabulary strings.

A null text counts as empty: no ids, and the digests of nothing. Rows with a null or repeated
id keep their own result row. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from quillsift.llm.arrow_text import id_and_text, slices
from quillsift.llm.pretoken import TextEncoder, WordSplitter

#: Fixed value: the splitting pattern of the word-end vocabulary, in lower case.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
SCHEMA = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_PAIR = 20


class MergeTable:
    """Vocabulary and merge ranks, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = (self.ids[left] << _PAIR) | self.ids[right]
            self.merges[key] = (rank, self.ids[left + right])

    def symbols(self, word: str) -> list[int]:
        found = [self.ids[letter] for letter in word[:-1]]
        found.append(self.ids[word[-1] + self.suffix])
        return found

    def encode(self, word: str) -> bytes:
        """Packed ids of one word in byte letters."""
        return array("I", merge(self.symbols(word), self.merges)).tobytes()


def merge(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Apply the lowest-ranked merge, leftmost first, until none is left."""
    count = len(symbols)
    before = list(range(-1, count - 1))
    after = [*range(1, count), -1]
    queue = []
    for place in range(count - 1):
        found = merges.get((symbols[place] << _PAIR) | symbols[place + 1])
        if found is not None:
            queue.append((found[0], place, symbols[place], symbols[place + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, place, left, right, merged = heapq.heappop(queue)
        second = after[place]
        if symbols[place] != left or second < 0 or symbols[second] != right:
            continue
        third = after[second]
        symbols[place], symbols[second] = merged, -1
        after[place] = third
        if third >= 0:
            before[third] = place
            found = merges.get((merged << _PAIR) | symbols[third])
            if found is not None:
                heapq.heappush(queue, (found[0], place, merged, symbols[third], found[1]))
        first = before[place]
        if first >= 0:
            found = merges.get((symbols[first] << _PAIR) | merged)
            if found is not None:
                heapq.heappush(queue, (found[0], first, symbols[first], merged, found[1]))
    return [s for s in symbols if s >= 0]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, expression: str = WORD_END_PATTERN, lower: bool = True) -> None:
        tokenizer = Tokenizer.from_file(path)
        table = MergeTable(path)
        self.encode = TextEncoder(WordSplitter(tokenizer, expression, lower), table.encode)
        self.strings = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings with one space between, as the library does without a decoder."""
        tokens = np.frombuffer(ids, dtype="<u4").tolist()
        return " ".join(map(self.strings.__getitem__, tokens))


_codecs: dict[tuple[str, str, bool], Codec] = {}


def codec(path: str, expression: str = WORD_END_PATTERN, lower: bool = True) -> Codec:
    """The worker's codec of a file, built once."""
    key = (path, expression, lower)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids binary, decoded string) of every document; row-local, no exchange."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in slices(batches):
            ids = [own.encode(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())],
                ["id", "ids", "decoded"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, ids binary, decoded string")


def token_digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Number of ids and digests of ids and decoded text per document.

    As ``encode_documents``, but ids and texts stay inside the task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                ids = own.encode(text)
                decoded = own.decode(ids).encode()
                rows.append(
                    (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                )
            counts, of_ids, of_text = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(counts, pa.int64()),
                    pa.array(of_ids, pa.string()),
                    pa.array(of_text, pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
