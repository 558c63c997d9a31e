"""Shingle sets of whole texts as sorted arrays of 64-bit hashes, and their digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillsift.llm.word_hash import chained, mix, words_of


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct ``size``-word shingles of each text, as sorted unsigned hashes.

    A text of fewer words has one shingle, the whole of it; one without words has none.
    """
    words = words_of(texts)
    runs = chained(words.hashes, size)
    bounds = words.bounds.tolist()
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        count = end - begin
        if count >= size:
            yield np.unique(runs[begin : end - size + 1])
        elif count:
            yield chained(words.hashes[begin:end], count)
        else:
            yield runs[:0]


def set_digest(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes; 0 for the empty set."""
    if not len(hashes):
        return 0
    first = np.sum(mix(hashes), dtype=np.uint64)
    second = np.sum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    both = mix(np.array([first, second, np.uint64(len(hashes))], dtype=np.uint64))
    value = int(mix(both[:1] ^ (both[1:2] * np.uint64(3)) ^ (both[2:] * np.uint64(5)))[0])
    return value - (1 << 64) if value >= 1 << 63 else value


def group_counts(hashes: np.ndarray, groups: int) -> np.ndarray:
    """How many shingles fall into each of ``groups`` (a power of two) hash groups."""
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def groups_for(size: int, least: int = 32, most: int = 8192) -> int:
    """Number of groups of a set of ``size``: about two to four shingles in each."""
    return max(least, min(most, 1 << max(0, (size // 2).bit_length() - 1)))


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts with the bytes of each in front: one, or two if any needs them."""
    kind = "<u1" if counts.max(initial=0) < 256 else "<u2"
    return bytes([int(kind[-1])]) + counts.astype(kind).tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1).astype(np.int32)
