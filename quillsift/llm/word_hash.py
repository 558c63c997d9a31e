"""Hashes of all words of an Arrow batch at once, straight from its UTF-8 buffer.

A word is a run of bytes other than the six white-space characters; A-Z count as a-z. Its hash
sums its bytes, each times a random 64-bit coefficient of its place in the word, modulo 2**64, and
goes through a mixer. Coefficients of different places have nothing to do with each other, so
two words collide with a chance of about 2**-56 whatever pattern they have; a sum of powers of one
base has no such bound modulo 2**64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quillsift.llm.arrow_text import string_bytes

_SEED = 60413
_GOLDEN = 0x9E3779B97F4A7C15
#: Coefficients kept; those of places further on are made when needed.
_KEPT = 4096
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_VALUE_OF = LOWER.astype(np.uint64) + np.uint64(1)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def coefficients(places: np.ndarray) -> np.ndarray:
    """Random factors of places in a word, the same on every machine."""
    return mix(places.astype(np.uint64) * np.uint64(_GOLDEN) + np.uint64(_SEED))


_COEFFICIENTS = coefficients(np.arange(_KEPT))


@dataclass
class Words:
    """Words of some texts: hash, first byte and end in ``data``; text n has words bounds[n]:bounds[n+1]."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def words_of(texts: pa.Array) -> Words:
    """All words of an Arrow string array without nulls."""
    data, offsets = string_bytes(texts)
    size = len(data)
    if size == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none.astype(np.uint64), none, none, np.zeros(len(texts) + 1, dtype=np.int64))
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < size]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    lengths = ends - starts
    at = np.arange(size, dtype=np.int64)
    places = at - np.maximum.accumulate(np.where(begins, at, 0))
    # Bytes between words have any place; no sum takes them.
    if lengths.max(initial=0) <= _KEPT:
        factors = _COEFFICIENTS[np.minimum(places, _KEPT - 1)]
    else:
        factors = coefficients(places)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_VALUE_OF[data] * factors, out=sums[1:])
    hashes = mix(sums[ends] - sums[starts] + lengths.astype(np.uint64) * np.uint64(_GOLDEN))
    return Words(data, hashes, starts, ends, np.searchsorted(starts, offsets))


def chained(hashes: np.ndarray, count: int) -> np.ndarray:
    """Hash of every run of ``count`` neighbouring hashes, in order."""
    total = len(hashes) - count + 1
    if total <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = np.zeros(total, dtype=np.uint64)
    for step in range(count):
        value = value * np.uint64(0xD1342543DE82EF95) + hashes[step : step + total]
    return mix(value + np.uint64(count))
