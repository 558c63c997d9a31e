"""Chunking under a tokenizer's own counts, as ``chunking.chunk_markdown`` is under the estimate.

Any batch counter decides what fits: a chunk's whole text, heading and fence included, must count
within the budget. Blocks come from the row-local segmentation; where a block is cut is found in
Arrow batches. The end of a group is guessed from the tokens per character of what was counted so
far and settled between a count that fits and one that does not, halving where guesses stall, so a
group mostly takes three or four counts of texts of its own size and never over some 2 log n. A group is the
longest that fits where a text never counts more than one it begins, as holds for whole words;
inside a word a count can fall as text grows, so there a piece fits but may not be the longest.

Prose is cut between paragraphs, else sentences, words, characters; code between definitions, else
lines, characters. A heading that takes the whole budget leaves chunks of one character over it.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable
from functools import cache, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import normalize_heading_path
from quillsift.operators.chunking import CODE_STARTS, FENCE, SENTENCE, blocks_of, exploded
from quillsift.params import ChunkBudget

# A counter maps texts to their numbers of tokens; it is sent to the executors.
TokenCounter = Callable[[list[str]], list[int]]
# The tokens that a text leaves of its limit, below 0 for one that does not fit.
Room = Callable[[str], int]

# The characters of Unicode white space, and the tokens kept for a part's number.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PART_SLACK = 10

BATCH_BYTES = 1 << 21
# Guesses for the end of a group before every other probe halves what is left.
GUESSES = 4
# Words whose counts a worker keeps, and the longest one kept.
CACHE_WORDS = 150_000
CACHE_WORD_CHARS = 48
RECENT_TEXTS = 512

_SENTENCES = re.compile(SENTENCE)
_WORDS = re.compile(rf"[^{SPACE}]+")
_EDGES = re.compile(rf"\A[{SPACE}]+|[{SPACE}]+\Z")
# The byte-level word pattern for letters up to U+017F, and what texts hold that go another way.
_L, _N = (
    "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"
)
_LATIN_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_UNCOMMON = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u017f]")
# White space that is not one space between words.
_LOOSE = re.compile(r" \s|\s ")
# Text between places where a single space follows a word and starts the next one.
_STRETCHES = re.compile(r"\s*\S+(?:(?! \S)\s+\S*)*|\s+")
_DEFINITIONS = re.compile(rf"\n(?=[^\S\n]*{CODE_STARTS})")
_PIECES = "array<struct<path:string,text:string,tokens:int>>"


class LibraryCounter:
    """Counts by a byte-level file of the tokenizers library, loaded once per worker.

    The strings of special tokens count as plain text. ``longest`` is how many characters one token
    covers at most, so a text longer than that times a limit is over it without being counted.
    Texts go to the library ``SLICE`` characters at a time, as its results take many times a text's size.
    Where the file's splitter starts a new word at a space between words, a text is counted word by
    word, each new word once per worker (bounded cache).
    """

    SLICE = 1 << 18

    def __init__(self, path: str) -> None:
        self.path = path

    def _load(self):
        if not hasattr(self, "_tokenizer"):
            self._tokenizer, self._longest, self._known = _loaded(self.path)
        return self._tokenizer

    @property
    def longest(self) -> int:
        self._load()
        return self._longest

    def __call__(self, texts: list[str]) -> list[int]:
        tokenizer = self._load()
        if self._known is not None:
            return list(map(self._by_words, texts))
        found = []
        for part in _slices(texts, self.SLICE):
            found += [len(e.ids) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return found

    def _by_words(self, text: str) -> int:
        known, behind_space = self._known
        if _LOOSE.search(text):
            return sum(map(known.__getitem__, _STRETCHES.findall(text)))
        first, *rest = text.split(" ")
        return known[first] + sum(map(behind_space.__getitem__, rest))

    def __getstate__(self) -> dict:
        return {"path": self.path}


@cache
def _loaded(path: str) -> tuple:
    """Tokenizer, characters of its longest token, and where words count one by one, counts of words
    by themselves and behind a space."""
    from tokenizers import Tokenizer

    # A task has one core; a pool of threads in every worker would only contend for it.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    longest = max(map(len, tokenizer.get_vocab(with_added_tokens=False)))
    if not _cuts_before_spaces(tokenizer):
        return tokenizer, longest, None
    words = _WordCounts(tokenizer)
    return tokenizer, longest, (_WordCounts(tokenizer, "", words), _WordCounts(tokenizer, " ", words))


class _WordCounts(dict):
    """Tokens of a text behind ``before``, counted when first met; emptied when full.

    With ``words``, a text of common Latin letters is cut into words by the byte-level pattern, so
    that only new words go to the library.
    """

    def __init__(self, tokenizer, before: str = "", words: _WordCounts | None = None) -> None:
        super().__init__()
        self.tokenizer, self.before, self.words = tokenizer, before, words

    def __missing__(self, word: str) -> int:
        text = self.before + word
        if self.words is not None and not _UNCOMMON.search(text):
            n = sum(map(self.words.__getitem__, _LATIN_WORDS.findall(text)))
        else:
            n = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def _cuts_before_spaces(tokenizer) -> bool:
    """Whether nothing but the byte-level word pattern looks at a text: one that takes a space with
    the word behind it and never crosses from a word into a space."""
    parts = json.loads(tokenizer.to_str())
    split = parts["pre_tokenizer"] or {}
    return (
        parts["normalizer"] is None
        and (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False)
        and all(t["special"] for t in parts["added_tokens"])
    )


def _slices(texts: list[str], size: int) -> Iterable[list[str]]:
    """Runs of texts that pass ``size`` characters by one text at most."""
    held, chars = [], 0
    for text in texts:
        held.append(text)
        chars += len(text)
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _counts(texts: list[str], count: TokenCounter, limit: int) -> list[int]:
    """Counts of texts; one that must be over ``limit`` by its length counts as just over it."""
    most = limit * getattr(count, "longest", 0)
    short = [not most or len(text) <= most for text in texts]
    counted = iter(count([t for t, ok in zip(texts, short, strict=True) if ok]))
    return [next(counted) if ok else limit + 1 for ok in short]


def _longest(start: int, stop: int, fits: Callable[[int], bool]) -> int:
    """The largest end in ``start + 1 .. stop`` that fits; ``start + 1`` where none does."""
    good, step = start + 1, 1
    while good < stop and fits(min(good + step, stop)):
        good = min(good + step, stop)
        step *= 2
    bad = min(good + step, stop + 1)
    while bad - good > 1:
        middle = (good + bad) // 2
        if fits(middle):
            good = middle
        else:
            bad = middle
    return good


def _by_characters(text: str, room: Room) -> list[str]:
    out, start = [], 0
    while start < len(text):
        end = _longest(start, len(text), lambda e: room(text[start:e]) >= 0)
        out.append(text[start:end])
        start = end
    return out


def _end_of_group(good: int, stop: int, ends: list[int], left: int, rate: float, room: Callable[[int], int]) -> tuple[int, int]:
    """The largest end in ``good .. stop`` with room, and its room; ``good`` leaves ``left``.

    ``ends`` holds where units end in characters, ``rate`` the tokens a character takes.
    """
    bad, over, probes = stop + 1, None, 0
    while bad - good > 1:
        probes += 1
        if probes > GUESSES and probes % 2 and bad <= stop:
            guess = (good + bad) // 2
        else:
            if over is not None:
                rate = (left - over) / max(1, ends[bad] - ends[good])
            guess = bisect_right(ends, ends[good] + left / rate, good, min(bad, stop + 1)) - 1
            guess = min(max(guess, good + 1), bad - 1)
        found = room(guess)
        if found >= 0:
            good, left = guess, found
        else:
            bad, over = guess, found
    return good, left


def _grouped(units: list[str], joiner: str, room: Room, split: Callable[[str], Iterable[str]]) -> list[str]:
    """Units joined as far as they fit; one that does not fit by itself is ``split``."""
    out, start, rate = [], 0, 0.3
    ends = list(accumulate((len(unit) + len(joiner) for unit in units), initial=0))
    while start < len(units):
        if not units[start]:
            start += 1
        elif (alone := room(units[start])) < 0:
            out.extend(split(units[start]))
            start += 1
        else:
            end, left = _end_of_group(
                start + 1, len(units), ends, alone, rate, lambda e: room(joiner.join(units[start:e]))
            )
            if left < alone:
                rate = (alone - left) / (ends[end] - ends[start + 1])
            out.append(joiner.join(units[start:end]))
            start = end
    return out


def paragraphs_of(body: str) -> list[str]:
    return [p for p in (_EDGES.sub("", part) for part in body.split("\n\n")) if p]


def prose_pieces(body: str, wanted: Room, room: Room) -> list[str]:
    """Paragraphs join while ``wanted`` (of the target) lasts; one that has ``room`` stays whole."""

    def words(sentence: str) -> list[str]:
        return _grouped(_WORDS.findall(sentence), " ", room, lambda w: _by_characters(w, room))

    def sentences(paragraph: str) -> list[str]:
        if room(paragraph) >= 0:
            return [paragraph]
        return _grouped([s for s in _SENTENCES.findall(paragraph) if _EDGES.sub("", s)], "", room, words)

    return _grouped(paragraphs_of(body), "\n\n", wanted, sentences)


def code_pieces(inner: str, room: Room) -> list[str]:
    """Definitions join while they fit; one that does not is cut between lines."""

    def lines(segment: str) -> list[str]:
        return _grouped(segment.split("\n"), "\n", room, lambda x: _by_characters(x, room))

    parts: list[str] = []
    for segment in _DEFINITIONS.split(inner):
        parts.extend([segment] if room(segment) >= 0 else lines(segment))
    return _grouped(parts, "\n", room, lambda part: [part])


def _fence_of(body: str) -> tuple[str, str, str]:
    """Opening line, inner text and closing mark of a fenced block."""
    lines = [x.removesuffix("\r") for x in body.removesuffix("\n").split("\n")]
    closed = len(lines) >= 2 and re.match(FENCE, lines[-1])
    run = re.match(r"(?:(.)\1*)?", lines[0].lstrip()).group(0)
    return lines[0], "\n".join(lines[1:-1] if closed else lines[1:]), run or "```"


def _prefix(path: str) -> str:
    return f"## {path}\n\n" if path else ""


def block_pieces(path: str, kind: str, body: str, whole: int, count: TokenCounter, budget: ChunkBudget) -> list[tuple]:
    """``(path, text, tokens)`` of a block's chunks; ``whole`` is the count of the block uncut."""
    prefix = _prefix(path)

    def counted(before: str, after: str = "") -> Callable[[str], int]:
        # Of the last texts, as the end of one step is counted again in the next.
        return lru_cache(RECENT_TEXTS)(lambda text: _counts([f"{before}{text}{after}"], count, budget.max_tokens)[0])

    def within(limit: int, tokens: Callable[[str], int]) -> Room:
        return lambda text: limit - tokens(text)

    if kind == "Info":
        if whole <= budget.target_tokens:
            return [(path, prefix + "\n\n".join(paragraphs_of(body)), whole)]
        tokens = counted(prefix)
        pieces = prose_pieces(body, within(budget.target_tokens, tokens), within(budget.max_tokens, tokens))
        return [(path, prefix + piece, tokens(piece)) for piece in pieces]
    elif whole <= budget.max_tokens:
        return [(path, prefix + body, whole)]
    else:
        head, inner, fence = _fence_of(body)
        after = f"\n{fence}\n"
        room = within(budget.max_tokens - PART_SLACK, counted(f"{_prefix(path or '-')}{head}\n", after))
        texts = []
        for n, piece in enumerate(code_pieces(inner, room), 1):
            own = f"{path} (part {n})".lstrip()
            texts.append((own, f"{_prefix(own)}{head}\n{piece}{after}"))
    return [(p, text, n) for (p, text), n in zip(texts, count([t for _, t in texts]), strict=True)]


def chunk_markdown_by(
    documents: DataFrame, count: TokenCounter, key: str = "doc_key", budget: ChunkBudget = ChunkBudget()
) -> DataFrame:
    """Chunks ``(key, block_no, part_no, heading_path, chunk_type, text, tokens)`` under ``count``.

    No exchange, and blocks are counted in batches; only those over their limit are counted again.
    """

    result = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("tokens", pa.int32())]))

    def pieces(paths: pa.Array, kinds: pa.Array, bodies: pa.Array) -> pa.Array:
        out, start = [pa.array([], result)], 0
        # Python strings of a stretch of rows at a time, whatever the batch holds.
        sizes = np.cumsum(pc.fill_null(pc.binary_length(bodies), 0).to_numpy(zero_copy_only=False))
        while start < len(bodies):
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, "right")))
            columns = (c.slice(start, stop - start).to_pylist() for c in (paths, kinds, bodies))
            rows = list(zip(*columns, strict=True))
            uncut = [
                _prefix(path) + ("\n\n".join(paragraphs_of(body)) if kind == "Info" else body)
                for path, kind, body in rows
            ]
            found = [
                [{"path": p, "text": t, "tokens": n} for p, t, n in block_pieces(*row, whole, count, budget)]
                for row, whole in zip(rows, _counts(uncut, count, budget.max_tokens), strict=True)
            ]
            out.append(pa.array(found, result))
            start = stop
        return pa.concat_arrays(out)

    cut = F.arrow_udf(pieces, _PIECES)(normalize_heading_path(F.col("path")), "kind", "body")
    blocks = blocks_of(documents, key).select(key, "block_no", "kind", cut.alias("pieces"))
    return exploded(blocks, "pieces", "part_no", "p").select(
        key, "block_no", "part_no",
        F.col("p.path").alias("heading_path"), F.col("kind").alias("chunk_type"), "p.text", "p.tokens",
    )
