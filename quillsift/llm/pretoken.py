"""Splitting texts into the words a BPE tokenizer encodes, each word encoded once per worker.

Texts of common Latin letters are split by one compiled expression. A text holding any
other character goes through the tokenizer's own normalizer and splitter, so both ways
give the same words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from tokenizers import Tokenizer

#: Code points below this, without the ones excluded in PLAIN, take the short way.
LATIN_END = 0x180
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]")
CACHE_WORDS = 150_000
CACHE_WORD_CHARS = 48


def _members(kind: str) -> str:
    chars = (chr(p) for p in range(LATIN_END))
    return "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class WordSplitter:
    """Cuts a text into special tokens and words spelled in byte letters."""

    def __init__(self, tokenizer: Tokenizer, expression: str, lower: bool) -> None:
        letters, numbers = _members("L"), _members("N")
        self.words = re.compile(expression.format(L=letters, N=numbers)).findall
        self.lower = lower
        self.tokenizer = tokenizer
        self.special = {
            t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special
        }
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split
        self.mark = min(self.special, key=len)[:2] if self.special else "\0"

    def other_words(self, text: str) -> list[str]:
        """The words of any text, in byte letters, by the tokenizer's own components."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class WordCache(dict):
    """Word -> packed ids, encoded when first met; emptied when full, so memory is bounded."""

    def __init__(self, encode: Callable[[str], bytes], room: int = CACHE_WORDS) -> None:
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= self.room:
                self.clear()
            self[word] = ids
        return ids


class TextEncoder:
    """Whole texts -> ids as little-endian unsigned 32-bit integers, special tokens included.

    ``encode`` turns one word in byte letters into its packed ids.
    """

    def __init__(self, splitter: WordSplitter, encode: Callable[[str], bytes], room: int = CACHE_WORDS) -> None:
        spell = byte_letters()
        self.splitter = splitter
        self.latin = WordCache(lambda w: encode("".join([spell[b] for b in w.encode()])), room)
        self.other = WordCache(encode, room)

    def __call__(self, text: str) -> bytes:
        splitter = self.splitter
        if splitter.mark not in text:
            return self._plain(text)
        parts = splitter.cut(text)
        return b"".join(
            splitter.special[p].to_bytes(4, "little") if n % 2 else self._plain(p)
            for n, p in enumerate(parts)
        )

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        splitter = self.splitter
        if PLAIN.search(text) is None:
            words = splitter.words(text.lower() if splitter.lower else text)
            return b"".join(map(self.latin.__getitem__, words))
        return b"".join(map(self.other.__getitem__, splitter.other_words(text)))
