"""Token alignment against a plain version on Python lists."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quillsift.llm import alignment
from quillsift.llm.pretoken import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", "Hello world", "Hello  world\n\n", "naïve café — ¿qué? 東京 😀", "a▁b", "tab\there\r\n", "x y",
    "<|endoftext|> and <s> </s> <unk> <0x0A>", "ﬁne ½ ① Å é", "​ zero\0byte", "1234567890 3.14", "the the the the", "the",
    " leading and trailing ", "def f(x):\n    return x+1\n" * 40, "ab" * 3000, "word " * 4000, "Hello world",
]


def brute(texts):
    letters = {letter: byte for byte, letter in enumerate(byte_letters())}
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=B)
    rows, pairs = [], Counter()
    for text in texts:
        ids_a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = second.encode(text) if text else []
        spelled_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in ids_a]
        spelled_b = []
        for i in ids_b:
            piece = second.id_to_piece(i)
            spelled_b.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
        if not text or any(b"".join(s) != (" " + text).encode() for s in (spelled_a, spelled_b)):
            rows.append((0, 0, [], ""))
            continue
        ends = []
        for spelled in (spelled_a, spelled_b):
            at, own = 0, []
            for token in spelled:
                at += len(token)
                own.append(at)
            ends.append(own)
        both = set(ends[0]) & set(ends[1])
        at_a, at_b = (dict(zip(own, ids, strict=True)) for own, ids in zip(ends, (ids_a, ids_b), strict=True))
        links = [(at_a[e], at_b[e]) for e in sorted(both)]
        groups = zip(grouped(ids_a, ends[0], both), grouped(ids_b, ends[1], both), strict=True)
        pairs.update(links)
        rows.append((len(ids_a), len(ids_b), links, hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()))
    highest = {}
    for (_, b), k in pairs.items():
        highest[b] = max(k, highest.get(b, 0))
    return [
        (a, b, len(links), len(links), sum(pairs[p] == highest[p[1]] for p in links), sum(pairs[p] for p in links), digest)
        for a, b, links, digest in rows
    ]


def grouped(ids, ends, both):
    held = []
    for i, e in zip(ids, ends, strict=True):
        held.append(str(i))
        if e in both:
            yield ",".join(held)
            held = []


@pytest.mark.parametrize("shared", [alignment.SHARED_PAIRS, 0])
def test_alignment_is_brute_force(spark, shared):
    rows = [(n, t, 1, b"x", 2) for n, t in enumerate(TEXTS)] + [(None, "the end", 1, b"x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, links binary, id int").repartition(3)
    found = alignment.align(docs, A, B, shared_pairs=shared).collect()
    got = {r["id"]: tuple(r)[1:] for r in found}
    expected = brute([t for _, t, *_ in rows])
    assert len(found) == len(rows)
    for (key, text, *_), line in zip(rows, expected, strict=True):
        assert got[key] == line, (key, text and text[:50])


def test_alignment_hands_counts_on_early(spark):
    rows = [(n, f"some words {n} the {n * 7}", n) for n in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").coalesce(1)
    found = sorted(tuple(r)[1:] for r in alignment.align(docs, A, B, held_pairs=3).collect())
    assert found == sorted(brute([t for _, t, _ in rows]))


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B).count() == 0
