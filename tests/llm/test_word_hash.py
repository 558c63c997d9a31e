"""Word hashes: patterns that collide under sums of powers, and what a word is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from quillsift.llm import lm_score, ngram_join
from quillsift.llm.word_hash import words_of


def thue_morse(length):
    return "".join("ab"[bin(n).count("1") % 2] for n in range(length))


def complement(word):
    return word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("length", [1024, 2048, 8192])
def test_patterned_words_differ(length):
    word = thue_morse(length)
    hashes = words_of(pa.array([word, complement(word), word.upper(), f"x {word}"])).hashes
    assert hashes[0] != hashes[1]
    assert hashes[0] == hashes[2] == hashes[4]


def test_words_are_equal_where_their_texts_are():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abAB é\t.\n"), rng.integers(1, 12))) for _ in range(3000)]
    found = words_of(pa.array(words))
    spelled = [w.encode().lower() for t in words for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
    lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in spelled]
    by_hash = dict(zip(found.hashes.tolist(), lower, strict=True))
    assert all(by_hash[h] == w for h, w in zip(found.hashes.tolist(), lower, strict=True))
    assert len(by_hash) == len(set(lower))
    assert found.counts().sum() == len(lower)


def test_patterned_words_do_not_link(spark):
    word = thue_morse(1024)
    rows = [(1, word), (2, complement(word)), (3, word)]
    found = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 1}


def test_patterned_words_are_counted_apart(spark):
    import public_tokenizers

    word = thue_morse(1024)
    rows = [(n, "some words to learn from here") for n in range(40)]
    rows += [(n, word if n % 2 else complement(word)) for n in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm_score.score_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    learned = [r["id"] for r in found if not r["held_out"]]
    known = {text for key, text in rows if key in learned}
    for row in found:
        text = dict(rows)[row["id"]]
        if row["id"] >= 100:
            assert row["n_known"] == 1 + (text in known)
