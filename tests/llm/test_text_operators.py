"""Operators on single texts against the tokenizers library, brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillsift.llm import attention, bpe, chat_format, exact_dedup, html_extract, language_id, lm_score, packing, quality
from quillsift.llm.word_hash import words_of

ODD = [
    "", " ", "\n\t", "It's DON'T we'll", "<|endoftext|>a<|startoftext|>", "ß Straße İstanbul ΣΑΣ ſ",
    "naïve café ½ x² ١٢", "日本語 mixed 文", "🙂🙂 ok", "a" * 3000, "x y z", "​﻿!",
    "  two   blanks  ", "ends with blank ", "a\r\nb\x0bc", "A-B_c--d!!! 12345",
]


def random_texts(count: int) -> list[str]:
    rng = random.Random(5)
    pool = "abcdefgh '.,!?<|>\n\tÄéñ123" + "ωЖ日🙂́"
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(count)]


def docs_of(spark, rows):
    """Documents with a clashing extra column."""
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, digest int")


@pytest.mark.parametrize(("file", "make"), [("word_bpe_49k.json", lambda p: bpe.Codec(p).encode), ("byte_bpe_50k.json", packing.byte_level_encoder)])
def test_ids_are_the_librarys(file, make):
    path = public_tokenizers.path(file)
    library, own = Tokenizer.from_file(path), make(path)
    for text in [*ODD, *random_texts(300)]:
        ids = np.frombuffer(own(text), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_decoding_is_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    for text in ODD:
        ids = own.encode(text)
        assert own.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_token_digests_handle_nulls_and_repeats(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.token_digests(docs_of(spark, [(1, None), (None, "a b"), (2, "a b"), (2, "a b")]), path).collect()
    assert len(rows) == 4
    empty = next(r for r in rows if r["id"] == 1)
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.token_digests(docs_of(spark, []), path).count() == 0


def brute_dedup(rows):
    import re

    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_compares_whole_texts(spark, weak):
    from pyspark.sql import functions as F

    rows = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, "a c"), (5, "a c"), (None, "a b"), (None, "lonely"), (9, "x" * 50000)]
    rows += [(100 + n, "hot") for n in range(300)]
    digest = (lambda c: F.length(c).cast("string").cast("binary")) if weak else exact_dedup.sha256_of
    found = exact_dedup.dedup_groups(docs_of(spark, rows), digest=digest).collect()
    groups = brute_dedup(rows)
    expected = sorted(
        (str(i), str(min((x for x in ids if x is not None), default=None)), len(ids)) for ids in groups.values() for i in ids
    )
    assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"]) for r in found) == expected
    assert sum(r["kept"] for r in found) == len(groups)


def test_deduplicated_keeps_one_row_of_each_text(spark):
    rows = [(1, "a b"), (2, "a  b"), (5, "c"), (5, "c"), (None, None), (7, "")]
    kept = exact_dedup.deduplicated(docs_of(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("1", "a b"), ("5", "c"), ("7", "")]


def test_packing_places_every_id_once(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    rows = [(n, " ".join(rng.choice(["the", "of", "word"]) for _ in range(rng.randrange(3000)))) for n in range(60)]
    rows += [(None, None), (3, "again")]
    pieces = packing.pack_documents(docs_of(spark, rows), path).collect()
    library = Tokenizer.from_file(path)
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(p["length"] for p in pieces) == total
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["context"]))
    for held in sequences.values():
        at = 0
        for offset, length, _ in sorted(held):
            assert offset == at
            at += length
        assert at <= held[0][2] <= 2048
    first = next(p for p in pieces if p["id"] == 5 and p["start"] == 0)
    ids = np.array([*library.encode(rows[5][1], add_special_tokens=False).ids, 1], dtype="<u4")
    assert first["ids_crc32"] == zlib.crc32(ids[: first["length"]].tobytes())
    assert packing.pack_documents(docs_of(spark, []), path).count() == 0


def test_step_groups_are_balanced_over_tasks(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(5)
    rows = [(n, " ".join(rng.choice(["the", "of", "word"]) for _ in range(rng.choice([40, 300, 5000])))) for n in range(90)]
    docs = docs_of(spark, rows).repartition(3)
    pieces = packing.pack_documents(docs, path)
    found = packing.balanced_steps(pieces, step_tokens=4 * 2048).collect()
    assert len(found) == pieces.count()
    windows = {p["sequence_id"]: (p["context"], p["step_group"]) for p in found}
    assert len({s >> packing.TASK_SHIFT for s in windows}) == 3
    tiers = {}
    for context, group in windows.values():
        tiers.setdefault(context, []).append(group)
    numbered = []
    for context in sorted(tiers, reverse=True):
        sizes = [tiers[context].count(g) for g in sorted(set(tiers[context]))]
        most = 4 * 2048 // context
        assert max(sizes) - min(sizes) <= 1 and max(sizes) <= most
        assert len(sizes) == -(-len(tiers[context]) // most)
        numbered += sorted(set(tiers[context]))
    assert numbered == list(range(len(numbered)))
    assert packing.balanced_steps(packing.pack_documents(docs_of(spark, []), path)).count() == 0


@pytest.mark.parametrize("text", ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "plain", "", "<", "a<|b\\|"])
def test_chat_escape_round_trip(text):
    piece, begin, end = chat_format.render("assistant", text)
    assert chat_format.read_turns(piece) == [("assistant", text)]
    assert chat_format.unescape(piece[begin:end]) == text


def test_chat_folds_deltas_edits_and_regenerations():
    events = [
        (1, 0, "message", "user", "hi"), (1, 1, "delta", "assistant", "he"), (1, 1, "delta", "", "llo"),
        (1, 1, "edit", "", "edited"), (1, 1, "regenerate", "", "gone"), (1, 1, "delta", "", "new"),
        (2, 0, "delta", "odd\nrole\\", ""),
    ]
    assert list(chat_format.fold(events)) == [(1, "user", "hi"), (1, "assistant", "new"), (2, "odd\nrole\\", "")]
    assert chat_format.read_turns(chat_format.render("odd\nrole\\", "")[0]) == [("odd\nrole\\", "")]


def test_chat_handles_nulls(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (3, 0, "user", None), (3, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.turn_events(turns)).collect()}
    assert found[None]["n_turns"] == 2 and found[None]["loss_chars"] == 1 and found[3]["n_turns"] == 2
    assert found[None]["loss_sha256"] == hashlib.sha256(b"x").hexdigest()


PAGES = {
    "marked": (
        "<html><head><title>T</title></head><body><nav>menu</nav><header><p>Top</p></header><div id='cookie-notice'>ok?</div>"
        "<article><h1>Head &amp; line</h1><p>First <b>bold</b>\n text.<p>Second&nbsp;one<script>x<1</script>"
        "<form>name<input></form><aside>side</aside><div class=\"ad\">buy</div><p>Third</p>"
        "<section class='comments'><p>reader says</p></section></article><footer>end</footer></body></html>",
        "Head & line\nFirst bold text.\nSecond one\nThird",
    ),
    "plain": (
        "<body><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div><p>Long text that goes on for a while here.</p>"
        "<p>And more of it.</p></div></body>",
        "Long text that goes on for a while here.\nAnd more of it.",
    ),
    "empty": ("", ""),
    "tags only": ("<div><br></div>", ""),
    "unclosed": ("<article><p>text<!-- open", "text"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, text = PAGES[name]
    assert html_extract.main_text(page, html_extract.weights_of({})) == text


def test_extract_handles_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<article>x</article>")], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert found == {1: "", None: "x"}


def test_language_of_odd_texts(spark):
    rows = [(n, "the cat and the hat", "en") for n in range(1, 9)] + [(n, "der hund und das haus", "de") for n in range(9, 17)]
    rows += [(20, None, "en"), (21, "123 !", "de"), (22, "", None), (None, "und das", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["id"]: r for r in language_id.predict(docs).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (20, 21, 22))
    assert found[3]["lang_pred"] == "en" and found[None]["lang_pred"] == "de" and not found[None]["held_out"]
    assert {r["doc_id"] for r in language_id.accepted(docs).collect()} == {*range(1, 17), None}


def test_quality_scores_every_text(spark):
    good, bad = "a calm line of words", "WORD!! LOUD!! NOISE!!"
    rows = [(n, good if n % 2 else bad) for n in range(1, 60)] + [(100, None), (None, good), (7, good)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(1, 60)] + [(61, None)], "doc_id long, quality int")
    found = quality.score_documents(docs_of(spark, rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all((r["score"] > 0.5) == bool(r["id"] % 2) for r in found if r["id"] and r["id"] < 60)
    none = labels.where("quality > 5")
    assert {r["score"] for r in quality.score_documents(docs_of(spark, rows), none).collect()} == {0.5}


def test_words_are_those_of_a_plain_split():
    texts = ["", " a  B\tc ", "x", "\n", "Ä b", "b"]
    words = words_of(pa.array(texts))
    assert words.counts().tolist() == [len(t.encode().split()) for t in texts]
    assert words.hashes[-1] == words.hashes[1] == words.hashes[-2]


def test_windows_score_each_place_once_and_causally():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 15, 16, 17, 70, 3])
    targets = rng.integers(0, attention.CLASSES, lengths.sum()).astype(np.uint8)
    model = attention.Weights.fresh(np.log(np.full((attention.CONTEXTS, attention.CLASSES), 1 / attention.CLASSES)))
    inputs = attention.shifted(targets, lengths)
    whole, _ = attention.log_probabilities(model, inputs, targets, lengths, 3, batch=2)
    assert (whole < 0).all()
    changed = targets.copy()
    changed[-4] ^= 1  # the last place of the long document
    other, _ = attention.log_probabilities(model, attention.shifted(changed, lengths), changed, lengths, 3)
    assert np.allclose(np.delete(whole, len(whole) - 4), np.delete(other, len(whole) - 4), atol=1e-5)


def test_base_score_is_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(8)
    words = ["the", "of", "Thing", "rare%d"]
    rows = [(n, " ".join(rng.choice(words).replace("%d", str(rng.randrange(40))) for _ in range(rng.randrange(30)))) for n in range(50)]
    rows += [(50, None), (None, "the of"), (3, rows[3][1])]
    found = lm_score.score_documents(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    split = [(t or "").lower().split() + [None] for _, t in rows]
    counts = Counter(w for ws, (i, _), h in zip(split, rows, out, strict=True) if i is not None and not h for w in ws)
    total = sum(counts.values()) + len(counts) + 1
    expected = sorted((str(i), len(ws), sum(w in counts for w in ws), round(sum(math.log10((counts[w] + 1) / total) for w in ws), 6)) for (i, _), ws in zip(rows, split, strict=True))
    assert sorted((str(r["id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found) == expected
    assert all(r["score"] < 0 for r in found)


def test_texts_of_unlearned_languages_go(spark):
    rng = random.Random(4)

    def text(letters, words):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(words))

    syllables = {"en": ["th", "er", "ing", "and", "ou", "re", "st"], "de": ["sch", "ein", "ich", "ung", "au", "be"]}
    rows = [(n, text(syllables[lang], 40), lang) for n, lang in enumerate(["en", "de"] * 60)]
    short = [(200, "andre", None), (201, "einung", None), (202, "there", "en")]
    scripts = [[chr(c) for c in range(*r)] for r in ((0x430, 0x450), (0x3B1, 0x3C9), (0x4E00, 0x5000), (0x627, 0x64A))]
    foreign = [(1000 + n, text(scripts[n % 4], 20 + n), None) for n in range(160)]
    docs = spark.createDataFrame(rows + short + foreign, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language_id.accepted(docs).collect()}
    assert kept == {i for i, _, _ in rows + short}


def test_lm_learns_from_every_row(spark):
    """Ids are ranked and windows trained over all rows, however many."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = lm_score.subwords(path)
    rows = [(n, "the of and") for n in range(700)] + [(700 + n, "zebra quartz " * 20) for n in range(60)]
    packed = lm_score.packed_ids(docs_of(spark, rows).repartition(3), path)
    vocabulary, windows = lm_score.corpus_vocabulary(packed, own.begin)
    ids, lengths = own.ids([t for _, t in rows])
    assert windows == len(attention.windows(lengths)[0])
    counts = np.bincount(ids, minlength=own.size)
    assert (vocabulary.detail == lm_score.vocabulary_of(counts, own.begin).detail).all()
    fitted, seen = [], []
    for number in range(lm_score.ROUNDS):
        bigram = np.zeros((attention.CONTEXTS, attention.CLASSES), np.float32)
        start = attention.Weights.fresh(bigram).pack()
        shared = spark.sparkContext.broadcast((vocabulary, bigram))
        found = lm_score._partial_fits(packed, shared, start, number, 1).collect()
        fitted.append(len(found))
        seen.append(sum(r["n"] for r in found))
    assert sum(seen) == windows and max(fitted) == 3


def test_texts_are_encoded_once(spark, monkeypatch):
    """One table of ids serves learning and scoring, whoever is learned from."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tables = []
    made = lm_score.packed_ids
    monkeypatch.setattr(lm_score, "packed_ids", lambda *a: tables.append(made(*a)) or tables[-1])
    rows = [(n, f"word{n % 7} and Others {n}") for n in range(60)] + [(60, None), (None, "no id")]
    assert lm_score.score_documents(docs_of(spark, rows).repartition(3), path).count() == len(rows)
    (table,) = tables
    own, held = lm_score.subwords(path), []
    for r in table.collect():
        ids, lengths = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["lengths"], np.int64)
        assert all((i is not None and not h) == r["learnable"] for i, h in zip(r["id"], r["held_out"], strict=True))
        ends = np.cumsum(lengths)
        held += [(str(i), ids[e - n : e].tolist()) for i, e, n in zip(r["id"], ends, lengths, strict=True)]
    assert sorted(held) == sorted((str(i), own.ids([t or ""])[0].tolist()) for i, t in rows)


def test_word_keys_tell_words_apart():
    own = lm_score.subwords(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["the The THE thee", "", "a" * 900 + " zq zqx\tqz 日本語 <|endoftext|>", " \n"]
    ids, lengths = own.ids(texts)
    starts, keys = lm_score.word_keys(ids, own.begin)
    words = [w for t in texts for w in [*t.lower().split(), None]]
    assert len(keys) == len(words) == len(starts)
    assert len(set(keys.tolist())) == len(set(words))
    assert all((k == lm_score.END_WORD) == (w is None) for k, w in zip(keys.tolist(), words, strict=True))
    assert len({(k, w) for k, w in zip(keys.tolist(), words, strict=True)}) == len(set(words))
    none, empty = lm_score.word_keys(ids[:0], own.begin)
    assert len(none) == len(empty) == 0


def test_first_scored_place_has_sixteen_of_context():
    rng = np.random.default_rng(3)
    lengths = np.array([80])
    inputs = rng.integers(0, attention.CONTEXTS, 80).astype(np.uint8)
    targets = rng.integers(0, attention.CLASSES, 80).astype(np.uint8)
    model = attention.Weights.fresh(np.zeros((attention.CONTEXTS, attention.CLASSES)))
    whole, _ = attention.log_probabilities(model, inputs, targets, lengths, 3)
    for back, seen in ((16, True), (17, False)):
        changed = inputs.copy()
        changed[32 - back] ^= 1  # 32 is the first place of a window
        other, _ = attention.log_probabilities(model, changed, targets, lengths, 3)
        assert (whole[32] != other[32]) == seen


LAYOUTS = {
    "words in names": (
        "<article class='post'><h2 id='related-work'>Related work</h2><p class='notice'>Seen here.</p>"
        "<h2 id='search'>Search</h2><section id='form-of-government'><p>A <span class='hidden-gem'>gem</span> of law.</p></section>"
        "<div class='share-holders'><p>They own it.</p></div><div class='big share'>tweet</div><section id='alert'><p>Last.</p></section></article>",
        "Related work\nSeen here.\nSearch\nA gem of law.\nThey own it.\nLast.",
    ),
    "teaser cards": (
        "<body><div class='story'><p>" + "The long text of the page goes on. " * 9 + "</p><h2 id='search'>Why search</h2><p>"
        + "More of the long text. " * 9 + "</p></div><article><a href=1>Teaser one</a></article><article><a href=2>Teaser two</a></article></body>",
        ("The long text of the page goes on. " * 9).strip() + "\nWhy search\n" + ("More of the long text. " * 9).strip(),
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_of_other_layouts(name):
    page, text = LAYOUTS[name]
    assert html_extract.main_text(page, html_extract.weights_of({})) == text


def test_language_vectors_take_a_byte_each():
    vectors = language_id.GramVectors()
    assert vectors.table.nbytes <= 16 << 20
    rng = np.random.default_rng(3)
    codes, counts = language_id.trigrams("".join(map(chr, rng.integers(0x61, 0x250, 6000))))
    assert len(codes) > 2 * language_id.BUNDLED
    other = language_id.GramVectors()
    expected = sum(n * other.bound(c).astype(np.int64) for c, n in zip(codes.tolist(), counts.tolist(), strict=True))
    assert np.array_equal(vectors.bundle(codes, counts), expected)


def test_new_words_are_encoded_together_as_the_library_does(monkeypatch):
    own = lm_score.Subwords(public_tokenizers.path("byte_bpe_50k.json"))
    words = sorted({w for t in [*ODD, *random_texts(300)] for w in t.encode().split() if len(w) <= 48} | {b"a" * 48, b"\xff"})
    assert own.merges([b" " + w for w in words]) == [own.__missing__(w) for w in words]
    assert own.merges([]) == []

    made, merges = [], own.merges
    own.merges = lambda new: made.append(new) or merges(new)
    monkeypatch.setattr(lm_score, "CACHE_WORDS", 3)
    for n in range(8):  # the words held are renewed all the time; those that come again stay
        ids, lengths = own.ids([f"often again n{n} m{n}", "", "x" * 300])
        plain = [b"".join(map(own.__missing__, t.encode().split())) + own.end for t in (f"often again n{n} m{n}", "", "x" * 300)]
        assert ids.tobytes() == b"".join(plain) and lengths.tolist() == [len(p) // 2 for p in plain]
    assert sum(words.count(b" often") for words in made) == 1


def test_attention_gradients_are_differences():
    rng = np.random.default_rng(4)
    lengths = np.array([5, 70, 1, 33])
    inputs, targets = rng.integers(0, 256, 109).astype(np.uint8), rng.integers(0, 64, 109).astype(np.uint8)
    first, begin, end = attention.windows(lengths)
    for size in (1, 400):  # 400: beyond the scores that go without a maximum
        model = attention.Weights.fresh(rng.normal(0, 1, (256, 64)))
        model.query, model.distance = model.query * np.float32(size), rng.normal(0, 1, 32).astype(np.float32)
        assert (model.reach > attention._SAFE) == (size == 400)

        def loss():
            done = attention.Pass(model, inputs, targets, first, begin, end)
            return -float(done.log_probability[done.scored].astype(np.float64).mean())

        found = attention.Pass(model, inputs, targets, first, begin, end).gradients(model)
        for name in attention.Weights.TRAINED:
            along = found[name] / np.linalg.norm(found[name])
            before, step = getattr(model, name), np.float32(0.02)
            setattr(model, name, before + step * along)
            more = loss()
            setattr(model, name, before - step * along)
            slope = (more - loss()) / (2 * float(step))
            setattr(model, name, before)
            if size == 1 or name not in ("query", "key"):  # such scores are too steep for a difference
                assert slope == pytest.approx(float(np.linalg.norm(found[name])), rel=0.05, abs=2e-5), name
            assert np.isfinite(found[name]).all()
