from __future__ import annotations

import random
import re
import time

import public_tokenizers
import pytest

from brute_chunks import blocks, clean_path
from quillsift.operators import token_chunks
from quillsift.params import ChunkBudget
from test_chunking import made_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def linear(units, joiner, fits, split):
    out, held = [], None
    for unit in units:
        joined = unit if held is None else held + joiner + unit
        if held is not None and fits(joined):
            held = joined
            continue
        if held is not None:
            out.append(held)
            held = None
        if not unit:
            continue
        if fits(unit):
            held = unit
        else:
            out += split(unit)
    return out + ([held] if held is not None else [])


def chars(text, fits):
    out = [""]
    for c in text:
        if out[-1] and not fits(out[-1] + c):
            out.append("")
        out[-1] += c
    return out


def brute(markdown, count, most, target):
    one = lambda text: count([text])[0]
    for path, kind, body in blocks(markdown):
        path = clean_path(path)
        prefix = f"## {path}\n\n" if path else ""
        if kind == "Info":
            fits = lambda t: one(prefix + t) <= most
            words = lambda s: linear(s.split(), " ", fits, lambda w: chars(w, fits))
            sentences = lambda p: [p] if fits(p) else linear(
                [s for s in re.findall(r"[^.!?]*[.!?][ \t\n]*|[^.!?]+", p) if s.strip()], "", fits, words)
            paragraphs = [p.strip() for p in body.split("\n\n") if p.strip()]
            for piece in linear(paragraphs, "\n\n", lambda t: one(prefix + t) <= target, sentences):
                yield path, kind, prefix + piece
        elif one(prefix + body) <= most:
            yield path, kind, prefix + body
        else:
            head, *rest = [x.removesuffix("\r") for x in body.removesuffix("\n").split("\n")]
            if rest and rest[-1].lstrip().startswith(("```", "~~~")):
                rest.pop()
            fence = re.match(r"(.)\1*", head.lstrip()).group(0)
            before, after = f"{prefix or '## -' + chr(10) * 2}{head}\n", f"\n{fence}\n"
            fits = lambda t: one(before + t + after) <= most - 10
            parts, segment = [], None
            for line in [*rest, None]:
                starts = line is not None and line.lstrip().startswith(("fn ", "def ", "function ", "class "))
                if segment is not None and (line is None or starts):
                    text = "\n".join(segment)
                    parts += [text] if fits(text) else linear(segment, "\n", fits, lambda x: chars(x, fits))
                    segment = None
                if line is not None:
                    segment = (segment or []) + [line]
            for n, piece in enumerate(linear(parts, "\n", fits, lambda x: [x]), 1):
                own = f"{path} (part {n})".strip()
                yield own, kind, f"## {own}\n\n{head}\n{piece}{after}"


def chunks_of(spark, docs, count, most, target):
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_key int, markdown string")
    found = token_chunks.chunk_markdown_by(frame, count, budget=ChunkBudget(most, target))
    got = {}
    for r in found.orderBy("doc_key", "block_no", "part_no").collect():
        assert r.tokens == count([r.text])[0]
        got.setdefault(r.doc_key, []).append((r.heading_path, r.chunk_type, r.text))
    return got


# At 200 tokens no line is cut inside a word, where a byte-level count can fall as text grows.
@pytest.mark.parametrize(("name", "most", "target"), [("length", 60, 40), ("length", 512, 384), ("bpe", 200, 120), ("bpe", 512, 384)])
def test_chunks_match_brute_force(spark, name, most, target):
    # A local function travels by value; workers cannot import this module.
    count = (lambda texts: [-(-len(t) // 3) for t in texts]) if name == "length" else token_chunks.LibraryCounter(PATH)
    docs = made_documents(seed=23, n=60) + [None]
    got = chunks_of(spark, docs, count, most, target)
    for i, doc in enumerate(docs):
        assert got.get(i, []) == list(brute(doc or "", count, most, target)), doc


def test_no_chunk_is_over_the_limit_and_long_texts_take_linear_time(spark):
    count = token_chunks.LibraryCounter(PATH)
    start = "word and other words, without an end " * 2000
    docs = ["# H\n\n" + start, "```py\n" + "x" * 60_000 + "\n" + "a = b\n" * 9000 + "```\n", "# T\n\n" + "<|endoftext|>" * 900]
    got = chunks_of(spark, docs, count, 512, 384)
    assert all(count([t])[0] <= 512 for rows in got.values() for _, _, t in rows)
    assert "".join(t.removeprefix("## H\n\n") + " " for _, _, t in got[0]) == start
    inner = "".join(t.split("```py\n", 1)[1].removesuffix("\n```\n") + "\n" for _, _, t in got[1])
    assert inner.replace("\n", "") == ("x" * 60_000 + "a = b" * 9000)

    def seconds(n):
        begun = time.perf_counter()
        token_chunks.block_pieces("H", "Info", start * n, 10**9, count, ChunkBudget())
        return time.perf_counter() - begun

    seconds(1)
    assert seconds(8) < 30 * seconds(1)


def test_cutting_counts_a_text_a_few_times():
    text = "Words of some lengths, among others these, follow one another here. " * 4000
    seen = 0

    def count(texts):
        nonlocal seen
        seen += sum(map(len, texts))
        return [len(t) // 4 for t in texts]

    for body, kind in ((text, "Info"), (text.replace(". ", " "), "Info"), (f"```\n{text.replace('. ', chr(10))}\n```\n", "Code")):
        seen = 0
        token_chunks.block_pieces("", kind, body, 10**9, count, ChunkBudget())
        assert seen < 8 * len(body)


def test_counter_by_words_equals_the_library():
    count = token_chunks.LibraryCounter(PATH)
    tokenizer = count._load()
    assert count._known
    rng = random.Random(3)
    units = [" ", "  ", "\n", "\t ", " ", "　", "\x1c", "\x85", "​", "a", "word", "'s", "'", "9", "é", "²", "ª", "µ", "ſ", "÷", "\u0180", "日本", "?!", "<|endoftext|>", "x" * 60]
    texts = ["".join(rng.choices(units, k=rng.randint(0, 30))) for _ in range(3000)]
    assert count(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert count(texts) == count(texts)
