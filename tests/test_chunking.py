from __future__ import annotations

import random

from pyspark.sql import functions as F

from brute_chunks import blocks, chunk, tokens
from quillsift.operators import chunking
from quillsift.params import ChunkBudget


def made_documents(seed: int = 7, n: int = 120) -> list[str]:
    rng = random.Random(seed)
    words = ["alpha", "beta.", "gamma!", "3.14", "delta", "été", "e.g.", "x?y", "end."]

    def text(n_words: int, seps: str = "    \n\t") -> str:
        return "".join(rng.choice(words) + rng.choice(seps) for _ in range(n_words))

    def part() -> str:
        kind = rng.randrange(8)
        if kind == 0:
            return "#" * rng.randint(1, 7) + rng.choice([" ", "", "  "]) + text(2, " ") + "\n"
        if kind == 1:
            body = "\n".join(
                rng.choice(["fn ", "  def ", "", "class ", "\t"]) + text(rng.randint(0, 30), " ")
                for _ in range(rng.randint(0, 9))
            )
            mark = rng.choice(["```", "~~~", "````"])
            return f"{mark}{rng.choice(['py', '', ' rust x'])}\n{body}\n{rng.choice(['```', '~~~ ', '  ````'])}\n"
        if kind == 2:
            return "```js\n# no heading\n" + text(4, " ") + rng.choice(["\n", ""])
        if kind == 3:
            return rng.choice(["\n\n", "\n", "   \n", "\r\n\r\n"])
        if kind == 4:
            return text(rng.randint(20, 90)) + "\n\n"
        if kind == 5:
            return " ".join(rng.choice(["word", "mot"]) for _ in range(rng.randint(1, 80))) + "\n\n"
        return text(rng.randint(1, 15)) + rng.choice(["\n\n", "\n"])

    docs = ["", "  \n ", "plain", "# Only heading\n", "### Deep\ntext\n# Top\nmore", "```\nopen fence"]
    return docs + ["".join(part() for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_blocks_match_a_line_by_line_reading(spark):
    docs = made_documents()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_key int, markdown string")
    got = {}
    for r in chunking.blocks_of(frame).orderBy("doc_key", "block_no").collect():
        got.setdefault(r.doc_key, []).append((r.path, r.kind, r.body))
    for i, doc in enumerate(docs):
        assert got.get(i, []) == blocks(doc), doc


def test_chunks_match_brute_force_for_several_budgets(spark):
    docs = made_documents(seed=11)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_key int, markdown string")
    for limit, target in ((512, 384), (40, 30), (20, 12)):
        rows = (
            chunking.chunk_markdown(frame, budget=ChunkBudget(limit, target))
            .orderBy("doc_key", "block_no", "part_no")
            .collect()
        )
        got = {}
        for r in rows:
            got.setdefault(r.doc_key, []).append((r.heading_path, r.chunk_type, r.text))
        for i, doc in enumerate(docs):
            assert got.get(i, []) == chunk(doc, limit, target), (limit, doc)


def test_prose_chunks_stay_within_the_limit(spark):
    docs = made_documents(seed=3)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_key int, markdown string")
    rows = chunking.chunk_markdown(frame, budget=ChunkBudget(60, 40)).where("chunk_type = 'Info'")
    # The estimate rounds down per piece, so a joined chunk can be one or two over.
    assert all(tokens(r.text) <= 62 for r in rows.collect())


def test_long_documents_do_not_overflow_the_matcher(spark):
    text = "# H\n" + "line of prose.\n" * 60_000 + "```\n" + "code line\n" * 60_000 + "```\n"
    frame = spark.createDataFrame([(0, text)], "doc_key int, markdown string")
    kinds = [r.kind for r in chunking.blocks_of(frame).orderBy("block_no").collect()]
    assert kinds == ["Info", "Code"]


def test_global_index_is_dense_and_ordered(spark):
    rows = spark.range(0, 1000).select(
        F.format_string("p%03d", F.col("id") % 37).alias("path"), (F.col("id") * 7919 % 1000).alias("at")
    )
    got = chunking.with_global_index(rows, "path", ["at"]).collect()
    expected = sorted((r.path, r["at"]) for r in got)
    assert [expected[r.chunk_idx] for r in got] == [(r.path, r["at"]) for r in got]
    assert sorted(r.chunk_idx for r in got) == list(range(1000))


def test_pages_come_back_in_order(spark):
    rows = spark.range(0, 900).select(
        F.when(F.col("id") < 600, "big").otherwise("small").alias("source_url"),
        F.col("id").alias("chunk_idx"),
        F.concat(F.lit("t"), F.col("id")).alias("text"),
    )
    got = {r.source_url: r for r in chunking.reassemble_pages(rows).collect()}
    assert got["big"].text == "\n\n".join(f"t{i}" for i in range(600))
    assert got["small"].text == "\n\n".join(f"t{i}" for i in range(600, 900))
    assert got["big"].n_chunks == 600
