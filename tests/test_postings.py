"""The stored index against a scan of the texts, and the stemmer's rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillsift.functions.stem import stem, stemmed_terms
from quillsift.functions.text import terms
from quillsift.operators import lexical
from quillsift.operators.batch import QueryBatch
from quillsift.sources import postings
from quillsift.sources.postings import PostingsIndex

STEMS = """
consign consign consigned consign consigning consign consignment consign consistency consist
consistently consist console consol consolations consol consolidate consolid kneeling kneel
knightly knight knocks knock knots knot generate generat generously generous communism communism
arsenal arsenal class class classes class tie tie ties tie cries cri dies die gas gas gaps gap kiwis kiwi
this this luxuriated luxuri hopped hop hoping hope hopping hop falling fall agreed agre feed feed
relational relat conditional condit digitizer digit happily happili sky sky skies sky dying die
early earli news news proceeding proceed exceeded exceed innings inning youth youth boyish boyish
say say cry cri by by enjoy enjoy dazzle dazzl rational ration hopefulness hope electricity electr
adoption adopt controlled control abilities abil geology geolog
""".split()


def test_stems():
    for word, expected in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert stem(word) == expected, word


def test_analysis_drops_stop_words_and_nulls(spark):
    rows = spark.createDataFrame([(0, "The classes, and a CLASS of ties!"), (1, None), (2, ""), (3, "tie 42 naïve")], "i int, x string")
    got = {r["i"]: r["t"] for r in rows.select("i", stemmed_terms(F.col("x")).alias("t")).collect()}
    assert got == {0: ["class", "class", "tie"], 1: [], 2: [], 3: ["tie", "42", "naïv"]}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    words = [f"w{n}" for n in range(60)] + ["running", "runs", "the"]
    weights = [1 / (n + 1) for n in range(len(words))]
    # Sparse chunk indexes, so that there are many ranges of few chunks.
    rows = [(n * 97, " ".join(rng.choices(words, weights, k=rng.randrange(1, 40)))) for n in range(600)]
    return [*rows, (97 * 600, None), (97 * 601, "")]


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "chunk_idx long, text string")


def answers(ranked):
    return sorted((r["qid"], r["lexical_rank"], r["chunk_idx"], round(r["score"], 8)) for r in ranked.collect())


@pytest.mark.parametrize(("name", "analyzer", "limit"), [("english", stemmed_terms, 4096), ("plain", terms, 1)])
def test_index_is_a_scan(spark, tmp_path, texts, name, analyzer, limit):
    rows = [(1, "w1 w40 w55"), (2, "the run w3 w3"), (3, "nothing here"), (4, "w0"), (5, "w59 w58")]
    asked = spark.createDataFrame([(q, t, [0.0]) for q, t in rows], "qid int, query string, qvec array<double>")
    batch = QueryBatch.measure(asked, max_queries=limit, analyzer=analyzer)
    expected = answers(lexical.bm25_topk(QueryBatch.measure(asked, analyzer=analyzer), chunks_of(spark, texts).fillna(""), 7))
    index = PostingsIndex.create(spark, f"{tmp_path}/index", name)
    assert answers(index.topk(batch, 7)) == []
    for part in range(3):
        index.append(chunks_of(spark, texts[part::3]))
    assert len(index.segments()) == 3
    assert answers(index.topk(batch, 7)) == expected
    index.compact()
    assert len(index.segments()) == 1
    assert answers(index.topk(batch, 7)) == expected
    whole = PostingsIndex.create(spark, f"{tmp_path}/whole", name)
    whole.append(chunks_of(spark, texts))
    assert whole.totals() == index.totals()
    assert not postings.postings_of(whole.blocks()).exceptAll(postings.postings_of(index.blocks())).count()


def test_blocks_below_the_threshold_are_not_read(spark, tmp_path, texts, monkeypatch):
    rare = [(n * 97, "rare rare w1" if n % 100 == 7 else t) for n, (_, t) in enumerate(texts)]
    index = PostingsIndex.create(spark, f"{tmp_path}/index", "plain")
    index.append(chunks_of(spark, rare))
    asked = spark.createDataFrame([(1, "rare w0", [0.0])], "qid int, query string, qvec array<double>")
    read = []
    whole = PostingsIndex._scored

    def watched(self, batch, asked, ranges, *more):
        read.append(ranges.count())
        return whole(self, batch, asked, ranges, *more)

    monkeypatch.setattr(PostingsIndex, "_scored", watched)
    batch = QueryBatch.measure(asked)
    found = answers(index.topk(batch, 3))
    assert found == answers(lexical.bm25_topk(batch, chunks_of(spark, rare).fillna(""), 3))
    ranges = index.blocks().select("range").distinct().count()
    assert ranges > 50 and read[0] == postings.SEED_RANGES and read[1] == 0


def test_queries_of_another_analyzer_are_refused(spark, tmp_path):
    index = PostingsIndex.create(spark, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, "a", [0.0])], "qid int, query string, qvec array<double>")
    with pytest.raises(ValueError, match="english"):
        index.topk(QueryBatch.measure(asked), 3)


def test_an_append_shuffles_packed_blocks_once(spark, texts):
    """Rows in any order and small Arrow batches give whole, ordered blocks from a single exchange."""
    rows = chunks_of(spark, texts).fillna("").select(F.col("chunk_idx").cast("long"), "text")
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "3")
    try:
        tokens = rows.orderBy(F.rand(5)).select("chunk_idx", terms(F.col("text")).alias("terms"))
        tokens = spark.createDataFrame(tokens.collect(), tokens.schema)
        blocks = postings.blocks_of(postings.parts_of(tokens))
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        found = blocks.collect()
    finally:
        spark.conf.set(limit, before)
    assert len({(r.term, r.range) for r in found}) == len(found)
    assert all(list(r.at) == sorted(set(r.at)) and r.entries == len(r.at) for r in found)
    assert all(r.max_tf == max(r.tf) and r.min_length == min(r.length) for r in found)
    got = {(r.term, r.range * postings.RANGE + at, tf, n) for r in found for at, tf, n in zip(r.at, r.tf, r.length, strict=True)}
    assert got == {(r.term, r.chunk_idx, r.tf, r.length) for r in lexical.postings(rows).collect()}
