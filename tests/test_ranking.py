from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.functions.text import english_terms
from quillsift.operators import answer, dense, fusion, lexical, mmr, rerank
from quillsift.operators.batch import QueryBatch
from quillsift.params import SearchParams
from quillsift.plans import search as plan

WORDS = ["alpha", "beta", "gamma", "delta", "été", "common", "x1", "rare"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    texts = [
        " ".join(["common"] * rng.randint(0, 3) + rng.choices(WORDS, k=rng.randint(0, 12)))
        for _ in range(150)
    ]
    vectors = np.random.default_rng(5).normal(size=(120, 8)).astype(np.float32)
    vectors[7] = vectors[8]
    chunks = spark.createDataFrame(
        [(i, f"page{i % 5}.md", f"H{i % 3}", "Info", None, t) for i, t in enumerate(texts)],
        "chunk_idx bigint, source_url string, heading_path string, chunk_type string, "
        "api_version string, text string",
    ).repartition(5)
    stored = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)],
        "chunk_idx bigint, embedding array<float>",
    ).repartition(5)
    queries = spark.createDataFrame(
        [
            (q, " ".join(rng.choices(WORDS, k=4)), [float(x) for x in vectors[q * 3] + 0.3 * vectors[q]], 3 + q % 4)
            for q in range(12)
        ],
        "qid bigint, query string, qvec array<double>, top_k int",
    )
    return texts, vectors.astype(float), chunks, stored, queries


def by_query(rows, *fields):
    out = {}
    for r in rows:
        out.setdefault(r["qid"], []).append(tuple(r[f] for f in fields))
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_dense_paths_agree_with_brute_force(spark, corpus, metric):
    _, vectors, _, stored, queries = corpus
    small = QueryBatch.measure(queries)
    large = QueryBatch.measure(queries, max_queries=3)
    assert small.small and not large.small
    results = [
        by_query(
            dense.dense_topk(b, stored, 10, metric, block_vectors=25).orderBy("qid", "dense_rank").collect(), "chunk_idx", "dense_rank"
        )
        for b in (small, large)
    ]
    for row in queries.collect():
        q = np.array(row.qvec)
        if metric == "l2":
            score = -((vectors - q) ** 2).sum(1)
        else:
            score = vectors @ q / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q)
        best = sorted(range(len(vectors)), key=lambda i: (-round(score[i], 9), i))[:10]
        for got in results:
            assert got[row.qid] == [(i, n) for n, i in enumerate(best, 1)]


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def test_bm25_paths_agree_with_brute_force(spark, corpus):
    texts, _, chunks, _, queries = corpus
    lexical.CHUNKS_PER_SALT, keep = 20, lexical.CHUNKS_PER_SALT
    try:
        results = [
            by_query(
                lexical.bm25_topk(QueryBatch.measure(queries, max_queries=n), chunks, 15)
                .orderBy("qid", "lexical_rank").collect(),
                "chunk_idx", "score",
            )
            for n in (100, 3)
        ]
        stored = lexical.bm25_topk(QueryBatch.measure(queries), chunks, 15, index=lexical.postings(chunks))
        results.append(by_query(stored.orderBy("qid", "lexical_rank").collect(), "chunk_idx", "score"))
    finally:
        lexical.CHUNKS_PER_SALT = keep
    docs = [words(t) for t in texts]
    mean = sum(map(len, docs)) / len(docs)
    for row in queries.collect():
        scores = {}
        for term in set(words(row.query)):
            df = sum(term in d for d in docs)
            for i, d in enumerate(docs):
                tf = d.count(term)
                if tf:
                    w = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    scores[i] = scores.get(i, 0) + w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:15]
        for got in results:
            assert [i for i, _ in got[row.qid]] == best
            assert [s for _, s in got[row.qid]] == pytest.approx([scores[i] for i in best])


def test_english_analysis(spark):
    values = ["The queries, and Classes of a bus!", "glass flies", "ponies does ties"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    got = [r.t for r in rows.select("i", english_terms(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == [["query", "classe", "bus"], ["glass", "fly"], ["pony", "ty"]]
    chunks = spark.createDataFrame([(0, "the the query"), (1, "the cat")], "chunk_idx bigint, text string")
    asked = spark.createDataFrame([(1, "the queries", [0.0])], "qid int, query string, qvec array<double>")
    for limit in (10, 0):
        batch = QueryBatch.measure(asked, max_queries=limit, analyzer=english_terms)
        assert [r.chunk_idx for r in lexical.bm25_topk(batch, chunks, 5).collect()] == [0]
        plain = QueryBatch.measure(asked, max_queries=limit)
        assert {r.chunk_idx for r in lexical.bm25_topk(plain, chunks, 5).collect()} == {0, 1}


def test_invalid_queries_are_left_out(spark, corpus):
    queries = corpus[4].withColumn(
        "query", F.when(F.col("qid") == 0, "").when(F.col("qid") == 1, F.repeat(F.lit("x"), 4097)).otherwise(F.col("query"))
    )
    batch = QueryBatch.measure(queries)
    assert sorted(r["qid"] for r in batch.rows) == list(range(2, 12))
    assert QueryBatch.measure(queries.limit(0)).rows == ()
    found = plan.search(batch, corpus[2], corpus[3])
    states = {r["qid"]: r["answer_state"] for r in found.decisions.collect()}
    assert sorted(states) == list(range(12))
    assert [q for q, state in states.items() if state == "invalid_query"] == [0, 1]


def test_fusion_keeps_missing_ranks(spark):
    left = spark.createDataFrame([(1, c, r) for r, c in enumerate([10, 11, 12, 13, 14], 1)], "qid int, chunk_idx bigint, dense_rank int")
    right = spark.createDataFrame([(1, c, r) for r, c in enumerate([12, 10, 14], 1)], "qid int, chunk_idx bigint, lexical_rank int")
    rows = fusion.rank_fused(fusion.fuse(left, right)).orderBy("fused_rank").collect()
    assert [r.chunk_idx for r in rows] == [10, 12, 14, 11, 13]
    assert rows[0].rrf == pytest.approx(1 / 60 + 1 / 61)
    assert (rows[3].dense_rank, rows[3].lexical_rank) == (2, None)


def brute_mmr(pool, q, top_k, weight, penalty=0.05):
    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if n else 0.0

    left = [c for c in pool if c["vec"] is not None]
    rest = sorted((c for c in pool if c["vec"] is None), key=lambda c: -c["rrf"])
    chosen = []
    while left and len(chosen) < top_k:
        def score(c):
            near = max([0.0] + [cos(c["vec"], s["vec"]) for s in chosen])
            same = sum(s["url"] == c["url"] for s in chosen)
            return round(weight * cos(q, c["vec"]) - (1 - weight) * (near + penalty * same), 9)

        best = max(left, key=score)
        chosen.append(best)
        left.remove(best)
    return [c["id"] for c in (chosen + rest)[:top_k]]


@pytest.mark.parametrize("weight", [0.3, 0.7, 1.0])
def test_mmr_matches_brute_force(spark, weight):
    rng = np.random.default_rng(9)
    rows, expected = [], {}
    for qid in range(6):
        q = rng.normal(size=5)
        pool = []
        for pos in range(1, 13):
            vec = None if (qid == 5 and pos > 2) or pos % 5 == 0 else rng.normal(size=5).astype(np.float32).astype(float)
            pool.append({"id": pos * 10, "vec": vec, "rrf": 1 / (60 + pos // 2), "url": f"u{pos % 3}"})
            rows.append((qid, q.tolist(), 6, pos, pos * 10, f"u{pos % 3}", 1 / (60 + pos // 2), pos, None, None if vec is None else vec.tolist()))
        expected[qid] = brute_mmr(pool, q, 6, weight)
    frame = spark.createDataFrame(
        rows,
        "qid int, qvec array<double>, top_k int, position int, chunk_idx bigint, source_url string, "
        "rrf double, dense_rank int, lexical_rank int, embedding array<float>",
    )
    got = mmr.mmr_select(frame, SearchParams(mmr_lambda=weight)).orderBy("qid", "mmr_rank").collect()
    assert {q: [c for c, in v] for q, v in by_query(got, "chunk_idx").items()} == expected
    assert all((r.cosine is None) == (r.chunk_idx % 50 == 0 or (r.qid == 5 and r.chunk_idx > 20)) for r in got)


def test_rerank_order_must_be_a_permutation(spark):
    pool = spark.createDataFrame([(q, c) for q in (1, 2, 3) for c in (5, 6, 7)], "qid int, chunk_idx bigint")
    order = spark.createDataFrame(
        [(1, 7, 0), (1, 5, 1), (1, 6, 2), (2, 5, 0), (2, 6, 1), (3, 5, 0), (3, 6, 1), (3, 7, 2), (3, 7, 3)],
        "qid int, chunk_idx bigint, rerank_pos int",
    )
    got = rerank.accepted_order(pool, order).orderBy("qid", "rerank_pos").collect()
    assert [(r.qid, r.chunk_idx) for r in got] == [(1, 7), (1, 5), (1, 6)]
    assert [r.relevance for r in got] == pytest.approx([1, 2 / 3, 1 / 3])


def test_oversized_or_empty_pools_get_no_documents(spark):
    rows = [(1, c, "h", "t") for c in range(41)] + [(2, 1, "", "")] + [(3, c, "h", "") for c in range(3)]
    pool = spark.createDataFrame(rows, "qid int, chunk_idx bigint, heading_part string, text_part string")
    got = rerank.rerank_documents(pool).collect()
    assert {r.qid for r in got} == {3}
    assert {r.document for r in got} == {"h\n\n"}


def test_decisions(spark):
    nan = float("nan")
    cases = [
        (None, None, "no_answer", "no_candidates", "no_candidates"),
        (0.81, 0.0330, "no_answer", "current_gate_reject", "calibrated_no_answer"),
        (0.81, 0.0331, "borderline", "current_dual_rank_pass", "calibrated_borderline"),
        (0.82, 0.01, "borderline", "current_cosine_pass", "calibrated_borderline"),
        (0.845, 0.01, "confident", "current_cosine_pass", "calibrated_confident"),
        (nan, 0.01, "borderline", "current_dual_rank_pass", "calibrated_borderline"),
        (0.5, None, "no_answer", "current_gate_reject", "calibrated_no_answer"),
    ]
    frame = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, cos double, rrf double")
    state, reason = answer.calibrated_decision(F.col("cos"), F.col("rrf"))
    _, binary = answer.binary_decision(F.col("cos"), F.col("rrf"))
    rows = frame.select("i", state.alias("s"), binary.alias("b"), reason.alias("r")).orderBy("i").collect()
    assert [(r.s, r.b, r.r) for r in rows] == [c[2:] for c in cases]


def test_window_puts_hits_first_and_clamps(spark):
    hits = spark.createDataFrame([(1, 1, 5, 0.3), (1, 2, 0, 0.2), (1, 3, 6, 0.1), (2, 1, 9, 0.4)], "qid int, mmr_rank int, chunk_idx bigint, rrf double")
    got = by_query(answer.neighbor_window(hits, 10).orderBy("qid", "pos").collect(), "chunk_idx", "score")
    assert [c for c, _ in got[1]] == [5, 0, 6, 4, 1, 7]
    assert [s for _, s in got[1]] == [0.3, 0.2, 0.1, None, None, None]
    assert [c for c, _ in got[2]] == [9, 8]


def test_budget_stops_at_first_overflow(spark):
    rows = [(1, 1, 50, 100), (1, 2, 60, 100), (1, 3, 10, 100), (2, 1, 500, 100), (3, 1, 40, 100), (3, 2, 60, 100)]
    got = answer.pack_to_budget(spark.createDataFrame(rows, "qid int, pos int, tokens int, max_tokens int")).collect()
    assert sorted((r.qid, r.pos, r.cum_tokens, r.truncated) for r in got) == [
        (1, 1, 50, True), (2, 1, 500, True), (3, 1, 40, False), (3, 2, 100, False),
    ]



def test_half_precision_queries_agree_on_both_paths(spark, corpus):
    _, _, _, stored, queries = corpus
    ask = lambda limit: sorted(map(tuple, dense.dense_topk(QueryBatch.measure(queries, max_queries=limit), stored, 5, half=True).collect()))
    assert [r[:2] for r in ask(100)] == [r[:2] for r in ask(3)]
    vectors = {r.chunk_idx: np.array(r.embedding, np.float64) for r in stored.where("embedding is not null").collect()}
    asked = {r.qid: np.array(r.qvec, np.float16).astype(np.float64) for r in queries.collect()}
    for qid, chunk_idx, score, _ in ask(100):
        assert score == pytest.approx(-((vectors[chunk_idx] - asked[qid]) ** 2).sum(), abs=1e-9)


def test_search_is_the_same_on_both_paths(spark, corpus):
    _, _, chunks, stored, queries = corpus
    loose = SearchParams(min_answer_cosine=0.3)
    runs = []
    for limit in (100, 3):
        result = plan.search(QueryBatch.measure(queries, max_queries=limit), chunks, stored, loose)
        runs.append(
            (
                sorted(map(tuple, result.rows.select("qid", "pos", "chunk_idx", "score", "answer_state", "cum_tokens").collect())),
                sorted(map(tuple, result.decisions.select("qid", "answer_state", "gate_passed").collect())),
            )
        )
    assert runs[0] == runs[1]
    assert {r[0] for r in runs[0][1]} == set(range(12))
    silent = {q for q, state, _ in runs[0][1] if state == "no_answer"}
    assert silent.isdisjoint({r[0] for r in runs[0][0]})


def test_search_with_a_failing_reranker_equals_search_without(spark, corpus):
    _, _, chunks, stored, queries = corpus
    batch = QueryBatch.measure(queries.withColumn("top_k", F.lit(5)))

    def wrong(documents):
        return documents.select("qid", "chunk_idx", F.lit(0).alias("rerank_pos")).where("chunk_idx % 2 = 0")

    plain = plan.search(batch, chunks, stored).selected
    failed = plan.search(batch, chunks, stored, reranker=wrong).selected
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, failed.collect()), key=str)
    good = plan.search(batch, chunks, stored, reranker=rerank.overlap_reranker).selected
    assert good.count() == plain.count()


def test_a_failed_or_late_call_changes_only_its_query(spark, corpus):
    _, _, chunks, stored, queries = corpus
    batch = QueryBatch.measure(queries.withColumn("top_k", F.lit(5)))
    by_qid = {r.qid: r.query for r in queries.collect()}
    bad = {by_qid[0]: "failed", by_qid[1]: "late", by_qid[2]: "invalid_order"}

    def ranker(query, documents):
        kind = bad.get(query)
        if kind == "failed":
            raise OSError("gone")
        if kind == "late":
            time.sleep(20)
        order = list(range(len(documents)))[::-1]
        return order[:-1] + order[:1] if kind == "invalid_order" else order

    def rows(result, key):
        return sorted((tuple(r) for r in result.selected.collect() if key(r.qid)), key=str)

    plain = plan.search(batch, chunks, stored)
    mixed = plan.search(batch, chunks, stored, reranker=rerank.per_query(ranker, timeout=3.0))
    good = plan.search(batch, chunks, stored, reranker=rerank.per_query(lambda q, d: list(range(len(d)))[::-1]))
    hit = lambda qid: by_qid[qid] in bad
    assert rows(mixed, hit) == rows(plain, hit)
    assert rows(mixed, lambda q: not hit(q)) == rows(good, lambda q: not hit(q))
    expected = {q: bad.get(t, "reranked") for q, t in by_qid.items()}
    assert {r.qid: r.status for r in mixed.rerank_status.collect()} == expected


def test_a_candidate_without_a_chunk_row_stays(spark, corpus):
    _, _, chunks, stored, queries = corpus
    batch = QueryBatch.measure(queries)
    pool = plan.hybrid_pool(batch, chunks, stored)
    gone = pool.first()["chunk_idx"]
    ready = plan.attach(batch, pool, chunks.where(F.col("chunk_idx") != gone), stored)
    assert ready.count() == pool.count()
    assert {r.source_url for r in ready.where(F.col("chunk_idx") == gone).collect()} == {None}
