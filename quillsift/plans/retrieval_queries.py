"""Registered retrieval queries over the provided tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.stem import ANALYZERS, stemmed_terms
from quillsift.functions.text import estimate_tokens, sanitize_chunk, sanitize_metadata
from quillsift.functions.vectors import cosine
from quillsift.operators import answer, fusion, mmr, rerank
from quillsift.operators.batch import QueryBatch
from quillsift.operators.dense import dense_topk
from quillsift.operators.lexical import bm25_topk
from quillsift.params import SearchParams
from quillsift.plans import bindings as b
from quillsift.plans import search as s
from quillsift.session import checkpointed, shared_folder
from quillsift.sources.hadoop_files import HadoopFiles
from quillsift.sources.postings import PostingsIndex

SWEEP_RRF_K = (5, 10, 20, 60)
SWEEP_LAMBDA = (0.3, 0.5, 0.7, 0.9, 1.0)
CHANNEL_DEPTH = 40
BLOCK_ROWS = 128


def _inputs(spark: SparkSession, folder: str):
    return b.batch(spark, folder), b.chunks(spark, folder), b.vectors(spark, folder)


def _ready(spark: SparkSession, folder: str):
    batch, chunks, vectors = _inputs(spark, folder)
    pool = checkpointed(s.hybrid_pool(batch, chunks, vectors))
    return batch, chunks, pool, s.attach(batch, pool, chunks, vectors)


def dense(spark: SparkSession, folder: str) -> DataFrame:
    batch, _, vectors = _inputs(spark, folder)
    return b.as_output(dense_topk(batch, vectors, CHANNEL_DEPTH))


def search_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """As ``dense_topk``, with queries kept distributed and passed in tiles over blocks of vectors."""
    batch = QueryBatch.measure(b.queries(spark, folder), max_queries=0)
    found = dense_topk(batch, b.vectors(spark, folder), CHANNEL_DEPTH, block_vectors=BLOCK_ROWS)
    return b.as_output(found)


def dense_half(spark: SparkSession, folder: str) -> DataFrame:
    """As ``dense_topk``, with the queries in the half precision of a store."""
    batch, _, stored = _inputs(spark, folder)
    return b.as_output(dense_topk(batch, stored, CHANNEL_DEPTH, half=True))


def bm25(spark: SparkSession, folder: str) -> DataFrame:
    batch, chunks, _ = _inputs(spark, folder)
    return b.as_output(bm25_topk(batch, chunks, CHANNEL_DEPTH))


def _indexed(spark: SparkSession, folder: str, analyzer: str, parts: int) -> DataFrame:
    """Ranked chunks from an index of the documents, appended in so many parts."""
    chunks = b.chunks(spark, folder)
    batch = QueryBatch.measure(b.queries(spark, folder), analyzer=ANALYZERS[analyzer])
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index = PostingsIndex.create(spark, root, analyzer)
    for part in range(parts):
        index.append(chunks.where(F.pmod("chunk_idx", F.lit(parts)) == part))
    # The answer has a fixed number of rows per query; the index is not needed after it.
    ranked = checkpointed(index.topk(batch, CHANNEL_DEPTH))
    HadoopFiles(spark, root).delete(root)
    return b.as_output(ranked)


def bm25_indexed(spark: SparkSession, folder: str) -> DataFrame:
    return _indexed(spark, folder, "plain", 1)


def bm25_segments(spark: SparkSession, folder: str) -> DataFrame:
    """As ``bm25_indexed``, over three appended segments."""
    return _indexed(spark, folder, "plain", 3)


def bm25_english(spark: SparkSession, folder: str) -> DataFrame:
    """Stop words out, words stemmed, over two appended segments."""
    return _indexed(spark, folder, "english", 2)


def term_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """What the English analyzer makes of every document."""
    stems = b.chunks(spark, folder).select("chunk_idx", stemmed_terms(F.col("text")).alias("stems"))
    return stems.select(
        "chunk_idx",
        F.size("stems").cast("long").alias("n_terms"),
        F.size(F.array_distinct("stems")).cast("long").alias("n_distinct"),
        F.sha2(F.array_join("stems", " "), 256).alias("stems_sha256"),
    )


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return b.as_output(fusion.fuse(*s.channels(*_inputs(spark, folder))))


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    return b.as_output(s.hybrid_pool(*_inputs(spark, folder)))


def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of every chunk vector with the next one."""
    stored = b.vectors(spark, folder)
    following = stored.select(
        (F.col("chunk_idx") - 1).alias("chunk_idx"), F.col("embedding").alias("next_embedding")
    )
    return b.as_output(
        stored.join(following, "chunk_idx").select(
            "chunk_idx", cosine(F.col("embedding"), F.col("next_embedding")).alias("cosine")
        )
    )


def mmr_selection(spark: SparkSession, folder: str) -> DataFrame:
    *_, ready = _ready(spark, folder)
    return b.as_output(mmr.mmr_select(ready))


def rerank_documents(spark: SparkSession, folder: str) -> DataFrame:
    batch, chunks, pool, _ = _ready(spark, folder)
    documents = s.documents_of(batch, pool, chunks)
    return b.as_output(
        documents.select(
            "qid",
            "chunk_idx",
            F.octet_length("document").alias("bytes"),
            F.sha2("document", 256).alias("sha256"),
        )
    )


def rerank_order(spark: SparkSession, folder: str) -> DataFrame:
    batch, chunks, pool, _ = _ready(spark, folder)
    order = rerank.overlap_reranker(s.documents_of(batch, pool, chunks))
    return b.as_output(rerank.accepted_order(pool, order))


def mmr_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    batch, chunks, pool, ready = _ready(spark, folder)
    return b.as_output(s.with_rerank(batch, pool, ready, chunks, rerank.overlap_reranker))


def longest_first(query: str, documents: list[str]) -> list[int]:
    """Longest document first; fails, or forgets one, for queries of some lengths."""
    if len(query) % 5 == 1:
        raise ConnectionError("no answer for this query")
    order = sorted(range(len(documents)), key=lambda i: (-len(documents[i]), i))
    return order[1:] if len(query) % 5 == 2 else order


def rerank_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Selection under a reranker that fails for some queries, which alone are selected by cosine."""
    batch, chunks, pool, ready = _ready(spark, folder)
    order = s.rerank_decisions(batch, pool, chunks, rerank.per_query(longest_first))
    picked = s.select_by_order(ready, order)
    status = order.select("qid", "status").distinct()
    return b.as_output(
        picked.join(batch.sized(status), "qid").select("qid", "status", "mmr_rank", "chunk_idx", "cosine")
    )


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    batch, _, _, ready = _ready(spark, folder)
    return answer.decide(batch.df, mmr.mmr_select(ready))


def answer_gate(spark: SparkSession, folder: str) -> DataFrame:
    return b.as_output(
        _decided(spark, folder).select("qid", "top_cosine", "top_rrf", "gate_passed")
    )


def answer_state(spark: SparkSession, folder: str) -> DataFrame:
    decided = _decided(spark, folder)
    state, reason = answer.binary_decision(F.col("top_cosine"), F.col("top_rrf"))
    return b.as_output(
        decided.select(
            "qid",
            "answer_state",
            "decision_reason",
            state.alias("binary_state"),
            reason.alias("binary_reason"),
        )
    )


def trace_pool_cosines(spark: SparkSession, folder: str) -> DataFrame:
    *_, ready = _ready(spark, folder)
    return b.as_output(s.pool_cosines(ready))


def neighbor_window(spark: SparkSession, folder: str) -> DataFrame:
    _, chunks, _, ready = _ready(spark, folder)
    return b.as_output(answer.neighbor_window(mmr.mmr_select(ready), chunks.count()))


def token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Budget packing of every query's neighbor window, under small budgets."""
    batch, chunks, _, ready = _ready(spark, folder)
    window = answer.neighbor_window(mmr.mmr_select(ready), chunks.count())
    fetched = chunks.join(batch.sized(window), "chunk_idx").select(
        "qid",
        "pos",
        "chunk_idx",
        estimate_tokens(F.col("text")).alias("tokens"),
        (F.lit(500) + F.col("qid") % 7 * 300).alias("max_tokens"),
    )
    return b.as_output(answer.pack_to_budget(fetched))


def search(spark: SparkSession, folder: str) -> DataFrame:
    rows = s.search(*_inputs(spark, folder)).rows
    return b.as_output(
        rows.select(
            "qid", "pos", "chunk_idx", "score", "answer_state", "tokens", "cum_tokens", "truncated"
        )
    )


def search_response(spark: SparkSession, folder: str) -> DataFrame:
    """What a caller sees: sanitized fields, no score and no label."""
    rows = s.search(*_inputs(spark, folder)).rows
    return b.as_output(
        rows.select(
            "qid",
            "pos",
            "chunk_idx",
            sanitize_metadata(F.col("heading_path")).alias("heading_path"),
            sanitize_metadata(F.col("source_url")).alias("source_url"),
            "chunk_type",
            sanitize_chunk(F.col("text")).alias("text"),
        )
    )


def rrf_k_sweep(spark: SparkSession, folder: str) -> DataFrame:
    batch, chunks, vectors = _inputs(spark, folder)
    dense, lexical = s.channels(batch, chunks, vectors)
    fused = fusion.fuse(dense, lexical).withColumn(
        "rrf_k", F.explode(F.array(*[F.lit(k) for k in SWEEP_RRF_K]))
    )
    k = F.col("rrf_k")
    rescored = fused.withColumn(
        "rrf",
        fusion.contribution(F.col("dense_rank"), k) + fusion.contribution(F.col("lexical_rank"), k),
    )
    ranked = fusion.rank_fused(rescored, "rrf_k").where(F.col("fused_rank") <= CHANNEL_DEPTH)
    return b.as_output(ranked.select("qid", "rrf_k", "fused_rank", "chunk_idx", "rrf"))


def mmr_lambda_sweep(spark: SparkSession, folder: str) -> DataFrame:
    *_, ready = _ready(spark, folder)
    swept = ready.withColumn(
        "mmr_lambda", F.explode(F.array(*[F.lit(x) for x in SWEEP_LAMBDA]))
    )
    chosen = mmr.mmr_select(swept, SearchParams(), keys=("mmr_lambda",))
    return b.as_output(chosen.select("qid", "mmr_lambda", "mmr_rank", "chunk_idx", "cosine"))


QUERIES = {
    "dense_topk": dense,
    "search_blocks": search_blocks,
    "dense_half": dense_half,
    "bm25_topk": bm25,
    "bm25_indexed": bm25_indexed,
    "bm25_segments": bm25_segments,
    "bm25_english": bm25_english,
    "term_analysis": term_analysis,
    "rrf_fusion": rrf_fusion,
    "hybrid_topk": hybrid_topk,
    "cosine_pairs": cosine_pairs,
    "mmr_select": mmr_selection,
    "mmr_ordinal": mmr_ordinal,
    "rerank_fallback": rerank_fallback,
    "rerank_order": rerank_order,
    "rerank_documents": rerank_documents,
    "answer_gate": answer_gate,
    "answer_state": answer_state,
    "trace_pool_cosines": trace_pool_cosines,
    "neighbor_window": neighbor_window,
    "token_budget": token_budget,
    "search": search,
    "search_response": search_response,
    "rrf_k_sweep": rrf_k_sweep,
    "mmr_lambda_sweep": mmr_lambda_sweep,
}
