"""The whole search over a query batch, stage by stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift import params
from quillsift.functions.stem import ANALYZERS, stemmed_terms
from quillsift.functions.text import estimate_tokens
from quillsift.functions.vectors import cosine
from quillsift.operators import answer, fusion, mmr, rerank
from quillsift.operators.batch import QueryBatch
from quillsift.operators.dense import dense_topk
from quillsift.operators.lexical import bm25_topk
from quillsift.params import SearchParams
from quillsift.schemas import span_of
from quillsift.session import checkpointed, spread
from quillsift.sources.postings import PostingsIndex


def pool_size(top_k: Column | int, p: SearchParams) -> Column:
    return F.greatest(F.lit(top_k) * p.pool_factor, F.lit(p.pool_floor))


def channel_depth(batch: QueryBatch, p: SearchParams) -> int:
    """Deepest pool any query of the batch asks for."""
    deepest = (
        max((r["top_k"] for r in batch.rows), default=params.TOP_K_DEFAULT)
        if batch.small
        else params.TOP_K_MAX
    )
    return max(deepest * p.pool_factor, p.pool_floor)


def channels(
    batch: QueryBatch, chunks: DataFrame, vectors: DataFrame, p: SearchParams = SearchParams(),
    index: PostingsIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ranked dense and lexical candidates, each to the query's own pool depth.

    With a stored ``index`` the lexical channel reads its blocks and no text.
    """
    depth = channel_depth(batch, p)
    dense = dense_topk(batch, vectors, depth, p.metric, half=p.half_query)
    lexical = index.topk(batch, depth, p) if index else bm25_topk(batch, chunks, depth, p)
    if batch.small and len({r["top_k"] for r in batch.rows}) <= 1:
        return dense, lexical
    limits = batch.sized(batch.df.select("qid", pool_size(F.col("top_k"), p).alias("_depth")))

    def within(ranked: DataFrame, rank: str) -> DataFrame:
        return ranked.join(limits, "qid").where(F.col(rank) <= F.col("_depth")).drop("_depth")

    return within(dense, "dense_rank"), within(lexical, "lexical_rank")


def hybrid_pool(
    batch: QueryBatch,
    chunks: DataFrame,
    vectors: DataFrame,
    p: SearchParams = SearchParams(),
    ranked: tuple[DataFrame, DataFrame] | None = None,
    index: PostingsIndex | None = None,
) -> DataFrame:
    """Fused candidates: ``(qid, chunk_idx, dense_rank, lexical_rank, rrf, fused_rank)``.

    ``ranked`` passes channels that were computed before.
    """
    dense, lexical = ranked or channels(batch, chunks, vectors, p, index)
    ranked = fusion.rank_fused(fusion.fuse(dense, lexical, p.rrf_k))
    limits = batch.df.select("qid", pool_size(F.col("top_k"), p).alias("_depth"))
    return (
        ranked.join(batch.sized(limits), "qid")
        .where(F.col("fused_rank") <= F.col("_depth"))
        .drop("_depth")
    )


def near(batch: QueryBatch, table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Only the partitions of a stored table that the wanted chunks lie in.

    A stored table is partitioned by spans of the chunk index. A small batch
    wants a bounded number of chunks, so their spans become a partition filter
    and the rest of the corpus is not read.
    """
    if "span" not in table.columns or not batch.small:
        return table
    spans = wanted.select(span_of(F.col("chunk_idx")).alias("span")).distinct().collect()
    return table.where(F.col("span").isin([r["span"] for r in spans]))


def attach(batch: QueryBatch, pool: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add page, vector and query columns to the pool, ready for selection.

    The pool has a bounded number of rows per query, so for a small batch it is
    the broadcast side and the chunk tables are only scanned. Every candidate stays,
    also one without a chunk row or a vector.
    """
    keys = batch.sized(pool.select("qid", "chunk_idx"))
    found = near(batch, chunks, pool).select("chunk_idx", "source_url").join(keys, "chunk_idx")
    pages = pool.join(found, ["qid", "chunk_idx"], "left")
    stored = near(batch, vectors, pool).select("chunk_idx", "embedding").join(keys, "chunk_idx")
    asked = batch.df.select("qid", "qvec", "top_k")
    return (
        pages.join(stored, ["qid", "chunk_idx"], "left")
        .join(batch.sized(asked), "qid")
        .withColumnRenamed("fused_rank", "position")
    )


def with_rerank(
    batch: QueryBatch, pool: DataFrame, ready: DataFrame, chunks: DataFrame, reranker: rerank.Reranker,
    p: SearchParams = SearchParams(),
) -> DataFrame:
    """Selection that follows an accepted rerank order where there is one.

    Queries whose documents do not qualify, whose order is not a permutation of the
    pool, or whose call failed (``rerank.per_query``) are selected by cosine as if there
    were no reranker. A reranker table that fails as a job fails the search.
    """
    return select_by_order(ready, rerank_decisions(batch, pool, chunks, reranker), p)


def rerank_decisions(
    batch: QueryBatch, pool: DataFrame, chunks: DataFrame, reranker: rerank.Reranker
) -> DataFrame:
    """The reranker's order over the pool, fixed once, with a status per query."""
    return rerank.decided_order(pool, reranker(documents_of(batch, pool, chunks)))


def select_by_order(ready: DataFrame, order: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    joined = ready.join(order.drop("status"), ["qid", "chunk_idx"], "left")
    reranked = joined.where(F.col("relevance").isNotNull()).withColumn("position", F.col("rerank_pos"))
    local = joined.where(F.col("relevance").isNull()).drop("relevance", "rerank_pos")
    return mmr.mmr_select(reranked.drop("rerank_pos"), p).unionByName(mmr.mmr_select(local, p))


def documents_of(batch: QueryBatch, pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rerank documents of a pool: ``(qid, query, chunk_idx, position, document)``."""
    placed = pool.select("qid", "chunk_idx", F.col("fused_rank").alias("position"))
    stored = spread(
        near(batch, chunks, pool).select("chunk_idx", "heading_path", "text"), "chunk_idx"
    )
    wanted = stored.join(batch.sized(placed.select("chunk_idx")), "chunk_idx", "left_semi")
    parts = rerank.clean_parts(wanted)
    return rerank.rerank_documents(parts.join(batch.sized(placed), "chunk_idx")).join(
        batch.sized(batch.df.select("qid", "query")), "qid"
    ).select("qid", "query", "chunk_idx", "position", "document")


@dataclass(frozen=True)
class SearchResult:
    """Answer rows plus the per-query label and the stages behind it."""

    rows: DataFrame
    decisions: DataFrame
    selected: DataFrame
    pool: DataFrame
    rerank_status: DataFrame | None = None


def search(
    batch: QueryBatch,
    chunks: DataFrame,
    vectors: DataFrame,
    p: SearchParams = SearchParams(),
    reranker: rerank.Reranker | None = None,
    count_tokens: Callable[[Column], Column] = estimate_tokens,
    ranked: tuple[DataFrame, DataFrame] | None = None,
    index: PostingsIndex | None = None,
) -> SearchResult:
    """Answer every query of the batch.

    ``rows`` has one row per returned chunk; a query labelled ``no_answer``
    returns none, which ``decisions`` tells apart; an invalid one has the state
    ``invalid_query`` there. With a reranker ``rerank_status`` says per query whether its
    order was used. The pool and the selection are
    small (a fixed number of rows per query) and each feeds several joins, so
    both cut their lineage.
    """
    pool = checkpointed(hybrid_pool(batch, chunks, vectors, p, ranked, index))
    ready = attach(batch, pool, chunks, vectors)
    status = None
    if reranker:
        order = rerank_decisions(batch, pool, chunks, reranker)
        status = order.select("qid", "status").distinct()
        picked = select_by_order(ready, order, p)
    else:
        picked = mmr.mmr_select(ready, p)
    selected = checkpointed(picked)
    decisions = answer.decide(batch.df, selected, p)
    answered = selected.join(
        decisions.where(F.col("answer_state") != "no_answer").select("qid", "answer_state"), "qid"
    )
    window = answer.neighbor_window(answered, chunks.count())
    labels = decisions.select("qid", "answer_state").join(
        batch.df.select("qid", "max_tokens"), "qid"
    )
    fetched = (
        near(batch, chunks, window)
        .drop("span")
        .join(batch.sized(window), "chunk_idx")
        .withColumn("tokens", count_tokens(F.col("text")))
        .join(batch.sized(labels), "qid")
    )
    if batch.refused is not None:
        decisions = decisions.unionByName(answer.refuse(batch.refused), allowMissingColumns=True)
    return SearchResult(answer.pack_to_budget(fetched), decisions, selected, pool, status)


def search_docsets(
    queries: DataFrame, store, p: SearchParams = SearchParams(half_query=True),
    reranker: rerank.Reranker | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answer queries ``(qid, docset, query, qvec)``, each in its own docset of a store.

    Returns the rows and the decisions, both with their ``docset``. The docsets
    are the store's catalog, one search per docset, over its stored index where it has one; a
    query for one that is not installed is an error. Texts are analyzed as English unless the
    index says otherwise. Invalid queries get a decision, also where no query is valid.
    """
    installed = store.docsets()
    known = F.coalesce(F.col("docset").isin(*installed), F.lit(False))
    unknown = queries.where(~known).limit(1).collect()
    if unknown:
        raise ValueError(f"docset not installed: {unknown[0]['docset']}")
    rows, decisions = [], []
    for docset in installed:
        index = store.postings_index(docset)
        analyzer = ANALYZERS[index.analyzer] if index else stemmed_terms
        batch = QueryBatch.measure(queries.where(F.col("docset") == docset), analyzer=analyzer)
        if batch.rows == () and (rows or docset != installed[-1]):
            decisions.append(answer.refuse(batch.refused).withColumn("docset", F.lit(docset)))
            continue
        table = store.chunks(docset)
        found = search(batch, table, table.select("chunk_idx", "embedding", "span"), p, reranker, index=index)
        rows.append(found.rows.withColumn("docset", F.lit(docset)))
        decisions.append(found.decisions.withColumn("docset", F.lit(docset)))
    if not rows:
        raise ValueError("no docset is installed")
    return reduce(DataFrame.unionByName, rows), reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), decisions
    )


def pool_cosines(ready: DataFrame) -> DataFrame:
    """Finite query cosines over the whole pool, best first: ``(qid, pos, cosine)``."""
    scored = ready.where(F.col("embedding").isNotNull()).select(
        "qid", "chunk_idx", cosine(F.col("qvec"), F.col("embedding")).alias("cosine")
    )
    best = Window.partitionBy("qid").orderBy(F.round("cosine", 9).desc(), "chunk_idx")
    finite = ~F.isnan("cosine") & (F.abs("cosine") < float("inf"))
    return scored.where(finite).withColumn("pos", F.row_number().over(best)).select(
        "qid", "pos", "chunk_idx", "cosine"
    )
