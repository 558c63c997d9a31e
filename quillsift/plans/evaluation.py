"""Evaluating a search over labelled queries, and over a whole labelled suite."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift import params
from quillsift.functions.vectors import Embedder
from quillsift.operators import metrics
from quillsift.operators.batch import QueryBatch
from quillsift.params import SearchParams
from quillsift.plans import search as s
from quillsift.session import checkpointed
from quillsift.sources.files import suite_targets
from quillsift.sources.store import DocsetStore


@dataclass(frozen=True)
class Evaluation:
    """Labels, hits per stage, metrics per query and stage, and the label of each query."""

    queries: DataFrame
    targets: DataFrame
    hits: DataFrame
    metrics: DataFrame
    decisions: DataFrame

    def report(self) -> DataFrame:
        return metrics.eval_report(self.queries, self.metrics, self.decisions)

    def stage_ranks(self) -> DataFrame:
        return metrics.stage_ranks(self.queries, self.metrics, self.hits, self.targets)


def stage_hits(
    batch: QueryBatch, chunks: DataFrame, vectors: DataFrame, p: SearchParams = SearchParams()
) -> tuple[DataFrame, s.SearchResult]:
    """Hits of all five stages ``(stage, qid, rank, source_url, heading_path)``.

    The channels feed both the search and their own stages, and the hits feed
    several joins; each is a fixed number of rows per query and cut from its
    lineage once.
    """
    dense, lexical = (checkpointed(c) for c in s.channels(batch, chunks, vectors, p))
    result = s.search(batch, chunks, vectors, p, ranked=(dense, lexical))
    stages = {
        "dense_at_40": (dense, "dense_rank"),
        "fts_at_40": (lexical, "lexical_rank"),
        "fused_at_40": (result.pool, "fused_rank"),
        "mmr_at_5": (result.selected, "mmr_rank"),
        "output_at_5": (result.rows, "pos"),
    }
    ranked = reduce(
        DataFrame.unionByName,
        [
            frame.where(F.col(rank) <= params.STAGE_CUTOFFS[name]).select(
                F.lit(name).alias("stage"), "qid", "chunk_idx", F.col(rank).alias("rank")
            )
            for name, (frame, rank) in stages.items()
        ],
    )
    pages = s.near(batch, chunks, ranked).select("chunk_idx", "source_url", "heading_path")
    return checkpointed(pages.join(batch.sized(ranked), "chunk_idx")), result


def evaluate(
    labelled: DataFrame, targets: DataFrame, batch: QueryBatch, chunks: DataFrame, vectors: DataFrame,
    p: SearchParams = SearchParams(),
) -> Evaluation:
    """Evaluate ``labelled`` queries ``(qid, docset, split, form, class)`` of one docset."""
    hits, result = stage_hits(batch, chunks, vectors, p)
    scores = metrics.ranking_metrics(labelled, hits, targets)
    return Evaluation(labelled, targets, hits, scores, result.decisions)


def evaluate_suite(
    store: DocsetStore, suite: DataFrame, embed: Embedder, split: str = "test",
    p: SearchParams = SearchParams(),
) -> Evaluation:
    """Evaluate one split of a labelled suite, each docset against its own store.

    The whole suite is checked before its split is taken.
    """
    targets = suite_targets(suite)
    broken = metrics.suite_violations(
        suite.withColumnRenamed("query_class", "class"), targets.withColumnRenamed("qid", "id")
    ).limit(5).collect()
    if broken:
        raise ValueError(f"the suite breaks its contract: {broken}")
    chosen = suite.where(F.col("split") == split).select(
        F.col("id").alias("qid"), "docset", "split", F.col("query_form").alias("form"),
        F.col("query_class").alias("class"), "query", embed(F.col("query")).alias("qvec"),
    )
    parts = []
    for docset in store.docsets():
        own = chosen.where(F.col("docset") == docset)
        table = store.chunks(docset)
        batch = QueryBatch.measure(own)
        if batch.rows == ():
            continue
        parts.append(
            evaluate(own.drop("query", "qvec"), targets, batch, table, table.select("chunk_idx", "embedding", "span"), p)
        )
    if not parts:
        raise ValueError(f"no installed docset has queries in split {split}")

    def union(field: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(part, field) for part in parts])

    return Evaluation(union("queries"), targets, union("hits"), union("metrics"), union("decisions"))
