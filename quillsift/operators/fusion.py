"""Reciprocal-rank fusion of the dense and lexical channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.operators.topk import SCORE_DIGITS


def contribution(rank: Column, k: Column | int) -> Column:
    """Share of one channel: ``1 / (k + rank - 1)``, nothing for a miss."""
    return F.coalesce(1.0 / (F.lit(k) + rank - 1), F.lit(0.0))


def fuse(dense: DataFrame, lexical: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Union of both channels with nullable ranks and the summed score."""
    both = dense.select("qid", "chunk_idx", "dense_rank").join(
        lexical.select("qid", "chunk_idx", "lexical_rank"), ["qid", "chunk_idx"], "full"
    )
    return both.withColumn(
        "rrf",
        contribution(F.col("dense_rank"), rrf_k) + contribution(F.col("lexical_rank"), rrf_k),
    )


def rank_fused(fused: DataFrame, *more_keys: str) -> DataFrame:
    """Position in the fused list: score, then dense rank, then chunk index."""
    order = Window.partitionBy("qid", *more_keys).orderBy(
        F.round("rrf", SCORE_DIGITS).desc(),
        F.col("dense_rank").asc_nulls_last(),
        F.col("chunk_idx"),
    )
    return fused.withColumn("fused_rank", F.row_number().over(order))
