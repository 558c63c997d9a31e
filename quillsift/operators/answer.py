"""Answer gate, confidence label, neighbor window and token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.params import SearchParams


def gate_rejects(cosine: Column, rrf: Column, p: SearchParams = SearchParams()) -> Column:
    """True when both signals are below their floors; NaN counts as above."""
    return (cosine < p.min_answer_cosine) & (F.coalesce(rrf, F.lit(0.0)) < p.dual_rank1_rrf)


def binary_decision(cosine: Column, rrf: Column, p: SearchParams = SearchParams()) -> tuple[Column, Column]:
    """(state, reason) of the two-state gate."""
    none = cosine.isNull()
    reject = gate_rejects(cosine, rrf, p)
    state = F.when(none | reject, "no_answer").otherwise("confident")
    reason = (
        F.when(none, "no_candidates")
        .when(reject, "current_gate_reject")
        .when(~F.isnan(cosine) & (cosine >= p.min_answer_cosine), "current_cosine_pass")
        .otherwise("current_dual_rank_pass")
    )
    return state, reason


def calibrated_decision(cosine: Column, rrf: Column, p: SearchParams = SearchParams()) -> tuple[Column, Column]:
    """(state, reason) of the three-state label on top of the gate."""
    none = cosine.isNull()
    reject = gate_rejects(cosine, rrf, p)
    finite = ~F.isnan(cosine) & (F.abs(cosine) < float("inf"))
    sure = finite & (cosine >= p.confident_cosine)
    state = (
        F.when(none | reject, "no_answer").when(sure, "confident").otherwise("borderline")
    )
    reason = (
        F.when(none, "no_candidates")
        .when(reject, "calibrated_no_answer")
        .when(sure, "calibrated_confident")
        .otherwise("calibrated_borderline")
    )
    return state, reason


def decide(queries: DataFrame, selected: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """One row per query with its evidence, gate result and label.

    The evidence is the first selected chunk; one without a vector counts as
    cosine 0. A query without candidates keeps null evidence.
    """
    top = selected.where(F.col("mmr_rank") == 1).select(
        "qid",
        F.coalesce("cosine", F.lit(0.0)).alias("top_cosine"),
        F.col("rrf").alias("top_rrf"),
        "dense_rank",
        "lexical_rank",
    )
    evidence = queries.select("qid").join(top, "qid", "left")
    cosine, rrf = F.col("top_cosine"), F.col("top_rrf")
    state, reason = calibrated_decision(cosine, rrf, p)
    passed = cosine.isNotNull() & ~gate_rejects(cosine, rrf, p)
    return evidence.select(
        "*",
        F.coalesce(passed, F.lit(False)).alias("gate_passed"),
        state.alias("answer_state"),
        reason.alias("decision_reason"),
    )


def refuse(qids: DataFrame) -> DataFrame:
    """Decisions about invalid queries, which have no evidence: one row per ``qid``."""
    return qids.select(
        "qid",
        F.lit(False).alias("gate_passed"),
        F.lit("invalid_query").alias("answer_state"),
        F.lit("invalid_query").alias("decision_reason"),
    )


def neighbor_window(selected: DataFrame, n_chunks: int) -> DataFrame:
    """Selected chunks in rank order, then the chunk before and after each.

    Returns ``(qid, pos, chunk_idx, score)``; score is null for neighbors. A
    chunk reached twice keeps its earliest place. Neighbors may come from
    another page.
    """
    reached = selected.select(
        "qid",
        "mmr_rank",
        F.col("chunk_idx").alias("hit_idx"),
        "rrf",
        F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("delta"),
    ).select(
        "qid",
        (F.col("hit_idx") + F.col("delta")).alias("chunk_idx"),
        F.struct(
            (F.col("delta") != 0).cast("int").alias("pass"), "mmr_rank", "delta"
        ).alias("place"),
        F.when(F.col("delta") == 0, F.col("rrf")).alias("score"),
    )
    kept = (
        reached.where(F.col("chunk_idx").between(0, n_chunks - 1))
        .groupBy("qid", "chunk_idx")
        .agg(F.min("place").alias("place"), F.max("score").alias("score"))
    )
    order = Window.partitionBy("qid").orderBy("place")
    return kept.select(
        "qid", F.row_number().over(order).alias("pos"), "chunk_idx", "score"
    )


def pack_to_budget(chunks: DataFrame) -> DataFrame:
    """Keep chunks in order until the first one that overflows ``max_tokens``.

    Input ``(qid, pos, tokens, max_tokens, ...)``. The first chunk always stays.
    Adds ``cum_tokens`` and the per-query ``truncated`` flag.
    """
    per_query = Window.partitionBy("qid")
    running = per_query.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = (
        chunks.withColumn("cum_tokens", F.sum("tokens").over(running))
        .withColumn("_first", F.row_number().over(per_query.orderBy("pos")) == 1)
        .withColumn("_total", F.sum("tokens").over(per_query))
    )
    return (
        totals.where(F.col("_first") | (F.col("cum_tokens") <= F.col("max_tokens")))
        .withColumn("truncated", F.col("_total") > F.col("max_tokens"))
        .drop("_first", "_total")
    )
