"""Keeping the k best scores per query, inside a task and across tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Scores are compared after rounding, so that equal scores tie on every engine.
SCORE_DIGITS = 9


class TaskTopK:
    """The k best (score, chunk) pairs of each query seen so far by one task."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.n_queries = n_queries
        # Key of the k-th best per query; anything below can no longer matter.
        self._cut = np.full(n_queries, -np.inf)
        self._held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._n_held = 0
        self._room = 2 * n_queries * k + 100_000

    def offer(self, chunk_ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer an (n chunks x n queries) score block; NaN means no match."""
        key = np.where(np.isnan(scores), -np.inf, np.round(scores, SCORE_DIGITS))
        floor = self._cut
        if key.shape[0] > self.k:
            floor = np.maximum(floor, np.partition(key, -self.k, axis=0)[-self.k])
        row, query = np.nonzero((key >= floor) & (key > -np.inf))
        self._held.append((query, chunk_ids[row], scores[row, query]))
        self._n_held += query.size
        if self._n_held > self._room:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drop what fell out; (query position, chunk, score), best first per query."""
        if not self._held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, chunk, score = (np.concatenate(part) for part in zip(*self._held))
        key = np.round(score, SCORE_DIGITS)
        order = np.lexsort((chunk, -key, query))
        first = np.searchsorted(query[order], np.arange(self.n_queries))
        place = np.arange(order.size) - first[query[order]]
        order, place = order[place < self.k], place[place < self.k]
        last = order[place == self.k - 1]
        self._cut[query[last]] = key[last]
        self._held = [(query[order], chunk[order], score[order])]
        self._n_held = order.size
        return self._held[0]

    def to_batch(self, qids: pa.Array) -> pa.RecordBatch:
        query, chunk, score = self.best()
        return pa.RecordBatch.from_arrays(
            [qids.take(pa.array(query)), pa.array(chunk), pa.array(score)],
            names=["qid", "chunk_idx", "score"],
        )


def rank_scores(scored: DataFrame, k: int, rank_name: str, buckets: int = 1) -> DataFrame:
    """Rank (qid, chunk_idx, score) per query and keep the first k.

    Ties go to the smaller chunk index. Each input task drops all but its own k
    best rows before the shuffle (WindowGroupLimit), so no query floods a task. With
    ``buckets`` the rows of very many tasks meet in that many places first.
    """
    order = [F.round("score", SCORE_DIGITS).desc(), F.col("chunk_idx")]
    if buckets > 1:
        place = F.row_number().over(Window.partitionBy("qid", "_bucket").orderBy(*order))
        spread = scored.withColumn("_bucket", F.spark_partition_id() % buckets)
        scored = spread.withColumn("_place", place).where(F.col("_place") <= k).drop("_bucket", "_place")
    best = Window.partitionBy("qid").orderBy(*order)
    return (
        scored.withColumn(rank_name, F.row_number().over(best))
        .where(F.col(rank_name) <= k)
        .select("qid", "chunk_idx", "score", rank_name)
    )
