"""Dense channel: exact nearest chunks by vector, for a whole query batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quillsift.operators.batch import QueryBatch
from quillsift.operators.topk import TaskTopK, rank_scores
from quillsift.session import spread

# Largest score block (chunks x queries) a task holds at once.
BLOCK_CELLS = 4_000_000
# Queries compared at once, and vectors a task holds, when the queries cannot be broadcast.
TILE_QUERIES = 4096
BLOCK_VECTORS = 50_000
# Partial results of a query meet in so many places before they meet in one.
MERGE_BUCKETS = 32


def similarity(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Score block, larger is nearer: negative squared distance, or cosine."""
    products = vectors @ queries.T
    if metric == "l2":
        return 2 * products - (vectors**2).sum(1)[:, None] - (queries**2).sum(1)[None, :]
    if metric == "cosine":
        norms = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(queries, axis=1)
        return np.divide(products, norms, out=np.zeros_like(products), where=norms != 0)
    raise ValueError(f"unknown metric {metric!r}")


def half_precision(queries: np.ndarray) -> np.ndarray:
    """Query lanes as half-precision numbers, which they are compared as with stored half vectors."""
    with np.errstate(over="ignore"):
        return queries.astype(np.float32).astype(np.float16).astype(np.float64)


def _lanes(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _score_schema(batch: QueryBatch) -> StructType:
    return StructType(
        [
            StructField("qid", batch.qid_type),
            StructField("chunk_idx", LongType()),
            StructField("score", DoubleType()),
        ]
    )


def dense_topk(
    batch: QueryBatch, vectors: DataFrame, k: int, metric: str = "l2", block_vectors: int = BLOCK_VECTORS,
    half: bool = False,
) -> DataFrame:
    """The k nearest chunks of every query: ``(qid, chunk_idx, score, dense_rank)``.

    ``vectors`` holds ``(chunk_idx, embedding)``. Every query is compared with
    every vector, as exact search demands, but only k rows per query and task
    leave a task. Queries too many to be broadcast come in tiles to blocks of vectors.
    ``half`` rounds the queries, and only here, to the half precision that a store keeps.
    """
    stored = spread(
        vectors.select(F.col("chunk_idx").cast("long"), "embedding").where(
            F.col("embedding").isNotNull()
        ),
        "chunk_idx",
    )
    if batch.small:
        return rank_scores(_scan(batch, stored, k, metric, half), k, "dense_rank")
    scored = _tiles(batch, stored, k, metric, block_vectors, half)
    return rank_scores(scored, k, "dense_rank", MERGE_BUCKETS)


def _scan(batch: QueryBatch, vectors: DataFrame, k: int, metric: str, half: bool) -> DataFrame:
    """Vectors stay where they are read; the measured query matrix travels."""
    if not batch.rows:
        return vectors.sparkSession.createDataFrame([], _score_schema(batch))
    shared = vectors.sparkSession.sparkContext.broadcast(
        (batch.qids, half_precision(batch.matrix) if half else batch.matrix)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries = shared.value
        best = TaskTopK(len(qids), k)
        step = max(1, BLOCK_CELLS // len(qids))
        for arrow in batches:
            for start in range(0, arrow.num_rows, step):
                part = arrow.slice(start, step)
                best.offer(
                    part.column("chunk_idx").to_numpy(),
                    similarity(_lanes(part.column("embedding")), queries, metric),
                )
        yield best.to_batch(qids)

    return vectors.mapInArrow(score, _score_schema(batch))


def _tiles(
    batch: QueryBatch, vectors: DataFrame, k: int, metric: str, block_vectors: int, half: bool
) -> DataFrame:
    """Query tiles pass over blocks of vectors that stay where they are.

    Each vector is dealt once into a block of about ``block_vectors``; each query visits every block.
    A task holds its block, then streams the queries through it a tile at a time.
    """
    blocks = max(1, math.ceil(vectors.count() / block_vectors))
    none = F.lit(None)
    held = vectors.select(
        F.pmod(F.xxhash64("chunk_idx"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(False).alias("asks"),
        "chunk_idx",
        none.cast(batch.qid_type).alias("qid"),
        F.col("embedding").cast("array<double>").alias("lanes"),
    )
    asked = batch.df.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(True).alias("asks"),
        none.cast("long").alias("chunk_idx"),
        "qid",
        F.col("qvec").alias("lanes"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, lanes = None, [], []
        for arrow in batches:
            for part in _runs(arrow):
                if part.column("block")[0].as_py() != block:
                    block, ids, lanes = part.column("block")[0].as_py(), [], []
                if not part.column("asks")[0].as_py():
                    ids.append(part.column("chunk_idx").to_numpy())
                    lanes.append(_lanes(part.column("lanes")))
                elif ids:
                    ids, lanes = [np.concatenate(ids)], [np.concatenate(lanes)]
                    for start in range(0, part.num_rows, TILE_QUERIES):
                        tile = part.slice(start, TILE_QUERIES)
                        yield compared(tile.column("qid"), _lanes(tile.column("lanes")), ids[0], lanes[0])

    def compared(qids: pa.Array, queries: np.ndarray, ids: np.ndarray, lanes: np.ndarray) -> pa.RecordBatch:
        best = TaskTopK(len(qids), k)
        queries = half_precision(queries) if half else queries
        step = max(1, BLOCK_CELLS // len(qids))
        for start in range(0, len(ids), step):
            part = slice(start, start + step)
            best.offer(ids[part], similarity(lanes[part], queries, metric))
        return best.to_batch(qids)

    placed = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    return placed.mapInArrow(score, _score_schema(batch))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a sorted batch within which block and side stay the same."""
    if batch.num_rows == 0:
        return
    key = batch.column("block").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(start, end - start)
