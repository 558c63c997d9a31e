"""Operator 4: nearest neighbours by a block matrix join.

Vectors become unit vectors, quantised to int8 with one scale each. A tile is the product of a
block of queries with a block of candidates; with the length of both quantisation errors it
gives bounds on every cosine. Pairs whose upper bound reaches the k-th best lower bound of
their query are recomputed on the original vectors in double precision, and heaps keep k of
them per query. The result is exact.

Queries travel in blocks of a fixed number of bytes, one scan of the candidates each, so what
is broadcast does not grow with the data. Of candidates with one and the same vector a task
keeps the k + 1 smallest ids (one may be the query itself), which no ranking can miss; the
per-task winners of a query meet in two steps.

Null, zero and non-finite vectors and rows with a null id take no part; of vectors of other
lengths than a query's none is its neighbour. A repeated id is a candidate once per row, never
for a query of that id. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
TILE_ROWS = 2048
MERGE_BUCKETS = 32
FOUND = "query_id long, vec_id long, score double"
_SLACK = 1e-5


class Quantised:
    """Unit vectors in int8, their scales and the lengths of their quantisation errors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.lengths = np.sqrt((vectors * vectors).sum(axis=1))
        units = vectors / self.lengths[:, None]
        self.scales = np.abs(units).max(axis=1) / 127
        codes = np.rint(units / self.scales[:, None])
        self.codes = codes.astype(np.int8)
        near = codes * self.scales[:, None]
        self.errors = np.linalg.norm(units - near, axis=1)
        self.near_lengths = np.linalg.norm(near, axis=1)

    def part(self, begin: int, end: int) -> tuple[np.ndarray, ...]:
        cut = slice(begin, end)
        return self.codes[cut].astype(np.float32), self.scales[cut], self.errors[cut], self.near_lengths[cut]


def usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors in double precision) of the rows that take part, by vector length."""
    by_length: dict[int, list[tuple[int, list]]] = defaultdict(list)
    for key, vector in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
        if key is not None and vector and None not in vector:
            by_length[len(vector)].append((key, vector))
    for rows in by_length.values():
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        vectors = np.array([r[1] for r in rows], dtype=np.float64)
        largest = np.abs(vectors).max(axis=1)
        kept = np.isfinite(vectors).all(axis=1) & (largest > 0)
        ids, vectors = ids[kept], vectors[kept]
        if len(ids):
            yield ids, vectors


def first_copies(ids: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with the same vector only the ``keep`` smallest ids."""
    rows = np.ascontiguousarray(vectors + 0.0).view([("", vectors.dtype)] * vectors.shape[1]).ravel()
    _, group = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, group))
    sorted_group = group[order]
    begins = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    kept = order[place < keep]
    return ids[kept], vectors[kept]


def cosines(queries: np.ndarray, candidates: np.ndarray, lengths: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed row by row so that equal pairs give equal values."""
    return (queries * candidates).sum(axis=1) / (lengths * others)


def search_tile(queries: Quantised, candidates: Quantised, k: int, best: list[list[tuple[float, int]]]) -> None:
    """Bring the queries' heaps of (score, -id) up to date with the candidates."""
    for begin in range(0, len(queries.ids), TILE_ROWS):
        end = min(begin + TILE_ROWS, len(queries.ids))
        q_codes, q_scales, q_errors, q_near = queries.part(begin, end)
        c_codes, c_scales, c_errors, _ = candidates.part(0, len(candidates.ids))
        product = (q_codes @ c_codes.T) * q_scales[:, None].astype(np.float32) * c_scales[None, :].astype(np.float32)
        slack = (q_errors[:, None] + q_near[:, None] * c_errors[None, :]).astype(np.float32) + _SLACK
        own = queries.ids[begin:end, None] == candidates.ids[None, :]
        lower = np.where(own, -np.inf, product - slack)
        if lower.shape[1] > k:
            floor = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
        else:
            floor = np.full(end - begin, -np.inf)
        held = [best[n][0][0] if len(best[n]) == k else -np.inf for n in range(begin, end)]
        floor = np.maximum(floor, np.array(held, dtype=np.float64) - 1e-9)
        rows, columns = np.nonzero((product + slack >= floor[:, None]) & ~own)
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
            exact = cosines(
                queries.vectors[begin + r], candidates.vectors[c], queries.lengths[begin + r], candidates.lengths[c]
            )
            for n, score, key in zip((begin + r).tolist(), exact.tolist(), candidates.ids[c].tolist(), strict=True):
                heap = best[n]
                if len(heap) < k:
                    heapq.heappush(heap, (score, -key))
                elif (score, -key) > heap[0]:
                    heapq.heapreplace(heap, (score, -key))


def nearest(
    table: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of ``table``, nearest first."""
    spark = table.sparkSession
    candidates = table.select(table[id_col].cast("long").alias("id"), table[vector_col].alias("vector"))
    asked = queries.select(queries[id_col].cast("long").alias("id"), queries[vector_col].alias("vector")).where(
        "id is not null and vector is not null"
    )
    found = None
    for shared in _query_blocks(asked, block_bytes):

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks = [Quantised(ids, vectors) for ids, vectors in shared.value]
            heaps: list[list[list[tuple[float, int]]]] = [[[] for _ in b.ids] for b in blocks]
            for batch in batches:
                for begin in range(0, batch.num_rows, TILE_ROWS):
                    for ids, vectors in usable(batch.slice(begin, TILE_ROWS)):
                        tile = Quantised(*first_copies(ids, vectors, k + 1))
                        for block, best in zip(blocks, heaps, strict=True):
                            if block.vectors.shape[1] == vectors.shape[1]:
                                search_tile(block, tile, k, best)
            for block, best in zip(blocks, heaps, strict=True):
                rows = [(q, -key, s) for q, heap in zip(block.ids.tolist(), best, strict=True) for s, key in heap]
                if rows:
                    q, v, s = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())],
                        ["query_id", "vec_id", "score"],
                    )

        part = candidates.mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    by_bucket = Window.partitionBy("query_id", "bucket").orderBy(F.desc("score"), "vec_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("bucket", F.spark_partition_id() % MERGE_BUCKETS)
        .withColumn("place", F.row_number().over(by_bucket))
        .where(F.col("place") <= k)
        .withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _query_blocks(asked: DataFrame, block_bytes: int) -> Iterator:
    """Broadcasts of (ids, vectors) of at most about ``block_bytes``, one partition's rows at a time."""
    context = asked.sparkSession.sparkContext

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors in usable(batch):
                step = max(1, block_bytes // 8 // (8 * vectors.shape[1]))
                for begin in range(0, len(ids), step):
                    part = slice(begin, begin + step)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([vectors.shape[1]], pa.int32()),
                            pa.array([ids[part].tobytes()], pa.binary()),
                            pa.array([vectors[part].tobytes()], pa.binary()),
                        ],
                        ["width", "ids", "vectors"],
                    )

    packed = asked.mapInArrow(pack, "width int, ids binary, vectors binary")
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for row in packed.toLocalIterator():
        ids = np.frombuffer(row["ids"], dtype=np.int64)
        vectors = np.frombuffer(row["vectors"]).reshape(-1, row["width"])
        held.append((ids, vectors))
        size += vectors.nbytes
        if size >= block_bytes:
            yield context.broadcast(_by_width(held))
            held, size = [], 0
    if held:
        yield context.broadcast(_by_width(held))


def _by_width(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    widths: dict[int, list] = defaultdict(list)
    for ids, vectors in held:
        widths[vectors.shape[1]].append((ids, vectors))
    return [(np.concatenate([i for i, _ in v]), np.concatenate([m for _, m in v])) for v in widths.values()]
