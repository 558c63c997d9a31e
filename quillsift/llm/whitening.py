"""Operator 13: embedding whitening by a bidiagonal qd solver.

1. One scan sums every dimension exactly, in integers.
2. Every task reduces its centred rows block by block to a triangle R (QR of R over the next
   block), triangles of ``FAN`` tasks are reduced again until one is left. R'R is the covariance
   times n, but is never formed.
3. ``qd_svd`` bidiagonalises that triangle, finds its singular values by dqds and its right
   vectors by twisted factorisations. The triangle's size is fixed by the width, so it is
   solved on the driver.
4. Rows are projected on the directions over the root of their variance; one more scan sums the
   products of what came out, for its distance from the identity.

Entries become whole numbers floor(64 * c) + 1000000 first, so sums and deviations are exact.

A vector takes no part if it is null or empty or has a null, a non-finite or a too large entry
(2**34 or more). One fit holds vectors of one length: the most frequent (of equally frequent ones
the longest); others take no part. A component needs a variance above rounding, so fewer rows or
constant or copied dimensions give fewer components; with none there are no rows. Repeated rows
and ids count each; a null id is handed on. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.qd_svd import right_singular
from quillsift.session import checkpointed

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 34)
BLOCK_ROWS = 4096
FAN = 16
SCHEMA = (
    "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def whole_vectors(batch: pa.RecordBatch, width: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, vectors as whole numbers) of the rows that take part, by vector length."""
    for begin in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(begin, BLOCK_ROWS)
        vectors = part.column("vector")
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        for length in np.unique(lengths).tolist():
            if length == 0 or width not in (None, length):
                continue
            own = np.flatnonzero(lengths == length)
            entries = pc.list_flatten(vectors.take(pa.array(own)))
            table = pc.fill_null(entries.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            table = table.reshape(-1, length)
            good = (np.abs(table) < LARGEST).all(axis=1)
            if good.any():
                whole = np.floor(SCALE * table[good]).astype(np.int64) + OFFSET
                yield part.column("id").take(pa.array(own[good])), whole


def _source(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return table.select(table[id_col].cast("long").alias("id"), table[vector_col].alias("vector"))


def sums(rows: DataFrame) -> DataFrame:
    """(width, dim, n, total) of all vectors that take part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, whole in whole_vectors(batch):
                entry = held.setdefault(whole.shape[1], [0, np.zeros(whole.shape[1], dtype=object)])
                entry[0] += len(whole)
                entry[1] += whole.sum(axis=0)
        for width, (count, total) in held.items():
            columns = [
                pa.array([width] * width, pa.int32()),
                pa.array(range(width), pa.int32()),
                pa.array([count] * width, pa.int64()),
                pa.array(total.tolist(), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["width", "dim", "n", "total"])

    parts = rows.select(F.lit(None).cast("long").alias("id"), "vector")
    parts = parts.mapInArrow(run, "width int, dim int, n long, total long")
    return parts.groupBy("width", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )


class Mean:
    """Sums of the fit list, and exact differences from them."""

    def __init__(self, count: int, totals: list[int]) -> None:
        self.count, self.totals = count, totals
        self.floor = np.array([t // count for t in totals], dtype=np.int64)
        self.rest = np.array([t % count for t in totals], dtype=np.float64) / count

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return (whole - self.floor) - self.rest

    def deviations(self, whole: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S) ** 2, in whole numbers."""
        kind = pa.decimal128(38, 0)
        bound = self.count * (float(np.abs(whole - self.floor).max()) + 1)
        if bound * bound * whole.shape[1] < 2.0**62 and self.count * (float(np.abs(whole).max()) + 1) < 2.0**62:
            off = whole * self.count - np.array(self.totals, dtype=np.int64)
            return pa.array((off * off).sum(axis=1)).cast(kind)
        off = whole.astype(object) * self.count - np.array(self.totals, dtype=object)
        return pa.array([str(v) for v in (off * off).sum(axis=1)]).cast(kind)


def triangle(rows: DataFrame, width: int, mean: Mean) -> np.ndarray:
    """R of the centred rows: R'R is n times the covariance."""

    def reduce_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            for _, whole in whole_vectors(batch, width):
                held = np.linalg.qr(np.vstack([held, mean.centred(whole)]), mode="r")
        if len(held):
            yield _packed([TaskContext.get().partitionId()], [held])

    def reduce_triangles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("triangle").to_pylist(), strict=True):
                own = np.frombuffer(data).reshape(-1, width)
                if part // FAN != key:
                    if key is not None:
                        yield _packed([key], [held])
                    key, held = part // FAN, own
                else:
                    held = np.linalg.qr(np.vstack([held, own]), mode="r")
        if key is not None:
            yield _packed([key], [held])

    def _packed(keys: list[int], triangles: list[np.ndarray]) -> pa.RecordBatch:
        data = pa.array([np.ascontiguousarray(t).tobytes() for t in triangles], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), data], ["part", "triangle"])

    schema = "part long, triangle binary"
    parts = rows.rdd.getNumPartitions()
    found = rows.mapInArrow(reduce_rows, schema)
    while parts > 1:
        parts = -(-parts // FAN)
        found = found.repartition(parts, F.floor(F.col("part") / FAN)).sortWithinPartitions("part")
        found = found.mapInArrow(reduce_triangles, schema)
    held = [np.frombuffer(r["triangle"]).reshape(-1, width) for r in found.collect()]
    full = np.zeros((width, width))
    full[: len(held[0])] = held[0]
    return full


def identity_distance(rows: DataFrame, width: int, mean: Mean, directions: np.ndarray) -> float:
    """Largest absolute entry of the projections' covariance minus the identity."""
    count = directions.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One more column of ones: its products are the sums.
        total = np.zeros((count + 1, count + 1))
        for batch in batches:
            for _, whole in whole_vectors(batch, width):
                out = np.c_[mean.centred(whole) @ directions, np.ones(len(whole))]
                total += out.T @ out
        at = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    summed = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    total = np.zeros((count + 1, count + 1))
    for row in summed.collect():
        total.ravel()[row["at"]] = row["value"]
    means = total[:count, count] / mean.count
    covariance = total[:count, :count] / mean.count - np.outer(means, means)
    return float(np.abs(covariance - np.eye(count)).max())


def whiten(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row and component."""
    spark = table.sparkSession
    rows = _source(table, id_col, vector_col)
    found = checkpointed(sums(rows))
    widest = found.where("dim = 0").orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widest:
        return spark.createDataFrame([], SCHEMA)
    width, count = widest[0]["width"], widest[0]["n"]
    totals = [int(r["total"]) for r in found.where(F.col("width") == width).orderBy("dim").collect()]
    mean = Mean(count, totals)
    values, vectors = right_singular(triangle(rows, width, mean), components)
    if vectors.shape[1] == 0:
        return spark.createDataFrame([], SCHEMA)
    variances = values / count
    directions = vectors / np.sqrt(variances[: vectors.shape[1]])
    error = identity_distance(rows, width, mean, directions)
    return _projected(rows, width, mean, directions, variances / variances.sum(), F.lit(error))


def _projected(
    rows: DataFrame, width: int, mean: Mean, directions: np.ndarray, explained: np.ndarray, error: Column
) -> DataFrame:
    count = directions.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, whole in whole_vectors(batch, width):
                size = len(whole)
                row = pa.array(np.repeat(np.arange(size), count))
                columns = [
                    ids.take(row),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * count, mean.count, dtype=np.int64)),
                    mean.deviations(whole).take(row),
                    pa.array((mean.centred(whole) @ directions).ravel()),
                    pa.array(np.tile(explained[:count], size)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained"])

    schema = SCHEMA.rsplit(",", 1)[0]
    return rows.mapInArrow(run, schema).withColumn("identity_error", error)
