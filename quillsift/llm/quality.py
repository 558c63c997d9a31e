"""Operator 10: quality classifier on hashed word n-grams.

Features are hashed n-grams of words (one and two) and of word shapes (one to three), each
weighing its share of the document's n-grams. Shapes hold what a word is made of: kinds of
characters, its last two marks, and whether it repeats the word before. A logistic regression
is trained with follow-the-regularised-leader updates; a score is a sparse dot product.

Training takes the ``train_rows`` labelled rows with the smallest hash of their id (all of
them, if fewer), a documented bound; every row is scored from its whole text.

Null texts count as empty and score by the bias alone. A row without usable labels for training
scores 0.5 everywhere. Several labels of one id count by the smallest; null labels do not count.
Rows with a null id are scored and not learned from; repeated ids keep their own rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.arrow_text import id_and_text, remainder, slices
from quillsift.llm.word_hash import LOWER, SPACE, Words, chained, mix, words_of

BITS = 18
TRAIN_ROWS = 6000
THRESHOLD = 0.7
HELD_OUT = 2
EPOCHS = 4
SCORED = "id long, held_out boolean, score double, predicted int"
#: Share of each family of n-grams: words 1 and 2, shapes 1, 2 and 3.
FAMILY_SCALE = (2.0, 2.0, 8.0, 8.0, 8.0)

_KIND = np.full(256, 16, dtype=np.uint8)  # marks
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 4
_KIND[0x80:] = 8
_KIND[SPACE] = 0


def shapes(words: Words) -> np.ndarray:
    """A hash of each word's shape."""
    if not len(words.starts):
        return np.zeros(0, dtype=np.uint64)
    kinds = _KIND[words.data]
    made_of = np.bitwise_or.reduceat(kinds, words.starts).astype(np.uint64)
    long = np.minimum(words.ends - words.starts, 24) // 6
    last, before = words.ends - 1, np.maximum(words.ends - 2, words.starts)
    final = np.where(kinds[last] == 16, LOWER[words.data[last]], kinds[last]).astype(np.uint64)
    second = np.where(kinds[before] == 16, LOWER[words.data[before]], kinds[before]).astype(np.uint64)
    again = np.zeros(len(words.starts), dtype=np.uint64)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    firsts = words.bounds[:-1][words.counts() > 0]
    again[firsts] = 0
    value = made_of | (kinds[words.starts].astype(np.uint64) << np.uint64(8)) | (final << np.uint64(16))
    value |= (second << np.uint64(24)) | (long.astype(np.uint64) << np.uint64(32)) | (again << np.uint64(40))
    return mix(value)


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: the feature of every n-gram, and the text it belongs to."""
    owners, shape = words.owners(), shapes(words)
    out = []
    for family, (base, size) in enumerate(((words.hashes, 1), (words.hashes, 2), (shape, 1), (shape, 2), (shape, 3))):
        grams = chained(base, size) if size > 1 else base
        whole = owners[: len(grams)] == owners[len(owners) - len(grams) :]
        index = mix(grams + np.uint64(family)) >> np.uint64(64 - BITS)
        out.append((index[whole].astype(np.int64), owners[: len(grams)][whole]))
    return out


def dot(words: Words, weights: np.ndarray, bias: float) -> np.ndarray:
    """Bias plus the weighted share of every feature, for each text."""
    texts = len(words.bounds) - 1
    total = np.full(texts, bias)
    for scale, (index, owner) in zip(FAMILY_SCALE, features(words), strict=True):
        count = np.bincount(owner, minlength=texts)
        total += scale * np.bincount(owner, weights[index], texts) / np.maximum(count, 1)
    return total


def sparse_rows(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, values) of each text."""
    texts = len(words.bounds) - 1
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(texts)]
    for scale, (index, owner) in zip(FAMILY_SCALE, features(words), strict=True):
        edges = np.searchsorted(owner, np.arange(texts + 1))
        for n in range(texts):
            own = index[edges[n] : edges[n + 1]]
            if len(own):
                numbers, counts = np.unique(own, return_counts=True)
                found[n].append((numbers, scale * counts / len(own)))
    rows = []
    for parts in found:
        if parts:
            numbers, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            rows.append((numbers, np.bincount(back, np.concatenate([p[1] for p in parts]))))
        else:
            rows.append((np.zeros(0, dtype=np.int64), np.zeros(0)))
    return rows


class Ftrl:
    """Logistic regression by follow-the-regularised-leader, one weight per feature."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        """One update; the bias is the last feature."""
        index, values = np.append(index, 1 << BITS), np.append(values, 1.0)
        weights = self.weights(index)
        gradient = (sigmoid(weights @ values) - label) * values
        squared = gradient * gradient
        rate = (np.sqrt(self.n[index] + squared) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += gradient - rate * weights
        self.n[index] += squared


def sigmoid(value: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(value, -40, 40)))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias from rows (id, text, label), at most ``train_rows`` of them.

    The sample is a top-k by hash; its sparse rows meet in one task, which trains.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = sparse_rows(words_of(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("rank"),
                    part.column("label"),
                    pa.array([r[0].astype(np.int32) for r in found], pa.list_(pa.int32())),
                    pa.array([r[1].astype(np.float32) for r in found], pa.list_(pa.float32())),
                ],
                ["rank", "label", "features", "shares"],
            )

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for label, index, values in zip(batch.column("label").to_pylist(), batch.column("features"), batch.column("shares"), strict=True):
                examples.append((label, index.values.to_numpy(), values.values.to_numpy().astype(np.float64)))
        if examples:
            model = Ftrl()
            for _ in range(EPOCHS):
                for label, index, values in examples:
                    model.learn(index, values, label)
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.weights(slice(None)).tobytes()], pa.binary())], ["weights"]
            )

    sparse = labelled.mapInArrow(rows, "rank long, label int, features array<int>, shares array<float>")
    fitted = (
        sparse.repartition(1).sortWithinPartitions("rank").mapInArrow(fit, "weights binary").collect()
    )
    if not fitted:
        return np.zeros(1 << BITS), 0.0
    weights = np.frombuffer(fitted[0]["weights"])
    return weights[:-1], float(weights[-1])


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int
) -> DataFrame:
    """(rank, text, label) of the labelled rows with the smallest hashes of their id."""
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label"))
    chosen = (
        known.where(F.col("label").isNotNull() & (remainder(F.col("id"), 4) != HELD_OUT))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .select("*", F.xxhash64("id").alias("rank"))
        .orderBy("rank", "id")
        .limit(train_rows)
    )
    # A broadcast of at most train_rows narrow rows.
    return id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "id").select("rank", "text", "label")


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int
) -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled rows that are not held out."""
    return train(training_rows(docs, labels, id_col, text_col, label_col, train_rows))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(id, held_out, score, predicted), one row per document."""
    weights, bias = learn(docs, labels, id_col, text_col, label_col, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 1 MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            score = sigmoid(dot(words_of(part.column("text")), shared.value, bias))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("held_out"),
                    pa.array(score, pa.float64()),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                ],
                ["id", "held_out", "score", "predicted"],
            )

    held_out = F.coalesce(remainder(docs[id_col], 4) == HELD_OUT, F.lit(False)).alias("held_out")
    return id_and_text(docs, id_col, text_col, held_out).mapInArrow(run, SCORED)


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    weights, bias = learn(docs, labels, id_col, text_col, label_col, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 1 MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts = pc.fill_null(part.column(text_col), "")
            yield part.filter(pa.array(sigmoid(dot(words_of(texts), shared.value, bias)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
