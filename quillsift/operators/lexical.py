"""Lexical channel: BM25 over chunk text, for a whole query batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quillsift.functions.text import terms
from quillsift.operators.batch import Analyzer, QueryBatch
from quillsift.operators.topk import TaskTopK, rank_scores
from quillsift.params import SearchParams
from quillsift.session import spread

# Most (chunk, term, query) incidences a task expands at once.
BLOCK_INCIDENCES = 4_000_000
# Chunks per salt of a term in the shuffled join.
CHUNKS_PER_SALT = 1_000_000
MAX_SALTS = 512


def idf(n_chunks: Column | float, df: Column) -> Column:
    return F.log(1 + (F.lit(n_chunks) - df + 0.5) / (df + 0.5))


def term_weight(tf, length, mean_length: float, p: SearchParams):
    """Saturated, length-normalized term frequency; works on columns and arrays."""
    norm = 1 - p.bm25_b + p.bm25_b * length / mean_length
    return tf * (p.bm25_k1 + 1) / (tf + p.bm25_k1 * norm)


def postings(chunks: DataFrame, analyzer: Analyzer = terms) -> DataFrame:
    """Inverted index rows ``(term, chunk_idx, tf, length)`` of ``(chunk_idx, text)``."""
    tokens = chunks.select("chunk_idx", analyzer(F.col("text")).alias("terms"))
    return (
        tokens.select(
            "chunk_idx", F.size("terms").alias("length"), F.explode("terms").alias("term")
        )
        .groupBy("chunk_idx", "term", "length")
        .agg(F.count("*").alias("tf"))
        .select("term", "chunk_idx", "tf", "length")
    )


def bm25_topk(
    batch: QueryBatch,
    chunks: DataFrame,
    k: int,
    p: SearchParams = SearchParams(),
    index: DataFrame | None = None,
) -> DataFrame:
    """The k best chunks of every query: ``(qid, chunk_idx, score, lexical_rank)``.

    A chunk is a candidate only when it shares a term with the query; each
    distinct query term counts once. Without an ``index`` a small batch scans the
    text and a large one builds postings; a stored ``index`` (see ``postings``)
    is read instead of the text; it must come from the batch's analyzer.
    """
    if index is not None:
        scored = _join(batch, index, _index_totals(chunks, index), p)
    else:
        stored = spread(chunks.select(F.col("chunk_idx").cast("long"), "text"), "chunk_idx")
        if batch.small:
            scored = _scan(batch, stored, k, p)
        else:
            scored = _join(batch, postings(stored, batch.analyzer), _text_totals(batch, stored), p)
    return rank_scores(scored, k, "lexical_rank")


def _text_totals(batch: QueryBatch, chunks: DataFrame) -> tuple[int, int]:
    row = chunks.agg(
        F.count("*").alias("n"), F.sum(F.size(batch.analyzer(F.col("text")))).alias("total")
    ).first()
    return row["n"], row["total"] or 0


def _index_totals(chunks: DataFrame, index: DataFrame) -> tuple[int, int]:
    """Chunk count from the table, total length from the postings; no text is read."""
    total = index.agg(F.sum("tf").alias("total")).first()["total"]
    return chunks.count(), total or 0


def _score_schema(batch: QueryBatch) -> StructType:
    return StructType(
        [
            StructField("qid", batch.qid_type),
            StructField("chunk_idx", LongType()),
            StructField("score", DoubleType()),
        ]
    )


def _vocabulary_stats(
    batch: QueryBatch, chunks: DataFrame, vocabulary: list[str]
) -> tuple[dict[str, int], int, int]:
    """Document frequency of each query term, chunk count and total length.

    One scan: every chunk contributes its distinct terms and one row under the
    empty term that carries its length. Counts combine before the shuffle.
    """
    spark = chunks.sparkSession
    wanted = spark.createDataFrame(pa.table({"term": [*vocabulary, ""]}))
    tokens = chunks.select(batch.analyzer(F.col("text")).alias("terms"))
    rows = tokens.select(
        F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit("")))).alias("term"),
        F.size("terms").cast("long").alias("length"),
    )
    found = (
        rows.join(F.broadcast(wanted), "term")
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("length").alias("length"))
        .collect()
    )
    frequency = {r["term"]: r["df"] for r in found}
    n_chunks = frequency.pop("", 0)
    total = next((r["length"] for r in found if r["term"] == ""), 0)
    return frequency, n_chunks, total


def _scan(batch: QueryBatch, chunks: DataFrame, k: int, p: SearchParams) -> DataFrame:
    """Text stays where it is read; the measured query vocabulary travels."""
    spark = chunks.sparkSession
    vocabulary = sorted({t for r in batch.rows for t in r["terms"]})
    frequency, n_chunks, total = _vocabulary_stats(batch, chunks, vocabulary)
    vocabulary = [t for t in vocabulary if t in frequency]
    if not vocabulary:
        return spark.createDataFrame([], _score_schema(batch))
    position = {t: i for i, t in enumerate(vocabulary)}
    owners: list[list[int]] = [[] for _ in vocabulary]
    for q, row in enumerate(batch.rows):
        for t in row["terms"]:
            if t in position:
                owners[position[t]].append(q)
    fanout = np.array([len(o) for o in owners])
    starts = np.concatenate([[0], np.cumsum(fanout)])
    df = np.array([frequency[t] for t in vocabulary], dtype=np.float64)
    weights = np.log(1 + (n_chunks - df + 0.5) / (df + 0.5))
    mean_length = total / n_chunks
    shared = spark.sparkContext.broadcast(
        (batch.qids, pa.array(vocabulary), weights, fanout, starts, np.concatenate(owners))
    )

    def block_scores(lengths, doc, term, n_queries, weights, fanout, starts, owners):
        """Score block of some chunks from their (doc, term) occurrences."""
        pair, tf = np.unique(doc * len(weights) + term, return_counts=True)
        doc, term = np.divmod(pair, len(weights))
        gain = weights[term] * term_weight(tf, lengths[doc], mean_length, p)
        repeat = fanout[term]
        offset = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        query = owners[np.repeat(starts[term], repeat) + offset]
        cell = np.repeat(doc, repeat) * n_queries + query
        size = lengths.size * n_queries
        scores = np.bincount(cell, weights=np.repeat(gain, repeat), minlength=size)
        return np.where(scores > 0, scores, np.nan).reshape(lengths.size, n_queries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, terms_known, weights, fanout, starts, owners = shared.value
        best = TaskTopK(len(qids), k)
        step = max(1, BLOCK_INCIDENCES // max(1, owners.size))
        for arrow in batches:
            for begin in range(0, arrow.num_rows, step):
                part = arrow.slice(begin, step)
                tokens = part.column("terms")
                lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), lengths)
                code = pc.index_in(tokens.flatten(), value_set=terms_known)
                known = code.is_valid().to_numpy(zero_copy_only=False)
                code = code.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                best.offer(
                    part.column("chunk_idx").to_numpy(),
                    block_scores(
                        lengths, doc[known], code[known], len(qids), weights, fanout, starts, owners
                    ),
                )
        yield best.to_batch(qids)

    tokens = chunks.select("chunk_idx", batch.analyzer(F.col("text")).alias("terms"))
    return tokens.mapInArrow(score, _score_schema(batch))


def _join(
    batch: QueryBatch, index: DataFrame, totals: tuple[int, int], p: SearchParams
) -> DataFrame:
    """Postings joined with query terms on (term, salt).

    A common term is in a large share of all chunks; its postings spread over
    the salts while the far smaller query side repeats once per salt. Scores
    combine before the shuffle by (qid, chunk).
    """
    n_chunks, total = totals
    mean_length = total / n_chunks if n_chunks else 1.0
    salts = min(MAX_SALTS, max(1, math.ceil(n_chunks / CHUNKS_PER_SALT)))
    asked = batch.df.select(
        "qid", F.explode(F.array_distinct(batch.analyzer(F.col("query")))).alias("term")
    )
    if batch.small:
        # Few terms are asked for: leave the other postings where they are.
        index = index.join(batch.sized(asked.select("term")), "term", "left_semi")
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.join(frequency, "term").select(
        "qid",
        "term",
        idf(n_chunks, F.col("df")).alias("weight"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    salted = index.withColumn(
        "salt", F.pmod(F.xxhash64("chunk_idx"), F.lit(salts)).cast("int")
    )
    gain = F.col("weight") * term_weight(F.col("tf"), F.col("length"), mean_length, p)
    return (
        salted.join(weighted, ["term", "salt"])
        .groupBy("qid", "chunk_idx")
        .agg(F.sum(gain).alias("score"))
    )
