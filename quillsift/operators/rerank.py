"""Optional reranking of the fused pool, with the local order as fallback."""

from __future__ import annotations

import threading
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quillsift import params
from quillsift.functions.text import sanitize_chunk, terms, truncate_utf8
from quillsift.session import checkpointed

# A reranker maps (qid, query, chunk_idx, position, document) rows to
# (qid, chunk_idx, rerank_pos[, status]) rows, positions counting from 0. A row with a
# status says why its query has no order and carries no chunk.
Reranker = Callable[[DataFrame], DataFrame]
# A ranker orders the documents of one query: their places, best first.
QueryRanker = Callable[[str, list[str]], list[int]]


def clean_parts(chunks: DataFrame) -> DataFrame:
    """Sanitized heading and text of chunks, each within the byte limit."""
    limit = params.RERANK_MAX_BYTES
    return chunks.select(
        "chunk_idx",
        truncate_utf8(sanitize_chunk(F.col("heading_path")), limit).alias("heading_part"),
        truncate_utf8(sanitize_chunk(F.col("text")), limit).alias("text_part"),
    )


def rerank_documents(pool: DataFrame) -> DataFrame:
    """Document text to rerank, for the queries whose whole pool qualifies.

    ``pool`` rows carry the ``clean_parts`` of their chunk. A pool of more than
    40 candidates, with a repeated chunk, or with a candidate that sanitizes to
    nothing yields no documents at all.
    """
    heading, text = F.col("heading_part"), F.col("text_part")
    per_query = Window.partitionBy("qid")
    return (
        pool.withColumn("_n", F.count("*").over(per_query))
        .withColumn("_distinct", F.size(F.collect_set("chunk_idx").over(per_query)))
        .withColumn("_empty", F.max(((heading == "") & (text == "")).cast("int")).over(per_query))
        .where(
            (F.col("_n") <= params.RERANK_MAX_DOCUMENTS)
            & (F.col("_n") == F.col("_distinct"))
            & (F.col("_empty") == 0)
        )
        .withColumn(
            "document",
            truncate_utf8(F.concat(heading, F.lit("\n\n"), text), params.RERANK_MAX_BYTES),
        )
        .drop("_n", "_distinct", "_empty", "heading_part", "text_part")
    )


def overlap_reranker(documents: DataFrame) -> DataFrame:
    """Deterministic local reranker: most distinct query terms found, pool order on ties."""
    shared = F.size(
        F.array_intersect(terms(F.col("query")), F.array_distinct(terms(F.col("document"))))
    )
    order = Window.partitionBy("qid").orderBy(F.col("overlap").desc(), F.col("position"))
    return (
        documents.withColumn("overlap", shared)
        .withColumn("rerank_pos", F.row_number().over(order) - 1)
        .select("qid", "chunk_idx", "rerank_pos")
    )


def per_query(rank: QueryRanker, timeout: float = 30.0) -> Reranker:
    """A reranker that calls ``rank`` once per query; a failure stays with its query.

    The documents of a query are bounded in number and bytes, so they are one group. Where the
    call raises, or has no answer after ``timeout`` seconds, the query gets one row with the status
    ``failed`` or ``late``. Places that are no permutation make an order that is not accepted.
    """

    def call(query: str, documents: list[str]) -> tuple[str | None, list[int]]:
        answer: list = []

        def attempt() -> None:
            try:
                answer.append((None, [int(i) for i in rank(query, documents)]))
            except Exception:  # whatever a model or its transport raises
                answer.append(("failed", []))

        worker = threading.Thread(target=attempt, daemon=True)
        worker.start()
        worker.join(timeout)
        return answer[0] if answer else ("late", [])

    def rerank(documents: DataFrame) -> DataFrame:
        fields = documents.schema
        schema = StructType(
            [
                fields["qid"], StructField("chunk_idx", fields["chunk_idx"].dataType),
                StructField("rerank_pos", IntegerType()), StructField("status", StringType()),
            ]
        )

        def order(group: pa.Table) -> pa.Table:
            group = group.sort_by("position")
            texts, ids = group["document"].to_pylist(), group["chunk_idx"].to_pylist()
            status, places = call(group["query"][0].as_py(), texts)
            if status is None and sorted(places) != list(range(len(ids))):
                status, places = "invalid_order", []
            qid = group["qid"][0].as_py()
            n = max(len(places), 1)
            return pa.table(
                {
                    "qid": pa.array([qid] * n, group.schema.field("qid").type),
                    "chunk_idx": pa.array([ids[i] for i in places] or [None], group.schema.field("chunk_idx").type),
                    "rerank_pos": pa.array(list(range(len(places))) or [None], pa.int32()),
                    "status": pa.array([status] * n, pa.string()),
                }
            )

        return documents.select("qid", "query", "chunk_idx", "position", "document").groupBy(
            "qid"
        ).applyInArrow(order, schema)

    return rerank


def accepted_order(pool: DataFrame, order: DataFrame) -> DataFrame:
    """Keep a query's order only when it is a permutation of its pool.

    Returns ``(qid, chunk_idx, rerank_pos, relevance)``; relevance falls linearly
    from 1 over the pool. Queries without an accepted order have no rows.
    """
    wanted = pool.select("qid", "chunk_idx", F.lit(1).alias("_want"))
    given = order.groupBy("qid", "chunk_idx").agg(
        F.count("*").alias("_times"), F.min("rerank_pos").alias("rerank_pos")
    )
    matched = wanted.join(given, ["qid", "chunk_idx"], "full")
    per_query = Window.partitionBy("qid")
    fits = (F.col("_want") == 1) & (F.col("_times") == 1)
    size = F.count("*").over(per_query)
    ranked = (
        matched.withColumn("_bad", F.max((~F.coalesce(fits, F.lit(False))).cast("int")).over(per_query))
        .withColumn("_n", size)
        .where(F.col("_bad") == 0)
        .withColumn(
            "rerank_pos",
            F.row_number().over(per_query.orderBy("rerank_pos", "chunk_idx")) - 1,
        )
    )
    relevance = (F.col("_n") - F.col("rerank_pos")) / F.col("_n")
    return ranked.select("qid", "chunk_idx", "rerank_pos", relevance.alias("relevance"))


def decided_order(pool: DataFrame, order: DataFrame) -> DataFrame:
    """Every candidate ``(qid, chunk_idx, rerank_pos, relevance, status)`` under one fixed order.

    A reranker need not answer alike twice, so its rows are fixed once; what is derived from them
    agrees for all readers. ``status`` of a query is ``reranked``, what the reranker says of it,
    ``invalid_order`` or, where it gave no row, ``no_order``; only the first has positions.
    """
    given = order if "status" in order.columns else order.withColumn("status", F.lit(None).cast("string"))
    fixed = checkpointed(given.select("qid", "chunk_idx", "rerank_pos", "status"))
    accepted = accepted_order(pool, fixed.drop("status"))
    said = fixed.groupBy("qid").agg(F.coalesce(F.max("status"), F.lit("invalid_order")).alias("_said"))
    return (
        pool.select("qid", "chunk_idx")
        .join(accepted, ["qid", "chunk_idx"], "left")
        .join(said, "qid", "left")
        .withColumn(
            "status",
            F.when(F.col("relevance").isNotNull(), "reranked").otherwise(
                F.coalesce("_said", F.lit("no_order"))
            ),
        )
        .drop("_said")
    )
