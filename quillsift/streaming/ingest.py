"""Extension: streaming ingest of Markdown files, and streaming queries.

Both are stateless analogs of the batch paths; neither needs a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillsift.functions.vectors import Embedder
from quillsift.operators.batch import QueryBatch
from quillsift.operators.chunking import chunk_markdown
from quillsift.params import ChunkBudget, SearchParams
from quillsift.plans.search import search
from quillsift.sources.files import relative_to, stamp_source


def markdown_stream(spark: SparkSession, folder: str, drop_depth: int = 0) -> DataFrame:
    """New ``.md`` files as ``(doc_key, markdown, version)``, keyed by their path below the folder.

    The first ``drop_depth`` folders of that path name the delivery and are not part of the key,
    so that a later delivery can replace a page. ``version`` orders deliveries of one page.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.md")
        .load(folder)
    )
    return files.select(
        F.regexp_replace(relative_to(folder), rf"^(?:[^/]+/){{{drop_depth}}}", "").alias("doc_key"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("markdown"),
        F.struct("modificationTime", "path").alias("version"),
    )


def ingest_stream(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    embed: Embedder,
    base_url: str | None = None,
    budget: ChunkBudget = ChunkBudget(),
    drop_depth: int = 0,
) -> StreamingQuery:
    """Chunk and embed arriving files; a page that arrives again replaces itself.

    Each batch writes its chunks, then its pages, under its own batch number, so
    a replayed batch overwrites itself. Readers take the latest batch per page,
    also of a page whose newest version has no chunks. Spark's file source does
    not see files of zero bytes.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("doc_key").agg(F.max_by("markdown", "version").alias("markdown"))
        rows = chunk_markdown(newest, budget=budget).select(
            stamp_source(F.col("doc_key"), base_url).alias("source_url"),
            "block_no",
            "part_no",
            "heading_path",
            "chunk_type",
            "text",
            embed(F.col("text")).alias("embedding"),
        )
        rows.write.mode("overwrite").parquet(f"{table}/chunks/batch={number}")
        pages = newest.select(stamp_source(F.col("doc_key"), base_url).alias("source_url"))
        pages.write.mode("overwrite").parquet(f"{table}/pages/batch={number}")

    return (
        markdown_stream(spark, folder, drop_depth)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_pages(spark: SparkSession, table: str) -> DataFrame:
    """Chunks of the newest version of every page written by ``ingest_stream``."""
    pages = spark.read.parquet(f"{table}/pages")
    newest = pages.groupBy("source_url").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{table}/chunks").join(newest, ["source_url", "batch"])


def search_stream(
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    p: SearchParams = SearchParams(),
    decisions: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Answer a stream of queries ``(qid, query, qvec)``, one search per micro-batch.

    ``sink`` takes the answer rows, ``decisions`` one label per query, invalid ones among them.
    """

    def answer(batch: DataFrame, number: int) -> None:
        found = search(QueryBatch.measure(batch), chunks, vectors, p)
        sink(found.rows, number)
        if decisions is not None:
            decisions(found.decisions, number)

    return (
        queries.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(answer)
        .start()
    )
