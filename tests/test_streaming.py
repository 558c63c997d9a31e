from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions.vectors import byte_embedder
from quillsift.params import SearchParams
from quillsift.streaming.ingest import ingest_stream, latest_pages, search_stream


def test_pages_replace_themselves(spark, tmp_path):
    docs, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "s")
    for name, text in {"a.md": "# A\nold words", "b.md": "# B\nother", "x/a.md": "# X\nmine", "c.md": "# C\ngone"}.items():
        (docs / "v1" / name).parent.mkdir(parents=True, exist_ok=True)
        (docs / "v1" / name).write_text(text)
    ingest_stream(spark, str(docs), table, state, byte_embedder(8), drop_depth=1).awaitTermination()
    (docs / "v2").mkdir()
    (docs / "v2" / "a.md").write_text("# A\nnew words")
    (docs / "v2" / "c.md").write_text("\n")
    ingest_stream(spark, str(docs), table, state, byte_embedder(8), drop_depth=1).awaitTermination()
    got = {r.source_url: r.text for r in latest_pages(spark, table).collect()}
    assert got == {"a.md": "## A\n\nnew words", "b.md": "## B\n\nother", "x/a.md": "## X\n\nmine"}


def test_streamed_queries_are_answered(spark, tmp_path):
    embed = byte_embedder(8)
    rows = [(i, "u.md", "H", "Info", None, text) for i, text in enumerate(["red apple", "green pear", "blue sky"])]
    chunks = spark.createDataFrame(rows, "chunk_idx bigint, source_url string, heading_path string, chunk_type string, api_version string, text string")
    vectors = chunks.select("chunk_idx", embed(F.col("text")).alias("embedding"))
    source = tmp_path / "q"
    chunks.select(F.col("chunk_idx").alias("qid"), F.col("text").alias("query"), embed(F.col("text")).cast("array<double>").alias("qvec")).write.parquet(str(source))
    stream = spark.readStream.schema("qid bigint, query string, qvec array<double>").parquet(str(source))
    out = str(tmp_path / "out")
    search_stream(
        stream, chunks, vectors, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "s"), SearchParams()
    ).awaitTermination()
    first = {r.qid: r.chunk_idx for r in spark.read.parquet(out).where("pos = 1").collect()}
    assert first == {0: 0, 1: 1, 2: 2}
