"""The docset store: versioned Parquet tables behind a pointer file.

``root/<docset>/v<n>/`` holds one complete version (chunk table, manifest,
license); ``root/<docset>/CURRENT`` names the live one. A version is written and
checked in full before the pointer moves, so a lost executor or a failed write
never leaves readers with half a docset. Manifests, receipts and pointers are
small files written through the file system of the root.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillsift import params, schemas
from quillsift.functions.text import normalize_heading_path, replace_heading_line
from quillsift.functions.validate import canonical_source_url
from quillsift.functions.vectors import Embedder, quantize_half
from quillsift.operators.chunking import chunk_markdown, with_global_index
from quillsift.params import ChunkBudget
from quillsift.sources.catalog import (
    chunk_contract_violations,
    install_violations,
    manifest_violations,
    parse_manifests,
)
from quillsift.sources.files import license_text, read_chunk_rows, read_markdown, stamp_source
from quillsift.sources.hadoop_files import HadoopFiles
from quillsift.sources.postings import PostingsIndex, postings_of


class StoreError(RuntimeError):
    """A store operation was refused or found the store inconsistent."""


class DocsetNotInstalled(StoreError):
    """No live version of the docset."""


def build_manifest(docset: str, chunk_count: int, **meta: str) -> dict:
    """Manifest of a fresh ingest; ``meta`` gives URLs, license and attribution."""
    return {
        "docset": docset,
        "doc_version": meta.get("doc_version", "1.0.0"),
        "schema_version": params.SCHEMA_VERSION,
        "embedder": {
            "model_id": params.MODEL_ID,
            "model_version": params.MODEL_ID.split("/")[-1],
            "model_revision": meta.get("model_revision", "main"),
            "model_sha256": meta.get("model_sha256", "unknown"),
            "vector_dim": params.VECTOR_DIM,
            "engine": params.MODEL_ENGINE,
            "dtype": params.MODEL_DTYPE,
        },
        "retrieval": {
            "tokenizer": params.TOKENIZER,
            "chunk_size_tokens": ChunkBudget().target_tokens,
            "window_tokens": 2048,
        },
        "source": {
            "entry_url": meta.get("entry_url", ""),
            "source_url": meta.get("source_url", ""),
            "scraped_at": datetime.datetime.now(datetime.timezone.utc).date().isoformat(),
            "chunk_count": chunk_count,
        },
        "legal": {
            "license": meta.get("license", "MIT"),
            "copyright_holder": meta.get("copyright_holder", ""),
            "attribution": meta.get("attribution", ""),
        },
        "refresh_strategy": meta.get("refresh_strategy", {"tier": "community", "auto_days": 0}),
    }


def notice_text(manifest: dict) -> str:
    legal, source = manifest["legal"], manifest["source"]
    lines = [
        f"Docset: {manifest['docset']}",
        f"Source: {source['source_url']}",
        f"Entry: {source['entry_url']}",
        f"License: {legal['license']}",
    ]
    if legal["copyright_holder"].strip():
        lines.append(f"Copyright: {legal['copyright_holder']}")
    if legal["attribution"].strip():
        lines.append(f"Attribution: {legal['attribution']}")
    return "\n".join([*lines, "", "Derived from the upstream documentation named above.", ""])


class DocsetStore:
    """Docsets under one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._files = HadoopFiles(spark, self.root)

    def _folder(self, docset: str) -> str:
        return f"{self.root}/{docset}"

    def _version(self, docset: str) -> str:
        pointer = f"{self._folder(docset)}/CURRENT"
        if not self._files.exists(pointer):
            raise DocsetNotInstalled(docset)
        return f"{self._folder(docset)}/{self._files.read(pointer).strip()}"

    def docsets(self) -> list[str]:
        return [d for d in self._files.names(self.root) if self._files.exists(f"{self.root}/{d}/CURRENT")]

    def manifest(self, docset: str) -> dict:
        return json.loads(self._files.read(f"{self._version(docset)}/manifest.json"))

    def chunks(self, docset: str) -> DataFrame:
        """The live chunk table, with its partition column ``span`` last."""
        table = self.spark.read.parquet(f"{self._version(docset)}/chunks")
        wanted = StructType([*schemas.CHUNKS.fields, StructField("span", LongType())])
        return schemas.ensure_schema(table.withColumn("span", F.col("span").cast("long")), wanted)

    def fetch(self, docset: str, ids: list[int]) -> DataFrame:
        """Chunks by index, ascending; absent ids are simply missing."""
        spans = {i // schemas.SPAN for i in ids}
        return (
            self.chunks(docset)
            .where(F.col("span").isin(*spans) & F.col("chunk_idx").isin(*ids))
            .orderBy("chunk_idx")
        )

    def row_counts(self) -> DataFrame:
        """``(docset, n_rows)`` of every live docset, from one scan of all tables."""
        folders = [f"{self._version(d)}/chunks" for d in self.docsets()]
        if not folders:
            return self.spark.createDataFrame([], "docset string, n_rows bigint")
        docset = F.regexp_extract("_metadata.file_path", r"([^/]+)/v[0-9]+/chunks/", 1)
        tables = self.spark.read.schema(schemas.CHUNKS).option("recursiveFileLookup", "true").parquet(*folders)
        return tables.groupBy(docset.alias("docset")).agg(F.count("*").alias("n_rows"))

    def manifests(self) -> DataFrame:
        rows = [
            (d, self._files.read(f"{self._version(d)}/manifest.json")) for d in self.docsets()
        ]
        return self.spark.createDataFrame(rows, "docset string, manifest string")

    def _check_manifest(self, docset: str, manifest: dict, waived: tuple[str, ...] = ()) -> None:
        """Refuse a manifest with violations other than the waived ones."""
        one = self.spark.createDataFrame([(docset, json.dumps(manifest))], "docset string, manifest string")
        m = F.col("m")
        row = parse_manifests(one).select(
            m.isNotNull().alias("ok"),
            F.concat(manifest_violations(m), install_violations(m, F.col("docset"))).alias("bad"),
        ).first()
        own_urls = [v for v in (row["bad"] or []) if v not in waived]
        if not row["ok"] or own_urls:
            raise StoreError(f"manifest of {docset} is not acceptable: {own_urls or 'unreadable'}")

    def write(self, docset: str, chunks: DataFrame, manifest: dict, license: str | None = None) -> str:
        """Write a complete new version and make it live.

        The table goes down first and is counted back; every vector must have the
        manifest's dimension. Only then does the pointer move.
        """
        folder = self._folder(docset)
        numbers = [int(n[1:]) for n in self._files.names(folder) if n.startswith("v") and n[1:].isdigit()]
        version = f"v{max(numbers, default=0) + 1}"
        target = f"{folder}/{version}"
        dim = manifest["embedder"]["vector_dim"]
        checked = chunks.withColumn(
            "embedding",
            F.when(F.size("embedding") == dim, quantize_half(F.col("embedding"))).otherwise(
                F.raise_error(F.lit(f"vector dimension is not {dim}"))
            ),
        )
        (
            checked.withColumn("span", schemas.span_of(F.col("chunk_idx")))
            .repartition("span", F.floor(F.col("chunk_idx") / (schemas.SPAN // 8)))
            .sortWithinPartitions("chunk_idx")
            .write.partitionBy("span")
            .mode("errorifexists")
            .parquet(f"{target}/chunks")
        )
        n = self.spark.read.parquet(f"{target}/chunks").count()
        manifest = {**manifest, "source": {**manifest["source"], "chunk_count": n}}
        try:
            # A docset of one's own may have no upstream; ``install`` asks for one.
            self._check_manifest(docset, manifest, ("no_upstream_url",))
        except StoreError:
            self._files.delete(target)
            raise
        self._files.write(f"{target}/manifest.json", json.dumps(manifest))
        if license is not None:
            self._files.write(f"{target}/LICENSE", license)
        self._files.write(f"{folder}/CURRENT", version)
        return target

    def write_index(self, docset: str, analyzer: str = "english") -> PostingsIndex:
        """Index the live version's texts; ``append`` adds to the index from then on."""
        index = PostingsIndex.create(self.spark, f"{self._version(docset)}/index", analyzer)
        index.append(self.chunks(docset).select("chunk_idx", "text"))
        return index

    def postings_index(self, docset: str) -> PostingsIndex | None:
        """The live version's index, if it was written."""
        index = PostingsIndex(self.spark, f"{self._version(docset)}/index")
        return index if index.exists() else None

    def index(self, docset: str) -> DataFrame:
        """Stored postings ``(term, chunk_idx, tf, length)``."""
        return postings_of(self.postings_index(docset).blocks())

    def append(self, docset: str, chunks: DataFrame) -> None:
        """Add rows to the live table and to its index, as a segment; wrong dimensions fail the write."""
        dim = self.manifest(docset)["embedder"]["vector_dim"]
        schemas.ensure_schema(chunks).withColumn(
            "embedding",
            F.when(F.size("embedding") == dim, quantize_half(F.col("embedding"))).otherwise(
                F.raise_error(F.lit(f"vector dimension is not {dim}"))
            ),
        ).withColumn("span", schemas.span_of(F.col("chunk_idx"))).write.partitionBy("span").mode(
            "append"
        ).parquet(f"{self._version(docset)}/chunks")
        index = self.postings_index(docset)
        if index is not None:
            index.append(chunks.select("chunk_idx", "text"))

    def ingest(
        self, docset: str, folder: str, embed: Embedder, base_url: str | None = None,
        budget: ChunkBudget = ChunkBudget(), **meta: str,
    ) -> str:
        """Chunk, embed and store a Markdown tree as the docset's new version.

        Files follow each other by path, compared component by component.
        """
        pages = read_markdown(self.spark, folder).withColumnRenamed("rel", "doc_key")
        chunked = chunk_markdown(pages, budget=budget).withColumn("_path", F.split("doc_key", "/"))
        indexed = with_global_index(chunked, "_path", ["block_no", "part_no"])
        rows = indexed.select(
            "chunk_idx",
            "heading_path",
            stamp_source(F.col("doc_key"), base_url).alias("source_url"),
            F.lit(None).cast("string").alias("api_version"),
            "chunk_type",
            "text",
            embed(F.col("text")).alias("embedding"),
        )
        found = license_text(self.spark, folder).first()
        return self.write(
            docset, rows, build_manifest(docset, 0, **meta), found["text"] if found else None
        )

    def rebuild(self, docset: str, embed: Embedder) -> str:
        """Embed the live chunks again as a new version; URLs and version stay."""
        old = self.manifest(docset)
        rows = self.chunks(docset).drop("span").withColumn("embedding", embed(F.col("text")))
        kept = {
            **{k: old["source"][k] for k in ("entry_url", "source_url")},
            **{k: old["legal"][k] for k in ("license", "copyright_holder", "attribution")},
            "doc_version": old["doc_version"],
            "refresh_strategy": old["refresh_strategy"],
        }
        path = f"{self._version(docset)}/LICENSE"
        text = self._files.read(path) if self._files.exists(path) else None
        return self.write(docset, rows, build_manifest(docset, 0, **kept), text)

    def wipe(self, docset: str) -> None:
        self._files.delete(self._folder(docset))

    def uninstall(self, docset: str) -> None:
        """Receipt first, then everything of the docset."""
        self._files.delete(f"{self.root}/receipts/{docset}.json")
        self.wipe(docset)

    def share(self, docset: str, out: str) -> str:
        """Export manifest, chunk rows without vectors, license and notice."""
        target = f"{out.rstrip('/')}/{docset}"
        files = HadoopFiles(self.spark, out)
        if files.names(target):
            raise StoreError(f"{target} is not empty")
        rows = self.chunks(docset).select(
            F.col("chunk_idx").alias("idx"), "heading_path", "source_url", "api_version", "chunk_type", "text"
        )
        rows.sortWithinPartitions("idx").write.mode("errorifexists").json(f"{target}/chunks.jsonl")
        manifest = self.manifest(docset)
        files.write(f"{target}/manifest.json", json.dumps(manifest))
        path = f"{self._version(docset)}/LICENSE"
        if self._files.exists(path):
            files.write(f"{target}/LICENSE", self._files.read(path))
        files.write(f"{target}/NOTICE", notice_text(manifest))
        return target

    def install(self, bundle: str, docset: str, embed: Embedder, package_sha256: str = "") -> str:
        """Check a shared bundle, normalize and embed its rows, make it live, write a receipt.

        Nothing of the live version is touched until the new one is complete. ``package_sha256``
        is empty or the digest of the package that the bundle came in.
        """
        if package_sha256 and not re.fullmatch("[0-9a-f]{64}", package_sha256):
            raise StoreError(f"package of {docset} has no SHA-256 digest: {package_sha256[:80]}")
        files = HadoopFiles(self.spark, bundle)
        raw = files.read(f"{bundle}/manifest.json")
        manifest = json.loads(raw)
        self._check_manifest(docset, manifest)
        rows = read_chunk_rows(self.spark, f"{bundle}/chunks.jsonl")
        expected = self.spark.createDataFrame(
            [(docset, manifest["source"]["chunk_count"])], "docset string, chunk_count bigint"
        )
        broken = chunk_contract_violations(
            rows.select(F.lit(docset).alias("docset"), F.col("idx").alias("chunk_idx"), "text", "chunk_type"),
            expected,
        ).limit(5).collect()
        if broken:
            raise StoreError(f"bundle of {docset} breaks the chunk contract: {broken}")
        path = f"{bundle}/LICENSE"
        text = files.read(path) if files.exists(path) else None
        target = self.write(docset, release_rows(rows, manifest, embed), manifest, text)
        self.record_receipt(docset, manifest["doc_version"], package_sha256)
        return target

    def record_receipt(self, docset: str, package_version: str, package_sha256: str) -> None:
        live = self._files.read(f"{self._version(docset)}/manifest.json")
        if json.loads(live)["doc_version"] != package_version:
            raise StoreError(f"receipt of {docset} does not match the installed version")
        receipt = {
            "schema_version": 1,
            "docset": docset,
            "package_version": package_version,
            "package_sha256": package_sha256,
            "manifest_sha256": hashlib.sha256(live.encode()).hexdigest(),
        }
        self._files.write(f"{self.root}/receipts/{docset}.json", json.dumps(receipt))


def release_rows(rows: DataFrame, manifest: dict, embed: Embedder) -> DataFrame:
    """Bundle rows normalized for a release: heading, own heading line, absolute URL, vector."""
    heading = normalize_heading_path(F.col("heading_path"))
    url = canonical_source_url(F.lit(manifest["source"]["source_url"]), F.col("source_url"))
    text = replace_heading_line(F.col("heading_path"), F.col("text"))
    return (
        rows.withColumn("heading_path", heading)
        .withColumn("text", text)
        .select(
            F.col("idx").alias("chunk_idx"),
            "heading_path",
            F.when(url.isNotNull(), url)
            .otherwise(F.raise_error(F.lit("invalid relative source_url")))
            .alias("source_url"),
            F.nullif("api_version", F.lit("")).alias("api_version"),
            F.coalesce("chunk_type", F.lit("Info")).alias("chunk_type"),
            "text",
            embed(F.col("text")).alias("embedding"),
        )
    )
