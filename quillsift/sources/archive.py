"""Package archives: entries as rows, and the rules an archive must keep."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift import params
from quillsift.functions.text import sanitize_chunk
from quillsift.functions.validate import sha256_ok
from quillsift.session import broadcast_if_small, checkpointed
from quillsift.sources.catalog import install_violations, manifest_violations, parse_manifests

ENTRY = "archive string, position int, name string, size bigint, content binary"
CHUNK_LINE = "idx bigint, heading_path string, source_url string, api_version string, chunk_type string, text string"
# Entry names that may appear once, and vector artifacts.
SINGLE_NAMES = ("manifest.json", "chunks.jsonl", "LICENSE", "NOTICES")
STORE_SUFFIX = ".lance"
VECTOR_PART = r"(?:^|/)(?:[^/]*\.faiss|vectors\.[^/]*|embeddings\.[^/]*)(?:/|$)"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Entries of tar archives, plain or gzipped: ``(archive, position, name, size, content)``.

    One archive is one row and one task. Folders are skipped; links and devices
    fail the read, and the size limits hold before an entry is read.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                count = total = 0
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for member in tar:
                        if member.isdir():
                            continue
                        if not member.isreg():
                            raise ValueError(f"{archive}: {member.name} is a link or device")
                        count, total = count + 1, total + member.size
                        if (
                            member.size > params.ARCHIVE_MAX_ENTRY_BYTES
                            or total > params.ARCHIVE_MAX_BYTES
                            or count > params.ARCHIVE_MAX_ENTRIES
                        ):
                            raise ValueError(f"{archive}: over the archive limits")
                        yield pd.DataFrame(
                            {
                                "archive": [archive],
                                "position": [count - 1],
                                "name": [member.name],
                                "size": [member.size],
                                "content": [tar.extractfile(member).read()],
                            }
                        )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(entries, ENTRY)


def archive_violations(
    entries: DataFrame, release: bool = False, archives: DataFrame | None = None
) -> DataFrame:
    """Broken rules ``(archive, violation, name)`` of an entry table.

    A share bundle must hold ``chunks.jsonl`` and no vectors; a release must hold
    a store folder instead. Counting rules are grouped aggregates. With the list of
    ``archives`` one that has no entry breaks the rules on what must be there.
    """
    name, parts = F.col("name"), F.split("name", "/")
    drive = r"^[A-Za-z]:"
    absolute = name.rlike(r"^[/\\]") | name.rlike(drive)
    climbing = F.exists(parts, lambda p: (p == "..") | p.rlike(drive))
    in_store = F.exists(parts, lambda p: p.endswith(STORE_SUFFIX))
    per_entry = {
        "entry_too_large": F.col("size") > params.ARCHIVE_MAX_ENTRY_BYTES,
        "absolute_path": absolute,
        "unsafe_path": ~absolute & climbing,
        "vector_artifact": name.rlike(VECTOR_PART) | (F.lit(not release) & in_store),
    }
    rules = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in per_entry.items()]))
    rows = entries.select("archive", F.explode(rules).alias("violation"), "name")
    base = F.element_at(parts, -1)
    repeated = (
        entries.where(base.isin(*SINGLE_NAMES))
        .groupBy("archive", base.alias("name"))
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("archive", F.lit("duplicate_entry").alias("violation"), "name")
    )

    def has(condition):
        return F.max(condition.cast("int"))

    needed = ("missing_store", "store") if release else ("missing_chunks", "chunks")
    whole = entries.groupBy("archive").agg(
        F.count("*").alias("n"),
        F.sum("size").alias("bytes"),
        has(name.endswith("manifest.json")).alias("manifest"),
        has(name.endswith("chunks.jsonl")).alias("chunks"),
        has(in_store).alias("store"),
    )
    if archives is not None:
        whole = archives.select("archive").distinct().join(whole, "archive", "left").fillna(
            0, ["n", "bytes", "manifest", "chunks", "store"]
        )
    overall = F.array_compact(
        F.array(
            F.when(F.col("n") > params.ARCHIVE_MAX_ENTRIES, "too_many_entries"),
            F.when(F.col("bytes") > params.ARCHIVE_MAX_BYTES, "archive_too_large"),
            F.when(F.col("manifest") == 0, "missing_manifest"),
            F.when(F.col(needed[1]) == 0, needed[0]),
        )
    )
    totals = whole.select(
        "archive", F.explode(overall).alias("violation"), F.lit(None).cast("string").alias("name")
    )
    return rows.unionByName(repeated).unionByName(totals)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, digest)`` of every archive file, also of those without entries."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("archive"), F.sha2("content", 256).alias("digest"))


def entry_facts(entries: DataFrame) -> DataFrame:
    """What the rules need of every entry, read once; texts stay behind.

    One row per entry, and one per further non-blank line of a ``chunks.jsonl``:
    ``(archive, position, name, size, line_no, manifest, bad_utf8, idx, faults)``. ``manifest``
    is the text of a ``manifest.json``. ``faults`` are the rules that a chunk line breaks by
    itself; ``line_no`` is null but for chunk lines. Lines of one entry leave it by an explode,
    so a large file is one row only until it is read.
    """
    name = F.col("name")
    text = F.col("content").cast("string")
    is_chunks, is_manifest = name.endswith("chunks.jsonl"), name.endswith("manifest.json")
    readable = F.is_valid_utf8(text)
    lines = F.when(
        is_chunks & readable, F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    )
    row = F.from_json("line", CHUNK_LINE)
    broken = F.col("row").isNull() | F.col("row.idx").isNull() | F.col("row.text").isNull()
    kind = F.coalesce(F.col("row.chunk_type"), F.lit("Info"))
    faults = F.when(broken, F.array(F.lit("malformed_line"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("row.idx") != F.col("line_no"), "idx_position"),
                F.when(sanitize_chunk(F.col("row.text")) == "", "empty_text"),
                F.when(~kind.isin("Code", "Info"), "chunk_type"),
            )
        )
    )
    return (
        entries.select(
            "archive", "position", "name", "size",
            F.when(is_manifest & readable, text).alias("manifest"),
            ((is_manifest | is_chunks) & ~readable).alias("bad_utf8"),
            F.posexplode_outer(lines).alias("line_no", "line"),
        )
        .withColumn("row", row)
        .withColumn("faults", F.when(F.col("line_no").isNotNull(), faults))
        .select(
            "archive", "position", "name", "size", "line_no", "manifest", "bad_utf8",
            F.col("row.idx").alias("idx"), "faults",
        )
    )


def validate_archives(archives: DataFrame, entries: DataFrame, release: bool = False) -> DataFrame:
    """All broken rules ``(archive, violation, name)`` of packages about to be installed.

    ``archives`` lists ``(archive, docset, sha256, digest)``: the requested docset, the catalog's
    digest in either case and the file's own. Beside the rules on entries these hold: the digest
    agrees; the first manifest reads and keeps the manifest and install rules (``name`` says
    which); and, but for a release, the first chunk file has rows 0..N-1 in order, as many as the
    manifest counts, each with text left after sanitizing and a known type. ``name`` is the line
    number for rules on one line. Contents are read once; the checkpoint holds no chunk text.
    """
    facts = checkpointed(entry_facts(entries))
    listed = archives.select("archive", "docset", "sha256", "digest")
    own = facts.where(F.coalesce("line_no", F.lit(0)) == 0)

    def broken(rows: DataFrame, name: Column | None = None) -> DataFrame:
        return rows.select(
            "archive", "violation", (F.lit(None) if name is None else name).cast("string").alias("name")
        )

    same = F.lower("sha256") == F.lower("digest")
    digests = listed.withColumn(
        "violation",
        F.when(~F.coalesce(sha256_ok(F.col("sha256")), F.lit(False)), "sha256_shape").when(
            ~F.coalesce(same, F.lit(False)), "sha256_mismatch"
        ),
    ).where(F.col("violation").isNotNull())
    first = own.where(F.col("name").endswith("manifest.json")).groupBy("archive").agg(
        F.min_by("manifest", "position").alias("manifest")
    )
    parsed = parse_manifests(listed.join(first, "archive")).select(
        "archive", "docset", "m", F.col("m.source.chunk_count").alias("chunk_count")
    )
    m = F.col("m")
    invalid = parsed.where(m.isNull()).withColumn("violation", F.lit("invalid_manifest"))
    rules = (
        parsed.where(m.isNotNull())
        .select(
            "archive", F.lit("manifest_rule").alias("violation"),
            F.explode(F.concat(manifest_violations(m), install_violations(m, F.col("docset")))).alias("rule"),
        )
    )
    found = [
        archive_violations(own, release, listed),
        broken(digests),
        broken(invalid),
        broken(rules, F.col("rule")),
    ]
    if not release:
        chunk_file = F.col("name").endswith("chunks.jsonl")
        place = broadcast_if_small(
            own.where(chunk_file).groupBy("archive").agg(F.min("position").alias("position"))
        )
        rows = facts.where(chunk_file).join(place, ["archive", "position"])
        unreadable = rows.where("bad_utf8").withColumn("violation", F.lit("invalid_chunks"))
        lines = rows.select("archive", "line_no", F.explode("faults").alias("violation"))
        counts = rows.groupBy("archive").agg(
            F.count("line_no").alias("n"), F.max("bad_utf8").alias("bad_utf8")
        )
        miscounted = (
            parsed.where(m.isNotNull()).join(counts, "archive")
            .where(~F.col("bad_utf8") & (F.col("n") != F.col("chunk_count")))
            .withColumn("violation", F.lit("chunk_count"))
        )
        found += [broken(unreadable), broken(lines, F.col("line_no")), broken(miscounted)]
    return reduce(DataFrame.unionByName, found)
