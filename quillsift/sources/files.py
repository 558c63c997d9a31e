"""Reading documentation trees: Markdown, license files, JSON catalogs and suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift import schemas
from quillsift.functions import license_rules
from quillsift.functions.text import (
    collapse_blank_lines,
    has_enough_lines,
    strip_markup_keeping_code,
)
from quillsift.functions.validate import join_source_url

# Files over this size are not scanned, and what the audit scans.
MAX_SCAN_BYTES = 1_000_000
AUDIT_EXTENSIONS = (
    ".md", ".markdown", ".txt", ".rst", ".py", ".rs", ".js", ".ts", ".tsx", ".jsx",
    ".go", ".java", ".rb", ".sh",
)
AUDIT_NAMES = ("license", "licence")
AUDIT_EXCLUDED_DIRS = (
    ".git", "node_modules", "target", "venv", ".venv", "env", "dist", "build",
    "__pycache__", ".next", ".cache", "vendor", ".turbo", "coverage", ".idea", ".vscode",
)


def list_files(
    spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True
) -> DataFrame:
    """Files under a folder: ``(path, rel, length, content)``, ``rel`` below it.

    Content is read only for queries that use it.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", glob)
        .load(folder)
    )
    return files.select("path", relative_to(folder).alias("rel"), "length", "content")


def relative_to(folder: str) -> Column:
    """The column ``path`` without the folder, whatever scheme either is written with."""
    base = folder.rstrip("/").split(":/")[-1].lstrip("/")
    return F.regexp_replace("path", rf"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*\Q{base}\E/+", "")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``.md`` file as ``(rel, markdown)``; invalid UTF-8 fails the read."""
    return list_files(spark, folder, "*.md").select(
        "rel", F.validate_utf8(F.col("content").cast("string")).alias("markdown")
    )


def stamp_source(rel: Column, base_url: str | None) -> Column:
    return join_source_url(F.lit(base_url).cast("string"), rel)


def prepared_docs(spark: SparkSession, folder: str, exclude: str = "") -> DataFrame:
    """Cleaned documents ``(rel, markdown)`` of a raw tree of ``.md``/``.mdx`` files.

    Large files, files that are not UTF-8 and files with fewer than three lines
    of content are left out.
    """
    files = list_files(spark, folder, "*.md*").where(
        F.col("rel").rlike(r"\.mdx?$") & (F.col("length") <= MAX_SCAN_BYTES)
    )
    if exclude:
        files = files.where(~F.col("rel").contains(exclude))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    cleaned = files.select(
        F.regexp_replace("rel", r"\.mdx$", ".md").alias("rel"), text.alias("raw")
    ).where(F.col("raw").isNotNull()).select(
        "rel", strip_markup_keeping_code(F.col("raw")).alias("markdown")
    )
    return cleaned.where(has_enough_lines(F.col("markdown"))).select(
        "rel", collapse_blank_lines(F.col("markdown")).alias("markdown")
    )


def license_text(spark: SparkSession, folder: str) -> DataFrame:
    """The license text in the folder's root, ``license`` before ``copying``; at most one row."""
    stem = F.regexp_replace(F.regexp_replace(F.lower("rel"), r"(\.md)+$", ""), r"(\.txt)+$", "")
    return (
        list_files(spark, folder, "[LlCc][IiOo]*", recursive=False)
        .withColumn("rank", F.when(stem == "license", 1).when(stem == "copying", 2))
        .where("rank is not null")
        .select("rank", "rel", F.col("content").cast("string").alias("text"))
        .orderBy("rank", "rel")
        .limit(1)
        .drop("rank")
    )


def audit_files(spark: SparkSession, folder: str, repo: str) -> DataFrame:
    """Text files a license audit reads: ``(repo, file, text)``."""
    dirs = F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1)
    name = F.lower(F.element_at(F.split("rel", "/"), -1))
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    wanted = (
        license_rules.is_license_file(F.col("rel"))
        | extension.isin(*AUDIT_EXTENSIONS)
        | name.isin(*AUDIT_NAMES)
    )
    excluded = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in AUDIT_EXCLUDED_DIRS]))
    return (
        list_files(spark, folder)
        .where(wanted & ~excluded & (F.col("length") <= MAX_SCAN_BYTES))
        .select(
            F.lit(repo).alias("repo"),
            F.col("rel").alias("file"),
            F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        )
    )


def read_chunk_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ``chunks.jsonl``; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(schemas.BUNDLE).option("mode", "FAILFAST").json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Packages of a catalog index, one per row."""
    index = spark.read.schema(schemas.INDEX).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return index.select(F.inline("packages"))


def read_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Install receipts of a folder; unreadable ones are dropped."""
    receipts = (
        spark.read.schema(schemas.RECEIPT)
        .option("multiLine", "true")
        .option("mode", "DROPMALFORMED")
        .json(folder)
    )
    return receipts.where((F.col("schema_version") == 1) & F.col("docset").isNotNull())


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """Labelled evaluation queries from JSON array files."""
    return spark.read.schema(schemas.SUITE).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def suite_targets(suite: DataFrame) -> DataFrame:
    """One row per labelled target: ``(qid, target_no, source_url, heading_prefix, grade)``."""
    return suite.select(
        F.col("id").alias("qid"), F.posexplode("targets").alias("target_no", "t")
    ).select(
        "qid",
        "target_no",
        "t.source_url",
        F.col("t.heading_path_prefix").alias("heading_prefix"),
        "t.grade",
    )


def stale_staging(listing: DataFrame, older_than_seconds: int, now: Column) -> DataFrame:
    """Staging folders ``docset-pid-timestamp`` old enough to clean: ``(name, modified)``."""
    return listing.where(
        F.col("name").rlike(r"^.+-[0-9]*-[0-9]*$")
        & (now - F.col("modified") >= F.lit(older_than_seconds))
    )
