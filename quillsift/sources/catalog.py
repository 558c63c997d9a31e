"""Manifests, registry catalog, receipts and install state as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift import params
from quillsift.functions.text import sanitize_chunk, sanitize_metadata, strip_edges
from quillsift.functions.validate import is_newer, package_url_ok, sha256_ok
from quillsift.session import broadcast_if_small, spread

MANIFEST_SCHEMA = (
    "docset string, doc_version string, schema_version bigint, "
    "embedder struct<model_id:string, model_version:string, model_revision:string, "
    "model_sha256:string, vector_dim:bigint, engine:string, dtype:string>, "
    "retrieval struct<tokenizer:string, chunk_size_tokens:bigint, window_tokens:bigint>, "
    "source struct<entry_url:string, source_url:string, scraped_at:string, chunk_count:bigint>, "
    "legal struct<license:string, copyright_holder:string, attribution:string>, "
    "refresh_strategy struct<tier:string, auto_days:bigint>"
)
MANIFEST_FIELDS = (
    "docset", "doc_version", "schema_version",
    "embedder.model_id", "embedder.model_version", "embedder.model_revision",
    "embedder.model_sha256", "embedder.vector_dim", "embedder.engine", "embedder.dtype",
    "retrieval.tokenizer", "retrieval.chunk_size_tokens", "retrieval.window_tokens",
    "source.entry_url", "source.source_url", "source.scraped_at", "source.chunk_count",
    "legal.license", "legal.copyright_holder", "legal.attribution",
    "refresh_strategy.tier", "refresh_strategy.auto_days",
)


@dataclass(frozen=True)
class RegistryHosts:
    """Where catalog packages may be downloaded from."""

    code_host: str
    owner: str
    mirror_host: str


def parse_manifests(manifests: DataFrame, json: str = "manifest") -> DataFrame:
    """Add the parsed manifest ``m``; null unless every field is there."""
    parsed = F.from_json(F.col(json), MANIFEST_SCHEMA)
    staged = manifests.withColumn("m", parsed)
    complete = F.lit(True)
    for field in MANIFEST_FIELDS:
        complete = complete & F.col(f"m.{field}").isNotNull()
    return staged.withColumn("m", F.when(complete, F.col("m")))


def schema_compatibility(version: Column) -> Column:
    return (
        F.when(version == params.SCHEMA_VERSION, "current")
        .when(version < params.SCHEMA_VERSION, "older")
        .when(version > params.SCHEMA_VERSION, "newer")
    )


def _listed(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))


def manifest_violations(m: Column) -> Column:
    """Names of the manifest rules broken, in a fixed order."""
    e, legal = m["embedder"], m["legal"]
    return _listed(
        {
            "schema_version": m["schema_version"] != params.SCHEMA_VERSION,
            "model_id": e["model_id"] != params.MODEL_ID,
            "vector_dim": e["vector_dim"] != params.VECTOR_DIM,
            "engine": e["engine"] != params.MODEL_ENGINE,
            "dtype": e["dtype"] != params.MODEL_DTYPE,
            "model_revision": strip_edges(e["model_revision"]) == "",
            "model_sha256": strip_edges(e["model_sha256"]) == "",
            "tokenizer": m["retrieval"]["tokenizer"] != params.TOKENIZER,
            "license": ~legal["license"].isin(*params.MANIFEST_LICENSES),
            "attribution": (legal["license"] == "CC-BY-4.0")
            & (strip_edges(legal["attribution"]) == ""),
        }
    )


def install_violations(m: Column, requested: Column) -> Column:
    """Rules that only hold for an install under a requested name."""
    source = m["source"]
    return _listed(
        {
            "docset_name": m["docset"] != requested,
            "chunk_count_zero": source["chunk_count"] == 0,
            "no_upstream_url": (strip_edges(source["source_url"]) == "")
            & (strip_edges(source["entry_url"]) == ""),
        }
    )


def registry_violations(packages: DataFrame, hosts: RegistryHosts) -> DataFrame:
    """Catalog packages with the names of the rules they break (empty when fine)."""
    return packages.withColumn(
        "violations",
        _listed(
            {
                "download_url": ~package_url_ok(
                    F.col("download_url"), hosts.code_host, hosts.owner, hosts.mirror_host
                ),
                "license": ~F.col("license").isin(*params.MANIFEST_LICENSES),
                "sha256": ~sha256_ok(F.col("sha256")),
            }
        ),
    )


def docset_states(manifests: DataFrame, store_rows: DataFrame, count_rows: bool = True) -> DataFrame:
    """Install state of every docset known to either side.

    ``manifests``: ``(docset, manifest)``; ``store_rows``: ``(docset, n_rows)``.
    The first rule that applies names the state. Without ``count_rows`` a store
    that is merely present counts as complete.
    """
    known = parse_manifests(manifests).join(store_rows, "docset", "full")
    m, rows = F.col("m"), F.col("n_rows")
    valid = F.size(manifest_violations(m)) == 0
    complete = (rows == m["source"]["chunk_count"]) if count_rows else F.lit(True)
    state = (
        F.when(m.isNull() & rows.isNull(), "not-installed")
        .when(m.isNull(), "no-manifest")
        .when(rows.isNull(), "no-store")
        .when(m["schema_version"] != params.SCHEMA_VERSION, "schema-mismatch")
        .when(~valid, "no-manifest")
        .when(~complete, "count-mismatch")
        .otherwise("ok")
    )
    return known.withColumn("state", state)


def installed_list(states: DataFrame) -> DataFrame:
    """Installed docsets by name; an unreadable manifest shows as ``broken``."""
    unreadable = F.col("manifest").isNotNull() & F.col("m").isNull()
    missing = F.lit("?")
    status = F.when(unreadable, "broken").otherwise(F.col("state"))
    return states.where(F.col("n_rows").isNotNull()).select(
        F.col("docset").alias("name"),
        F.coalesce("m.doc_version", missing).alias("version"),
        F.coalesce(F.col("m.source.chunk_count").cast("string"), missing).alias("chunks"),
        F.coalesce("m.legal.license", missing).alias("license"),
        status.alias("status"),
        F.concat(sanitize_metadata(F.col("docset")), F.lit(" ("), status, F.lit(")")).alias("label"),
    )


def matching_receipts(receipts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Receipts whose version and manifest digest still match what is installed."""
    live = parse_manifests(manifests).select(
        "docset",
        F.col("m.doc_version").alias("package_version"),
        F.sha2("manifest", 256).alias("manifest_sha256"),
    )
    return receipts.withColumn("manifest_sha256", F.lower("manifest_sha256")).join(
        live, ["docset", "package_version", "manifest_sha256"]
    )


def docset_updates(receipts: DataFrame, packages: DataFrame) -> DataFrame:
    """Installed docsets the catalog has a newer version of."""
    latest = packages.select("docset", F.col("version").alias("latest_version"))
    return (
        receipts.select("docset", F.col("package_version").alias("installed_version"))
        .join(latest, "docset")
        .where(is_newer(F.col("latest_version"), F.col("installed_version")))
        .withColumn(
            "snapshot_part",
            F.concat("docset", F.lit(":"), "installed_version", F.lit("->"), "latest_version"),
        )
    )


def unnotified(updates: DataFrame, notified: DataFrame) -> DataFrame:
    """Updates a notification has not named before."""
    return updates.join(notified.select("snapshot_part"), "snapshot_part", "left_anti")


def search_packages(packages: DataFrame, query: str) -> DataFrame:
    """Packages whose name or description contains the query, any case."""
    needle = query.lower()
    return packages.where(
        F.lower("docset").contains(needle)
        | F.coalesce(F.lower("description").contains(needle), F.lit(False))
    )


def list_packages(packages: DataFrame, installed: DataFrame) -> DataFrame:
    """Catalog with an ``installed`` flag."""
    have = installed.select("docset").distinct().withColumn("_have", F.lit(True))
    return (
        packages.join(have, "docset", "left")
        .withColumn("installed", F.coalesce("_have", F.lit(False)))
        .drop("_have")
    )


def chunk_contract_violations(chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Breaches ``(docset, violation, chunk_idx)`` of the published chunk contract.

    Indices are 0..N-1 without gaps exactly when none repeats, none lies outside
    and their number is the manifest's ``chunk_count``; each of these is a grouped
    count, so no docset has to be walked in order.
    """
    expected = broadcast_if_small(manifests.select("docset", "chunk_count"))
    indexed = (
        chunks.groupBy("docset", "chunk_idx").agg(F.count("*").alias("n"))
        .join(expected, "docset")
    )
    repeated = indexed.where("n > 1").select("docset", F.lit("repeated_idx").alias("violation"), "chunk_idx")
    outside = indexed.where((F.col("chunk_idx") < 0) | (F.col("chunk_idx") >= F.col("chunk_count"))).select(
        "docset", F.lit("idx_out_of_range").alias("violation"), "chunk_idx"
    )
    rows = F.posexplode(
        _listed(
            {
                "empty_text": F.coalesce(sanitize_chunk(F.col("text")), F.lit("")) == "",
                "chunk_type": ~F.coalesce(F.col("chunk_type").isin("Code", "Info"), F.lit(True)),
            }
        )
    )
    content = spread(chunks, "chunk_idx").select("docset", "chunk_idx", rows.alias("_n", "violation")).select(
        "docset", "violation", "chunk_idx"
    )
    counted = (
        expected.join(chunks.groupBy("docset").agg(F.count("*").alias("n")), "docset", "left")
        .where(F.coalesce("n", F.lit(0)) != F.col("chunk_count"))
        .select("docset", F.lit("chunk_count").alias("violation"), F.lit(None).cast("long").alias("chunk_idx"))
    )
    return repeated.unionByName(outside).unionByName(content).unionByName(counted)


def worst_severity(checks: DataFrame) -> DataFrame:
    """Overall status of a table of check results: fail over warn over ok."""
    order = F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    worst = F.coalesce(F.max(order), F.lit(0))
    return checks.agg(
        F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("ok").alias("status")
    )


def corpus_identity(manifests: DataFrame, parameters: dict[str, float | int | str], commit: str) -> DataFrame:
    """What an evaluation ran on: one row per docset, with code, parameters and digests.

    A docset whose manifest cannot be read or names no version is an error.
    """
    m = F.col("m")
    version = F.when(strip_edges(m["doc_version"]) != "", m["doc_version"])
    settings = F.struct(*[F.lit(v).alias(k) for k, v in sorted(parameters.items())])
    return parse_manifests(manifests).select(
        "docset",
        F.lit(commit).alias("code_commit"),
        settings.alias("parameters"),
        F.sha2("manifest", 256).alias("manifest_sha256"),
        F.when(version.isNotNull(), version)
        .otherwise(F.raise_error(F.concat(F.lit("no readable version in the manifest of "), "docset")))
        .alias("doc_version"),
        m["source"]["chunk_count"].alias("chunk_count"),
        m["embedder"]["model_id"].alias("model_id"),
        m["embedder"]["model_revision"].alias("model_revision"),
        m["embedder"]["model_sha256"].alias("model_sha256"),
    )
