"""Registered validation and catalog queries over the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift import params
from quillsift.functions import validate as v
from quillsift.plans import bindings as b
from quillsift.sources import archive, catalog
from quillsift.sources.catalog import RegistryHosts
from quillsift.sources.files import stale_staging as stale

HOSTS = RegistryHosts("code.example.org", "docs-registry", "mirror.example.org")
LICENSES = ("MIT", "Apache-2.0", "CC-BY-4.0", "GPL-3.0")
NOW = 1_704_500_000
#: Staging folders this many seconds old are listed.
STAGING_AGE = 48 * 3600
RUNNING = "click"
SEARCH_TEXT = "WiDGet"


def _choice(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (by % len(values)).cast("int") + 1)


def docset_name_valid(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id") % 7
    name = (
        F.when(d == 0, F.upper("source")).when(d == 1, F.concat("source", F.lit("..x")))
        .when(d == 2, F.concat_ws("/", "source", "lang")).when(d == 3, F.repeat("source", 20))
        .when(d == 4, F.lit("")).when(d == 5, F.concat_ws("_-.", "source", "lang")).otherwise(F.col("source"))
    )
    return b.table(spark, folder, "documents").select("doc_id", name.alias("name")).withColumn(
        "valid", v.docset_name_ok(F.col("name"))
    )


def query_valid(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 50 == 7, "").otherwise(F.col("text"))
    return b.table(spark, folder, "documents").select("doc_id", v.query_ok(text).alias("valid"))


def resolve_limits(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    tokens = F.when(e % 5 == 0, None).when(e % 5 == 1, 0).otherwise(e * 13 % 9000)
    top_k = F.when(e % 7 == 0, None).otherwise(e % 31)
    return b.table(spark, folder, "events").select(
        "event_id",
        v.resolve_max_tokens(tokens).cast("long").alias("max_tokens"),
        v.resolve_top_k(top_k).cast("long").alias("top_k"),
    )


def source_url_join(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("page_id") % 4
    base = F.when(p == 0, None).when(p == 1, F.concat("url", F.lit("//"))).otherwise(F.col("url"))
    relative = F.concat(F.lit("docs/"), "page_id", F.lit(".md"))
    return b.table(spark, folder, "pages").select(
        "page_id", v.join_source_url(base, relative).alias("source_url")
    )


def source_url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("page_id") % 5
    source = (
        F.when(p == 0, F.col("url")).when(p == 1, F.concat(F.lit("//docs/"), "page_id"))
        .when(p == 2, F.concat(F.lit("a/../"), "page_id")).when(p == 3, F.lit("/"))
        .otherwise(F.concat(F.lit("a/..b/"), "page_id"))
    )
    return b.table(spark, folder, "pages").select(
        "page_id", v.canonical_source_url(F.lit("https://docs.example.org/x/"), source).alias("source_url")
    )


def package_urls(key: Column) -> Column:
    k = key.cast("string")
    root = F.lit("https://code.example.org/docs-registry/")
    shape = key % 9
    return (
        F.when(shape == 0, F.concat(root, F.lit("p"), k, F.lit("/releases/download/v1/a.tar")))
        .when(shape == 1, F.concat(root, F.lit("p"), k, F.lit("/releases/latest/download/a.tar")))
        .when(shape == 2, F.concat(root, F.lit("p"), k, F.lit("/raw/main/releases/download/a.tar")))
        .when(shape == 3, F.concat(F.lit("https://mirror.example.org/releases/"), k))
        .when(shape == 4, F.concat(F.lit("https://mirror.example.org/other/"), k))
        .when(shape == 5, F.concat(F.lit("https://code.example.org/docs-registry.bad/p"), k, F.lit("/releases/download/v1/a")))
        .when(shape == 6, F.concat(root, F.lit("/releases/download/v1/"), k))
        .when(shape == 7, F.concat(F.lit("file:///tmp/"), k))
        .otherwise(F.concat(root, F.lit("p"), k, F.lit("/releases/download//a.tar")))
    )


def package_url_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Both URL gates over every page URL and a made package URL per page."""
    pages = b.table(spark, folder, "pages").select(
        "page_id", F.explode(F.array("url", package_urls(F.col("page_id")))).alias("url")
    )
    hosts = (HOSTS.code_host, HOSTS.owner, HOSTS.mirror_host)
    return pages.withColumn("index_ok", v.index_url_ok(F.col("url"), *hosts)).withColumn(
        "package_ok", v.package_url_ok(F.col("url"), *hosts)
    )


def contract_chunks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    documents = b.table(spark, folder, "documents")
    chunks = documents.select(
        F.lit("docs").alias("docset"),
        F.when(d % 101 == 7, d - 1).when(d % 199 == 11, d + 1_000_000_000).otherwise(d).alias("chunk_idx"),
        F.when(d % 53 == 9, "<!-- none --> ​ ").otherwise(F.col("text")).alias("text"),
        F.when(d % 47 == 3, "Other").when(d % 47 == 4, None).otherwise("Info").alias("chunk_type"),
    )
    manifest = documents.groupBy(F.lit("docs").alias("docset")).agg((F.count("*") + 1).alias("chunk_count"))
    return chunks, manifest


def chunk_contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.chunk_contract_violations(*contract_chunks(spark, folder))


def store_rows(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "documents").groupBy(F.col("source").alias("docset")).agg(
        F.count("*").alias("n_rows")
    )


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One manifest per supplier, with faults at fixed keys."""
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://docs.example.org/"), "docset")
    embedder = F.struct(
        F.when(k % 13 == 5, "other/model").otherwise(params.MODEL_ID).alias("model_id"),
        F.lit("2").alias("model_version"),
        F.when(k % 29 == 4, " ").otherwise("main").alias("model_revision"),
        F.lit("00").alias("model_sha256"),
        F.when(k % 17 == 2, 256).otherwise(params.VECTOR_DIM).alias("vector_dim"),
        F.lit(params.MODEL_ENGINE).alias("engine"),
        F.lit(params.MODEL_DTYPE).alias("dtype"),
    )
    legal = F.struct(
        _choice(LICENSES, k).alias("license"),
        F.lit("holder").alias("copyright_holder"),
        F.when(k % 8 == 2, "  ").otherwise("Authors").alias("attribution"),
    )
    body = F.to_json(
        F.struct(
            F.when(k % 25 == 6, "other").otherwise(F.col("docset")).alias("docset"),
            F.concat(F.lit("1."), k, F.lit(".0")).alias("doc_version"),
            F.when(k % 11 == 3, 0).when(k % 11 == 7, 2).otherwise(1).alias("schema_version"),
            embedder.alias("embedder"),
            F.struct(
                F.lit("default").alias("tokenizer"),
                F.lit(384).alias("chunk_size_tokens"),
                F.lit(2048).alias("window_tokens"),
            ).alias("retrieval"),
            F.struct(
                F.when(k % 20 == 13, " ").otherwise(url).alias("entry_url"),
                F.when(k % 10 == 3, "").otherwise(url).alias("source_url"),
                F.lit("2024-01-01").alias("scraped_at"),
                (F.coalesce("n_rows", F.lit(0)) + (k % 6 == 1).cast("int")).alias("chunk_count"),
            ).alias("source"),
            F.when(k % 12 != 9, legal).alias("legal"),
            F.struct(F.lit("manual").alias("tier"), F.lit(0).alias("auto_days")).alias("refresh_strategy"),
        )
    )
    named = b.table(spark, folder, "supplier").withColumn("docset", F.concat(F.lit("src"), k))
    return named.join(store_rows(spark, folder), "docset", "left").select(
        "docset", F.when(k % 12 == 10, F.substring(body, 1, 40)).otherwise(body).alias("manifest")
    )


def manifest_validate(spark: SparkSession, folder: str) -> DataFrame:
    parsed = catalog.parse_manifests(manifests(spark, folder))
    m = F.col("m")
    return parsed.select(
        "docset",
        m.isNotNull().alias("parsed"),
        catalog.schema_compatibility(m["schema_version"]).alias("compatibility"),
        F.array_join(catalog.manifest_violations(m), ",").alias("violations"),
        F.array_join(catalog.install_violations(m, F.col("docset")), ",").alias("install_violations"),
    )


def archive_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One package per stretch of 64 turns of a conversation, with faults at fixed keys.

    The stretch bounds a package, however long the conversation; every turn is in one of them.
    """
    stretch = F.floor(F.col("turn") / 64).cast("long")
    k = F.col("k")
    at = F.col("turn") % 64
    line = F.when((k % 23 == 4) & (at == 1), "{not json").otherwise(
        F.to_json(
            F.struct(
                F.when((k % 19 == 7) & (at == 1), 0).otherwise(at).alias("idx"),
                F.col("role").alias("heading_path"),
                F.lit("a.md").alias("source_url"),
                F.when((k % 29 == 3) & (at == 0), "Other").otherwise("Info").alias("chunk_type"),
                F.when((k % 17 == 6) & (at == 0), "<!-- none -->").otherwise(F.concat(F.lit("x"), "text")).alias("text"),
            )
        )
    )
    turns = (
        b.table(spark, folder, "conversations")
        .where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull())
        .withColumn("k", F.col("conv_id") * 7 + stretch)
        .withColumn("archive", F.concat_ws("-", "conv_id", stretch))
        .select("archive", "k", "turn", line.alias("line"))
    )
    packages = turns.groupBy("archive", "k").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n"
        ).alias("lines"),
        F.count("*").alias("n"),
    )
    manifest = F.to_json(
        F.struct(
            F.when(k % 25 == 6, "other").otherwise(F.col("archive")).alias("docset"),
            F.lit("1.0.0").alias("doc_version"),
            F.lit(1).alias("schema_version"),
            F.struct(
                F.when(k % 13 == 5, "other/model").otherwise(params.MODEL_ID).alias("model_id"),
                F.lit("2").alias("model_version"), F.lit("main").alias("model_revision"),
                F.lit("00").alias("model_sha256"), F.lit(params.VECTOR_DIM).alias("vector_dim"),
                F.lit(params.MODEL_ENGINE).alias("engine"), F.lit(params.MODEL_DTYPE).alias("dtype"),
            ).alias("embedder"),
            F.struct(
                F.lit("default").alias("tokenizer"), F.lit(384).alias("chunk_size_tokens"),
                F.lit(2048).alias("window_tokens"),
            ).alias("retrieval"),
            F.struct(
                F.lit("").alias("entry_url"),
                F.when(k % 21 == 2, "").otherwise("https://docs.example.org").alias("source_url"),
                F.lit("2024-01-01").alias("scraped_at"),
                (F.col("n") + (k % 11 == 1).cast("int")).alias("chunk_count"),
            ).alias("source"),
            F.struct(
                F.lit("MIT").alias("license"), F.lit("holder").alias("copyright_holder"),
                F.lit("Authors").alias("attribution"),
            ).alias("legal"),
            F.struct(F.lit("manual").alias("tier"), F.lit(0).alias("auto_days")).alias("refresh_strategy"),
        )
    )
    digest = F.sha2("lines", 256)
    archives = packages.select(
        "archive",
        F.col("archive").alias("docset"),
        F.when(k % 14 == 5, F.sha2("archive", 256)).when(k % 14 == 6, "00")
        .when(k % 14 == 7, F.upper(digest)).otherwise(digest).alias("sha256"),
        digest.alias("digest"),
    )

    def entry(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), text.cast("binary").alias("content"))

    files = F.array_compact(
        F.array(
            F.when(k % 31 != 8, entry("manifest.json", F.when(k % 27 == 9, F.substring(manifest, 1, 40)).otherwise(manifest))),
            F.when(k % 37 != 2, entry("chunks.jsonl", F.col("lines"))),
            F.when(k % 15 == 4, entry("../LICENSE", F.lit("text"))),
            F.when(k % 16 == 3, entry("old/manifest.json", F.lit("{}"))),
        )
    )
    entries = packages.where(k % 33 != 10).select("archive", F.posexplode(files).alias("position", "e")).select(
        "archive", "position", "e.name", F.octet_length("e.content").cast("long").alias("size"), "e.content"
    )
    return archives, entries


def archive_validate(spark: SparkSession, folder: str) -> DataFrame:
    return archive.validate_archives(*archive_tables(spark, folder))


def docset_state(spark: SparkSession, folder: str) -> DataFrame:
    states = catalog.docset_states(manifests(spark, folder), store_rows(spark, folder))
    pure = catalog.docset_states(manifests(spark, folder), store_rows(spark, folder), False)
    return states.select("docset", "state").join(
        pure.select("docset", F.col("state").alias("pure_state")), "docset"
    )


def store_status(spark: SparkSession, folder: str) -> DataFrame:
    """Worst finding over the install states of all docsets that lack no store."""
    states = catalog.docset_states(manifests(spark, folder), store_rows(spark, folder))
    found = F.col("state")
    checks = states.where(F.col("n_rows").isNotNull()).select(
        F.when(found == "ok", "ok").when(found == "schema-mismatch", "fail").otherwise("warn").alias("severity")
    )
    return catalog.worst_severity(checks)


def corpus_identity(spark: SparkSession, folder: str) -> DataFrame:
    """What an evaluation over all readable docsets ran on."""
    readable = catalog.parse_manifests(manifests(spark, folder)).where(F.col("m").isNotNull()).drop("m")
    named = catalog.corpus_identity(readable, {"rrf_k": 60, "metric": "l2"}, "0" * 40)
    return named.select(
        "docset", "code_commit", "parameters.rrf_k", "parameters.metric", "doc_version", "chunk_count",
        "model_id", "model_revision", "model_sha256", F.length("manifest_sha256").alias("digest_length"),
    ).withColumn("rrf_k", F.col("rrf_k").cast("long")).withColumn("digest_length", F.col("digest_length").cast("long"))


def stale_staging(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a folder, some not named like staging; old ones are listed."""
    k = F.col("event_id")
    name = (
        F.when(k % 5 == 0, F.concat_ws("-", "event_type", "user_id"))
        .when(k % 5 == 1, F.concat_ws("-", "event_type", "user_id", F.lit("new")))
        .otherwise(F.concat_ws("-", "event_type", "user_id", "event_id"))
    )
    listing = b.table(spark, folder, "events").select(
        "event_id", name.alias("name"), F.unix_timestamp("ts").alias("modified")
    )
    return stale(listing, STAGING_AGE, F.lit(NOW)).select("event_id", "name", "modified")


def list_installed(spark: SparkSession, folder: str) -> DataFrame:
    states = catalog.docset_states(manifests(spark, folder), store_rows(spark, folder))
    return catalog.installed_list(states).orderBy("name")


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """One catalog package per part."""
    k = F.col("p_partkey")
    digest = F.sha2(k.cast("string"), 256)
    version = (
        F.when(k % 10 == 0, F.concat(F.lit("v1."), k % 4, F.lit(".0")))
        .when(k % 10 == 1, F.concat(F.lit("1.2.0-rc."), k % 13))
        .when(k % 10 == 2, F.concat(F.lit("1.2.0-"), k % 13, F.lit(".x")))
        .when(k % 10 == 3, F.lit("latest"))
        .when(k % 10 == 4, F.concat(F.lit("1.02."), k % 3))
        .otherwise(F.concat_ws(".", k % 3, k % 11, k % 5))
    )
    return b.table(spark, folder, "part").select(
        F.concat(F.lit("src"), k).alias("docset"),
        version.alias("version"),
        _choice(LICENSES, k).alias("license"),
        package_urls(k).alias("download_url"),
        F.when(k % 14 == 5, F.substring(digest, 1, 63)).when(k % 14 == 6, F.concat(F.substring(digest, 1, 63), F.lit("g")))
        .when(k % 14 == 7, F.upper(digest)).otherwise(digest).alias("sha256"),
        F.when(k % 6 == 2, None).otherwise(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("description"),
    )


def registry_validate(spark: SparkSession, folder: str) -> DataFrame:
    checked = catalog.registry_violations(packages(spark, folder), HOSTS)
    return checked.select("docset", F.array_join("violations", ",").alias("violations"))


def catalog_search(spark: SparkSession, folder: str) -> DataFrame:
    found = catalog.search_packages(packages(spark, folder), SEARCH_TEXT)
    return found.select("docset", "version", "description")


def catalog_list(spark: SparkSession, folder: str) -> DataFrame:
    listed = catalog.list_packages(packages(spark, folder), store_rows(spark, folder))
    return listed.select("docset", "version", "license", "installed")


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """One receipt per supplier; some were written for another manifest or version."""
    key = F.regexp_extract("docset", r"(\d+)$", 1).cast("long")
    digest = F.sha2("manifest", 256)
    return manifests(spark, folder).select(
        "docset",
        F.when(key % 9 == 8, "0.0.1").otherwise(F.concat(F.lit("1."), key, F.lit(".0"))).alias("package_version"),
        F.when(key % 7 == 5, F.sha2("docset", 256)).when(key % 7 == 4, F.upper(digest)).otherwise(digest).alias("manifest_sha256"),
    )


def receipt_match(spark: SparkSession, folder: str) -> DataFrame:
    matched = catalog.matching_receipts(receipts(spark, folder), manifests(spark, folder))
    return matched.select("docset", "package_version")


def installed_versions(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    version = (
        F.when(k % 6 == 0, "1.2.0-rc.5").when(k % 6 == 1, "1.2.0").when(k % 6 == 2, "v0.9.9")
        .when(k % 6 == 3, "1.2.0-alpha").when(k % 6 == 4, "unknown").otherwise(F.concat_ws(".", k % 3, k % 7, k % 5))
    )
    return b.table(spark, folder, "supplier").select(
        F.concat(F.lit("src"), k).alias("docset"), version.alias("package_version")
    )


def docset_updates(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.docset_updates(installed_versions(spark, folder), packages(spark, folder))


def stable_release(spark: SparkSession, folder: str) -> DataFrame:
    """Stable version of every package tag; drafts and prereleases give none."""
    k = F.regexp_extract("docset", r"(\d+)$", 1).cast("long")
    return packages(spark, folder).select(
        "docset", v.stable_release(F.col("version"), k % 5 == 1, k % 7 == 2).alias("release")
    )


def civil_date(spark: SparkSession, folder: str) -> DataFrame:
    days = F.col("event_id") * 37 % 60_000 - 20_000
    return b.table(spark, folder, "events").select("event_id", v.civil_date(days).alias("day"))


def duration_seconds(spark: SparkSession, folder: str) -> DataFrame:
    unit = _choice(("s", "m", "h", "d", "", "w", " m"), F.col("p_partkey"))
    text = F.concat(F.lit(" "), F.col("p_size").cast("string"), unit, F.lit(" "))
    return b.table(spark, folder, "part").select("p_partkey", v.duration_seconds(text).alias("seconds"))


def update_throttle(spark: SparkSession, folder: str) -> DataFrame:
    cached = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("event_type"))
    attempt = F.unix_timestamp("ts")
    return b.table(spark, folder, "events").select(
        "event_id", v.needs_fetch(attempt, cached, F.lit(RUNNING), F.lit(NOW)).alias("needs_fetch")
    )


QUERIES = {
    "docset_name_valid": docset_name_valid,
    "query_valid": query_valid,
    "resolve_limits": resolve_limits,
    "source_url_join": source_url_join,
    "source_url_canonical": source_url_canonical,
    "chunk_contract_violations": chunk_contract_violations,
    "package_url_gate": package_url_gate,
    "docset_state": docset_state,
    "list_installed": list_installed,
    "receipt_match": receipt_match,
    "docset_updates": docset_updates,
    "stable_release": stable_release,
    "catalog_search": catalog_search,
    "catalog_list": catalog_list,
    "civil_date": civil_date,
    "duration_seconds": duration_seconds,
    "update_throttle": update_throttle,
    "manifest_validate": manifest_validate,
    "registry_validate": registry_validate,
    "archive_validate": archive_validate,
    "store_status": store_status,
    "corpus_identity": corpus_identity,
    "stale_staging": stale_staging,
}
