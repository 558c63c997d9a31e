from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from brute_chunks import chunk
from quillsift import params, schemas
from quillsift.functions.vectors import byte_embedder
from quillsift.operators.batch import QueryBatch
from quillsift.operators.license_audit import scan_files
from quillsift.plans.evaluation import evaluate_suite
from quillsift.plans.search import search, search_docsets
from quillsift.sources import archive, catalog, files
from quillsift.sources.store import DocsetNotInstalled, DocsetStore, StoreError, build_manifest


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    pages = {
        "b.md": "# B\n\n" + "Long text here. " * 400,
        "a.md": "# A\nintro\n```py\nprint(1)\n```\n## Two\nmore",
        "sub/c.md": "plain page",
    }
    for name, text in pages.items():
        (root / name).write_text(text)
    (root / "COPYING.txt").write_text("copying")
    (root / "License.md").write_text("MIT terms")
    (root / "x.mdx").write_text("<Tabs>t</Tabs>\none {a}\n\n\n\ntwo\nthree `{b}`\n")
    return root, {**pages, "License.md": "MIT terms"}


def test_files(spark, tree):
    root, pages = tree
    got = {r.rel: r.markdown for r in files.read_markdown(spark, str(root)).collect()}
    assert got == pages
    prepared = {r.rel: r.markdown for r in files.prepared_docs(spark, str(root), exclude="sub").collect()}
    assert "sub/c.md" not in prepared and "License.md" not in prepared
    assert prepared["x.md"] == "\none \n\ntwo\nthree `{b}`\n"
    assert files.license_text(spark, str(root)).first().text == "MIT terms"
    (root / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="(?i)utf"):
        files.read_markdown(spark, str(root)).collect()
    audited = files.audit_files(spark, str(root), "r")
    assert {r.kind for r in scan_files(audited.where("file = 'License.md'")).collect()} == {"license_file"}


def test_store_life_cycle(spark, tree, tmp_path):
    root, pages = tree
    embed = byte_embedder()
    store = DocsetStore(spark, str(tmp_path / "store"))
    with pytest.raises(DocsetNotInstalled):
        store.chunks("docs")
    meta = {"license": "MIT", "source_url": "https://docs.example.org/", "copyright_holder": "Them"}
    first = store.ingest("docs", str(root), embed, base_url="https://docs.example.org/", **meta)
    rows = store.chunks("docs").orderBy("chunk_idx").collect()
    expected = [
        (f"https://docs.example.org/{name}", *c) for name in sorted(pages) for c in chunk(pages[name])
    ]
    assert [(r.source_url, r.heading_path, r.chunk_type, r.text) for r in rows] == expected
    assert [r.chunk_idx for r in rows] == list(range(len(rows)))
    assert len(rows[0].embedding) == params.VECTOR_DIM
    assert store.manifest("docs")["source"]["chunk_count"] == len(rows)
    assert [r.chunk_idx for r in store.fetch("docs", [3, 1, 999]).collect()] == [1, 3]

    with pytest.raises(StoreError, match="license"):
        store.ingest("docs", str(root), embed, license="GPL-3.0")
    with pytest.raises(Exception, match="dimension"):
        store.write("docs", store.chunks("docs").withColumn("embedding", F.slice("embedding", 1, 3)), store.manifest("docs"))
    assert store.chunks("docs").count() == len(rows)

    live = store.chunks("docs")
    queries = live.where("chunk_idx in (0, 2)").select(
        F.col("chunk_idx").alias("qid"), F.col("text").alias("query"), F.col("embedding").alias("qvec")
    )
    found = search(QueryBatch.measure(queries), live, live.select("chunk_idx", "embedding", "span"))
    assert {r.qid: r.chunk_idx for r in found.rows.where("pos = 1").collect()} == {0: 0, 2: 2}
    assert "span" in found.rows._jdf.queryExecution().executedPlan().toString()

    second = store.rebuild("docs", embed)
    assert second != first and store.manifest("docs")["source"]["source_url"] == meta["source_url"]
    bundle = store.share("docs", str(tmp_path / "out"))
    with pytest.raises(StoreError, match="not empty"):
        store.share("docs", str(tmp_path / "out"))
    notice = (tmp_path / "out/docs/NOTICE").read_text()
    assert "Copyright: Them" in notice and "Attribution" not in notice

    other = DocsetStore(spark, str(tmp_path / "other"))
    other.install(bundle, "docs", embed, "0" * 64)
    columns = [c for c in schemas.CHUNKS.names if c != "embedding"]
    same = store.chunks("docs").select(*columns).exceptAll(other.chunks("docs").select(*columns))
    assert same.count() == 0
    receipts = files.read_receipts(spark, str(tmp_path / "other/receipts"))
    assert catalog.matching_receipts(receipts, other.manifests()).count() == 1
    states = catalog.docset_states(other.manifests(), other.row_counts())
    assert [(r.docset, r.state) for r in states.collect()] == [("docs", "ok")]
    other.write_index("docs")
    assert other.index("docs").where("term = 'intro'").count() == 1
    other.append("docs", other.chunks("docs").limit(1))
    states = catalog.docset_states(other.manifests(), other.row_counts())
    assert [r.state for r in states.collect()] == ["count-mismatch"]
    other.uninstall("docs")
    assert other.docsets() == []


def test_schema_migration(spark):
    base = spark.createDataFrame([], schemas.CHUNKS)
    assert schemas.ensure_schema(base.drop("api_version")).columns == schemas.CHUNKS.names
    with pytest.raises(schemas.SchemaError):
        schemas.ensure_schema(base.drop("text"))
    with pytest.raises(schemas.SchemaError):
        schemas.ensure_schema(base.withColumn("text", F.lit(1)))


def make_tar(entries, compress=False):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return gzip.compress(raw.getvalue()) if compress else raw.getvalue()


def test_archives(spark, tmp_path):
    good = [("manifest.json", b"{}"), ("chunks.jsonl", b"{}"), ("sub/LICENSE", b"x")]
    bad = [("../manifest.json", b"{}"), ("/abs", b""), ("C:\\x", b""), ("a/manifest.json", b"{}"), ("index.lance/data.bin", b""), ("v/embeddings.bin", b"")]
    (tmp_path / "good.tar").write_bytes(make_tar(good))
    (tmp_path / "bad.tgz").write_bytes(make_tar(bad, compress=True))
    entries = archive.read_archives(spark, str(tmp_path)).withColumn("archive", F.regexp_extract("archive", "([^/.]+)[.][^/]+$", 1))
    assert {(r.name, r.content.decode()) for r in entries.where("archive = 'good'").collect()} == {(n, d.decode()) for n, d in good}
    got = sorted((r.archive, r.violation, r["name"]) for r in archive.archive_violations(entries).collect() if r["name"])
    assert got == [
        ("bad", "absolute_path", "/abs"), ("bad", "absolute_path", "C:\\x"),
        ("bad", "duplicate_entry", "manifest.json"), ("bad", "unsafe_path", "../manifest.json"),
        ("bad", "vector_artifact", "index.lance/data.bin"), ("bad", "vector_artifact", "v/embeddings.bin"),
    ]
    release = {(r.archive, r.violation) for r in archive.archive_violations(entries, release=True).collect()}
    assert ("good", "missing_store") in release and ("bad", "missing_store") not in release


def test_archive_contents_and_digests(spark, tmp_path):
    legal = {"license": "MIT", "copyright_holder": "h", "attribution": "a"}
    base = build_manifest("d", 2, source_url="https://docs.example.org", doc_version="1.0.0", **legal)
    line = lambda i, **over: json.dumps({"idx": i, "heading_path": "H", "source_url": "a.md", "text": "some text", **over})
    good = "\r\n".join([line(0), "", line(1, chunk_type="Code"), ""]).encode()
    manifest = json.dumps(base).encode()
    files = {
        "good": [("m/manifest.json", manifest), ("m/chunks.jsonl", good)],
        "empty": [],
        "utf8": [("manifest.json", b"\xff\xfe"), ("chunks.jsonl", b"\xff")],
        "lines": [("manifest.json", manifest), ("chunks.jsonl", "\n".join(
            [line(1), "{torn", line(2, text="<!-- x -->", chunk_type="Prose"), '{"idx": 3}']).encode())],
        "other": [("manifest.json", json.dumps({**base, "docset": "e", "schema_version": 2}).encode()), ("chunks.jsonl", good)],
        "second": [("manifest.json", manifest), ("chunks.jsonl", good), ("x-chunks.jsonl", b"{torn")],
        "wrong": [("manifest.json", manifest), ("chunks.jsonl", good)],
    }
    digests = {}
    for name, entries in files.items():
        data = make_tar(entries)
        digests[name] = hashlib.sha256(data).hexdigest()
        (tmp_path / f"{name}.tar").write_bytes(data)
    named = F.regexp_extract("archive", "([^/.]+)[.][^/]+$", 1)
    expected = [(n, "d", {"wrong": "0" * 64, "good": d.upper(), "other": "abc"}.get(n, d)) for n, d in digests.items()]
    archives = archive.archive_files(spark, str(tmp_path)).withColumn("archive", named).join(
        spark.createDataFrame(expected, "archive string, docset string, sha256 string"), "archive"
    )
    entries = archive.read_archives(spark, str(tmp_path)).withColumn("archive", named)
    got = sorted((r.archive, r.violation, r["name"] or "") for r in archive.validate_archives(archives, entries).collect())
    assert got == sorted([
        ("empty", "missing_chunks", ""), ("empty", "missing_manifest", ""),
        ("utf8", "invalid_manifest", ""), ("utf8", "invalid_chunks", ""),
        ("lines", "chunk_count", ""), ("lines", "idx_position", "0"), ("lines", "malformed_line", "1"),
        ("lines", "empty_text", "2"), ("lines", "chunk_type", "2"), ("lines", "malformed_line", "3"),
        ("other", "sha256_shape", ""), ("other", "manifest_rule", "schema_version"), ("other", "manifest_rule", "docset_name"),
        ("wrong", "sha256_mismatch", ""),
    ])
    release = {(r.archive, r.violation) for r in archive.validate_archives(archives, entries, release=True).collect()}
    assert ("good", "missing_store") in release and not any(v == "chunk_count" for _, v in release)


def test_catalog_files(spark, tmp_path):
    package = {"docset": "d", "version": "1.0.0", "license": "MIT", "chunk_count": 3, "freshness": "now", "download_url": "u", "sha256": "s"}
    (tmp_path / "index.json").write_text(json.dumps({"schema_version": 1, "generated_at": "x", "packages": [package]}, indent=1))
    row = files.read_registry(spark, str(tmp_path / "index.json")).first()
    assert (row.docset, row.chunk_count, row.description) == ("d", 3, None)
    suite = [{"id": "q1", "docset": "d", "query": "how", "intent_family": "f", "split": "test", "query_form": "short", "query_class": "positive",
              "targets": [{"source_url": "a", "grade": 2}, {"source_url": "b", "heading_path_prefix": "H", "grade": 1}]}]
    (tmp_path / "suite.json").write_text(json.dumps(suite))
    targets = files.suite_targets(files.read_suite(spark, str(tmp_path / "suite.json"))).collect()
    assert [(r.target_no, r.source_url, r.heading_prefix, r.grade) for r in targets] == [(0, "a", None, 2), (1, "b", "H", 1)]
    listing = spark.createDataFrame([("d-12-34", 0), ("x-y-1-2", 0), ("d-1-new", 0), ("d-1-2", 95)], "name string, modified bigint")
    assert {r.name for r in files.stale_staging(listing, 50, F.lit(100)).collect()} == {"d-12-34", "x-y-1-2"}


def test_identity_and_status(spark):
    from dataclasses import asdict

    from quillsift.params import SearchParams
    from quillsift.sources.store import build_manifest

    good = json.dumps(build_manifest("d", 3, license="MIT"))
    row = catalog.corpus_identity(
        spark.createDataFrame([("d", good)], "docset string, manifest string"), asdict(SearchParams()), "abc"
    ).first()
    assert (row.doc_version, row.chunk_count, row.parameters.rrf_k, row.code_commit) == ("1.0.0", 3, 60, "abc")
    blank = json.dumps(build_manifest("d", 3, license="MIT", doc_version=" "))
    with pytest.raises(Exception, match="no readable version"):
        catalog.corpus_identity(
            spark.createDataFrame([("d", blank)], "docset string, manifest string"), {"k": 1}, "abc"
        ).collect()
    checks = spark.createDataFrame([("ok",), ("warn",), ("ok",)], "severity string")
    assert catalog.worst_severity(checks).first().status == "warn"
    assert catalog.worst_severity(checks.where("severity = 'x'")).first().status == "ok"


def test_suite_over_a_store(spark, tree, tmp_path):
    root, _ = tree
    embed = byte_embedder()
    store = DocsetStore(spark, str(tmp_path / "store"))
    for name in ("one", "two"):
        store.ingest(name, str(root), embed, license="MIT")
    row = store.chunks("one").where("heading_path = 'A'").first()

    def entry(name, docset, split="test", kind="positive", query=row.text):
        targets = [{"source_url": "a.md", "heading_path_prefix": "A", "grade": 2}] if kind == "positive" else []
        return {"id": name, "docset": docset, "query": query, "intent_family": f"f-{name}", "split": split,
                "query_form": "short", "query_class": kind, "targets": targets}

    suite = [entry("q1", "one"), entry("q2", "two"), entry("q3", "one", "development"),
             entry("q4", "two", kind="near_domain_negative", query="zzz")]
    (tmp_path / "suite.json").write_text(json.dumps(suite))
    loaded = files.read_suite(spark, str(tmp_path / "suite.json"))
    run = evaluate_suite(store, loaded, embed)
    report = {(r.stratum_kind, r.stratum_value, r.measure): r.value for r in run.report().collect()}
    assert report[("overall", "", "dense_at_40.mrr")] == 1
    assert report[("overall", "", "decisive_coverage.total")] == 3
    assert report[("docset", "one", "output_at_5.recall")] == 1
    assert {r.qid: r.output_at_5 for r in run.stage_ranks().collect()} == {"q1": 1, "q2": 1, "q4": None}
    with pytest.raises(ValueError, match="contract"):
        evaluate_suite(store, loaded.unionByName(loaded), embed)

    asked = loaded.where("split = 'test'").select(
        F.col("id").alias("qid"), "docset", "query", embed(F.col("query")).alias("qvec")
    )
    rows, decisions = search_docsets(asked, store)
    assert {(r.qid, r.docset) for r in decisions.collect()} == {("q1", "one"), ("q2", "two"), ("q4", "two")}
    assert rows.where("pos = 1 and qid = 'q2'").first().text == row.text
    with pytest.raises(ValueError, match="not installed"):
        search_docsets(asked.withColumn("docset", F.lit("none")), store)
    with pytest.raises(ValueError, match="not installed"):
        search_docsets(asked.withColumn("docset", F.lit(None).cast("string")), store)
    # The stored index of one docset answers as its texts do.
    one = asked.where("docset = 'one'")
    plain, _ = search_docsets(one, store)
    index = store.write_index("one")
    assert index.analyzer == "english" and len(index.segments()) == 1
    stored, _ = search_docsets(one, store)
    key = ("qid", "pos", "chunk_idx")
    assert sorted(map(tuple, stored.select(*key).collect())) == sorted(map(tuple, plain.select(*key).collect()))
    rows, decisions = search_docsets(asked.withColumn("query", F.lit("")), store)
    assert rows.count() == 0
    assert {r["answer_state"] for r in decisions.collect()} == {"invalid_query"}
    assert decisions.count() == asked.count()
