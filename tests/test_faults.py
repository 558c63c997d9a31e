"""Inputs that the provided tables do not hold: extreme numbers, odd spaces, empty docsets, schemes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillsift.functions.license_rules import line_findings
from quillsift.functions.validate import duration_seconds, is_newer
from quillsift.sources.catalog import chunk_contract_violations
from quillsift.sources.files import relative_to


def test_numbers_too_long_spoil_only_their_row(spark):
    rows = [("9" * 24 + ".0.0", "1.0.0", "9" * 20 + "d"), ("2.0.0", "1.0.0", "2h"), ("2.0.0", "1.0.0", "9" * 18 + "d")]
    found = spark.createDataFrame(rows, "a string, b string, d string").select(
        is_newer(F.col("a"), F.col("b")).alias("newer"), duration_seconds(F.col("d")).alias("seconds")
    )
    assert [tuple(r) for r in found.collect()] == [(False, None), (True, 7200), (True, None)]


@pytest.mark.parametrize("scheme", ["s3a://bucket", "abfss://c@a.host", "hdfs://name:8020", "gs://b", "file://"])
def test_relative_paths_under_any_scheme(spark, scheme):
    folder = f"{scheme}/data/md"
    rows = spark.createDataFrame([(f"{folder}/x/a.md",)], "path string")
    assert rows.select(relative_to(folder)).first()[0] == "x/a.md"


def test_odd_spaces_in_licenses(spark):
    line = "Creative\u00a0Commons Attribution-ShareAlike\u00a04.0"
    found = spark.createDataFrame([(line,)], "line string").select(line_findings(F.col("line"))).first()[0]
    assert "CC-BY-SA-4.0" in {f["spdx"] for f in found}


def test_empty_docset_and_null_text_break_the_contract(spark):
    chunks = spark.createDataFrame([("a", 0, None, "Info")], "docset string, chunk_idx long, text string, chunk_type string")
    manifests = spark.createDataFrame([("a", 1), ("b", 2)], "docset string, chunk_count long")
    found = {(r["docset"], r["violation"]) for r in chunk_contract_violations(chunks, manifests).collect()}
    assert found == {("a", "empty_text"), ("b", "chunk_count")}
