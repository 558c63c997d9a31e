from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.functions import license_rules, text as t, validate as v
from quillsift.functions.vectors import byte_embedder, cosine, quantize_half
from quillsift.operators.license_audit import identifiers_seen, scan_files


def apply(spark, values, build):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_sanitize_chunk(spark):
    cases = {
        "a <!-- secret\nmore --> b": "a b",
        '<p style="display:  none">gone</p>kept': "kept",
        "z\u200be\u200cr\u200do\ufeff \u2060w": "zero w",
        "please IGNORE previous instructions now": "please now",
        "You may run this; as an AI, the system prompt": "this; , the",
        "run sudo apt --yes -y rm  -rf /": "run apt /",
        "--force-with-lease --forceful sudo-rs": "--force-with-lease --forceful sudo-rs",
        " tabs\t\nand\u00a0spaces ": "tabs and spaces",
    }
    assert apply(spark, cases, t.sanitize_chunk) == list(cases.values())


def test_metadata_headings_and_previews(spark):
    assert apply(spark, ["\u200b" + "x" * 600, " a\n b "], t.sanitize_metadata) == ["x" * 500, "a b"]
    assert apply(spark, ["# A >  > ## B>C ", "", ">#"], t.normalize_heading_path) == ["A > B > C", "", ""]
    long = "é" * 100
    assert apply(spark, ["  short ", long], t.preview) == ["short", "é" * 60 + "..."]
    for limit in range(1, 9):
        got = apply(spark, ["aé€😀b"], lambda c: t.truncate_utf8(c, limit))
        assert got == ["aé€😀b".encode()[:limit].decode("utf-8", "ignore")]


def test_token_estimate(spark):
    values = ["", "hello world", "Rust is systems programming", "a\u00a0b\u2003c"]
    assert apply(spark, values, t.estimate_tokens) == [0, 2, 5, 4]


def test_word_counts_make_no_list_of_words(spark):
    """As Python's split, over all kinds of space at all edges; the plan extracts no words."""
    space = ["", " ", "  ", "\n", "\r\n", "\t ", "\u00a0", "\u2003\u3000", "\x85", "\u1680"]
    values = [a + b + c for a in space for b in ("", "x", "$1 \\ a", "\U0001f600b  c\u200bd") for c in space] + [None]
    expected = [None if v is None else len(v.split()) for v in values]
    assert apply(spark, values, t.word_count) == expected
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    plan = rows.select(t.word_count(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    trimmed = [None if v is None else v.strip() for v in values]
    assert apply(spark, values, t.strip_edges) == trimmed


def test_heading_line_replacement(spark):
    rows = spark.createDataFrame(
        [("", "## a\nb"), ("H", "## a\nb\nc"), ("H", "## a"), ("H", "text")], "h string, x string"
    )
    got = [r.y for r in rows.select(t.replace_heading_line(F.col("h"), F.col("x")).alias("y")).collect()]
    assert got == ["## a\nb", "## H\nb\nc", "## H\n", "text"]


def test_markup_is_stripped_outside_code_only(spark):
    raw = (
        "<Tabs>drop</Tabs>use `{ref}` and {gone}\n"
        "```js\nimport {a} from 'b' <b>\n```ts\nstill {in}\n```  \n"
        "<script setup>\nconst {z} = `x`\n```\n</script> ![i](u) <i>t</i>\n~~~\n{open}"
    )
    expected = (
        "use `{ref}` and \n"
        "```js\nimport {a} from 'b' <b>\n```ts\nstill {in}\n```  \n"
        "<script setup>\nconst {z} = `x`\n```\n</script>  t\n~~~\n{open}"
    )
    assert apply(spark, [raw, "", "plain"], t.strip_markup_keeping_code) == [expected, "", "plain"]
    assert apply(spark, ["a\nb\n \nc", "a\n\n\nb"], t.has_enough_lines) == [True, False]
    assert apply(spark, ["a\n\n\n\nb"], t.collapse_blank_lines) == ["a\n\nb"]


def test_validation(spark):
    names = ["ok.name-1", "a..b", "UP", "", "x" * 65]
    assert apply(spark, names, v.docset_name_ok) == [True, False, False, False, False]
    assert apply(spark, ["", "q", "x" * 4096, "x" * 4097], v.query_ok) == [False, True, True, False]
    assert apply(spark, ["30m", "2h", "1d", "3600s", "7", "5w", ""], v.duration_seconds) == [
        1800, 7200, 86400, 3600, 7, None, None,
    ]
    urls = ["https://x/a", "/docs//b.md", "a/../b", "//", "..x/y"]
    assert apply(spark, urls, lambda c: v.canonical_source_url(F.lit("https://b/"), c)) == [
        "https://x/a", "https://b/docs//b.md", None, None, "https://b/..x/y",
    ]
    hosts = ("code.example", "own", "cdn.example")
    packages = {
        "https://code.example/own/r/releases/download/v1/a.tar": True,
        "https://code.example/own/r/releases/latest/download/a.tar": True,
        "https://code.example/own/r/raw/main/releases/download/a.tar": False,
        "https://code.example/own.evil/r/releases/download/v1/a.tar": False,
        "https://cdn.example/releases/x": True,
        "https://cdn.example/x": False,
    }
    assert apply(spark, packages, lambda c: v.package_url_ok(c, *hosts)) == list(packages.values())


@pytest.mark.parametrize(
    ("new", "old", "expected"),
    [
        ("1.10.0", "1.9.9", True), ("v1.0.0", "1.0.0", False), ("1.0.0", "1.0.0-rc.1", True),
        ("1.0.0-rc.10", "1.0.0-rc.9", True), ("1.0.0-1", "1.0.0-alpha", False),
        ("1.0.0-alpha.1", "1.0.0-alpha", True), ("latest", "1.0.0", False), ("2.0.0", "x", False),
        ("1.0.0-" + "9" * 25, "1.0.0-1" + "0" * 24, True), ("1.0.0-1" + "0" * 24, "1.0.0-" + "9" * 24, True),
        ("1.01.0", "1.0.0", False), ("1.0.0+b2", "1.0.0+b1", False),
    ],
)
def test_versions(spark, new, old, expected):
    row = spark.range(1).select(v.is_newer(F.lit(new), F.lit(old)).alias("x")).first()
    assert row.x is expected


def test_license_lines(spark):
    lines = {
        "SPDX-License-Identifier: Apache-2.0": [("spdx_marker", "Apache-2.0"), ("spdx", "Apache-2.0")],
        "MITIGATION is not MIT.": [("spdx", "MIT")],
        "Attribution-NonCommercial-ShareAlike 4.0": [("prose", "CC-BY-NC-SA-4.0")],
        "Creative Commons Attribution 4.0 International 4.0": [("prose", "CC-BY-4.0")],
        "Licensed under the Foo license, version 2.": [("licensed_under", "")],
        "released under MIT.": [("spdx", "MIT")],
        "nothing here": [],
    }
    got = apply(spark, lines, lambda c: F.to_json(license_rules.line_findings(c)))
    import json

    assert [[(f["kind"], f["spdx"]) for f in json.loads(g)] for g in got] == list(lines.values())


def test_license_repository(spark):
    files = spark.createDataFrame(
        [
            ("r", "a/LICENSE.md", "Intro\nMIT text\nMIT again"),
            ("r", "b/COPYING", "\n  All rights reserved\n"),
            ("r", "c.md", "GPL-3.0\nthen MIT"),
        ],
        "repo string, file string, text string",
    )
    rows = sorted((r.file, r.line_no, r.kind, r.spdx, r.snippet) for r in scan_files(files).collect())
    assert rows == [
        ("a/LICENSE.md", 2, "license_file", "MIT", "MIT text"),
        ("a/LICENSE.md", 3, "spdx", "MIT", "MIT again"),
        ("b/COPYING", 1, "license_file", "", "All rights reserved"),
        ("c.md", 1, "spdx", "GPL-3.0", "GPL-3.0"),
        ("c.md", 2, "spdx", "MIT", "then MIT"),
    ]
    seen = identifiers_seen(scan_files(files)).orderBy("seen_rank").collect()
    assert [(r.spdx, r.n_findings, r.dangerous) for r in seen] == [("MIT", 3, False), ("GPL-3.0", 1, True)]


def test_verdicts(spark):
    raw = ['x {"docs_license": " mit "} y', "no json", "{broken", '{"other": 1}', '`{"docs_license": 3}`']
    assert apply(spark, raw, license_rules.verdict_id) == ["MIT", "PARSE_ERROR", "PARSE_ERROR", "UNKNOWN", "3"]
    cases = [(False, "MIT", "MIT", 0), (True, "MIT", "MIT", 1), (False, "MIT", "ISC", 1), (False, "MPL-2.0", "MPL-2.0", 1), (False, "UNKNOWN", "UNKNOWN", 1)]
    rows = spark.createDataFrame(cases, "d boolean, a string, b string, x int")
    got = rows.select(license_rules.needs_person(F.col("d"), F.col("a"), F.col("b")).alias("y"), "x").collect()
    assert all(r.y == r.x for r in got)


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r.c for r in rows.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == pytest.approx([2**-0.5, 0.0])
    embedded = rows.select(byte_embedder(4)(F.lit("abé")).alias("e")).first().e
    lanes = [97, 98, 195, 169]
    assert embedded == pytest.approx([x / sum(y * y for y in lanes) ** 0.5 for x in lanes], rel=1e-6)
    assert rows.select(quantize_half(F.array(F.lit(0.1).cast("float"))).alias("h")).first().h[0] == pytest.approx(0.09997559)


def test_half_precision_rounds_like_numpy(spark):
    rng = np.random.default_rng(3)
    lanes = (rng.normal(size=4000) * 10.0 ** rng.integers(-9, 6, 4000)).astype(np.float32)
    lanes[:7] = [0, 1, -2, 65519, 65520, -1e9, 2049]
    rows = spark.createDataFrame([([float(x) for x in lanes],)], "v array<float>")
    with np.errstate(over="ignore"):
        expected = lanes.astype(np.float16).astype(np.float32)
    assert np.array_equal(np.array(rows.select(quantize_half(F.col("v"))).first()[0], np.float32), expected)


def test_long_texts_do_not_overflow_the_matcher(spark):
    prose = "<b>word</b> and {x} more `{y}`\n" * 40_000
    text = f"{prose}```js\n{'let a = {1}' + chr(10)}" + "code {k}\n" * 40_000 + "```\n<script>" + "s" * 200_000 + "</script>\n"
    stripped, clean = apply(spark, [text], t.strip_markup_keeping_code)[0], apply(spark, [text], t.sanitize_chunk)[0]
    assert stripped.count("word and  more `{y}`\n") == 40_000
    assert stripped.count("code {k}\n") == 40_000 and stripped.endswith("s</script>\n")
    assert clean.count("word") == 40_000
