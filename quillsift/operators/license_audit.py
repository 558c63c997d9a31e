"""License findings per line, and what they say about a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.functions import license_rules as rules
from quillsift.functions.text import strip_edges
from quillsift.session import spread


def scan_files(files: DataFrame) -> DataFrame:
    """Findings ``(repo, file, line_no, seq, kind, spdx, raw, snippet)`` of
    ``(repo, file, text)``.

    The first finding of a license file is tagged ``license_file``; a license
    file without any gets a bare one at line 1 with its first non-blank line.
    """
    in_license = rules.is_license_file(F.col("file"))
    lines = rules.lines_of(F.col("text"))
    numbered = F.filter(
        F.transform(lines, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line"))),
        lambda x: x["line"].rlike(rules.HINT),
    )
    found = F.flatten(
        F.transform(
            numbered,
            lambda x: F.transform(
                rules.line_findings(x["line"]),
                lambda f, seq: F.struct(
                    x["line_no"].alias("line_no"),
                    seq.alias("seq"),
                    f["kind"].alias("kind"),
                    f["spdx"].alias("spdx"),
                    f["raw"].alias("raw"),
                    rules.snippet(x["line"]).alias("snippet"),
                ),
            ),
        )
    )
    anchor = F.lit("license_file")
    tagged = F.transform(
        "found",
        lambda f, i: F.when((i == 0) & F.col("in_license"), f.withField("kind", anchor)).otherwise(f),
    )
    first_line = F.try_element_at(F.filter(lines, lambda x: strip_edges(x) != ""), F.lit(1))
    bare = F.struct(
        F.lit(1).alias("line_no"),
        F.lit(0).alias("seq"),
        anchor.alias("kind"),
        F.lit("").alias("spdx"),
        F.lit("").alias("raw"),
        F.coalesce(rules.snippet(first_line), F.lit("")).alias("snippet"),
    )
    return (
        spread(files, "file")
        .select("repo", "file", "text", in_license.alias("in_license"), found.alias("found"))
        .select(
            "repo",
            "file",
            F.inline(
                F.when(F.col("in_license") & (F.size("found") == 0), F.array(bare)).otherwise(tagged)
            ),
        )
    )


def identifiers_seen(findings: DataFrame) -> DataFrame:
    """Distinct identifiers per repository in first-seen order, with their risk.

    Counts combine before the shuffle, so one large repository costs no more
    than its distinct identifiers.
    """
    seen = (
        findings.where(F.col("spdx") != "")
        .groupBy("repo", "spdx")
        .agg(
            F.count("*").alias("n_findings"),
            F.min(F.struct("file", "line_no", "seq")).alias("first"),
        )
    )
    order = Window.partitionBy("repo").orderBy("first", "spdx")
    return seen.select(
        "repo",
        "spdx",
        "n_findings",
        F.row_number().over(order).alias("seen_rank"),
        F.col("first.file").alias("first_file"),
        F.col("first.line_no").alias("first_line"),
        F.col("spdx").isin(*rules.DANGEROUS).alias("dangerous"),
    )
