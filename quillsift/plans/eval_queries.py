"""Registered evaluation queries: the benchmark items as a labelled suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift import params
from quillsift.operators import metrics
from quillsift.plans import bindings as b
from quillsift.plans import evaluation
from quillsift.plans import search as s

FORMS = ("short", "natural_language", "verbose", "keyword_heavy")


def _choice(values: tuple[str, ...], by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int") + 1)


def labelled_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every benchmark item; class, form and split follow from its id."""
    qid = F.col("item_id")
    return b.table(spark, folder, "benchmark").select(
        qid.alias("qid"),
        F.concat(F.lit("set"), qid % 3).alias("docset"),
        F.when(qid % 2 == 0, "development").otherwise("test").alias("split"),
        _choice(FORMS, qid).alias("form"),
        F.when(qid % 5 == 3, "near_domain_negative")
        .when(qid % 5 == 4, "cross_domain_negative")
        .otherwise("positive")
        .alias("class"),
    )


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """Positive items: the page of their own chunk (grade 2) and, under its
    heading, that of the next chunk (grade 1)."""
    positive = labelled_queries(spark, folder).where(F.col("class") == "positive").select("qid")
    pages = b.chunks(spark, folder).select("chunk_idx", "source_url", "heading_path")
    labels = positive.select(
        "qid",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("target_no"), F.lit(2).alias("grade"), F.col("qid").alias("chunk_idx")),
                F.struct(F.lit(1).alias("target_no"), F.lit(1).alias("grade"), (F.col("qid") + 1).alias("chunk_idx")),
            )
        ),
    )
    return labels.join(pages, "chunk_idx").select(
        "qid",
        "target_no",
        "grade",
        "source_url",
        F.when(F.col("target_no") == 1, F.col("heading_path")).alias("heading_prefix"),
    )


def evaluate(spark: SparkSession, folder: str) -> evaluation.Evaluation:
    return evaluation.evaluate(
        labelled_queries(spark, folder),
        targets(spark, folder),
        b.batch(spark, folder),
        b.chunks(spark, folder),
        b.vectors(spark, folder),
    )


def ranking_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return b.as_output(evaluate(spark, folder).metrics.drop("first_rank"))


def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    return b.as_output(evaluate(spark, folder).report())


def stage_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return b.as_output(evaluate(spark, folder).stage_ranks())


def decision_evidence(spark: SparkSession, folder: str) -> DataFrame:
    batch, chunks, vectors = b.batch(spark, folder), b.chunks(spark, folder), b.vectors(spark, folder)
    result = s.search(batch, chunks, vectors)
    cosines = s.pool_cosines(s.attach(batch, result.pool, chunks, vectors))
    return b.as_output(
        metrics.decision_evidence(
            labelled_queries(spark, folder), result.selected, cosines, result.decisions
        )
    )


def _expected_page(spark: SparkSession, folder: str) -> DataFrame:
    """One expected page per benchmark item: the page of the chunk with its id."""
    items = b.table(spark, folder, "benchmark").select(F.col("item_id").alias("chunk_idx"))
    return items.join(b.chunks(spark, folder).select("chunk_idx", "source_url"), "chunk_idx").select(
        F.col("chunk_idx").alias("qid"), F.col("source_url").alias("expected_url")
    )


def _first_ranks(spark: SparkSession, folder: str, ranked: DataFrame) -> DataFrame:
    """First rank of the expected page per query; null when it never appears."""
    expected = _expected_page(spark, folder)
    pages = b.chunks(spark, folder).select("chunk_idx", "source_url")
    found = (
        ranked.join(pages, "chunk_idx")
        .join(expected, "qid")
        .where(F.col("source_url") == F.col("expected_url"))
        .groupBy("qid")
        .agg(F.min("rank").alias("rank"))
    )
    return expected.join(found, "qid", "left")


def recall_mrr(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and MRR of the expected page in the fused pool, per query form."""
    pool = s.hybrid_pool(b.batch(spark, folder), b.chunks(spark, folder), b.vectors(spark, folder))
    ranks = _first_ranks(spark, folder, pool.select("qid", "chunk_idx", F.col("fused_rank").alias("rank")))
    forms = labelled_queries(spark, folder).select("qid", "form")
    return b.as_output(metrics.recall_mrr(ranks.join(forms, "qid"), "form"))


def golden_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Recall@5 and MRR of the returned chunks, with the release gates."""
    rows = s.search(b.batch(spark, folder), b.chunks(spark, folder), b.vectors(spark, folder)).rows
    first = rows.where(F.col("pos") <= 5).select("qid", "chunk_idx", F.col("pos").alias("rank"))
    scores = metrics.recall_mrr(_first_ranks(spark, folder, first))
    return b.as_output(
        scores.withColumn("recall_ok", F.col("recall") >= params.MIN_RECALL).withColumn(
            "mrr_ok", F.col("mrr") >= params.MIN_MRR
        )
    )


def negative_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Per negative class: how many queries got any chunk, and the highest score."""
    rows = s.search(b.batch(spark, folder), b.chunks(spark, folder), b.vectors(spark, folder)).rows
    negatives = labelled_queries(spark, folder).where(F.col("class") != "positive").select("qid", "class")
    best = rows.groupBy("qid").agg(F.max("score").alias("score"), F.lit(True).alias("answered"))
    per_query = negatives.join(best, "qid", "left").withColumn(
        "answered", F.coalesce("answered", F.lit(False))
    )
    rate = F.avg(F.col("answered").cast("double"))
    return b.as_output(
        per_query.groupBy("class").agg(
            F.count("*").alias("n_queries"),
            F.sum(F.col("answered").cast("long")).alias("n_answered"),
            rate.alias("false_positive_rate"),
            F.max("score").alias("max_score"),
            (rate <= params.MAX_FALSE_POSITIVE_RATE).alias("rate_ok"),
        )
    )


def wilson_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of toxic labels per language and source, with its interval."""
    labels = b.table(spark, folder, "labels").join(
        b.table(spark, folder, "documents").select("doc_id", "lang", "source"), "doc_id"
    )
    counted = labels.groupBy("lang", "source").agg(
        F.sum("toxic").cast("long").alias("n_hits"), F.count("*").alias("n_total")
    )
    bounds = metrics.wilson(F.col("n_hits"), F.col("n_total"))
    return b.as_output(counted.select("*", *[c.alias(n) for n, c in bounds.items()]))


def _suite(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a suite entry, with breaches at fixed ids."""
    d = F.col("doc_id")
    return b.table(spark, folder, "documents").select(
        F.concat(F.lit("q"), F.when(d % 97 == 5, d - 1).otherwise(d)).alias("id"),
        F.when(d % 211 == 8, "").otherwise(F.col("lang")).alias("docset"),
        F.when(d % 173 == 9, "").otherwise(F.col("text")).alias("query"),
        F.when(d % 223 == 6, "").otherwise(F.concat("source", F.lit("-"), F.floor(d / 6))).alias("intent_family"),
        F.when(F.floor(d / 3) % 2 == 0, "development").otherwise("test").alias("split"),
        F.when(d % 7 < 4, "positive").when(d % 7 < 6, "near_domain_negative")
        .otherwise("cross_domain_negative").alias("class"),
        d.alias("doc_id"),
    )


def suite_violations(spark: SparkSession, folder: str) -> DataFrame:
    suite = _suite(spark, folder)
    d, positive = F.col("doc_id"), F.col("class") == "positive"
    n_labels = F.when(positive, (d % 31 != 2).cast("int")).otherwise((d % 37 == 4).cast("int"))
    grade = F.when(d % 61 == 0, 3).otherwise(1)
    labels = suite.select("id", F.explode(F.array_repeat(grade, n_labels)).alias("grade"))
    return metrics.suite_violations(suite, labels)


def suite_composition(spark: SparkSession, folder: str) -> DataFrame:
    return b.as_output(metrics.suite_composition(_suite(spark, folder)))


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    return b.as_output(
        metrics.latency_summary(b.table(spark, folder, "events"), "event_type", "value")
    )


QUERIES = {
    "recall_mrr": recall_mrr,
    "golden_eval": golden_eval,
    "negative_eval": negative_eval,
    "ranking_metrics": ranking_metrics,
    "wilson_interval": wilson_interval,
    "eval_report": eval_report,
    "stage_ranks": stage_ranks,
    "decision_evidence": decision_evidence,
    "suite_violations": suite_violations,
    "suite_composition": suite_composition,
    "latency_summary": latency_summary,
}
