from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillsift.operators import metrics
from quillsift.params import STAGE_CUTOFFS


def test_ranking_metrics(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    targets = spark.createDataFrame(
        [(1, 0, "a", None, 2), (1, 1, "b", "Exports > Matcher", 1), (1, 2, "c", None, 1), (2, 0, "z", None, 2)],
        "qid int, target_no int, source_url string, heading_prefix string, grade int",
    )
    hits = spark.createDataFrame(
        [
            ("mmr_at_5", 1, 1, "x", "H"),
            ("mmr_at_5", 1, 2, "b", "Exports > MatcherX"),
            ("mmr_at_5", 1, 3, "b", "# Exports > Matcher > Deep"),
            ("mmr_at_5", 1, 4, "a", ""),
            ("mmr_at_5", 1, 5, "a", "again"),
            ("mmr_at_5", 3, 1, "a", ""),
        ],
        "stage string, qid int, rank int, source_url string, heading_path string",
    )
    rows = {(r.qid, r.stage): r for r in metrics.ranking_metrics(queries, hits, targets).collect()}
    assert len(rows) == 3 * len(STAGE_CUTOFFS)
    one = rows[(1, "mmr_at_5")]
    dcg = 1 / math.log2(4) + 3 / math.log2(5)
    ideal = 3 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert (one.relevant_targets_found, one.first_rank) == (2, 3)
    assert (one.recall, one.mrr, one.ndcg, one.precision) == pytest.approx((2 / 3, 1 / 3, dcg / ideal, 2 / 5))
    for key in ((2, "mmr_at_5"), (3, "mmr_at_5"), (1, "dense_at_40")):
        r = rows[key]
        assert (r.recall, r.mrr, r.ndcg, r.precision) == (0, 0, 0, 0)


@pytest.mark.parametrize(
    ("count", "total", "low", "high"),
    [(0, 0, 0, 0), (0, 10, 0, 0.277533), (10, 10, 0.722467, 1), (5, 10, 0.236593, 0.763407), (9, 7, 0.645661, 1)],
)
def test_wilson(spark, count, total, low, high):
    bounds = metrics.wilson(F.lit(count), F.lit(total))
    row = spark.range(1).select(*[c.alias(n) for n, c in bounds.items()]).first()
    assert (row.lower, row.upper) == pytest.approx((low, high), abs=1e-5)


def test_report_counts_borderline_apart(spark):
    rows = [
        (1, "d", "short", "positive", "confident"), (2, "d", "short", "positive", "borderline"),
        (3, "e", "short", "positive", "no_answer"), (4, "e", "verbose", "near_domain_negative", "confident"),
        (5, "e", "verbose", "cross_domain_negative", "borderline"),
    ]
    frame = spark.createDataFrame(rows, "qid int, docset string, form string, class string, answer_state string")
    queries, decisions = frame.drop("answer_state"), frame.select("qid", "answer_state")
    targets = spark.createDataFrame([(1, 0, "a", None, 1), (2, 0, "a", None, 1), (3, 0, "a", None, 1)], "qid int, target_no int, source_url string, heading_prefix string, grade int")
    hits = spark.createDataFrame([("fused_at_40", 1, 2, "a", "")], "stage string, qid int, rank int, source_url string, heading_path string")
    scores = metrics.ranking_metrics(queries, hits, targets)
    report = {
        (r.stratum_kind, r.stratum_value, r.measure): r.value
        for r in metrics.eval_report(queries, scores, decisions).collect()
    }
    assert report[("overall", "", "fused_at_40.mrr")] == pytest.approx(0.5 / 3)
    assert report[("form", "verbose", "fused_at_40.recall")] == 0
    assert report[("overall", "", "false_accept.count")] == 1
    assert report[("overall", "", "false_reject.rate")] == pytest.approx(1 / 3)
    assert report[("overall", "", "decisive_coverage.rate")] == pytest.approx(3 / 5)
    assert report[("class", "cross_domain_negative", "negative_borderline.rate")] == 1
    assert report[("docset", "d", "false_accept.total")] == 0


def test_suite_rules(spark):
    suite = spark.createDataFrame(
        [
            ("a", "d", "q", "f", "development", "positive"), ("a", "d", "q", "g", "test", "positive"),
            ("b", "d", "", "f", "test", "positive"), ("c", "d", "q", "h", "test", "near_domain_negative"),
        ],
        "id string, docset string, query string, intent_family string, split string, class string",
    )
    targets = spark.createDataFrame([("a", 3), ("c", 1)], "id string, grade int")
    got = sorted((r.violation, r.key) for r in metrics.suite_violations(suite, targets).collect())
    assert got == [
        ("duplicate_id", "a"), ("empty_query", "b"), ("family_in_both_splits", "d/f"),
        ("grade_out_of_range", "a"), ("negative_with_targets", "c"), ("positive_without_targets", "b"),
    ]


def test_suite_rules_read_their_tables_thrice_and_repeat_breaches(spark):
    suite = spark.createDataFrame(
        [(None, "d", "q", "f", "test", "positive")] * 2 + [("x", None, "q", None, "test", None)]
        + [("y", "d", "q", "f", "test", "near_domain_negative")] * 5000,
        "id string, docset string, query string, intent_family string, split string, class string",
    )
    targets = spark.createDataFrame([(None, 1), ("y", None), ("z", 0), ("z", 9)], "id string, grade int")
    found = metrics.suite_violations(suite, targets)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan ExistingRDD") == 3, plan
    assert Counter((r.violation, r.key) for r in found.collect()) == {
        ("duplicate_id", None): 1, ("duplicate_id", "y"): 1, ("positive_without_targets", None): 2,
        ("negative_with_targets", "y"): 5000, ("grade_out_of_range", "z"): 2,
    }


def test_latency_is_exact_even_for_one_hot_value(spark):
    rng = random.Random(1)
    data = [("even", float(rng.randint(0, 50))) for _ in range(400)] + [("hot", 7.0)] * 300
    data += [("hot", rng.random() * 1e6) for _ in range(50)] + [("one", 3.5)] + [("odd", None)]
    frame = spark.createDataFrame(data, "kind string, ms double").repartition(6)
    got = {r.kind: r for r in metrics.latency_summary(frame, "kind", "ms", buckets=16).collect()}
    assert set(got) == {"even", "hot", "one"}
    for kind, row in got.items():
        values = sorted(v for k, v in data if k == kind and v is not None)
        n = len(values)
        assert row.n_samples == n
        assert row.median == (values[(n - 1) // 2] + values[n // 2]) / 2
        assert row.p95 == values[math.ceil(0.95 * n) - 1]


def test_latency_beside_outliers(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(500)] + [1e300, -1e300, float("inf"), -0.0, 0.0, 5e-324]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", -2.5)], "kind string, ms double").repartition(4)
    got = {r.kind: r for r in metrics.latency_summary(frame, "kind", "ms").collect()}
    values.sort()
    n = len(values)
    assert got["a"].median == (values[(n - 1) // 2] + values[n // 2]) / 2
    assert got["a"].p95 == values[math.ceil(0.95 * n) - 1]
    assert (got["b"].median, got["b"].p95, got["b"].n_samples) == (-2.5, -2.5, 1)


def test_ordered_bits_keep_the_order_of_doubles():
    import pyarrow as pa

    values = sorted([0.0, 1.5, -1.5, 1e300, -1e300, 5e-324, -5e-324, float("inf"), float("-inf"), 3.0, -3.0])
    keys = metrics._ordered(pa.array(values))
    assert keys.to_pylist() == sorted(keys.to_pylist())
    assert metrics._unordered(keys).to_pylist() == values
