"""Graded retrieval metrics, rates with intervals, and stratified reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift import params
from quillsift.functions.text import normalize_heading_path
from quillsift.session import broadcast_if_small, checkpointed

MEASURES = ("recall", "mrr", "ndcg", "precision")
NEGATIVE_CLASSES = ("near_domain_negative", "cross_domain_negative")
RATES = ("false_reject", "false_accept", "positive_borderline", "negative_borderline", "decisive_coverage")


def heading_matches(heading: Column, prefix: Column) -> Column:
    """No prefix, the same heading path, or a path below it."""
    want, have = normalize_heading_path(prefix), normalize_heading_path(heading)
    below = have.startswith(F.concat(want, F.lit(" > ")))
    return prefix.isNull() | (have == want) | below


def target_ranks(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """First rank at which each target is met: ``(stage, qid, target_no, grade, rank)``."""
    met = hits.join(targets, ["qid", "source_url"]).where(
        heading_matches(F.col("heading_path"), F.col("heading_prefix"))
    )
    return met.groupBy("stage", "qid", "target_no", "grade").agg(F.min("rank").alias("rank"))


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def _stage_cutoff(stage: Column) -> Column:
    cases = [F.when(stage == s, k) for s, k in params.STAGE_CUTOFFS.items()]
    return F.coalesce(*cases)


def ranking_metrics(queries: DataFrame, hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Recall, MRR, nDCG and precision per query and stage.

    ``hits``: ``(stage, qid, rank, source_url, heading_path)`` within the stage's
    cutoff. A target gains once, at its first rank; a hit counts for precision
    when it is the first for some target. Empty denominators give 0.
    """
    stages = F.explode(F.array(*[F.lit(s) for s in params.STAGE_CUTOFFS]))
    frame = queries.select("qid", stages.alias("stage")).withColumn("k", _stage_cutoff(F.col("stage")))
    returned = hits.groupBy("stage", "qid").agg(F.count("*").alias("n_returned"))
    reached = (
        target_ranks(hits, targets)
        .groupBy("stage", "qid")
        .agg(
            F.count("*").alias("found"),
            F.countDistinct("rank").alias("gain_ranks"),
            F.min("rank").alias("first_rank"),
            F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1)).alias("dcg"),
        )
    )
    by_gain = Window.partitionBy("qid").orderBy(F.col("grade").desc(), "target_no")
    ideal = (
        targets.select("qid", "grade", F.row_number().over(by_gain).alias("place"))
        .groupBy("qid")
        .agg(
            F.count("*").alias("n_targets"),
            *[
                F.sum(
                    F.when(F.col("place") <= k, gain(F.col("grade")) / F.log2(F.col("place") + 1))
                ).alias(f"idcg_{k}")
                for k in sorted(set(params.STAGE_CUTOFFS.values()))
            ],
        )
    )
    joined = (
        frame.join(returned, ["stage", "qid"], "left")
        .join(reached, ["stage", "qid"], "left")
        .join(ideal, "qid", "left")
    )
    idcg = F.coalesce(
        *[
            F.when(F.col("k") == k, F.col(f"idcg_{k}"))
            for k in sorted(set(params.STAGE_CUTOFFS.values()))
        ]
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.when(bottom > 0, top / bottom), F.lit(0.0))

    return joined.select(
        "qid",
        "stage",
        "k",
        F.coalesce("found", F.lit(0)).alias("relevant_targets_found"),
        F.coalesce("n_targets", F.lit(0)).alias("n_targets"),
        F.col("first_rank"),
        ratio(F.col("found"), F.col("n_targets")).alias("recall"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        ratio(F.col("dcg"), idcg).alias("ndcg"),
        ratio(F.col("gain_ranks"), F.col("n_returned")).alias("precision"),
    )


def recall_mrr(ranked: DataFrame, *by: str) -> DataFrame:
    """Share of queries with a rank, and mean reciprocal rank, of a nullable ``rank``."""
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n_queries"),
        F.coalesce(F.avg(F.col("rank").isNotNull().cast("double")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
    )


def wilson(count: Column, total: Column) -> dict[str, Column]:
    """Rate and Wilson 95% bounds of ``count / total``; zeros for no trials."""
    z, z2 = params.WILSON_Z, params.WILSON_Z**2
    n = total.cast("double")
    hits = F.least(count, total)
    p = hits / n
    denominator = 1 + F.lit(z2) / n
    center = (p + F.lit(z2) / (2 * n)) / denominator
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n)) / denominator
    none = total == 0
    return {
        "rate": F.when(none, 0.0).otherwise(p),
        "lower": F.when(none | (hits == 0), 0.0).otherwise(F.greatest(center - half, F.lit(0.0))),
        "upper": F.when(none, 0.0)
        .when(hits == total, 1.0)
        .otherwise(F.least(center + half, F.lit(1.0))),
    }


def eval_report(queries: DataFrame, metrics: DataFrame, decisions: DataFrame) -> DataFrame:
    """Long report ``(stratum_kind, stratum_value, measure, value)``.

    Overall and by docset, form and class in one pass of grouping sets. Stage
    means run over queries with targets only; borderline answers are neither
    false accepts nor decisive.
    """
    strata = ("docset", "form", "class")

    def by_strata(rows: DataFrame, *always: str):
        sets = [list(always), *[[*always, s] for s in strata]]
        return rows.groupingSets(sets, *always, *strata)

    def labelled(report: DataFrame, entries: list[Column]) -> DataFrame:
        """Name the stratum of a grouping-set row and put its measures on rows."""
        present = [F.when(F.col(f"_{s}") == 0, s) for s in strata]
        value = [F.when(F.col(f"_{s}") == 0, F.col(s)) for s in strata]
        return report.select(
            F.coalesce(*present, F.lit("overall")).alias("stratum_kind"),
            F.coalesce(*value, F.lit("")).alias("stratum_value"),
            F.inline(F.array(*entries)),
        )

    def entry(measure: Column | str, value: Column) -> Column:
        name = F.lit(measure) if isinstance(measure, str) else measure
        return F.struct(name.alias("measure"), value.cast("double").alias("value"))

    absent = [F.grouping(s).alias(f"_{s}") for s in strata]
    has_targets = F.col("n_targets") > 0
    means = by_strata(queries.join(metrics, "qid"), "stage").agg(
        *absent,
        *[
            F.coalesce(F.avg(F.when(has_targets, F.col(m))), F.lit(0.0)).alias(m)
            for m in MEASURES
        ],
    )
    stage_rows = labelled(
        means,
        entries=[entry(F.concat("stage", F.lit(f".{m}")), F.col(m)) for m in MEASURES],
    )

    positive = F.col("class") == "positive"
    negative = F.col("class").isin(*NEGATIVE_CLASSES)
    state = F.col("answer_state")

    def tally(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    states = by_strata(queries.join(decisions.select("qid", "answer_state"), "qid")).agg(
        *absent,
        F.count("*").alias("total"),
        tally(positive).alias("positives"),
        tally(negative).alias("negatives"),
        tally(positive & (state == "no_answer")).alias("false_reject"),
        tally(negative & (state == "confident")).alias("false_accept"),
        tally(positive & (state == "borderline")).alias("positive_borderline"),
        tally(negative & (state == "borderline")).alias("negative_borderline"),
        tally(state != "borderline").alias("decisive_coverage"),
    )
    base = dict(
        zip(RATES, ("positives", "negatives", "positives", "negatives", "total"), strict=True)
    )
    entries = []
    for rate in RATES:
        count, total = F.col(rate), F.col(base[rate])
        parts = {"count": count, "total": total, **wilson(count, total)}
        entries += [entry(f"{rate}.{name}", value) for name, value in parts.items()]
    return stage_rows.unionByName(labelled(states, entries=entries))


def stage_ranks(queries: DataFrame, metrics: DataFrame, hits: DataFrame, targets: DataFrame) -> DataFrame:
    """First relevant rank per stage, and which targets the delivered chunks met.

    Targets per query are a handful of labels, so their lists stay short.
    """
    stages = list(params.STAGE_CUTOFFS)
    ranks = metrics.groupBy("qid").pivot("stage", stages).agg(F.first("first_rank"))
    delivered = (
        target_ranks(hits.where(F.col("stage") == "output_at_5"), targets)
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("target_no", "grade"))).alias("met"))
    )

    def listed(field: str) -> Column:
        values = F.transform("met", lambda x: x[field].cast("string"))
        return F.coalesce(F.array_join(values, ","), F.lit(""))

    return (
        queries.select("qid")
        .join(ranks, "qid", "left")
        .join(delivered, "qid", "left")
        .select(
            "qid",
            *stages,
            listed("target_no").alias("matched_target_indexes"),
            listed("grade").alias("matched_target_grades"),
        )
    )


def decision_evidence(queries: DataFrame, selected: DataFrame, cosines: DataFrame, decisions: DataFrame) -> DataFrame:
    """What the label of each query rests on; non-finite cosines read as missing."""
    top = selected.where(F.col("mmr_rank") == 1).select(
        "qid",
        F.when(~F.isnan("cosine") & (F.abs("cosine") < float("inf")), F.col("cosine")).alias(
            "top_selected_cosine"
        ),
        F.col("rrf").alias("top_selected_rrf"),
        "dense_rank",
        "lexical_rank",
    )
    best = cosines.where(F.col("pos") <= 2).groupBy("qid").agg(
        F.max(F.when(F.col("pos") == 1, F.col("cosine"))).alias("pre_mmr_top_cosine"),
        F.max(F.when(F.col("pos") == 2, F.col("cosine"))).alias("pre_mmr_second_cosine"),
    )
    return (
        queries.join(top, "qid", "left")
        .join(best, "qid", "left")
        .join(decisions.select("qid", "answer_state", "decision_reason"), "qid")
        .withColumn(
            "pre_mmr_cosine_margin", F.col("pre_mmr_top_cosine") - F.col("pre_mmr_second_cosine")
        )
    )


def suite_violations(suite: DataFrame, targets: DataFrame) -> DataFrame:
    """Contract breaches of a labelled suite as ``(violation, key)`` rows.

    ``suite``: ``(id, docset, query, intent_family, split, class)``; ``targets``:
    ``(id, grade)``. Rules on one row come from a list exploded in its scan. Rules on
    several rows come from one grouped count: a suite row counts once under its id and
    once under its family, a target under its id. A breach of a row is told once per row.
    """
    id_, grade = F.col("id"), F.col("grade")
    row_rules = F.array(
        *[
            F.when(F.col(field) == "", F.lit(f"empty_{field}"))
            for field in ("id", "docset", "query", "intent_family")
        ]
    )
    of_rows = suite.select(F.explode(F.array_compact(row_rules)).alias("violation"), id_.alias("key"))

    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    positive = F.col("class") == "positive"
    by_id = F.struct(
        F.lit("id").alias("rule"),
        id_.alias("a"),
        F.lit("").alias("b"),
        F.lit(None).cast("string").alias("split"),
        one.alias("rows"),
        F.when(positive, one).otherwise(none).alias("positives"),
        F.when(~positive, one).otherwise(none).alias("negatives"),
        none.alias("targets"),
        none.alias("bad_grades"),
    )
    by_family = F.struct(
        F.lit("family").alias("rule"),
        F.col("docset").alias("a"),
        F.col("intent_family").alias("b"),
        "split",
        *[none.alias(n) for n in ("rows", "positives", "negatives", "targets", "bad_grades")],
    )
    counted = (
        suite.select(F.explode(F.array(by_id, by_family)).alias("f"))
        .select("f.*")
        .unionByName(
            targets.select(
                F.lit("id").alias("rule"),
                id_.alias("a"),
                F.lit("").alias("b"),
                F.lit(None).cast("string").alias("split"),
                *[none.alias(n) for n in ("rows", "positives", "negatives")],
                one.alias("targets"),
                F.when(~grade.between(1, 2), one).otherwise(none).alias("bad_grades"),
            )
        )
        .groupBy("rule", "a", "b")
        .agg(
            F.min("split").alias("first_split"),
            F.max("split").alias("last_split"),
            *[F.sum(n).alias(n) for n in ("rows", "positives", "negatives", "targets", "bad_grades")],
        )
    )
    own = F.when(F.col("a").isNotNull(), F.col("targets")).otherwise(none)
    per_id = F.col("rule") == "id"

    def told(name: str, times: Column) -> Column:
        return F.struct(F.lit(name).alias("violation"), times.cast("long").alias("times"))

    group_rules = F.array(
        told("duplicate_id", F.when(per_id & (F.col("rows") > 1), one)),
        told(
            "family_in_both_splits",
            F.when(~per_id & (F.col("first_split") != F.col("last_split")), one),
        ),
        told("positive_without_targets", F.when(own == 0, F.col("positives"))),
        told("negative_with_targets", F.when(own > 0, F.col("negatives"))),
        told("grade_out_of_range", F.col("bad_grades")),
    )
    # Repeats are written out in two steps, so that no row holds a list as long as a hot key.
    step = 4096
    of_groups = (
        counted.select(
            F.when(per_id, F.col("a")).otherwise(F.concat_ws("/", "a", "b")).alias("key"),
            F.explode(F.filter(group_rules, lambda r: r["times"] > 0)).alias("r"),
        )
        .select("key", "r.*")
        .withColumn("from", F.explode(F.sequence(none, F.col("times") - 1, F.lit(step).cast("long"))))
        .withColumn("i", F.explode(F.sequence(none, F.least(F.col("times") - F.col("from"), F.lit(step)) - 1)))
        .select("violation", "key")
    )
    return of_rows.unionByName(of_groups)


# The smallest numbers of families a balanced suite has.
MIN_POSITIVE_FAMILIES = 20
MIN_NEGATIVE_FAMILIES = 15
MIN_NEAR_SHARE = 0.5


def suite_composition(suite: DataFrame) -> DataFrame:
    """Distinct families per docset and split, and whether the suite is balanced."""
    family = F.col("intent_family")
    positive = F.col("class") == "positive"
    near = F.col("class") == "near_domain_negative"
    counted = suite.groupBy("docset", "split").agg(
        F.countDistinct(F.when(positive, family)).alias("positive_families"),
        F.countDistinct(F.when(~positive, family)).alias("negative_families"),
        F.countDistinct(F.when(near, family)).alias("near_families"),
    )
    share = F.coalesce(F.try_divide("near_families", "negative_families"), F.lit(0.0))
    return counted.withColumn("near_share", share).withColumn(
        "balanced",
        (F.col("positive_families") >= MIN_POSITIVE_FAMILIES)
        & (F.col("negative_families") >= MIN_NEGATIVE_FAMILIES)
        & (share >= MIN_NEAR_SHARE),
    )


def _ordered(values: pa.Array) -> pa.Array:
    """Whole numbers in the order of the doubles: the sign decides whether the other bits count down."""
    bits = (values.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
    return pa.array(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))


def _unordered(keys: pa.Array) -> pa.Array:
    bits = keys.to_numpy(zero_copy_only=False)
    return pa.array((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64))


def latency_summary(samples: DataFrame, group: str, value: str, buckets: int = 1 << 16) -> DataFrame:
    """Exact median and nearest-rank 95th percentile per group.

    Radix selection: doubles become whole numbers of the same order, and each pass counts the next
    digit, one of ``buckets`` (a power of two), among the values that share the digits found so
    far. No pass holds more than ``buckets`` counts per group and wanted rank, however the values
    lie; outliers and hot values change nothing.
    """
    bits = buckets.bit_length() - 1
    data = samples.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    keyed = data.select("g", F.arrow_udf(_ordered, "long")("v").alias("key"))
    sizes = checkpointed(data.groupBy("g").agg(F.count("*").alias("n")))
    n = F.col("n")
    wanted = sizes.select(
        "g",
        F.explode(
            F.array(
                F.struct(F.lit("lower").alias("what"), F.floor((n + 1) / 2).cast("long").alias("r")),
                F.struct(F.lit("upper").alias("what"), F.ceil((n + 1) / 2).cast("long").alias("r")),
                F.struct(F.lit("p95").alias("what"), F.ceil(0.95 * n).cast("long").alias("r")),
            )
        ).alias("w"),
    ).select("g", "w.what", "w.r", F.lit(None).cast("long").alias("prefix"))
    left = 64
    while left:
        step = min(bits, left)
        left -= step
        # The first digit keeps the sign, so digits and prefixes compare as the keys do.
        digit = F.shiftright("key", left)
        rows = keyed.select("g", digit.alias("found"), F.shiftright(digit, step).alias("prefix"))
        if left + step < 64:
            rows = rows.join(broadcast_if_small(wanted.select("g", "prefix").distinct()), ["g", "prefix"], "left_semi")
        else:
            rows = rows.withColumn("prefix", F.lit(0).cast("long"))
            wanted = wanted.withColumn("prefix", F.lit(0).cast("long"))
        counts = rows.groupBy("g", "prefix", "found").agg(F.count("*").alias("m"))
        upto = Window.partitionBy("g", "prefix").orderBy("found").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("m").over(upto))
        hit = wanted.join(counts, ["g", "prefix"]).where("r <= upto and r > upto - m")
        wanted = checkpointed(
            hit.select("g", "what", (F.col("r") - F.col("upto") + F.col("m")).alias("r"), F.col("found").alias("prefix"))
        )
    picked = wanted.select("g", "what", F.arrow_udf(_unordered, "double")("prefix").alias("v"))
    picked = picked.groupBy("g").agg(
        *[F.max(F.when(F.col("what") == w, F.col("v"))).alias(w) for w in ("lower", "upper", "p95")]
    )
    return sizes.join(picked, "g").select(
        F.col("g").alias(group),
        F.col("n").alias("n_samples"),
        ((F.col("lower") + F.col("upper")) / 2).alias("median"),
        F.col("p95"),
    )
