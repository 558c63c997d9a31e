"""SQL that states what each evaluation query must return, for the check tool."""

from __future__ import annotations

from quillsift.params import STAGE_CUTOFFS, WILSON_Z
from quillsift.plans.retrieval_oracle import DECIDED, POOL, SEARCH

STAGES = list(STAGE_CUTOFFS)
MEASURES = ("recall", "mrr", "ndcg", "precision")

LABELS = """
labelled_q AS (
  SELECT item_id AS qid, 'set' || (item_id % 3) AS docset, CASE WHEN item_id % 2 = 0 THEN 'development' ELSE 'test' END AS split,
         ['short', 'natural_language', 'verbose', 'keyword_heavy'][item_id % 4 + 1] AS form,
         CASE item_id % 5 WHEN 3 THEN 'near_domain_negative' WHEN 4 THEN 'cross_domain_negative' ELSE 'positive' END AS class
  FROM benchmark),
target AS (
  SELECT l.qid, n AS target_no, 2 - n AS grade, c.source_url, CASE WHEN n = 1 THEN c.heading_path END AS prefix
  FROM labelled_q l, (VALUES (0), (1)) t(n), chunks c WHERE l.class = 'positive' AND c.chunk_idx = l.qid + n)
"""

METRICS = SEARCH + "," + LABELS + f""",
ranked AS (
  SELECT 'dense_at_40' AS stage, qid, chunk_idx, dense_rank AS rank FROM dense
  UNION ALL SELECT 'fts_at_40', qid, chunk_idx, lexical_rank FROM lexical
  UNION ALL SELECT 'fused_at_40', qid, chunk_idx, fused_rank FROM pool
  UNION ALL SELECT 'mmr_at_5', qid, chunk_idx, mmr_rank FROM sel
  UNION ALL SELECT 'output_at_5', qid, chunk_idx, pos FROM result WHERE pos <= 5),
hit AS (SELECT r.*, c.source_url, c.heading_path FROM ranked r JOIN chunks c USING (chunk_idx)),
met AS (
  SELECT stage, qid, target_no, grade, min(rank) AS rank FROM hit h JOIN target t USING (qid, source_url)
  WHERE prefix IS NULL OR h.heading_path = prefix OR starts_with(h.heading_path, prefix || ' > ') GROUP BY ALL),
frame AS (SELECT q.qid, stage, k FROM labelled_q q, (VALUES {', '.join(f"('{s}', {k})" for s, k in STAGE_CUTOFFS.items())}) s(stage, k)),
place AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, target_no) AS place FROM target),
per AS MATERIALIZED (
  SELECT f.qid, f.stage, f.k,
    (SELECT count(*) FROM met m WHERE m.qid = f.qid AND m.stage = f.stage) AS found,
    (SELECT count(*) FROM target t WHERE t.qid = f.qid) AS n_targets,
    (SELECT min(rank) FROM met m WHERE m.qid = f.qid AND m.stage = f.stage) AS first_rank,
    (SELECT count(DISTINCT rank) FROM met m WHERE m.qid = f.qid AND m.stage = f.stage) AS gain_ranks,
    (SELECT count(*) FROM hit h WHERE h.qid = f.qid AND h.stage = f.stage) AS n_returned,
    (SELECT sum((power(2, grade) - 1) / log2(rank + 1)) FROM met m WHERE m.qid = f.qid AND m.stage = f.stage) AS dcg,
    (SELECT sum((power(2, grade) - 1) / log2(place + 1)) FROM place p WHERE p.qid = f.qid AND place <= f.k) AS idcg
  FROM frame f),
metric AS MATERIALIZED (
  SELECT qid, stage, k, found, n_targets, first_rank,
    CASE WHEN n_targets > 0 THEN found / n_targets::DOUBLE ELSE 0 END AS recall,
    coalesce(1.0::DOUBLE / first_rank, 0) AS mrr,
    CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg,
    CASE WHEN n_returned > 0 THEN gain_ranks / n_returned::DOUBLE ELSE 0 END AS precision FROM per)
"""


def wilson_sql(count: str, total: str) -> dict[str, str]:
    z = f"{WILSON_Z}::DOUBLE"
    p = f"({count} / {total}::DOUBLE)"
    z2 = f"({z} * {z})"
    denominator = f"(1 + {z2} / {total})"
    center = f"(({p} + {z2} / (2 * {total})) / {denominator})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {total} + {z2} / (4 * {total}::DOUBLE * {total})) / {denominator})"
    return {
        "rate": f"CASE WHEN {total} = 0 THEN 0 ELSE {p} END",
        "lower": f"CASE WHEN {total} = 0 OR {count} = 0 THEN 0 ELSE greatest({center} - {half}, 0) END",
        "upper": f"CASE WHEN {total} = 0 THEN 0 WHEN {count} = {total} THEN 1 ELSE least({center} + {half}, 1) END",
    }


RATES = {
    "false_reject": ("positives", "class = 'positive' AND answer_state = 'no_answer'"),
    "false_accept": ("negatives", "class <> 'positive' AND answer_state = 'confident'"),
    "positive_borderline": ("positives", "class = 'positive' AND answer_state = 'borderline'"),
    "negative_borderline": ("negatives", "class <> 'positive' AND answer_state = 'borderline'"),
    "decisive_coverage": ("total", "answer_state <> 'borderline'"),
}


def _report() -> str:
    wide = ", ".join(
        f"max(CASE WHEN stage = '{s}' THEN {m} END) AS {s}_{m}" for s in STAGES for m in MEASURES
    )
    means = ", ".join(
        f"coalesce(avg({s}_{m}) FILTER (WHERE n_targets > 0), 0) AS {s}_{m}" for s in STAGES for m in MEASURES
    )
    counts = ", ".join(f"count(*) FILTER (WHERE {cond}) AS {rate}" for rate, (_, cond) in RATES.items())
    entries = [f"{{'measure': '{s}.{m}', 'value': {s}_{m}::DOUBLE}}" for s in STAGES for m in MEASURES]
    for rate, (total, _) in RATES.items():
        parts = {"count": rate, "total": total, **wilson_sql(rate, total)}
        entries += [f"{{'measure': '{rate}.{n}', 'value': ({v})::DOUBLE}}" for n, v in parts.items()]
    return f"""WITH {METRICS},
wide AS (SELECT qid, max(n_targets) AS n_targets, {wide} FROM metric GROUP BY qid),
rows_ AS (SELECT * FROM labelled_q JOIN (SELECT qid, answer_state FROM stated) USING (qid) JOIN wide USING (qid)),
rep AS (SELECT CASE GROUPING(docset, form, class) WHEN 7 THEN 'overall' WHEN 3 THEN 'docset' WHEN 5 THEN 'form' ELSE 'class' END AS stratum_kind,
  coalesce(docset, form, class, '') AS stratum_value, {means}, count(*) AS total,
  count(*) FILTER (WHERE class = 'positive') AS positives, count(*) FILTER (WHERE class <> 'positive') AS negatives, {counts}
  FROM rows_ GROUP BY GROUPING SETS ((), (docset), (form), (class))),
long AS (SELECT stratum_kind, stratum_value, unnest([{', '.join(entries)}]) AS e FROM rep)
SELECT stratum_kind, stratum_value, e.measure AS measure, round(e.value, 6) AS value FROM long"""


EXPECTED = """
expected AS (SELECT c.chunk_idx AS qid, c.source_url AS expected_url FROM chunks c WHERE c.chunk_idx IN (SELECT item_id FROM benchmark))
"""

SUITE = """
suite AS (
  SELECT 'q' || (CASE WHEN doc_id % 97 = 5 THEN doc_id - 1 ELSE doc_id END) AS id,
    CASE WHEN doc_id % 211 = 8 THEN '' ELSE lang END AS docset,
    CASE WHEN doc_id % 173 = 9 THEN '' ELSE text END AS query,
    CASE WHEN doc_id % 223 = 6 THEN '' ELSE source || '-' || (doc_id // 6) END AS intent_family,
    CASE WHEN doc_id // 3 % 2 = 0 THEN 'development' ELSE 'test' END AS split,
    CASE WHEN doc_id % 7 < 4 THEN 'positive' WHEN doc_id % 7 < 6 THEN 'near_domain_negative' ELSE 'cross_domain_negative' END AS class,
    doc_id FROM documents)
"""

_WILSON = wilson_sql("n_hits", "n_total")

ORACLES = {
    "ranking_metrics": (
        f"WITH {METRICS} SELECT qid, stage, k, found AS relevant_targets_found, n_targets, "
        + ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES) + " FROM metric"
    ),
    "eval_report": _report(),
    "stage_ranks": (
        f"WITH {METRICS} SELECT qid, " + ", ".join(f"max(CASE WHEN stage = '{s}' THEN first_rank END) AS {s}" for s in STAGES)
        + ", coalesce((SELECT string_agg(target_no::VARCHAR, ',' ORDER BY target_no) FROM met x WHERE x.qid = metric.qid AND x.stage = 'output_at_5'), '') AS matched_target_indexes"
        + ", coalesce((SELECT string_agg(grade::VARCHAR, ',' ORDER BY target_no) FROM met x WHERE x.qid = metric.qid AND x.stage = 'output_at_5'), '') AS matched_target_grades"
        + " FROM metric GROUP BY qid"
    ),
    "decision_evidence": f"""
WITH {DECIDED},{LABELS},
pc AS (SELECT qid, cosine, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, chunk_idx) AS pos FROM ready WHERE emb IS NOT NULL AND isfinite(cosine)),
best AS (SELECT qid, max(cosine) FILTER (WHERE pos = 1) AS c1, max(cosine) FILTER (WHERE pos = 2) AS c2 FROM pc GROUP BY qid)
SELECT l.*, round(s.cosine, 6) AS top_selected_cosine, round(s.rrf, 6) AS top_selected_rrf, s.dense_rank, s.lexical_rank,
  round(c1, 6) AS pre_mmr_top_cosine, round(c2, 6) AS pre_mmr_second_cosine, round(c1 - c2, 6) AS pre_mmr_cosine_margin,
  answer_state, decision_reason
FROM labelled_q l LEFT JOIN sel s ON s.qid = l.qid AND s.mmr_rank = 1 LEFT JOIN best b ON b.qid = l.qid JOIN stated t ON t.qid = l.qid""",
    "recall_mrr": f"""
WITH {POOL},{LABELS},{EXPECTED},
f AS (SELECT p.qid, min(fused_rank) AS rank FROM pool p JOIN chunks c USING (chunk_idx) JOIN expected e ON e.qid = p.qid AND e.expected_url = c.source_url GROUP BY p.qid)
SELECT form, count(*) AS n_queries, round(avg((rank IS NOT NULL)::INT), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr
FROM expected JOIN labelled_q USING (qid) LEFT JOIN f USING (qid) GROUP BY form""",
    "golden_eval": f"""
WITH {SEARCH},{EXPECTED},
f AS (SELECT r.qid, min(pos) AS rank FROM result r JOIN expected e ON e.qid = r.qid AND e.expected_url = r.source_url WHERE pos <= 5 GROUP BY r.qid),
s AS (SELECT count(*) AS n_queries, avg((rank IS NOT NULL)::INT) AS recall, avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr FROM expected LEFT JOIN f USING (qid))
SELECT n_queries, round(recall, 6) AS recall, round(mrr, 6) AS mrr, recall >= 0.9 AS recall_ok, mrr >= 0.7 AS mrr_ok FROM s""",
    "negative_eval": f"""
WITH {SEARCH},{LABELS},
b AS (SELECT qid, max(score) AS score FROM result GROUP BY qid),
p AS (SELECT l.qid, class, b.score, b.qid IS NOT NULL AS answered FROM labelled_q l LEFT JOIN b USING (qid) WHERE class <> 'positive')
SELECT class, count(*) AS n_queries, sum(answered::INT)::BIGINT AS n_answered, round(avg(answered::INT), 6) AS false_positive_rate,
  round(max(score), 6) AS max_score, avg(answered::INT) <= 0.10 AS rate_ok FROM p GROUP BY class""",
    "wilson_interval": f"""
WITH c AS (SELECT lang, source, sum(toxic)::BIGINT AS n_hits, count(*) AS n_total FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
SELECT *, {', '.join(f'round(({v})::DOUBLE, 6) AS {n}' for n, v in _WILSON.items())} FROM c""",
    "suite_violations": f"""
WITH {SUITE}, t AS (SELECT id, CASE WHEN doc_id % 61 = 0 THEN 3 ELSE 1 END AS grade FROM suite
  WHERE (class = 'positive' AND doc_id % 31 <> 2) OR (class <> 'positive' AND doc_id % 37 = 4))
SELECT 'empty_docset' AS violation, id AS key FROM suite WHERE docset = ''
UNION ALL SELECT 'empty_query', id FROM suite WHERE query = ''
UNION ALL SELECT 'empty_intent_family', id FROM suite WHERE intent_family = ''
UNION ALL SELECT 'duplicate_id', id FROM suite GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'family_in_both_splits', docset || '/' || intent_family FROM suite GROUP BY docset, intent_family HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'positive_without_targets', id FROM suite WHERE class = 'positive' AND id NOT IN (SELECT id FROM t)
UNION ALL SELECT 'negative_with_targets', id FROM suite WHERE class <> 'positive' AND id IN (SELECT id FROM t)
UNION ALL SELECT 'grade_out_of_range', id FROM t WHERE grade NOT BETWEEN 1 AND 2""",
    "suite_composition": f"""
WITH {SUITE}, c AS (SELECT docset, split, count(DISTINCT intent_family) FILTER (WHERE class = 'positive') AS positive_families,
  count(DISTINCT intent_family) FILTER (WHERE class <> 'positive') AS negative_families,
  count(DISTINCT intent_family) FILTER (WHERE class = 'near_domain_negative') AS near_families FROM suite GROUP BY ALL)
SELECT *, round(CASE WHEN negative_families > 0 THEN near_families / negative_families::DOUBLE ELSE 0 END, 6) AS near_share,
  positive_families >= 20 AND negative_families >= 15 AND near_families >= 0.5 * negative_families AS balanced FROM c""",
    "latency_summary": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n_samples,
  round((max(value) FILTER (WHERE i = (n + 1) // 2) + max(value) FILTER (WHERE i = (n + 2) // 2)) / 2, 6) AS median,
  round(max(value) FILTER (WHERE i = ceil(0.95::DOUBLE * n)), 6) AS p95 FROM r GROUP BY event_type""",
}
