"""SQL that states what each retrieval query must return, for the check tool."""

from __future__ import annotations

from quillsift.plans.stem_oracle import kept, stem_ctes
from quillsift.plans.text_oracle import sanitize_chunk_sql, sanitize_metadata_sql, tokens_sql, utf8_cut_sql

TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"

STORE = """
chunks AS (
  SELECT doc_id AS chunk_idx, concat(source, '/', lang, '.md') AS source_url,
         lang AS heading_path, text FROM documents),
vec AS (SELECT vec_id AS chunk_idx, embedding::DOUBLE[] AS emb FROM embeddings),
weighted AS (
  SELECT item_id, text, CASE item_id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE
         WHEN 2 THEN 0.65::DOUBLE ELSE 0.75::DOUBLE END AS w FROM benchmark),
q AS MATERIALIZED (
  SELECT b.item_id AS qid, b.text AS query,
         list_transform(range(1, len(e1.emb) + 1), lambda i: e1.emb[i] + b.w * e2.emb[i]) AS qvec
  FROM weighted b JOIN vec e1 ON e1.chunk_idx = b.item_id JOIN vec e2 ON e2.chunk_idx = b.item_id + 1)
"""

DENSE = """
dense AS MATERIALIZED (
  SELECT * FROM (
    SELECT qid, chunk_idx, score,
           row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_idx) AS dense_rank
    FROM (SELECT qid, chunk_idx, -power(list_distance(qvec, emb), 2) AS score FROM q, vec))
  WHERE dense_rank <= 40)
"""

# Query lanes rounded to ten bits behind the leading one, ties to even.
_HALF = (
    "sign(@) * round_even(abs(@) / power(2.0, greatest(floor(log2(abs(@))), -14) - 10), 0) "
    "* power(2.0, greatest(floor(log2(abs(@))), -14) - 10)"
)
HALF_DENSE = (
    "half AS MATERIALIZED (SELECT qid, list_transform(qvec, lambda y: "
    f"CASE WHEN y = 0 THEN 0.0::DOUBLE ELSE {_HALF.replace('@', 'y::FLOAT::DOUBLE')} END) AS qvec FROM q),"
    + DENSE.replace("FROM q, vec", "FROM half, vec")
)

LEXICAL = f"""
tok AS (SELECT chunk_idx, unnest({TERMS.format('text')}) AS term FROM chunks),
tf AS (SELECT chunk_idx, term, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT chunk_idx, count(*) AS length FROM tok GROUP BY ALL),
corpus AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(length) FROM lens) AS total),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
qterm AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({TERMS.format('query')}) AS term FROM q)),
bm AS (
  SELECT qid, chunk_idx, sum(
      ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
      / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / (total / n::DOUBLE)))) AS score
  FROM qterm JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (chunk_idx), corpus
  GROUP BY ALL),
lexical AS MATERIALIZED (
  SELECT * FROM (
    SELECT qid, chunk_idx, score,
           row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_idx) AS lexical_rank
    FROM bm) WHERE lexical_rank <= 40)
"""

FUSED = """
fused AS MATERIALIZED (
  SELECT qid, chunk_idx, dense_rank, lexical_rank,
         coalesce(1.0::DOUBLE / (60 + dense_rank - 1), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank - 1), 0) AS rrf
  FROM (SELECT qid, chunk_idx, dense_rank FROM dense)
  FULL JOIN (SELECT qid, chunk_idx, lexical_rank FROM lexical) USING (qid, chunk_idx)),
pool AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid
             ORDER BY round(rrf, 9) DESC, dense_rank NULLS LAST, chunk_idx) AS fused_rank
    FROM fused) WHERE fused_rank <= 40)
"""

READY = """
ready AS MATERIALIZED (
  SELECT p.qid, p.chunk_idx, c.source_url, p.rrf, p.dense_rank, p.lexical_rank,
         p.fused_rank AS position, v.emb,
         list_cosine_similarity(q.qvec, v.emb) AS cosine
  FROM pool p JOIN chunks c USING (chunk_idx) JOIN q USING (qid) LEFT JOIN vec v USING (chunk_idx)),
sim AS MATERIALIZED (
  SELECT a.qid, a.chunk_idx AS a, b.chunk_idx AS b, list_cosine_similarity(a.emb, b.emb) AS sim
  FROM ready a JOIN ready b ON a.qid = b.qid
  WHERE a.emb IS NOT NULL AND b.emb IS NOT NULL)
"""

CHANNELS = ",".join([STORE, DENSE, LEXICAL])
POOL = ",".join([CHANNELS, FUSED])
READY_ALL = ",".join([POOL, READY])


def mmr_ctes(cand: str, name: str, extra: str = "", weight: str = "0.7::DOUBLE") -> str:
    """Five unrolled selection rounds over ``cand`` (qid, chunk_idx, position, rel, ...)."""
    key = f"qid{extra}"
    keys = [k.strip() for k in key.split(",")]
    same = " AND ".join(f"{{0}}.{k} = {{1}}.{k}" for k in keys)
    cols = ", ".join(f"c.{k}" for k in keys)
    parts = [
        f"{name}_h0 AS (SELECT {key}, chunk_idx, source_url, 0 AS mmr_rank FROM {cand} WHERE false)"
    ]
    for r in range(1, 6):
        prev = f"{name}_h{r - 1}"
        parts.append(f"""
{name}_p{r} AS MATERIALIZED (
  SELECT {key}, chunk_idx, source_url, {r} AS mmr_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(
        wt * rel - (1 - wt) * (near + 0.05::DOUBLE * same_url), 9) DESC, position) AS rn
    FROM (
      SELECT {cols}, c.chunk_idx, c.source_url, c.position, c.rel, {weight} AS wt,
             greatest(0::DOUBLE, coalesce(max(s.sim), 0::DOUBLE)) AS near,
             count(*) FILTER (WHERE h.source_url = c.source_url) AS same_url
      FROM {cand} c LEFT JOIN {prev} h ON {same.format('c', 'h')}
      LEFT JOIN sim s ON s.qid = c.qid AND s.a = c.chunk_idx AND s.b = h.chunk_idx
      WHERE c.emb IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM {prev} x WHERE {same.format('x', 'c')} AND x.chunk_idx = c.chunk_idx)
      GROUP BY ALL)) WHERE rn = 1),
{name}_h{r} AS (SELECT * FROM {prev} UNION ALL SELECT * FROM {name}_p{r})""")
    return ",".join(parts)


def selected_ctes(cand: str, name: str, filler: str = "rrf DESC, position", extra: str = "",
                  weight: str = "0.7::DOUBLE") -> str:
    """Rounds plus the vector-less chunks that fill what is left of five places."""
    key = f"qid{extra}"
    return mmr_ctes(cand, name, extra, weight) + f""",
{name} AS MATERIALIZED (
  SELECT {key}, c.chunk_idx, c.source_url, h.mmr_rank, c.rrf, c.dense_rank, c.lexical_rank, c.cosine
  FROM {name}_h5 h JOIN {cand} c USING ({key}, chunk_idx)
  UNION ALL
  SELECT {key}, chunk_idx, source_url, taken + rn, rrf, dense_rank, lexical_rank, NULL FROM (
    SELECT c.*, (SELECT count(*) FROM {name}_h5 h WHERE {' AND '.join(f'h.{k.strip()} = c.{k.strip()}' for k in key.split(','))}) AS taken,
           row_number() OVER (PARTITION BY {key} ORDER BY {filler}) AS rn
    FROM {cand} c WHERE emb IS NULL) WHERE taken + rn <= 5)"""


SELECTED = READY_ALL + ", cand AS (SELECT *, cosine AS rel FROM ready)," + selected_ctes("cand", "sel")

DECIDED = SELECTED + """,
decided AS MATERIALIZED (
  SELECT q.qid, CASE WHEN s.qid IS NULL THEN NULL ELSE coalesce(s.cosine, 0) END AS top_cosine,
         s.rrf AS top_rrf, s.dense_rank, s.lexical_rank
  FROM q LEFT JOIN sel s ON s.qid = q.qid AND s.mmr_rank = 1),
labelled AS MATERIALIZED (
  SELECT *, top_cosine IS NULL AS none, coalesce(top_cosine < 0.82 AND top_rrf < 0.0331, false) AS reject FROM decided),
stated AS MATERIALIZED (
  SELECT *, CASE WHEN none OR reject THEN 'no_answer' WHEN top_cosine >= 0.845 THEN 'confident' ELSE 'borderline' END AS answer_state,
    CASE WHEN none THEN 'no_candidates' WHEN reject THEN 'calibrated_no_answer'
         WHEN top_cosine >= 0.845 THEN 'calibrated_confident' ELSE 'calibrated_borderline' END AS decision_reason,
    CASE WHEN none OR reject THEN 'no_answer' ELSE 'confident' END AS binary_state,
    CASE WHEN none THEN 'no_candidates' WHEN reject THEN 'current_gate_reject'
         WHEN top_cosine >= 0.82 THEN 'current_cosine_pass' ELSE 'current_dual_rank_pass' END AS binary_reason
  FROM labelled)
"""


def window_ctes(hits: str, name: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT qid, chunk_idx, score, row_number() OVER (PARTITION BY qid ORDER BY pass, mmr_rank, delta) AS pos FROM (
    SELECT qid, h.chunk_idx + delta AS chunk_idx, (delta <> 0)::INT AS pass, mmr_rank, delta,
           CASE WHEN delta = 0 THEN rrf END AS score,
           row_number() OVER (PARTITION BY qid, h.chunk_idx + delta ORDER BY (delta <> 0)::INT, mmr_rank, delta) AS rn
    FROM {hits} h, (VALUES (0), (-1), (1)) d(delta)
    WHERE h.chunk_idx + delta BETWEEN 0 AND (SELECT count(*) - 1 FROM chunks))
  WHERE rn = 1)"""


SEARCH = (
    DECIDED
    + ", answered AS (SELECT s.*, t.answer_state FROM sel s JOIN stated t USING (qid) WHERE answer_state <> 'no_answer'),"
    + window_ctes("answered", "win")
    + f""",
fetched AS (
  SELECT w.qid, w.pos, c.chunk_idx, w.score, t.answer_state, {tokens_sql('c.text')} AS tokens,
         c.heading_path, c.source_url, c.text
  FROM win w JOIN chunks c USING (chunk_idx) JOIN stated t USING (qid)),
run AS (
  SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY pos) AS cum, sum(tokens) OVER (PARTITION BY qid) AS total,
         row_number() OVER (PARTITION BY qid ORDER BY pos) AS rn FROM fetched),
result AS MATERIALIZED (SELECT * FROM run WHERE rn = 1 OR cum <= 4000)
"""
)

DOCUMENTS = POOL + f""",
built AS (
  SELECT p.qid, p.chunk_idx, p.fused_rank AS position,
         {utf8_cut_sql(sanitize_chunk_sql('c.heading_path'), 8192)} AS h,
         {utf8_cut_sql(sanitize_chunk_sql('c.text'), 8192)} AS t
  FROM pool p JOIN chunks c USING (chunk_idx)),
document AS MATERIALIZED (
  SELECT qid, chunk_idx, position, {utf8_cut_sql("h || chr(10) || chr(10) || t", 8192)} AS document FROM built
  WHERE qid IN (SELECT qid FROM built GROUP BY qid HAVING count(*) <= 40
                AND count(*) = count(DISTINCT chunk_idx) AND max((h = '' AND t = '')::INT) = 0))
"""

RERANKED = DOCUMENTS + f""",
overlap AS (
  SELECT d.qid, d.chunk_idx, d.position,
         len(list_intersect({TERMS.format('q.query')}, {TERMS.format('d.document')})) AS overlap
  FROM document d JOIN q USING (qid)),
ordered AS MATERIALIZED (
  SELECT qid, chunk_idx, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, position) - 1 AS rerank_pos,
         count(*) OVER (PARTITION BY qid) AS n FROM overlap),
accepted AS MATERIALIZED (SELECT qid, chunk_idx, rerank_pos, (n - rerank_pos) / n::DOUBLE AS relevance FROM ordered)
"""

_MMR_OUT = ("SELECT qid, mmr_rank, chunk_idx, source_url, round(rrf, 6) AS rrf, dense_rank, lexical_rank, "
            "round(cosine, 6) AS cosine FROM ")

LAMBDAS = "(VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) l(mmr_lambda)"

# As LEXICAL, over stems: raw terms of chunks and queries are stemmed once each.
ENGLISH = f"""
raw AS MATERIALIZED (SELECT chunk_idx, unnest({kept(TERMS.format('text'))}) AS term FROM chunks),
rawq AS MATERIALIZED (SELECT DISTINCT qid, unnest({kept(TERMS.format('query'))}) AS term FROM q),
every AS (SELECT term FROM raw UNION SELECT term FROM rawq),
{stem_ctes('every')},
tok AS (SELECT chunk_idx, stem AS term FROM raw JOIN stems USING (term)),
tf AS{LEXICAL.split("tf AS", 1)[1]}""".replace(
    f"SELECT DISTINCT qid, term FROM (SELECT qid, unnest({TERMS.format('query')}) AS term FROM q)",
    "SELECT DISTINCT qid, stem AS term FROM rawq JOIN stems USING (term)",
)
_RANKED = "SELECT qid, chunk_idx, round(score, 6) AS score, lexical_rank FROM lexical"

ORACLES = {
    "dense_topk": f"WITH {STORE}, {DENSE} SELECT qid, chunk_idx, round(score, 6) AS score, dense_rank FROM dense",
    "search_blocks": f"WITH {STORE}, {DENSE} SELECT qid, chunk_idx, round(score, 6) AS score, dense_rank FROM dense",
    "dense_half": f"WITH {STORE}, {HALF_DENSE} SELECT qid, chunk_idx, round(score, 6) AS score, dense_rank FROM dense",
    "bm25_topk": f"WITH {STORE}, {LEXICAL} SELECT qid, chunk_idx, round(score, 6) AS score, lexical_rank FROM lexical",
    "bm25_indexed": f"WITH {STORE}, {LEXICAL} {_RANKED}",
    "bm25_segments": f"WITH {STORE}, {LEXICAL} {_RANKED}",
    "bm25_english": f"WITH {STORE}, {ENGLISH} {_RANKED}",
    "term_analysis": f"""
WITH raw AS MATERIALIZED (
  SELECT doc_id AS chunk_idx, term, row_number() OVER () AS place FROM (
    SELECT doc_id, unnest({kept(TERMS.format('text'))}) AS term FROM documents)),
{stem_ctes('raw')},
found AS (
  SELECT chunk_idx, count(*) AS n_terms, count(DISTINCT stem) AS n_distinct, string_agg(stem, ' ' ORDER BY place) AS line
  FROM raw JOIN stems USING (term) GROUP BY chunk_idx)
SELECT doc_id AS chunk_idx, coalesce(n_terms, 0) AS n_terms, coalesce(n_distinct, 0) AS n_distinct,
       sha256(coalesce(line, '')) AS stems_sha256
FROM documents LEFT JOIN found ON doc_id = chunk_idx""",
    "rrf_fusion": f"WITH {POOL} SELECT qid, chunk_idx, dense_rank, lexical_rank, round(rrf, 6) AS rrf FROM fused",
    "hybrid_topk": f"WITH {POOL} SELECT qid, chunk_idx, dense_rank, lexical_rank, round(rrf, 6) AS rrf, fused_rank FROM pool",
    "cosine_pairs": (
        "SELECT a.vec_id AS chunk_idx, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine "
        "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
    ),
    "mmr_select": f"WITH {SELECTED} {_MMR_OUT} sel",
    "rerank_documents": f"WITH {DOCUMENTS} SELECT qid, chunk_idx, octet_length(encode(document)) AS bytes, sha256(document) AS sha256 FROM document",
    "rerank_order": f"WITH {RERANKED} SELECT qid, chunk_idx, rerank_pos, round(relevance, 6) AS relevance FROM accepted",
    "mmr_ordinal": (
        f"WITH {RERANKED}, {READY}, cand AS (SELECT r.* EXCLUDE (position), a.rerank_pos AS position, a.relevance AS rel "
        f"FROM ready r JOIN accepted a USING (qid, chunk_idx)), {selected_ctes('cand', 'sel', 'position')}, "
        f"other AS (SELECT *, cosine AS rel FROM ready WHERE qid NOT IN (SELECT qid FROM accepted)), {selected_ctes('other', 'loc')} "
        f"{_MMR_OUT} (SELECT * FROM sel UNION ALL SELECT * FROM loc)"
    ),
    "rerank_fallback": (
        f"WITH {DOCUMENTS}, stated AS MATERIALIZED (SELECT qid, CASE WHEN qid NOT IN (SELECT qid FROM document) THEN 'no_order' "
        "WHEN length(query) % 5 = 1 THEN 'failed' WHEN length(query) % 5 = 2 THEN 'invalid_order' ELSE 'reranked' END AS status FROM q), "
        "accepted AS MATERIALIZED (SELECT qid, chunk_idx, row_number() OVER w - 1 AS rerank_pos, "
        "(count(*) OVER (PARTITION BY qid) - (row_number() OVER w - 1)) / (count(*) OVER (PARTITION BY qid))::DOUBLE AS relevance "
        "FROM document JOIN stated USING (qid) WHERE status = 'reranked' WINDOW w AS (PARTITION BY qid ORDER BY length(document) DESC, position)), "
        f"{READY}, cand AS (SELECT r.* EXCLUDE (position), a.rerank_pos AS position, a.relevance AS rel "
        f"FROM ready r JOIN accepted a USING (qid, chunk_idx)), {selected_ctes('cand', 'sel', 'position')}, "
        f"other AS (SELECT *, cosine AS rel FROM ready WHERE qid NOT IN (SELECT qid FROM accepted)), {selected_ctes('other', 'loc')} "
        "SELECT qid, status, mmr_rank, chunk_idx, round(cosine, 6) AS cosine FROM (SELECT * FROM sel UNION ALL SELECT * FROM loc) JOIN stated USING (qid)"
    ),
    "answer_gate": f"WITH {DECIDED} SELECT qid, round(top_cosine, 6) AS top_cosine, round(top_rrf, 6) AS top_rrf, NOT none AND NOT reject AS gate_passed FROM labelled",
    "answer_state": f"WITH {DECIDED} SELECT qid, answer_state, decision_reason, binary_state, binary_reason FROM stated",
    "trace_pool_cosines": (
        f"WITH {READY_ALL} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, chunk_idx) AS pos, "
        "chunk_idx, round(cosine, 6) AS cosine FROM ready WHERE emb IS NOT NULL AND isfinite(cosine)"
    ),
    "neighbor_window": f"WITH {SELECTED}, {window_ctes('sel', 'win')} SELECT qid, pos, chunk_idx, round(score, 6) AS score FROM win",
    "token_budget": f"""
WITH {SELECTED}, {window_ctes('sel', 'win')},
t AS (SELECT qid, pos, chunk_idx, {tokens_sql('text')} AS tokens, 500 + qid % 7 * 300 AS max_tokens FROM win JOIN chunks USING (chunk_idx)),
r AS (SELECT *, (sum(tokens) OVER (PARTITION BY qid ORDER BY pos))::BIGINT AS cum_tokens, sum(tokens) OVER (PARTITION BY qid) AS total,
      row_number() OVER (PARTITION BY qid ORDER BY pos) AS rn FROM t)
SELECT qid, pos, chunk_idx, tokens, max_tokens, cum_tokens, total > max_tokens AS truncated FROM r WHERE rn = 1 OR cum_tokens <= max_tokens""",
    "search": f"WITH {SEARCH} SELECT qid, pos, chunk_idx, round(score, 6) AS score, answer_state, tokens, cum::BIGINT AS cum_tokens, total > 4000 AS truncated FROM result",
    "search_response": (
        f"WITH {SEARCH} SELECT qid, pos, chunk_idx, {sanitize_metadata_sql('heading_path')} AS heading_path, "
        f"{sanitize_metadata_sql('source_url')} AS source_url, 'Info' AS chunk_type, {sanitize_chunk_sql('text')} AS text FROM result"
    ),
    "rrf_k_sweep": f"""
WITH {POOL}, scored AS (
  SELECT qid, k AS rrf_k, chunk_idx, dense_rank,
         coalesce(1.0::DOUBLE / (k + dense_rank - 1), 0) + coalesce(1.0::DOUBLE / (k + lexical_rank - 1), 0) AS rrf
  FROM fused, (VALUES (5), (10), (20), (60)) s(k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, rrf_k
    ORDER BY round(rrf, 9) DESC, dense_rank NULLS LAST, chunk_idx) AS fused_rank FROM scored)
SELECT qid, rrf_k::BIGINT AS rrf_k, fused_rank, chunk_idx, round(rrf, 6) AS rrf FROM ranked WHERE fused_rank <= 40""",
    "mmr_lambda_sweep": (
        f"WITH {READY_ALL}, cand AS (SELECT *, cosine AS rel FROM ready, {LAMBDAS}), "
        f"{selected_ctes('cand', 'sel', extra=', mmr_lambda', weight='c.mmr_lambda')} "
        "SELECT qid, mmr_lambda, mmr_rank, chunk_idx, round(cosine, 6) AS cosine FROM sel"
    ),
}
