"""SQL that states what each catalog query must return, for the check tool."""

from __future__ import annotations

from quillsift import params
from quillsift.plans.catalog_queries import LICENSES, NOW, RUNNING, SEARCH_TEXT, STAGING_AGE
from quillsift.plans.text_oracle import literal, sanitize_chunk_sql

_LICENSE = f"[{', '.join(map(literal, LICENSES))}]"
_OK_LICENSES = ", ".join(map(literal, params.MANIFEST_LICENSES))

ROWS = "store AS (SELECT source AS docset, count(*) AS n_rows FROM documents GROUP BY source)"

# The manifest fields straight from the keys they are made of.
MANIFESTS = ROWS + f""",
mani AS (
  SELECT 'src' || s_suppkey AS docset, s_suppkey AS k, s_suppkey % 12 NOT IN (9, 10) AS parsed,
    CASE WHEN s_suppkey % 25 = 6 THEN 'other' ELSE 'src' || s_suppkey END AS named,
    '1.' || s_suppkey || '.0' AS doc_version,
    CASE s_suppkey % 11 WHEN 3 THEN 0 WHEN 7 THEN 2 ELSE 1 END AS sv,
    s_suppkey % 13 = 5 AS bad_model, s_suppkey % 29 = 4 AS bad_revision, s_suppkey % 17 = 2 AS bad_dim,
    {_LICENSE}[s_suppkey % 4 + 1] AS license, s_suppkey % 8 = 2 AS no_attribution,
    s_suppkey % 20 = 13 AS no_entry, s_suppkey % 10 = 3 AS no_source,
    coalesce(n_rows, 0) + (s_suppkey % 6 = 1)::INT AS chunk_count, n_rows
  FROM supplier LEFT JOIN store ON store.docset = 'src' || s_suppkey),
judged AS (
  SELECT *, array_to_string(list_filter([
      CASE WHEN sv <> 1 THEN 'schema_version' END, CASE WHEN bad_model THEN 'model_id' END, CASE WHEN bad_dim THEN 'vector_dim' END,
      CASE WHEN bad_revision THEN 'model_revision' END, CASE WHEN license NOT IN ({_OK_LICENSES}) THEN 'license' END,
      CASE WHEN license = 'CC-BY-4.0' AND no_attribution THEN 'attribution' END], lambda x: x IS NOT NULL), ',') AS violations,
    array_to_string(list_filter([
      CASE WHEN named <> docset THEN 'docset_name' END, CASE WHEN chunk_count = 0 THEN 'chunk_count_zero' END,
      CASE WHEN no_entry AND no_source THEN 'no_upstream_url' END], lambda x: x IS NOT NULL), ',') AS install_violations
  FROM mani),
known AS (SELECT coalesce(j.docset, s.docset) AS docset, j.* EXCLUDE (docset, n_rows), s.n_rows FROM judged j FULL JOIN store s ON s.docset = j.docset),
state AS (
  SELECT *, CASE WHEN NOT coalesce(parsed, false) AND n_rows IS NULL THEN 'not-installed' WHEN NOT coalesce(parsed, false) THEN 'no-manifest'
    WHEN n_rows IS NULL THEN 'no-store' WHEN sv <> 1 THEN 'schema-mismatch' WHEN violations <> '' THEN 'no-manifest'
    ELSE 'ok' END AS pure_state FROM known),
full_state AS (SELECT *, CASE WHEN pure_state = 'ok' AND n_rows <> chunk_count THEN 'count-mismatch' ELSE pure_state END AS state FROM state)
"""

_URL = """CASE p % 9
  WHEN 0 THEN 'https://code.example.org/docs-registry/p' || p || '/releases/download/v1/a.tar'
  WHEN 1 THEN 'https://code.example.org/docs-registry/p' || p || '/releases/latest/download/a.tar'
  WHEN 2 THEN 'https://code.example.org/docs-registry/p' || p || '/raw/main/releases/download/a.tar'
  WHEN 3 THEN 'https://mirror.example.org/releases/' || p
  WHEN 4 THEN 'https://mirror.example.org/other/' || p
  WHEN 5 THEN 'https://code.example.org/docs-registry.bad/p' || p || '/releases/download/v1/a'
  WHEN 6 THEN 'https://code.example.org/docs-registry//releases/download/v1/' || p
  WHEN 7 THEN 'file:///tmp/' || p
  ELSE 'https://code.example.org/docs-registry/p' || p || '/releases/download//a.tar' END"""

_REST = "CASE WHEN contains(url, '://') THEN string_split(url, '://')[2] ELSE url END"
_HOSTED = f"""(SELECT *, string_split(rest, '/')[1] AS host, substring(rest, len(string_split(rest, '/')[1]) + 1) AS path FROM (SELECT *, {_REST} AS rest FROM {{0}}))"""
_MIRROR = "(host = 'mirror.example.org' AND (starts_with(path, '/releases/') OR path = '/releases'))"
_SEG = "string_split(ltrim(path, '/'), '/')"
_PACKAGE_OK = f"""coalesce({_MIRROR} OR (host = 'code.example.org' AND len({_SEG}) = 6 AND {_SEG}[1] = 'docs-registry' AND {_SEG}[2] <> '' AND {_SEG}[3] = 'releases'
  AND ({_SEG}[4] = 'download' AND {_SEG}[5] <> '' OR {_SEG}[4] = 'latest' AND {_SEG}[5] = 'download') AND {_SEG}[6] <> ''), false)"""
_INDEX_OK = f"({_MIRROR} OR (host = 'code.example.org' AND (starts_with(path, '/docs-registry/') OR path = '/docs-registry')))"

PACKAGES = f"""
raw_pkg AS (SELECT p_partkey AS p, 'src' || p_partkey AS docset,
  CASE p_partkey % 10 WHEN 0 THEN 'v1.' || (p_partkey % 4) || '.0' WHEN 1 THEN '1.2.0-rc.' || (p_partkey % 13) WHEN 2 THEN '1.2.0-' || (p_partkey % 13) || '.x'
    WHEN 3 THEN 'latest' WHEN 4 THEN '1.02.' || (p_partkey % 3) ELSE (p_partkey % 3) || '.' || (p_partkey % 11) || '.' || (p_partkey % 5) END AS version,
  {_LICENSE}[p_partkey % 4 + 1] AS license,
  CASE WHEN p_partkey % 6 = 2 THEN NULL ELSE p_name || ' ' || p_brand || ' ' || p_type END AS description FROM part),
pkg AS (SELECT *, {_URL} AS url FROM raw_pkg)
"""

_SEM = r"^v?(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-((?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+[0-9A-Za-z.-]+)?$"


def _key(v: str) -> str:
    part = lambda g: f"regexp_extract({v}, '{_SEM}', {g})"
    ids = (
        f"list_transform(string_split({part(4)}, '.'), lambda i: CASE WHEN regexp_full_match(i, '[0-9]+') "
        f"THEN '0' || lpad(i, 20, '0') ELSE '1' || i END)"
    )
    nums = ", ".join(f"'n{g}': try_cast({part(g)} AS BIGINT)" for g in (1, 2, 3))
    return f"CASE WHEN regexp_matches({v}, '{_SEM}') THEN {{{nums}, 'r': ({part(4)} = '')::INT, 'p': {ids}}} END"


_CONTRACT = """
c AS (SELECT CASE WHEN doc_id % 101 = 7 THEN doc_id - 1 WHEN doc_id % 199 = 11 THEN doc_id + 1000000000 ELSE doc_id END AS chunk_idx,
  CASE WHEN doc_id % 53 = 9 THEN '<!-- none --> ' || chr(8203) || ' ' ELSE text END AS text,
  CASE doc_id % 47 WHEN 3 THEN 'Other' WHEN 4 THEN NULL ELSE 'Info' END AS chunk_type FROM documents)
"""

# Packages straight from the keys their faults are made of.
_ARCHIVES = """
turns AS (SELECT conv_id || '-' || (turn // 64) AS archive, conv_id * 7 + turn // 64 AS k, turn % 64 AS pos FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY pos) - 1 AS line_no FROM turns),
packs AS (SELECT archive, k, k % 33 <> 10 AS filled FROM turns GROUP BY archive, k),
held AS (SELECT *, filled AND (k % 31 <> 8 OR k % 16 = 3) AS has_manifest, filled AND k % 31 <> 8 AND k % 27 <> 9 AS reads, filled AND k % 37 <> 2 AS has_chunks FROM packs),
lines AS (SELECT archive, k, line_no, pos, k % 23 = 4 AND pos = 1 AS torn FROM placed JOIN held USING (archive, k) WHERE has_chunks)
"""

ORACLES = {
    "archive_validate": f"""
WITH {_ARCHIVES}
SELECT archive, 'missing_manifest' AS violation, NULL::VARCHAR AS name FROM held WHERE NOT has_manifest
UNION ALL SELECT archive, 'missing_chunks', NULL FROM held WHERE NOT has_chunks
UNION ALL SELECT archive, 'unsafe_path', '../LICENSE' FROM held WHERE filled AND k % 15 = 4
UNION ALL SELECT archive, 'duplicate_entry', 'manifest.json' FROM held WHERE filled AND k % 31 <> 8 AND k % 16 = 3
UNION ALL SELECT archive, CASE WHEN k % 14 = 5 THEN 'sha256_mismatch' ELSE 'sha256_shape' END, NULL FROM held WHERE k % 14 IN (5, 6)
UNION ALL SELECT archive, 'invalid_manifest', NULL FROM held WHERE has_manifest AND NOT reads
UNION ALL SELECT archive, 'manifest_rule', 'model_id' FROM held WHERE reads AND k % 13 = 5
UNION ALL SELECT archive, 'manifest_rule', 'docset_name' FROM held WHERE reads AND k % 25 = 6
UNION ALL SELECT archive, 'manifest_rule', 'no_upstream_url' FROM held WHERE reads AND k % 21 = 2
UNION ALL SELECT archive, 'chunk_count', NULL FROM held WHERE reads AND has_chunks AND k % 11 = 1
UNION ALL SELECT archive, 'malformed_line', line_no::VARCHAR FROM lines WHERE torn
UNION ALL SELECT archive, 'idx_position', line_no::VARCHAR FROM lines WHERE NOT torn AND CASE WHEN k % 19 = 7 AND pos = 1 THEN 0 ELSE pos END <> line_no
UNION ALL SELECT archive, 'empty_text', line_no::VARCHAR FROM lines WHERE NOT torn AND k % 17 = 6 AND pos = 0
UNION ALL SELECT archive, 'chunk_type', line_no::VARCHAR FROM lines WHERE NOT torn AND k % 29 = 3 AND pos = 0""",
    "docset_name_valid": """
WITH n AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN upper(source) WHEN 1 THEN source || '..x' WHEN 2 THEN source || '/' || lang
  WHEN 3 THEN repeat(source, 20) WHEN 4 THEN '' WHEN 5 THEN source || '_-.' || lang ELSE source END AS name FROM documents)
SELECT doc_id, name, regexp_full_match(name, '[a-z0-9._-]{1,64}') AND NOT contains(name, '..') AS valid FROM n""",
    "query_valid": "SELECT doc_id, length(CASE WHEN doc_id % 50 = 7 THEN '' ELSE text END) BETWEEN 1 AND 4096 AS valid FROM documents",
    "resolve_limits": """
SELECT event_id, least(coalesce(nullif(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE event_id * 13 % 9000 END, 0), 4000), 4000) AS max_tokens,
  least(greatest(coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 31 END, 5), 1), 20) AS top_k FROM events""",
    "source_url_join": """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'docs/' || page_id || '.md' WHEN 1 THEN rtrim(url || '//', '/') || '/docs/' || page_id || '.md'
  ELSE rtrim(url, '/') || '/docs/' || page_id || '.md' END AS source_url FROM pages""",
    "source_url_canonical": """
WITH s AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '//docs/' || page_id WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN '/' ELSE 'a/..b/' || page_id END AS s FROM pages)
SELECT page_id, CASE WHEN starts_with(s, 'https://') THEN s WHEN ltrim(s, '/') = '' OR list_contains(string_split(ltrim(s, '/'), '/'), '..') THEN NULL
  ELSE 'https://docs.example.org/x/' || ltrim(s, '/') END AS source_url FROM s""",
    "chunk_contract_violations": f"""
WITH {_CONTRACT}, r AS (
SELECT 'repeated_idx' AS violation, chunk_idx FROM c GROUP BY chunk_idx HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'idx_out_of_range', chunk_idx FROM c WHERE chunk_idx NOT BETWEEN 0 AND (SELECT count(*) FROM c)
UNION ALL SELECT 'empty_text', chunk_idx FROM c WHERE {sanitize_chunk_sql('text')} = ''
UNION ALL SELECT 'chunk_type', chunk_idx FROM c WHERE chunk_type = 'Other'
UNION ALL SELECT 'chunk_count', NULL)
SELECT 'docs' AS docset, violation, chunk_idx FROM r""",
    "package_url_gate": f"""
WITH u AS (SELECT page_id, page_id AS p, url FROM pages), b AS (SELECT page_id, url FROM u UNION ALL SELECT page_id, {_URL} FROM u)
SELECT page_id, url, {_INDEX_OK} AS index_ok, {_PACKAGE_OK} AS package_ok FROM {_HOSTED.format('b')}""",
    "docset_state": f"WITH {MANIFESTS} SELECT docset, state, pure_state FROM full_state",
    "store_status": f"""
WITH {MANIFESTS}, c AS (SELECT max(CASE state WHEN 'ok' THEN 0 WHEN 'schema-mismatch' THEN 2 ELSE 1 END) AS worst FROM full_state WHERE n_rows IS NOT NULL)
SELECT CASE worst WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS status FROM c""",
    "corpus_identity": f"""
WITH {MANIFESTS} SELECT docset, repeat('0', 40) AS code_commit, 60 AS rrf_k, 'l2' AS metric, doc_version, chunk_count,
  CASE WHEN bad_model THEN 'other/model' ELSE {literal(params.MODEL_ID)} END AS model_id, CASE WHEN bad_revision THEN ' ' ELSE 'main' END AS model_revision,
  '00' AS model_sha256, 64 AS digest_length FROM judged WHERE parsed""",
    "stale_staging": f"""
WITH l AS (SELECT event_id, event_type || '-' || user_id || CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '-new' ELSE '-' || event_id END AS name, floor(epoch(ts))::BIGINT AS modified FROM events)
SELECT * FROM l WHERE event_id % 5 > 1 AND {NOW} - modified >= {STAGING_AGE}""",
    "list_installed": f"""
WITH {MANIFESTS}, s AS (SELECT *, CASE WHEN parsed = false THEN 'broken' ELSE state END AS status, coalesce(parsed, false) AS ok FROM full_state WHERE n_rows IS NOT NULL)
SELECT docset AS name, CASE WHEN ok THEN doc_version ELSE '?' END AS version, CASE WHEN ok THEN chunk_count::VARCHAR ELSE '?' END AS chunks,
  CASE WHEN ok THEN license ELSE '?' END AS license, status, docset || ' (' || status || ')' AS label FROM s""",
    "receipt_match": "SELECT 'src' || s_suppkey AS docset, '1.' || s_suppkey || '.0' AS package_version FROM supplier WHERE s_suppkey % 12 NOT IN (9, 10) AND s_suppkey % 9 <> 8 AND s_suppkey % 7 <> 5",
    "docset_updates": f"""
WITH {PACKAGES}, i AS (SELECT 'src' || s_suppkey AS docset, CASE s_suppkey % 6 WHEN 0 THEN '1.2.0-rc.5' WHEN 1 THEN '1.2.0' WHEN 2 THEN 'v0.9.9' WHEN 3 THEN '1.2.0-alpha'
  WHEN 4 THEN 'unknown' ELSE (s_suppkey % 3) || '.' || (s_suppkey % 7) || '.' || (s_suppkey % 5) END AS installed_version FROM supplier)
SELECT docset, installed_version, version AS latest_version, docset || ':' || installed_version || '->' || version AS snapshot_part
FROM i JOIN pkg USING (docset) WHERE {_key('version')} > {_key('installed_version')}""",
    "stable_release": f"""
WITH {PACKAGES} SELECT docset, CASE WHEN p % 5 <> 1 AND p % 7 <> 2 AND regexp_matches(version, '{_SEM}') AND regexp_extract(version, '{_SEM}', 4) = ''
  THEN regexp_replace(version, '^v', '') END AS release FROM pkg""",
    "catalog_search": f"""
WITH {PACKAGES} SELECT docset, version, description FROM pkg WHERE contains(lower(docset), {literal(SEARCH_TEXT.lower())}) OR contains(lower(description), {literal(SEARCH_TEXT.lower())})""",
    "catalog_list": f"WITH {PACKAGES} SELECT docset, version, license, docset IN (SELECT source FROM documents) AS installed FROM pkg",
    "civil_date": "SELECT event_id, strftime(DATE '1970-01-01' + (event_id * 37 % 60000 - 20000)::INT, '%Y-%m-%d') AS day FROM events",
    "duration_seconds": "SELECT p_partkey, p_size * CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 4 THEN 1 END::BIGINT AS seconds FROM part",
    "update_throttle": f"""
SELECT event_id, (user_id % 3 <> 0 AND event_type <> {literal(RUNNING)}) OR greatest({NOW} - floor(epoch(ts))::BIGINT, 0) >= 86400 AS needs_fetch FROM events""",
    "manifest_validate": f"""
WITH {MANIFESTS} SELECT docset, parsed, CASE WHEN parsed THEN CASE WHEN sv = 1 THEN 'current' WHEN sv < 1 THEN 'older' ELSE 'newer' END END AS compatibility,
  CASE WHEN parsed THEN violations ELSE '' END AS violations, CASE WHEN parsed THEN install_violations ELSE '' END AS install_violations FROM judged""",
    "registry_validate": f"""
WITH {PACKAGES} SELECT docset, array_to_string(list_filter([CASE WHEN NOT {_PACKAGE_OK} THEN 'download_url' END,
  CASE WHEN license NOT IN ({_OK_LICENSES}) THEN 'license' END, CASE WHEN p % 14 IN (5, 6) THEN 'sha256' END], lambda x: x IS NOT NULL), ',') AS violations
FROM {_HOSTED.format('pkg')}""",
}
