"""SQL that states what each text query must return, for the check tool."""

from __future__ import annotations

from quillsift.functions.license_rules import (
    ALLOWED,
    CC_PROSE,
    DANGEROUS,
    LICENSED_UNDER,
    MARKER,
    SPDX_IDS,
)
from quillsift.plans.retrieval_oracle import SEARCH
from quillsift.plans.text_oracle import (
    WS,
    heading_sql,
    literal,
    pick_sql,
    rx,
    sanitize_chunk_sql,
    sanitize_metadata_sql,
    strip_markup_sql,
    tokens_sql,
    trim_sql,
    utf8_cut_sql,
    words_sql,
)
from quillsift.plans.text_queries import INJECTIONS, LICENSE_LINES, MARKUP_TAIL

_IDS = "|".join(i.replace(".", r"\.") for i in sorted(SPDX_IDS, key=len, reverse=True))
_IDS_DOUBLED = _IDS.replace(r"\.", r"\.\.")
_EDGE = "[^A-Za-z0-9-]"
_DOUBLED = rf"regexp_replace(line, '({_EDGE})', '\1\1', 'g')"
_HAS_ID = rf"regexp_matches(p, '(?:^|{_EDGE})(?:{_IDS})(?:$|{_EDGE})')"


def _prose_sql() -> str:
    items = ", ".join(
        f"CASE WHEN regexp_matches(line, '(?i){rx_}') THEN {{'kind': 'prose', "
        f"'spdx': '{prefix}' || regexp_extract(line, '(?i){rx_}', 1), 'raw': regexp_extract(line, '(?i){rx_}', 0)}} END"
        for rx_, prefix in CC_PROSE
    )
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


_PHRASE = rx(trim_sql("p"), "[,;:]+$")

FINDINGS = f"""
files AS (
  SELECT source AS repo, doc_id % 10 = 0 AS is_license,
         printf(CASE WHEN doc_id % 10 = 0 THEN '%06d/LICENSE.md' ELSE '%06d/page.md' END, doc_id) AS file,
         text || chr(10) || {pick_sql(LICENSE_LINES, 'doc_id')} AS text FROM documents),
split AS (SELECT repo, file, is_license,
  string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM files),
line AS (SELECT repo, file, is_license, line_no, l[line_no] AS line
  FROM split, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS line_no)),
raw AS (
  SELECT *, list_concat(
    list_transform(range(1, len(regexp_extract_all(line, '{MARKER}', 1)) + 1),
      lambda i: {{'kind': 'spdx_marker', 'spdx': regexp_extract_all(line, '{MARKER}', 1)[i], 'raw': regexp_extract_all(line, '{MARKER}', 0)[i]}}),
    list_transform(regexp_extract_all({_DOUBLED}, '(?:^|{_EDGE})({_IDS_DOUBLED})(?:$|{_EDGE})', 1),
      lambda s: {{'kind': 'spdx', 'spdx': replace(s, '..', '.'), 'raw': replace(s, '..', '.')}}),
    {_prose_sql()},
    list_transform(list_filter(list_transform(
        regexp_extract_all(line, '(?i){LICENSED_UNDER}', 1), lambda p: {_PHRASE}),
        lambda p: NOT {_HAS_ID}),
      lambda p: {{'kind': 'licensed_under', 'spdx': '', 'raw': p}})) AS found
  FROM line),
found AS (
  SELECT repo, file, is_license, line_no, seq - 1 AS seq, found[seq].kind AS kind, found[seq].spdx AS spdx,
         found[seq].raw AS raw, substring({trim_sql('line')}, 1, 120) AS snippet
  FROM raw, LATERAL (SELECT unnest(range(1, len(found) + 1)) AS seq)),
findings AS MATERIALIZED (
  SELECT repo, file, line_no, seq, CASE WHEN is_license AND row_number() OVER (
           PARTITION BY repo, file ORDER BY line_no, seq) = 1 THEN 'license_file' ELSE kind END AS kind,
         spdx, raw, snippet FROM found
  UNION ALL
  SELECT repo, file, 1, 0, 'license_file', '', '', coalesce(substring(list_filter(
      list_transform(l, lambda x: {trim_sql('x')}), lambda x: x <> '')[1], 1, 120), '')
  FROM split WHERE is_license AND file NOT IN (SELECT file FROM found)),
seen AS MATERIALIZED (
  SELECT *, (m).f AS first_file, (m).l AS first_line, row_number() OVER (PARTITION BY repo ORDER BY m, spdx) AS seen_rank FROM (
    SELECT repo, spdx, count(*) AS n_findings, min({{'f': file, 'l': line_no, 's': seq}}) AS m,
           spdx IN ({', '.join(literal(d) for d in DANGEROUS)}) AS dangerous
    FROM findings WHERE spdx <> '' GROUP BY repo, spdx))
"""

_N = "chr(10)"
MIXED = f"""
md AS (SELECT doc_id AS doc_key, '# ' || source || {_N} || {_N} || replace(text, {_N}, {_N} || {_N}) || {_N} || {_N}
  || '### ' || lang || {_N} || {_N} || '```' || lang || {_N} || '# not a heading' || {_N} || text || {_N} || '~~~' || {_N}
  || source || '.' || {_N} || '## > #' || lang || {_N} || ' ' || {_N} AS markdown FROM documents)
"""

_LEVELS = range(1, 7)
SEGMENT_CTES = f"""
arr AS (SELECT doc_key, string_split(regexp_replace(markdown, '\\n$', ''), {_N}) AS l FROM md),
ln AS (SELECT doc_key, i, l[i] AS line, l[i] || {_N} AS body
  FROM arr, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
fl AS (SELECT *, regexp_matches(line, '^{WS}*(```|~~~)') AS fence FROM ln),
st AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_code FROM fl),
ty AS (SELECT *, NOT in_code AND NOT fence AND regexp_matches(line, '^{WS}*#{{1,6}} .*[^\\s]') AS head FROM st),
kd AS (SELECT *, CASE WHEN in_code OR fence THEN 'Code' WHEN head THEN 'Head' ELSE 'Info' END AS kind,
  CASE WHEN head THEN len(regexp_extract(line, '^{WS}*(#{{1,6}}) ', 1)) END AS level,
  {trim_sql(f"regexp_replace(line, '^{WS}*#{{1,6}} ', '')")} AS title FROM ty),
bs AS (SELECT *, head OR (fence AND NOT in_code) OR (kind = 'Info' AND lag(kind) OVER (PARTITION BY doc_key ORDER BY i) IS DISTINCT FROM 'Info') AS start FROM kd),
bl AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_key ORDER BY i) AS blk,
  {', '.join(f"max(CASE WHEN level = {n} THEN {{'i': i, 't': title}} END) OVER (PARTITION BY doc_key ORDER BY i) AS h{n}" for n in _LEVELS)} FROM bs),
ph AS (SELECT *, {' || '.join(f"CASE WHEN h{n} IS NOT NULL AND h{n}.i > greatest(0, {', '.join(f'coalesce(h{m}.i, 0)' for m in range(1, n)) or '0'}) THEN h{n}.t || ' > ' ELSE '' END" for n in _LEVELS)} AS path FROM bl),
gr AS (SELECT doc_key, blk, min(kind) AS kind, min_by(path, i) AS path, string_agg(body, '' ORDER BY i) AS body FROM ph GROUP BY doc_key, blk),
segments AS (SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY blk) - 1 AS block_no, {heading_sql('path')} AS heading_path, kind, body
  FROM gr WHERE kind = 'Code' OR (kind = 'Info' AND {trim_sql('body')} <> ''))
"""

SEGMENTS = MIXED + "," + SEGMENT_CTES

PROSE_MD = f"""
md AS (SELECT doc_id AS doc_key, '# ' || source || {_N} || {_N} || '## ' || lang || {_N} || {_N} || replace(text, {_N}, {_N} || {_N}) AS markdown FROM documents)
"""
CODE_MD = f"""
md AS (SELECT doc_id AS doc_key, '# ' || source || {_N} || '```' || lang || {_N} || replace(text, '. ', '.' || {_N} || 'fn ') || {_N} || '```' || {_N} AS markdown FROM documents)
"""


def _tokens(text: str) -> str:
    return tokens_sql(f"({text})")


def _fold(items: str, step: str, last: str) -> str:
    """Fold a list of strings with a (buf, out) state; ``step`` names it ``a`` and the item ``x.t``."""
    state = "{{'buf': '', 'out': []::VARCHAR[], 't': {0}}}"
    folded = (
        f"list_reduce(list_concat([{state.format(chr(39) * 2)}], list_transform({items}, lambda t: {state.format('t')})), "
        f"lambda a, x: {step})"
    )
    return f"list_extract(list_transform([{folded}], lambda a: {last}), 1)"


_FLUSHED = "(CASE WHEN a.buf = '' THEN a.out ELSE list_append(a.out, a.buf) END)"


def _state(buf: str, out: str) -> str:
    return f"{{'buf': {buf}, 'out': {out}, 't': ''}}"


_PER = "((3 * eff_max + 3) // 4)"
_WORDS = f"list_filter(string_split_regex(x.t, '{WS}+'), lambda w: w <> '')"
_GROUPS = (
    f"list_transform(range(0, (len({_WORDS}) + {_PER} - 1) // {_PER}), "
    f"lambda i: array_to_string(list_slice({_WORDS}, i * {_PER} + 1, (i + 1) * {_PER}), ' '))"
)
_SENTENCES = (
    "list_filter(regexp_extract_all(para, '[^.!?]*[.!?][ \\t\\n]*|[^.!?]+'), lambda s: "
    + trim_sql("s") + " <> '')"
)
_LONG = _fold(
    _SENTENCES,
    f"CASE WHEN {_tokens('x.t')} > eff_max THEN {_state(chr(39) * 2, f'list_concat({_FLUSHED}, {_GROUPS})')} "
    f"WHEN a.buf <> '' AND {_tokens('a.buf')} + {_tokens('x.t')} > eff_max THEN {_state('x.t', _FLUSHED)} "
    f"ELSE {_state('a.buf || x.t', 'a.out')} END",
    _FLUSHED,
)
_CUT = "regexp_extract_all(x.t, '(?s)\\s*(?:\\S+\\s+){' || ((3 * room + 3) // 4 - 1) || '}\\S|.+')"


def _joined(items: str, cut: bool) -> str:
    grown = f"CASE WHEN a.buf = '' THEN x.t ELSE a.buf || {_N} || x.t END"
    over = (
        f"WHEN {_tokens('x.t')} > room THEN {_state(chr(39) * 2, f'list_concat({_FLUSHED}, {_CUT})')} " if cut else ""
    )
    return _fold(
        items,
        f"CASE {over}WHEN a.buf <> '' AND {_tokens(f'a.buf || {_N} || x.t')} > room THEN {_state('x.t', _FLUSHED)} "
        f"ELSE {_state(grown, 'a.out')} END",
        _FLUSHED,
    )


_PREFIX = f"CASE WHEN heading_path = '' THEN '' ELSE '## ' || heading_path || {_N} || {_N} END"
_INNER = f"string_split(regexp_replace(body, '\\n$', ''), {_N})"
_STARTS = f"regexp_matches(line, '^{WS}*(?:fn |def |function |class )')"

# Every block's pieces: prose by paragraphs, code whole or by definitions.
CHUNKS = SEGMENT_CTES + f""",
blk AS MATERIALIZED (
  SELECT *, {_PREFIX} AS prefix, {_tokens(_PREFIX)} AS overhead,
         greatest(512 - {_tokens(_PREFIX)}, 1) AS eff_max,
         least(greatest(384 - {_tokens(_PREFIX)}, 0), greatest(512 - {_tokens(_PREFIX)}, 1)) AS eff_target,
         kind = 'Code' AND {_tokens(f'{_PREFIX} || body')} > 512 AS is_split FROM segments),
pr AS (
  SELECT doc_key, block_no, eff_max, eff_target, prefix, heading_path, i, {trim_sql('ps[i]')} AS para FROM (
    SELECT *, string_split(body, {_N} || {_N}) AS ps FROM blk WHERE kind = 'Info'), LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i)),
pl AS (SELECT *, {_tokens('para')} AS n, CASE WHEN {_tokens('para')} > eff_max THEN {_LONG} END AS long FROM pr WHERE para <> ''),
pa AS (
  SELECT doc_key, block_no, any_value(eff_target) AS eff_target, any_value(prefix) AS prefix, any_value(heading_path) AS heading_path,
         list({{'buf': '', 'out': []::VARCHAR[], 't': para, 'n': n, 'long': long}} ORDER BY i) AS items FROM pl GROUP BY ALL),
pf AS (
  SELECT doc_key, block_no, prefix, heading_path, list_reduce(
    list_concat([{{'buf': '', 'out': []::VARCHAR[], 't': '', 'n': 0::BIGINT, 'long': NULL::VARCHAR[]}}], items), lambda a, x:
      CASE WHEN x.long IS NOT NULL THEN {{'buf': '', 'out': list_concat({_FLUSHED}, x.long), 't': '', 'n': 0::BIGINT, 'long': NULL::VARCHAR[]}}
           WHEN a.buf = '' OR {_tokens('a.buf')} + x.n > eff_target THEN {{'buf': x.t, 'out': {_FLUSHED}, 't': '', 'n': 0::BIGINT, 'long': NULL::VARCHAR[]}}
           ELSE {{'buf': a.buf || {_N} || {_N} || x.t, 'out': a.out, 't': '', 'n': 0::BIGINT, 'long': NULL::VARCHAR[]}} END) AS a
  FROM pa),
pp AS (SELECT doc_key, block_no, heading_path, 'Info' AS kind, prefix, NULL AS open_line, NULL AS fence, {_FLUSHED} AS pieces FROM pf),
cs AS (SELECT *, {_INNER} AS ls FROM blk WHERE is_split),
co AS (SELECT *, ls[1] AS open_line, regexp_extract({trim_sql('ls[1]')}, '^(`+|~+)') AS fence,
  list_slice(ls, 2, CASE WHEN len(ls) >= 2 AND regexp_matches(ls[-1], '^{WS}*(```|~~~)') THEN len(ls) - 1 ELSE len(ls) END) AS inner_lines FROM cs),
cr AS MATERIALIZED (SELECT doc_key, block_no, heading_path, open_line, fence, inner_lines,
  greatest(512 - 8 - overhead - {_tokens('open_line')} - {_tokens('fence')}, 1) AS room FROM co),
cl AS (SELECT doc_key, block_no, room, i, inner_lines[i] AS line FROM cr, LATERAL (SELECT unnest(range(1, len(inner_lines) + 1)) AS i)),
cb AS (SELECT *, sum({_STARTS}::INT) OVER (PARTITION BY doc_key, block_no ORDER BY i) AS seg FROM cl),
cg AS (SELECT doc_key, block_no, room, seg, list(line ORDER BY i) AS lines FROM cb GROUP BY ALL),
ci AS (SELECT doc_key, block_no, room, seg, CASE WHEN {_tokens(f'array_to_string(lines, {_N})')} <= room THEN [array_to_string(lines, {_N})]
         ELSE {_joined('lines', True)} END AS pieces FROM cg),
cj AS (SELECT doc_key, block_no, room, flatten(list(pieces ORDER BY seg)) AS pieces FROM ci GROUP BY ALL),
cp AS (SELECT doc_key, block_no, {_joined('pieces', False)} AS pieces FROM cj),
piece AS (
  SELECT * FROM pp
  UNION ALL SELECT doc_key, block_no, heading_path, 'Code', prefix, NULL, NULL, [body] FROM blk WHERE kind = 'Code' AND NOT is_split
  UNION ALL SELECT doc_key, block_no, heading_path, 'Code', NULL, open_line, fence, cp.pieces FROM cp JOIN cr USING (doc_key, block_no)),
part AS (SELECT *, pieces[i] AS piece, i - 1 AS part_no FROM piece, LATERAL (SELECT unnest(range(1, len(pieces) + 1)) AS i)),
chunked AS (
  SELECT doc_key, block_no, part_no, kind AS chunk_type,
    CASE WHEN open_line IS NULL THEN heading_path ELSE trim(heading_path || ' (part ' || i || ')') END AS heading_path,
    CASE WHEN open_line IS NULL THEN prefix || piece ELSE '## ' || trim(heading_path || ' (part ' || i || ')') || {_N} || {_N}
         || open_line || {_N} || piece || {_N} || fence || {_N} END AS text FROM part),
counted AS MATERIALIZED (SELECT *, {tokens_sql('text')} AS tokens FROM chunked)
"""
_CHUNK_COLUMNS = "doc_key, block_no, part_no, heading_path, chunk_type, text, tokens"

_KIND = "doc_id % 3"
_RAW = f"CASE {_KIND} WHEN 0 THEN '## old name' || {_N} || text WHEN 1 THEN '## only ' || source ELSE text END"
_SPAN = "chr(1) || 'S' || chr(1)"
_SCRIPT = "<script setup>\nconst {z} = '```'\n</script>"
_PREP_HEAD = f"""'<Card a="1">' || source || '</Card>' || text || ' use ' || {_SPAN} || ' and {{y}}' || {_N}"""

ORACLES = {
    "chunk_scan": "SELECT doc_id AS chunk_idx, concat(source, '/', lang, '.md') AS source_url, lang AS heading_path, 'Info' AS chunk_type, text FROM documents",
    "chunk_lookup": "SELECT doc_id AS chunk_idx, concat(source, '/', lang, '.md') AS source_url, lang AS heading_path, text FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "vector_lookup": (
        "SELECT vec_id AS chunk_idx, len(embedding) AS dim, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2, "
        "round(embedding[1]::DOUBLE, 6) AS first_lane FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)"
    ),
    "row_count": "SELECT count(*) AS n_rows FROM documents",
    "page_reassemble": f"SELECT conv_id, string_agg(text, {_N} || {_N} ORDER BY turn) AS text, count(*) AS n_chunks FROM conversations GROUP BY conv_id",
    "content_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "sanitize_chunk": "SELECT page_id, " + sanitize_chunk_sql(f"(html || ' ' || {pick_sql(INJECTIONS, 'page_id')})") + " AS text FROM pages",
    "sanitize_metadata": (
        "SELECT page_id, " + sanitize_metadata_sql("url") + " AS url, "
        + sanitize_metadata_sql(f"({pick_sql(INJECTIONS, 'page_id')} || chr(8205) || ' ' || {_N} || html)") + " AS heading FROM pages"
    ),
    "heading_normalize": "SELECT doc_id, " + heading_sql("(' # ' || source || ' > > ## ' || lang || '>### ' || text)") + " AS heading_path FROM documents",
    "token_estimate": f"SELECT doc_id, {words_sql('text')} AS words, {tokens_sql('text')} AS tokens FROM documents",
    "strip_markup": "SELECT page_id, " + strip_markup_sql(f"(html || {literal(MARKUP_TAIL)})") + " AS text FROM pages",
    "prep_filter": (
        "WITH s AS (SELECT doc_id, " + strip_markup_sql("(text || " + literal("\n\n\n\n{aside}\n<Card/>\n \nend") + ")") + " AS text FROM documents) "
        + f"SELECT doc_id, regexp_replace(text, '\\n{{3,}}', {_N} || {_N}, 'g') AS text FROM s WHERE len(list_filter("
        + f"string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: {trim_sql('x')} <> '')) >= 3"
    ),
    "prep_docs": (
        "WITH s AS (SELECT doc_id, replace(" + strip_markup_sql(f"({_PREP_HEAD})") + f", {_SPAN}, '`{{x}}`') AS head, text, "
        + strip_markup_sql(f"(chr(1) || 'T' || chr(1) || {literal(chr(10) + 'end {w} <b>bold</b>' + chr(10))})") + " AS tail FROM documents) "
        + f"SELECT doc_id, head || {literal('```js' + chr(10) + 'import {a} from ' + chr(39) + 'b' + chr(39) + chr(10))} || text || "
        + literal("\n```ts\n{kept}\n```\n") + f" || replace(tail, chr(1) || 'T' || chr(1), {literal(_SCRIPT)}) AS text FROM s"
    ),
    "chunk_text_normalize": f"""
WITH r AS (SELECT doc_id, {_RAW} AS t, CASE WHEN doc_id % 4 = 3 THEN '' ELSE source || ' > ' || lang END AS h FROM documents)
SELECT doc_id, CASE WHEN h = '' OR NOT starts_with(t, '## ') THEN t
  WHEN contains(t, {_N}) THEN '## ' || h || substring(t, strpos(t, {_N})) ELSE '## ' || h || {_N} END AS text FROM r""",
    "release_rows": f"""
WITH r AS (SELECT *, {_RAW} AS t, CASE WHEN doc_id % 4 = 3 THEN '' ELSE source || ' > ' || lang END AS h FROM documents)
SELECT doc_id AS chunk_idx, h AS heading_path, CASE WHEN doc_id % 5 = 2 THEN 'https://other.example.org/' || doc_id ELSE 'https://docs.example.org/x/docs/' || doc_id END AS source_url,
  CASE WHEN doc_id % 7 = 2 THEN 'v2' END AS api_version, CASE WHEN doc_id % 6 <> 1 THEN 'Code' ELSE 'Info' END AS chunk_type,
  CASE WHEN h = '' OR NOT starts_with(t, '## ') THEN t
  WHEN contains(t, {_N}) THEN '## ' || h || substring(t, strpos(t, {_N})) ELSE '## ' || h || {_N} END AS text FROM r""",
    "license_findings": f"WITH {FINDINGS} SELECT repo, file, line_no, seq, kind, spdx, raw, snippet FROM findings",
    "license_summary": f"WITH {FINDINGS} SELECT repo, spdx, n_findings, seen_rank, first_file, first_line, dangerous FROM seen",
    "license_verdict": f"""
WITH {FINDINGS}, p AS (
  SELECT repo, max(dangerous) AS found_dangerous,
         min_by(spdx, seen_rank) FILTER (WHERE NOT dangerous) AS best, max_by(spdx, seen_rank) AS last FROM seen GROUP BY repo),
v AS (SELECT repo, found_dangerous, coalesce(upper(best), 'PARSE_ERROR') AS first_verdict,
  CASE WHEN len(repo) % 2 = 0 THEN 'PARSE_ERROR' ELSE coalesce(upper(best), 'PARSE_ERROR') END AS second_verdict FROM p)
SELECT *, (found_dangerous OR first_verdict IN ({', '.join(map(literal, DANGEROUS))}) OR second_verdict IN ({', '.join(map(literal, DANGEROUS))})
  OR first_verdict <> second_verdict OR first_verdict NOT IN ({', '.join(map(literal, ALLOWED))}))::INT::BIGINT AS exit_code FROM v""",
    "stub_embed": """
WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents),
x AS (SELECT doc_id, (i - 1) % 512 AS lane, ('0x' || b[i])::INT AS v FROM h, LATERAL (SELECT unnest(range(1, len(b) + 1)) AS i)),
s AS (SELECT doc_id, lane, sum(v)::DOUBLE AS v FROM x GROUP BY ALL)
SELECT doc_id, lane, round((v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS weight FROM s WHERE v <> 0""",
    "smoke_preview": (
        f"WITH {SEARCH}, t AS (SELECT *, {trim_sql('text')} AS p FROM result WHERE pos <= 5) "
        f"SELECT qid, pos AS rank, round(coalesce(score, 0), 6) AS score, chunk_idx, CASE WHEN octet_length(encode(p)) <= 120 THEN p "
        f"ELSE {utf8_cut_sql('p', 120)} || '...' END AS preview FROM t"
    ),
    "chunk_prose": f"WITH {PROSE_MD},{CHUNKS} SELECT {_CHUNK_COLUMNS} FROM counted",
    "chunk_code": f"WITH {CODE_MD},{CHUNKS} SELECT {_CHUNK_COLUMNS} FROM counted",
    "chunk_markdown": f"WITH {MIXED},{CHUNKS} SELECT {_CHUNK_COLUMNS}, row_number() OVER (ORDER BY doc_key, block_no, part_no) - 1 AS chunk_idx FROM counted",
    "chunk_segments": f"WITH {SEGMENTS} SELECT doc_key, block_no, heading_path, kind, body FROM segments",
}
