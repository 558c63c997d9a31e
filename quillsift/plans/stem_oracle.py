"""SQL that stems English words, rule by rule, for the check of the analyzer."""

from __future__ import annotations

#: Fixed values, as published with the algorithm; typed apart from the code that is checked.
STOP = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then "
    "there these they this to was will with"
)
IRREGULAR = (
    "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli "
    "singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"
)
FINAL = "inning outing canning herring earring proceed exceed succeed"

#: Suffixes, longest first, each with its replacement.
SECOND = (
    "ational:ate fulness:ful iveness:ive ization:ize ousness:ous biliti:ble lessli:less tional:tion alism:al "
    "aliti:al ation:ate entli:ent fulli:ful iviti:ive ousli:ous abli:able alli:al anci:ance ator:ate enci:ence "
    "izer:ize bli:ble ogi:og li:"
)
THIRD = "ational:ate tional:tion alize:al ative: icate:ic iciti:ic ical:ic ness: ful:"
FOURTH = "ement: ance: ence: able: ible: ment: ant: ent: ism: ate: iti: ous: ive: ize: ion: al: er: ic:"

_SHORT = "'(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$'"


def _listed(words: str) -> str:
    return ", ".join(f"'{w}'" for w in words.split())


def _suffixes(rules: str, region: str, extra: dict[str, str]) -> str:
    """CASE over the longest suffix found; a rule that does not hold ends the step."""
    cases = []
    for rule in rules.split():
        suffix, new = rule.split(":")
        holds = f"length(w) - {len(suffix)} >= {extra.get(suffix + '@', region)}"
        if suffix in extra:
            holds += f" AND regexp_matches(w, '{extra[suffix]}{suffix}$')"
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {holds} THEN left(w, length(w) - {len(suffix)}) || '{new}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stem_ctes(source: str, name: str = "stems") -> str:
    """CTEs that end in ``name`` (term, stem) for the distinct values of ``source`` (term)."""
    irregular = " ".join(f"WHEN '{r.split(':')[0]}' THEN '{r.split(':')[1]}'" for r in IRREGULAR.split())
    past = r"'(eedly|eed|edly|ingly|ed|ing)$'"
    region = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'"
    return f"""
st0 AS (SELECT DISTINCT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {source}),
st1 AS (SELECT *, CASE
    WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)'))
    WHEN regexp_matches(w, {region}) THEN length(regexp_extract(w, {region})) ELSE length(w) END AS r1 FROM st0),
st2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), {region})
    THEN r1 + length(regexp_extract(substr(w, r1 + 1), {region})) ELSE length(w) END AS r2 FROM st1),
st3 AS (SELECT term, r1, r2, CASE
    WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
    WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
    WHEN regexp_matches(w, '[us]s$') THEN w
    WHEN regexp_matches(w, '[aeiouy].*.s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM st2),
st4 AS (SELECT *, regexp_extract(w, {past}) AS cut, left(w, length(w) - length(regexp_extract(w, {past}))) AS base FROM st3),
st5 AS (SELECT term, r1, r2, w AS plain, CASE
    WHEN cut = '' THEN w
    WHEN cut LIKE 'eed%' THEN CASE WHEN length(base) >= r1 THEN base || 'ee' ELSE w END
    WHEN NOT regexp_matches(base, '[aeiouy]') THEN w
    WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e'
    WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(base, length(base) - 1)
    WHEN length(base) <= r1 AND regexp_matches(base, {_SHORT}) THEN base || 'e' ELSE base END AS w FROM st4),
st6 AS (SELECT term, r1, r2, plain, regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w FROM st5),
st7 AS (SELECT term, r1, r2, plain, {_suffixes(SECOND, "r1", {"ogi": "l", "li": "[cdeghkmnrt]"})} AS w FROM st6),
st8 AS (SELECT term, r1, r2, plain, {_suffixes(THIRD, "r1", {"ative@": "r2"})} AS w FROM st7),
st9 AS (SELECT term, r1, r2, plain, {_suffixes(FOURTH, "r2", {"ion": "[st]"})} AS w FROM st8),
st10 AS (SELECT term, plain, CASE
    WHEN ends_with(w, 'e') AND (length(w) > r2 OR length(w) > r1 AND NOT regexp_matches(left(w, length(w) - 1), {_SHORT}))
      THEN left(w, length(w) - 1)
    WHEN ends_with(w, 'll') AND length(w) > r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM st9),
{name} AS MATERIALIZED (SELECT term, CASE term {irregular} ELSE CASE
    WHEN length(term) < 3 THEN term WHEN plain IN ({_listed(FINAL)}) THEN plain ELSE replace(w, 'Y', 'y') END END AS stem FROM st10)
"""


def kept(terms: str) -> str:
    """A list of terms without stop words."""
    return f"list_filter({terms}, lambda x: x NOT IN ({_listed(STOP)}))"
