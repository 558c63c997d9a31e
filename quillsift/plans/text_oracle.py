"""SQL building blocks for the text expressions, for the check tool."""

from __future__ import annotations

# The Unicode whitespace class in RE2 terms.
WS = r"[\s\x0b\x{85}\p{Z}]"
WORD = r"[^\s\x0b\x{85}\p{Z}]+"
ZERO_WIDTH = "chr(8203)||chr(8204)||chr(8205)||chr(65279)||chr(8288)"


def rx(text: str, pattern: str, by: str = "", flags: str = "g") -> str:
    pattern = pattern.replace("'", "''")
    by = by.replace("'", "''")
    return f"regexp_replace({text}, '{pattern}', '{by}', '{flags}')"


def collapse_sql(text: str) -> str:
    return f"trim({rx(text, WS + '+', ' ')}, ' ')"


def trim_sql(text: str) -> str:
    return rx(text, rf"^{WS}+|{WS}+$")


def drop_zero_width_sql(text: str) -> str:
    return f"translate({text}, {ZERO_WIDTH}, '')"


def sanitize_chunk_sql(text: str) -> str:
    mark = chr(0xF8FF)
    danger = rf"(?:-y|--yes|--force|sudo|rm{WS}+-rf)"
    s = rx(text, r"<!--.*?-->", flags="gs")
    s = rx(s, rf"<[^>]*display:{WS}*none[^>]*>.*?</[^>]+>", flags="gs")
    s = drop_zero_width_sql(s)
    s = rx(
        s,
        r"ignore (?:previous|prior) instructions|note for the assistant|you (?:may|can) (?:run|execute)|as an ai\b|system prompt",
        flags="gi",
    )
    # RE2 has no lookahead: guard the tokens a hyphen follows with a mark.
    s = rx(s, rf"(^|{WS})({danger}-)", rf"\1{mark}\2")
    s = rx(s, rf"(^|{WS}){danger}\b", r"\1")
    return collapse_sql(f"replace({s}, '{mark}', '')")


def sanitize_metadata_sql(text: str) -> str:
    return collapse_sql(f"substring({drop_zero_width_sql(text)}, 1, 500)")


def words_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{WORD}'))"


def tokens_sql(text: str) -> str:
    return f"({words_sql(text)} * 4 // 3)"


def utf8_cut_sql(text: str, limit: int) -> str:
    """Longest prefix within ``limit`` bytes, a cut character dropped by its bytes."""
    head = f"substring(x, 1, {2 * limit})"
    inside = f"regexp_matches(substring(x, {2 * limit + 1}, 1), '[89AB]')"
    cut = f"decode(unhex(CASE WHEN {inside} THEN regexp_replace({head}, '[C-F][0-9A-F](?:[89AB][0-9A-F])*$', '') ELSE {head} END))"
    return (
        f"list_extract(list_transform([hex(encode({text}))], lambda x: "
        f"CASE WHEN length(x) <= {2 * limit} THEN decode(unhex(x)) ELSE {cut} END), 1)"
    )


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick_sql(values, by: str) -> str:
    return f"list_extract([{', '.join(literal(v) for v in values)}], ({by} % {len(values)} + 1)::BIGINT)"


def heading_sql(text: str) -> str:
    inner = rx(trim_sql("p"), "^#+")
    return (
        f"array_to_string(list_filter(list_transform(string_split({text}, '>'), "
        f"lambda p: {trim_sql(inner)}), lambda p: p <> ''), ' > ')"
    )


def strip_markup_sql(text: str) -> str:
    flags = {0: "gs", 2: "gi", 3: "gs"}
    from quillsift.functions.text import MARKUP_PATTERNS

    for i, pattern in enumerate(MARKUP_PATTERNS):
        pattern = pattern.removeprefix("(?s)").removeprefix("(?i)")
        text = rx(text, pattern, flags=flags.get(i, "g"))
    return text


def prefix_sql(path: str) -> str:
    return f"CASE WHEN {path} = '' THEN '' ELSE '## ' || {path} || chr(10) || chr(10) END"
