"""Text expressions: sanitizer, normalizers, token estimate, markup removal.

Everything here is a Column-to-Column function built from Spark SQL functions,
so it stays in the JVM and can be pushed into any projection.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift import params

# The whitespace class and the zero-width characters.
SPACE = r"\p{IsWhite_Space}"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u2060"

# Sanitizer patterns, in the order they apply.
COMMENT = r"(?s)<!--.*?-->"
HIDDEN_ELEMENT = r"(?sU)<[^>]*display:\s*none[^>]*>.*?</[^>]+>"
OVERRIDE_PHRASE = (
    r"(?iU)ignore (?:previous|prior) instructions|note for the assistant"
    r"|you (?:may|can) (?:run|execute)|as an ai\b|system prompt"
)
DANGER_TOKEN = r"(?U)(^|\s)(?:-y|--yes|--force|sudo|rm\s+-rf)\b(?!-)"

# Markup removal patterns, in the order they apply.
MARKUP_PATTERNS = (
    r"(?s)<!--.*?-->",
    r"!\[[^\]]*\]\([^)]*\)",
    r"(?i)<img[^>]*/?>",
    r"(?s)<[A-Z][A-Za-z0-9]*[^>]*>.*?</[A-Z][A-Za-z0-9]*>",
    r"<[A-Z][A-Za-z0-9]*[^>]*/>",
    r"</?[A-Z][A-Za-z0-9]*[^>]*>",
    r"<[a-z][^>]*/?>",
    r"</[a-z][^>]*>",
    r"\{`[^`]*`\}",
    r"\{[^{}]*\}",
)

# Characters the markup patterns look at, and private-use stand-ins for them.
_MARKUP_CHARS = "<>{}`![]()-/\n"
_SHIELD_CHARS = "".join(chr(0xE000 + i) for i in range(len(_MARKUP_CHARS)))


def strip_edges(col: Column) -> Column:
    """Trim Unicode whitespace at both ends; looks at the edges only, not at every run inside."""
    return F.regexp_extract(col, rf"(?s)^{SPACE}*+(.*[^{SPACE}])", 1)


def has_word(col: Column) -> Column:
    """Whether anything but Unicode whitespace is there."""
    return col.rlike(rf"[^{SPACE}]")


def collapse_whitespace(col: Column) -> Column:
    """Turn every whitespace run into one space and trim."""
    return F.trim(F.regexp_replace(col, rf"{SPACE}+", " "))


def drop_zero_width(col: Column) -> Column:
    return F.translate(col, ZERO_WIDTH, "")


def sanitize_chunk(col: Column) -> Column:
    """Remove hidden markup, injected instructions and dangerous flags."""
    visible = F.regexp_replace(F.regexp_replace(col, COMMENT, ""), HIDDEN_ELEMENT, "")
    phrases = F.regexp_replace(drop_zero_width(visible), OVERRIDE_PHRASE, "")
    return collapse_whitespace(F.regexp_replace(phrases, DANGER_TOKEN, "$1"))


def sanitize_metadata(col: Column, max_chars: int = params.METADATA_MAX_CHARS) -> Column:
    """Clean a heading, URL or version: zero-width strip, length cap, collapse."""
    return collapse_whitespace(F.substring(drop_zero_width(col), 1, max_chars))


def normalize_heading_path(col: Column) -> Column:
    """Join the non-empty ``>`` segments, without Markdown ``#`` marks."""
    parts = F.transform(
        F.split(col, ">"),
        lambda p: strip_edges(F.regexp_replace(strip_edges(p), r"^#+", "")),
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), " > ")


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words; each becomes one character, so no list of them is made.

    A word put in front takes whatever space the text begins with.
    """
    marks = F.regexp_replace(F.concat(F.lit("x "), col), rf"[^{SPACE}]+{SPACE}*", "x")
    return F.char_length(marks) - 1


def tokens_for_words(words: Column) -> Column:
    """Estimated tokens of a text with ``words`` words: four thirds, rounded down."""
    return F.floor(words.cast("long") * 4 / 3).cast("int")


def estimate_tokens(col: Column) -> Column:
    return tokens_for_words(word_count(col))


def strip_markup(col: Column) -> Column:
    """Remove comments, images, tags and brace expressions."""
    for pattern in MARKUP_PATTERNS:
        col = F.regexp_replace(col, pattern, "")
    return col


def _shield(col: Column) -> Column:
    return F.translate(col, _MARKUP_CHARS, _SHIELD_CHARS)


def _unshield(col: Column) -> Column:
    return F.translate(col, _SHIELD_CHARS, _MARKUP_CHARS)


def strip_markup_keeping_code(col: Column) -> Column:
    """Strip markup from prose but keep scripts, fenced code and inline code.

    The text is cut into protected and open pieces by one regular expression;
    protected pieces have the characters the markup patterns react to swapped
    for private-use stand-ins, so a single pass over the rejoined prose runs
    keeps them verbatim wherever they survive.
    """
    script = r"<script\b[^>]*>.*?</script>"
    shielded = F.array_join(
        F.transform(
            F.regexp_extract_all(
                col, F.lit(rf"(?si){script}|(?:[^<]|<(?!script\b[^>]*>.*?</script>))++"), F.lit(0)
            ),
            lambda p: F.when(p.rlike(rf"(?si)^{script}$"), _shield(p)).otherwise(p),
        ),
        "",
    )

    indent = r"[^\S\n]*"

    def fence(mark: str) -> str:
        closer = rf"{indent}{mark}{indent}(?:\n|\z)"
        line = r"(?:[^\n]*\n|[^\n]+\z)"
        return rf"{indent}{mark}{line[:-1]}|\z)(?:(?!{closer}){line})*+(?:{closer})?"

    fenced = rf"(?:{fence('```')}|{fence('~~~')})"
    prose = rf"(?:(?!{indent}(?:```|~~~))(?:[^\n]*\n|[^\n]+\z))++"
    pieces = F.regexp_extract_all(shielded, F.lit(rf"{fenced}|{prose}"), F.lit(0))

    def clean(piece: Column) -> Column:
        spans = F.transform(
            F.regexp_extract_all(piece, F.lit(r"`[^`\n]+`|[^`]++|`"), F.lit(0)),
            lambda s: F.when(s.rlike(r"^`[^`\n]+`$"), _shield(s)).otherwise(s),
        )
        return F.when(piece.rlike(rf"^{indent}(?:```|~~~)"), piece).otherwise(
            strip_markup(F.array_join(spans, ""))
        )

    return _unshield(F.array_join(F.transform(pieces, clean), ""))


def has_enough_lines(col: Column, minimum: int = 3) -> Column:
    """True when at least ``minimum`` lines hold something but whitespace."""
    lines = F.filter(F.split(col, r"\r\n|\n|\r"), lambda x: strip_edges(x) != "")
    return F.size(lines) >= minimum


def collapse_blank_lines(col: Column) -> Column:
    return F.regexp_replace(col, r"\n{3,}", "\n\n")


def replace_heading_line(heading: Column, text: Column) -> Column:
    """Make the leading ``## `` line of a chunk say its own heading path."""
    line_end = F.instr(text, "\n")
    replaced = F.when(
        line_end > 0,
        F.concat(F.lit("## "), heading, F.substr(text, line_end)),
    ).otherwise(F.concat(F.lit("## "), heading, F.lit("\n")))
    return F.when((heading == "") | ~text.startswith("## "), text).otherwise(replaced)


def truncate_utf8(col: Column, max_bytes: int) -> Column:
    """Longest prefix of at most ``max_bytes`` UTF-8 bytes on a character edge."""
    raw = col.cast("binary")
    head = F.substring(raw, 1, max_bytes)
    # A cut inside a character shows as a continuation byte right after the cut.
    partial = r"(?:[C-F][0-9A-F])?(?:[89AB][0-9A-F])*$"
    cut = F.hex(F.substring(raw, max_bytes + 1, 1)).rlike("^[89AB]")
    trimmed = F.unhex(
        F.when(
            cut,
            F.concat(
                F.hex(F.substring(raw, 1, max_bytes - 3)),
                F.regexp_replace(F.hex(F.substring(raw, max_bytes - 2, 3)), partial, ""),
            ),
        ).otherwise(F.hex(head))
    )
    return F.when(F.octet_length(col) <= max_bytes, col).otherwise(F.decode(trimmed, "UTF-8"))


def preview(col: Column, max_bytes: int = params.PREVIEW_MAX_BYTES) -> Column:
    """Trimmed text, cut to ``max_bytes`` bytes with an ellipsis when longer."""
    text = strip_edges(col)
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(
        F.concat(truncate_utf8(text, max_bytes), F.lit("..."))
    )


def terms(col: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(
        F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda t: t != ""
    )


def singular(term: Column) -> Column:
    """Fold English plural endings: ``-ies`` to ``-y``, then ``-es`` and ``-s`` off their stems."""
    return (
        F.when(term.rlike("(?<![ae])ies$"), F.regexp_replace(term, "ies$", "y"))
        .when(term.rlike("(?<![aeo])es$"), F.regexp_replace(term, "s$", ""))
        .when(term.rlike("[^us]s$"), F.regexp_replace(term, "s$", ""))
        .otherwise(term)
    )


def english_terms(col: Column) -> Column:
    """``terms`` without English stop words, plurals folded."""
    stop = StopWordsRemover.loadDefaultStopWords("english")
    return F.transform(F.filter(terms(col), lambda t: ~t.isin(*stop)), singular)
