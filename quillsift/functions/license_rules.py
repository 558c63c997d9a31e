"""License declarations in text, line by line, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.text import strip_edges

# The license identifiers looked for.
SPDX_IDS = (
    "CC-BY-NC-SA-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0",
    "CC-BY-NC-SA-3.0", "CC-BY-SA-3.0", "CC-BY-ND-3.0", "CC-BY-NC-3.0",
    "CC-BY-4.0", "CC-BY-3.0", "CC0-1.0",
    "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "BSL-1.0",
    "Unlicense", "ISC", "Zlib", "0BSD",
    "AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "GPL-3.0", "GPL-2.0",
    "MIT",
)
# Licenses that always need a person, and those accepted.
DANGEROUS = (
    "CC-BY-ND-4.0", "CC-BY-ND-3.0", "CC-BY-NC-4.0", "CC-BY-NC-3.0",
    "CC-BY-NC-SA-4.0", "CC-BY-NC-SA-3.0", "CC-BY-SA-4.0", "CC-BY-SA-3.0",
    "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0",
)
ALLOWED = (
    "MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Zlib",
    "0BSD", "Unlicense", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-3.0",
)
UNUSABLE_VERDICTS = ("UNKNOWN", "ERROR", "PARSE_ERROR", "SKIPPED")
# The declaration patterns, in the order they apply.
MARKER = r"SPDX-License-Identifier:\s*([A-Za-z0-9.+\-]+)"
CC_PROSE = (
    (r"Creative\s+Commons\s+Attribution[- ]+NonCommercial[- ]+ShareAlike\s+(\d(?:\.\d)?)", "CC-BY-NC-SA-"),
    (r"\bAttribution[- ]+NonCommercial[- ]+ShareAlike\s+(\d(?:\.\d)?)", "CC-BY-NC-SA-"),
    (r"Creative\s+Commons\s+Attribution[- ]+ShareAlike\s+(\d(?:\.\d)?)", "CC-BY-SA-"),
    (r"Creative\s+Commons\s+Attribution[- ]+NoDeriv\w*\s+(\d(?:\.\d)?)", "CC-BY-ND-"),
    (r"Creative\s+Commons\s+Attribution[- ]+NonCommercial\s+(\d(?:\.\d)?)", "CC-BY-NC-"),
    (r"Creative\s+Commons\s+Attribution(?:[- ]+4\.0)?\s+(?:International\s+)?(\d(?:\.\d)?)", "CC-BY-"),
    (r"\bAttribution[- ]+ShareAlike\s+(\d(?:\.\d)?)", "CC-BY-SA-"),
    (r"\bAttribution[- ]+NoDeriv\w*\s+(\d(?:\.\d)?)", "CC-BY-ND-"),
    (r"\bAttribution[- ]+NonCommercial\s+(\d(?:\.\d)?)", "CC-BY-NC-"),
)
LICENSED_UNDER = r"(?:licensed?|released|distributed|made available)\s+under\s+(.{3,80}?)(?:\.|\n|$)"
# What counts as a license file, and its extensions.
LICENSE_STEMS = ("license", "licence", "copying", "notice", "unlicense")
LICENSE_EXTENSIONS = r"\.(?:md|markdown|txt|rst)$"


def id_pattern() -> str:
    """Any known identifier that is not part of a longer word, longest first."""
    ids = sorted(SPDX_IDS, key=len, reverse=True)
    names = "|".join(i.replace(".", r"\.") for i in ids)
    return rf"(?<![A-Za-z0-9-])({names})(?![A-Za-z0-9-])"


# A cheap test most lines fail, so the rules run on few of them.
HINT = r"(?i)spdx|attribution|under|" + "|".join(
    i.replace(".", r"\.") for i in ("cc-by", "cc0", "apache", "bsd", "mpl-", "bsl-", "unlicense", "isc", "zlib", "gpl", "mit")
)


def _found(kind: str, spdx: Column, raw: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), spdx.alias("spdx"), raw.alias("raw"))


def line_findings(line: Column) -> Column:
    """Declarations on one line, in rule order: array of (kind, spdx, raw)."""
    ids = id_pattern()

    def all_of(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(line, F.lit(pattern), F.lit(group))

    markers = F.zip_with(
        all_of("(?U)" + MARKER, 1), all_of("(?U)" + MARKER, 0), lambda s, raw: _found("spdx_marker", s, raw)
    )
    bare = F.transform(all_of(ids, 1), lambda s: _found("spdx", s, s))
    prose = F.filter(
        F.array(
            *[
                F.when(
                    line.rlike("(?iU)" + rx),
                    _found(
                        "prose",
                        F.concat(F.lit(prefix), F.regexp_extract(line, "(?iU)" + rx, 1)),
                        F.regexp_extract(line, "(?iU)" + rx, 0),
                    ),
                )
                for rx, prefix in CC_PROSE
            ]
        ),
        lambda x: x.isNotNull(),
    )
    phrases = F.transform(
        all_of("(?iU)" + LICENSED_UNDER, 1),
        lambda p: F.regexp_replace(strip_edges(p), "[,;:]+$", ""),
    )
    under = F.transform(
        F.filter(phrases, lambda p: ~p.rlike(ids)),
        lambda p: _found("licensed_under", F.lit(""), p),
    )
    return F.concat(markers, bare, prose, under)


def is_license_file(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, "[^/]*$", 0))
    stem = F.regexp_replace(name, LICENSE_EXTENSIONS, "")
    return stem.isin(*LICENSE_STEMS)


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def snippet(line: Column) -> Column:
    return F.substring(strip_edges(line), 1, 120)


def verdict_id(raw: Column) -> Column:
    """License id a model named: the ``docs_license`` of its first JSON blob, upper-cased."""
    blob = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    parsed = F.try_parse_json(F.nullif(blob, F.lit("")))
    named = F.upper(
        strip_edges(F.coalesce(F.try_variant_get(parsed, "$.docs_license", "string"), F.lit("")))
    )
    return F.when(parsed.isNull(), "PARSE_ERROR").otherwise(
        F.when(named == "", "UNKNOWN").otherwise(named)
    )


def needs_person(found_dangerous: Column, first: Column, second: Column) -> Column:
    """1 unless both verdicts agree on an accepted, harmless license."""
    risky = found_dangerous | first.isin(*DANGEROUS) | second.isin(*DANGEROUS)
    unusable = ~first.isin(*ALLOWED) | first.isin(*UNUSABLE_VERDICTS)
    return (risky | (first != second) | unusable).cast("int")

