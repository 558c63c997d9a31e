"""Input limits, URL rules, versions, durations and dates as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift import params


def docset_name_ok(name: Column) -> Column:
    return name.rlike(params.DOCSET_NAME_PATTERN) & ~name.contains("..")


def query_ok(query: Column) -> Column:
    return F.char_length(query).between(1, params.QUERY_MAX_CHARS)


def resolve_max_tokens(requested: Column) -> Column:
    asked = F.nullif(requested, F.lit(0))
    return F.least(F.coalesce(asked, F.lit(params.TOKENS_DEFAULT)), F.lit(params.TOKENS_CAP))


def resolve_top_k(requested: Column) -> Column:
    asked = F.coalesce(requested, F.lit(params.TOP_K_DEFAULT))
    return F.least(F.greatest(asked, F.lit(params.TOP_K_MIN)), F.lit(params.TOP_K_MAX))


def join_source_url(base: Column, relative: Column) -> Column:
    """``relative`` under ``base``, or alone when there is no base."""
    return F.when(base.isNull(), relative).otherwise(
        F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), relative)
    )


def canonical_source_url(base: Column, source: Column) -> Column:
    """Absolute URL of a chunk source; null when the source is not acceptable."""
    relative = F.regexp_replace(source, "^/+", "")
    bad = (relative == "") | F.array_contains(F.split(relative, "/"), "..")
    return (
        F.when(source.startswith("https://"), source)
        .when(bad, F.lit(None).cast("string"))
        .otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), relative))
    )


def url_host(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.split(url, "://")[1]).otherwise(url)
    return F.split(rest, "/")[0]


def url_path(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.split(url, "://")[1]).otherwise(url)
    return F.substr(rest, F.char_length(url_host(url)) + 1)


def index_url_ok(url: Column, code_host: str, owner: str, mirror_host: str) -> Column:
    """Catalog index location: the owner's tree on the code host, or the mirror."""
    host, path = url_host(url), url_path(url)
    return ((host == code_host) & (path.startswith(f"/{owner}/") | (path == f"/{owner}"))) | (
        (host == mirror_host) & (path.startswith("/releases/") | (path == "/releases"))
    )


def package_url_ok(url: Column, code_host: str, owner: str, mirror_host: str) -> Column:
    """Package download location: exactly a release asset, nothing deeper."""
    host, path = url_host(url), url_path(url)
    prefix = rf"^/+\Q{owner}\E/[^/]+/releases/"
    asset = path.rlike(prefix + r"download/[^/]+/[^/]+$") | path.rlike(
        prefix + r"latest/download/[^/]+$"
    )
    return ((host == code_host) & asset) | (
        (host == mirror_host) & (path.startswith("/releases/") | (path == "/releases"))
    )


def sha256_ok(digest: Column) -> Column:
    return digest.rlike("^[0-9A-Fa-f]{64}$")


def _number(part: str) -> str:
    return rf"(0|[1-9][0-9]*){part}"


# Fixed value: the shape of a semantic version.
_PRE_ID = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
SEMVER = (
    r"^v?" + _number(r"\.") + _number(r"\.") + _number("")
    + rf"(?:-({_PRE_ID}(?:\.{_PRE_ID})*))?(?:\+[0-9A-Za-z.-]+)?$"
)


def version_key(version: Column) -> Column:
    """Struct that compares like semantic-version precedence; null if unparsable.

    Numeric pre-release identifiers sort below textual ones, by their length, then digits;
    a release sorts above every pre-release of the same triple.
    """
    pre = F.regexp_extract(version, SEMVER, 4)
    ids = F.transform(
        F.split(pre, r"\."),
        lambda i: F.when(
            i.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(F.length(i).cast("string"), 10, "0"), i)
        ).otherwise(F.concat(F.lit("1"), i)),
    )
    numbers = [F.regexp_extract(version, SEMVER, g).try_cast("decimal(20,0)") for g in (1, 2, 3)]
    key = F.struct(
        *[n.alias(f"n{g}") for g, n in enumerate(numbers, 1)],
        (pre == "").cast("int").alias("release"),
        ids.alias("pre"),
    )
    readable = version.rlike(SEMVER)
    for n in numbers:
        readable = readable & n.isNotNull()
    return F.when(readable, key)


def is_newer(candidate: Column, current: Column) -> Column:
    """Strictly newer by semantic version; false when either cannot be read."""
    return F.coalesce(version_key(candidate) > version_key(current), F.lit(False))


def stable_release(tag: Column, draft: Column, prerelease: Column) -> Column:
    """Version of a published stable release, else null."""
    ok = ~draft & ~prerelease & tag.rlike(SEMVER) & (F.regexp_extract(tag, SEMVER, 4) == "")
    return F.when(ok, F.regexp_replace(tag, "^v", ""))


def duration_seconds(text: Column) -> Column:
    """``30m``, ``2h``, ``1d``, ``3600s`` or a bare number as seconds, else null."""
    shape = r"^([0-9]+)([smhd]?)$"
    value = F.trim(text)
    unit = F.regexp_extract(value, shape, 2)
    scale = (
        F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86_400).otherwise(1)
    )
    return F.when(
        value.rlike(shape), F.try_multiply(F.regexp_extract(value, shape, 1).try_cast("long"), scale.cast("long"))
    )


def civil_date(days: Column) -> Column:
    """ISO date of a day number since 1970-01-01."""
    return F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")


def needs_fetch(last_attempt: Column, cached: Column, running: Column, now: Column) -> Column:
    """Throttle rule: fetch when the version moved or the last attempt is a day old."""
    moved = (cached != "") & (cached != running)
    age = F.greatest(now - last_attempt, F.lit(0))
    return moved | (age >= params.FRESHNESS_SECONDS)
