"""Operator 5: main text of web pages by the maximum-scoring contiguous region.

A page becomes a sequence of tags and runs of words. Words in reading context score positive,
tags negative; one linear scan finds the contiguous stretch of the largest sum. The weights are
log-odds learned over all pages that mark their own main text by ``article`` or ``main``: those
pages are the labels. Elements that never hold main text (menus, headers, footers, sidebars,
forms, scripts and the like, by name, and containers by role or class) are taken out before
the scan, so what lies within the stretch is text only.

The learned table has at most ``len(FEATURES)`` rows, whatever the input. Pages of any length
take one pass. A null or empty page, and one without text, gives the empty string. Null and
repeated ids keep their own row; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.arrow_text import slices

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = RAW | frozenset(
    "head nav header footer aside form menu dialog template svg math canvas object audio video map "
    "select button input search datalist".split()
)
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("article aside center div dl fieldset figure li ol section table ul".split())
# Words in class, id or role that mark what is not main text.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert sidebar aside nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer comment comments disqus respond replies reply "
    "form newsletter subscribe signup login share sharing social related recommended pagination pager "
    "popup modal overlay widget toolbar skip copyright complementary contentinfo search dialog hidden".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies ad ads advert sponsored promo related".split())
#: Contexts of words, then tags; anything else counts as "other".
CONTEXTS = ("marked", "unmarked", "plain", "link", "item")
FEATURES = (*CONTEXTS, *sorted(BLOCKS - DROPPED), "a", "b", "br", "em", "i", "img", "span", "strong", "other")
#: Counts every feature starts with, inside and outside the main text.
PRIOR = {"marked": (50, 1), "unmarked": (1, 50), "plain": (20, 5), "link": (1, 20), "item": (5, 10)}
TAG_PRIOR = (2, 4)
LEAST_TAG = 0.05

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_MARKS = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _is_dropped(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is taken out; ``inside`` says that ``article`` or ``main`` is open around it.

    By words go containers alone: inside by a whole token of class or role, elsewhere by a part
    of one, or of the id of a container other than ``section``.
    """
    if name in DROPPED:
        return True
    if not attributes or name not in CONTAINERS:
        return False
    words = COMMENT_WORDS if name == "article" else DROPPED_WORDS
    whole = inside or name == "article"
    for m in _MARKS.finditer(attributes):
        if m[1].lower() == "id" and (whole or name == "section"):
            continue
        value = m[2] or m[3] or m[4] or ""
        if any(part.lower() in words for part in (value.split() if whole else _PARTS.findall(value))):
            return True
    return False


def tokens(page: str) -> list[tuple[str, str]]:
    """("text", words), ("open", name) and ("close", name) outside dropped elements."""
    out: list[tuple[str, str]] = []
    lower = page.lower()
    at = mains = 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            out.append(("text", page[at:]))
            break
        if m.start() > at:
            out.append(("text", page[at : m.start()]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            out.append(("close", name))
            mains = max(0, mains - (name in MAIN))
        elif name in VOID:
            out.append(("open", name))
        elif _is_dropped(name, attributes, mains > 0):
            at = _after(page, lower, name, at)
            out.append(("open", "div"))
        else:
            out.append(("open", name))
            mains += name in MAIN
    return out


def _after(page: str, lower: str, name: str, at: int) -> int:
    """Where a dropped element that opened before ``at`` ends."""
    if name in RAW:
        end = lower.find(f"</{name}", at)
        close = page.find(">", end) if end >= 0 else -1
        return close + 1 if close >= 0 else len(page)
    depth, closed = 1, False
    where = at
    for m in _MARKUP.finditer(page, at):
        other = (m[2] or m[5] or "").lower()
        if other in RAW and not (m[1] or m[4]) and other != name:
            continue
        if other == name:
            depth += -1 if m[1] or m[4] else 1
            where = m.end()
            if depth == 0:
                closed = True
                break
        elif name in ("p", "li", "head") and not (m[1] or m[4]) and other in BLOCKS and depth == 1:
            if name == "p" or other == "body":
                return m.start()
    if closed:
        return where
    # Never closed: it ends where the next block begins.
    for m in _MARKUP.finditer(page, at):
        if (m[2] or m[5] or "").lower() in BLOCKS:
            return m.start()
    return len(page)


def parts(page: str) -> tuple[list[tuple[str, str, int]], bool]:
    """(kind or context, content, words) in page order; whether the page marks its main text.

    Marks count only if they hold most of the words of the region found without them.
    """
    depth: dict[str, int] = defaultdict(int)
    out, inside = [], []
    for kind, content in tokens(page):
        inside.append(depth["article"] > 0 or depth["main"] > 0)
        if kind == "text":
            text = html.unescape(content)
            context = "link" if depth["a"] > 0 else "item" if depth["li"] > 0 else "plain"
            out.append((context, text, len(text.split())))
        else:
            out.append((kind, content, 0))
            if content not in VOID:
                depth[content] = max(0, depth[content] + (1 if kind == "open" else -1))
    if not _trusted(out, inside):
        return out, False
    return [
        (kind if kind in ("open", "close") else "marked" if within else "unmarked", content, count)
        for (kind, content, count), within in zip(out, inside, strict=True)
    ], True


def _trusted(rows: list[tuple[str, str, int]], inside: list[bool]) -> bool:
    """Whether marks hold most of the words that score positive in the best region by prior weights."""
    if not any(kind == "open" and content in MAIN for kind, content, _ in rows):
        return False
    begin, end = best_region(scores_of(rows, _PRIOR_WEIGHTS))
    held = [0, 0]
    for (kind, _, count), within in zip(rows[begin:end], inside[begin:end], strict=True):
        if count and _PRIOR_WEIGHTS[kind] > 0:
            held[within] += count
    return held[1] >= held[0]


def scores_of(rows: list[tuple[str, str, int]], weights: dict[str, float]) -> list[float]:
    return [
        weights[feature_of(content)] if kind in ("open", "close") and content not in MAIN
        else 0.0 if kind in ("open", "close")
        else weights[kind] * count
        for kind, content, count in rows
    ]


def feature_of(name: str) -> str:
    return name if name in _TAGS else "other"


_TAGS = frozenset(FEATURES[len(CONTEXTS) :])


def label_counts(page: str) -> dict[str, list[int]]:
    """Words and tags inside and outside the marked main text of a labelled page."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    rows, marked = parts(page)
    if not marked:
        return counts
    depth, links, items = 0, 0, 0
    for kind, content, count in rows:
        if kind in ("open", "close"):
            step = 1 if kind == "open" else -1
            depth += step * (content in MAIN)
            links += step * (content == "a")
            items += step * (content == "li")
            if content not in MAIN:
                counts[feature_of(content)][0 if depth > 0 else 1] += 1
        elif count:
            side = 0 if kind == "marked" else 1
            counts[kind][side] += count
            counts["link" if links > 0 else "item" if items > 0 else "plain"][side] += count
    return counts


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weight of every feature, from all labelled pages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for part in slices(batches, "html"):
            for page in part.column("html").to_pylist():
                for name, (inside, outside) in label_counts(page).items():
                    total[name][0] += inside
                    total[name][1] += outside
        if total:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(total.keys(), pa.string()),
                    pa.array([v[0] for v in total.values()], pa.int64()),
                    pa.array([v[1] for v in total.values()], pa.int64()),
                ],
                ["feature", "inside", "outside"],
            )

    rows = (
        pages.select(F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
        .mapInArrow(run, "feature string, inside long, outside long")
        .groupBy("feature")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .collect()  # at most len(FEATURES) rows
    )
    return weights_of({r["feature"]: (r["inside"], r["outside"]) for r in rows})


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    weights = {}
    for name in FEATURES:
        inside, outside = counts.get(name, (0, 0))
        more = PRIOR.get(name, TAG_PRIOR)
        odds = math.log((inside + more[0]) / (outside + more[1]))
        if name in ("marked", "plain"):
            odds = max(odds, 1.0)
        elif name == "unmarked":
            odds = min(odds, -1.0)
        weights[name] = odds if name in CONTEXTS else min(odds, -LEAST_TAG)
    return weights


_PRIOR_WEIGHTS = weights_of({})


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end place of the contiguous run of the largest positive sum."""
    best, region, total, begin = 0.0, (0, 0), 0.0, 0
    for place, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, place
        total += score
        if total > best:
            best, region = total, (begin, place + 1)
    return region


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best region, one line each."""
    rows, marked = parts(page)
    begin, end = best_region(scores_of(rows, weights))
    blocks: list[str] = []
    open_block: list[str] = []
    for kind, content, _ in rows[begin:end]:
        if kind in ("open", "close"):
            if content in BLOCKS:
                blocks.append("".join(open_block))
                open_block = []
            elif content == "br":
                open_block.append(" ")
        elif not marked or kind == "marked":
            open_block.append(content)
    blocks.append("".join(open_block))
    return "\n".join(b for b in (" ".join(block.split()) for block in blocks) if b)


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; row-local after the weights are learned."""
    learned = learn_weights(pages, html_col) if weights is None else weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(p, learned) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"),
                    part.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
