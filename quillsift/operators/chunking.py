"""Markdown to chunks: segmentation, packing to a token budget, global order.

Segmentation and packing only ever look at one document, so they are row-local
and nothing is shuffled: one regular expression cuts a document into blocks and
column expressions cut blocks into units and count their words. Where groups of
units end is found in one pass over the counts in Arrow batches, without the
text, so the time is linear in the length of a document. Only the global chunk
order needs an exchange.

Token counts are the word-based estimate. Under that estimate a single word
never exceeds a budget, so prose never has to be cut inside a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.functions.text import (
    SPACE,
    has_word,
    normalize_heading_path,
    strip_edges,
    tokens_for_words,
    word_count,
)
from quillsift.params import ChunkBudget
from quillsift.session import checkpointed, spread

INDENT = r"[^\S\n]*+"
LINE = r"(?:[^\n]*\n|[^\n]+\z)"
FENCE = rf"{INDENT}(?:```|~~~)"
FENCE_LINE = rf"{FENCE}[^\n]*(?:\n|\z)"
HEADING = rf"{INDENT}#{{1,6}} (?=[^\n]*\S)"
CODE_BLOCK = rf"{FENCE_LINE}(?:(?!{FENCE}){LINE})*+(?:{FENCE_LINE})?"
PROSE_BLOCK = rf"(?:(?!{FENCE}|{HEADING}){LINE})++"
BLOCKS = rf"(?U){CODE_BLOCK}|{HEADING}{LINE}|{PROSE_BLOCK}"

# Line starts that open a new piece of code.
CODE_STARTS = r"(?:fn |def |function |class )"
SENTENCE = r"[^.!?]*+[.!?][ \t\n]*+|[^.!?]++"

_CUTS = "array<struct<start:int,stop:int>>"


def _rows(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists in one array, and where each list starts in it."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate(([0], np.cumsum(sizes)))


def _open_headings(levels: pa.Array) -> pa.Array:
    """Per block the places of the headings above it by level, -1 for a skipped level."""
    values, ends = _rows(levels)
    values = values.to_pylist()
    out = []
    for start, stop in zip(ends[:-1].tolist(), ends[1:].tolist()):
        stack: list[int] = []
        mine = []
        for i, level in enumerate(values[start:stop]):
            if level:
                stack = (stack + [-1] * 6)[: level - 1] + [i]
            mine.append(stack)
        out.append(mine)
    return pa.array(out, pa.list_(pa.list_(pa.int32())))


def with_blocks(documents: DataFrame, markdown: str = "markdown", name: str = "blocks") -> DataFrame:
    """Adds the blocks of a document in order: raw heading path, ``Code``/``Info``, body.

    Any fence line closes a fenced block; a ``#`` inside one is code. Headings
    set the path, skipped levels stay empty, and blank prose is dropped. Only the
    heading levels leave the JVM; the time is linear in the number of blocks.
    """
    lead = rf"(?U)^{INDENT}(#{{1,6}}) "

    def marked(block: Column) -> Column:
        code = block.rlike(rf"(?U)^{FENCE}")
        heading = ~code & block.rlike(rf"(?U)^{HEADING}")
        level = F.when(heading, F.char_length(F.regexp_extract(block, lead, 1))).otherwise(0)
        return F.struct(
            block.alias("body"),
            F.when(code, "Code").otherwise("Info").alias("kind"),
            level.cast("int").alias("level"),
            F.when(heading, strip_edges(F.regexp_replace(block, lead, ""))).alias("title"),
            (~heading & (code | has_word(block))).alias("keep"),
        )

    def placed(block: Column, i: Column) -> Column:
        titles = F.transform(
            F.get("_open", i), lambda at: F.when(at < 0, "").otherwise(F.get("_marks", at)["title"])
        )
        return F.struct(F.array_join(titles, " > ").alias("path"), block["kind"], block["body"], block["keep"])

    cut = F.regexp_extract_all(F.col(markdown), F.lit(BLOCKS), F.lit(0))
    levels = F.transform("_marks", lambda m: m["level"])
    return (
        documents.withColumn("_marks", F.transform(cut, marked))
        .withColumn("_open", F.arrow_udf(_open_headings, "array<array<int>>")(levels))
        .withColumn(name, F.filter(F.transform("_marks", placed), lambda b: b["keep"]))
        .drop("_marks", "_open")
    )


def heading_prefix(path: Column) -> Column:
    """``## path`` and a blank line, or nothing for an empty path."""
    clean = normalize_heading_path(path)
    return F.when(clean == "", F.lit("")).otherwise(F.concat(F.lit("## "), clean, F.lit("\n\n")))


def _unit(
    text: Column, words: Column, run: Column, limit: Column, alone: Column, blank: Column | None = None
) -> Column:
    """A piece of text that packing never cuts: it joins others of its ``run`` up to ``limit``."""
    return F.struct(
        text.alias("text"),
        words.cast("int").alias("words"),
        run.cast("int").alias("run"),
        limit.cast("int").alias("limit"),
        alone.alias("alone"),
        (F.lit(False) if blank is None else blank).alias("blank"),
    )


def _cuts(units: pa.Array, apart: pa.Array) -> pa.Array:
    """Per row the groups of units, one pass over their counts.

    A group takes units of one run while its tokens stay within the limit. ``alone`` units are
    groups of their own. Blank units never start a group. ``apart`` marks prose: the tokens of the
    group and of the next unit are rounded one by one, and two sentences may share a word; ``glued``
    tells by two bits whether a unit starts and ends inside one.
    """
    flags, ends = _rows(units)
    columns = [
        flags.field(of).to_pylist() for of in ("words", "run", "limit", "alone", "blank", "glued")
    ]
    flat: list[tuple[int, int]] = []
    sizes = [0]
    for row, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        split_rounding = apart[row].as_py()
        start, total = -1, 0
        for i in range(lo, hi):
            n, run, limit, single, empty, edge = (c[i] for c in columns)
            if start >= 0:
                if split_rounding:
                    tokens = total * 4 // 3 + n * 4 // 3
                else:
                    tokens = (total + n) * 4 // 3
                if single or run != columns[1][i - 1] or tokens > limit:
                    flat.append((start - lo, i - lo))
                    start = -1
            if single:
                flat.append((i - lo, i - lo + 1))
            elif start >= 0:
                total += n - (1 if edge & 1 and columns[5][i - 1] & 2 else 0)
            elif not empty:
                start, total = i, n
        if start >= 0:
            flat.append((start - lo, hi - lo))
        sizes.append(len(flat))
    pairs = np.array(flat, np.int32).reshape(-1, 2)
    values = pa.StructArray.from_arrays(
        [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["start", "stop"]
    )
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)


def _with_cuts(rows: DataFrame, units: str, name: str, apart: Column) -> DataFrame:
    """Adds the groups of ``units``; counts and flags alone leave the JVM, no text does."""

    def flags(u: Column) -> Column:
        starts = u["text"].rlike(rf"^[^{SPACE}]").cast("int")
        ends = u["text"].rlike(rf"[^{SPACE}]\z").cast("int")
        inside = F.when(apart & (u["run"] >= 0), starts + 2 * ends).otherwise(0)
        return F.struct(
            *[u[of].alias(of) for of in ("words", "run", "limit", "alone", "blank")],
            inside.cast("int").alias("glued"),
        )

    return rows.withColumn(name, F.arrow_udf(_cuts, _CUTS)(F.transform(units, flags), apart))


def _joined(units: str, cut: Column, separator: Column | str) -> Column:
    texts = F.transform(
        F.slice(F.col(units), cut["start"] + 1, cut["stop"] - cut["start"]), lambda u: u["text"]
    )
    if isinstance(separator, str):
        return F.array_join(texts, separator)
    return F.when(separator, F.array_join(texts, "\n\n")).otherwise(F.array_join(texts, ""))


def _word_groups(text: Column, max_tokens: Column) -> Column:
    """Words joined by spaces, as many per piece as the token limit lets in."""
    words = F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")
    per_piece = F.ceil(max_tokens * 3 / 4).cast("int")
    last = F.floor((F.size(words) - 1) / per_piece).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice(words, i * per_piece + 1, per_piece), " "),
    )


def _counted(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.struct(x.alias("text"), word_count(x).alias("words")))


def _prose_units(body: Column, target: Column, max_tokens: Column) -> Column:
    """Paragraphs, which join up to ``target``; one over ``max_tokens`` becomes a run of its sentences."""

    def sentences(paragraph: Column, run: Column) -> Column:
        cut = F.filter(F.regexp_extract_all(paragraph, F.lit(SENTENCE), F.lit(0)), has_word)
        return F.transform(
            _counted(cut),
            lambda s: _unit(
                s["text"], s["words"], run, max_tokens, tokens_for_words(s["words"]) > max_tokens
            ),
        )

    paragraphs = F.filter(F.transform(F.split(body, "\n\n"), strip_edges), lambda x: x != "")
    return F.flatten(
        F.transform(
            _counted(paragraphs),
            lambda p, i: F.when(
                tokens_for_words(p["words"]) > max_tokens, sentences(p["text"], i)
            ).otherwise(F.array(_unit(p["text"], p["words"], F.lit(-1), target, F.lit(False)))),
        )
    )


def _prose_pieces(units: str, cuts: str, max_tokens: Column) -> Column:
    """The text of each group; an over-long sentence becomes word groups."""

    def piece(cut: Column) -> Column:
        first = F.get(units, cut["start"])
        return F.when(first["alone"], _word_groups(first["text"], max_tokens)).otherwise(
            F.array(_joined(units, cut, first["run"] < 0))
        )

    return F.flatten(F.transform(cuts, piece))


def _cut_line(line: Column, budget: Column) -> Column:
    """A line over budget, cut right where its word count reaches the budget."""
    whole_words = (F.ceil(budget * 3 / 4) - 1).cast("int").cast("string")
    pattern = F.concat(
        F.lit(r"(?sU)\s*+(?:\S++\s++){"), whole_words, F.lit(r"}\S|.+")
    )
    return F.regexp_extract_all(line, pattern, F.lit(0))


def _code_units(inner: Column, budget: Column) -> Column:
    """Definitions, each a run of its own; one over the budget is a run of its lines."""

    def lines(segment: Column, run: Column) -> Column:
        return F.transform(
            _counted(F.split(segment, "\n")),
            lambda x: _unit(
                x["text"], x["words"], run, budget,
                tokens_for_words(x["words"]) > budget, x["text"] == "",
            ),
        )

    segments = F.split(inner, rf"(?U)\n(?={INDENT}{CODE_STARTS})")
    return F.flatten(
        F.transform(
            _counted(segments),
            lambda s, i: F.when(tokens_for_words(s["words"]) > budget, lines(s["text"], i)).otherwise(
                F.array(_unit(s["text"], s["words"], i, budget, F.lit(False)))
            ),
        )
    )


def _code_parts(units: str, cuts: str, budget: Column) -> Column:
    """The text of each group as units of the next pass, which joins definitions up to the budget."""

    def part(cut: Column) -> Column:
        first = F.get(units, cut["start"])
        return F.when(first["alone"], _cut_line(first["text"], budget)).otherwise(
            F.array(_joined(units, cut, "\n"))
        )

    return F.transform(
        _counted(F.flatten(F.transform(cuts, part))),
        lambda p: _unit(p["text"], p["words"], F.lit(-1), budget, F.lit(False), p["text"] == ""),
    )


def exploded(rows: DataFrame, values: str, at: str, name: str) -> DataFrame:
    """One row per value with its place. From an inner explode the optimizer infers a filter on the
    size of the list and evaluates the whole expression behind it once more; an outer one has none."""
    return rows.select(
        *[c for c in rows.columns if c != values], F.posexplode_outer(values).alias(at, name)
    ).where(F.col(at).isNotNull())


def blocks_of(documents: DataFrame, key: str = "doc_key") -> DataFrame:
    """Rows ``(key, block_no, path, kind, body)`` of ``(key, markdown)``."""
    blocks = with_blocks(spread(documents, key).select(key, "markdown"))
    return exploded(blocks.select(key, "blocks"), "blocks", "block_no", "b").select(
        key, "block_no", "b.path", "b.kind", "b.body"
    )


def chunk_markdown(
    documents: DataFrame, key: str = "doc_key", budget: ChunkBudget = ChunkBudget()
) -> DataFrame:
    """Chunks ``(key, block_no, part_no, heading_path, chunk_type, text)``.

    ``part_no`` counts from 0 within its block. A code block over the budget is
    re-wrapped in its own fence per part and its heading says which part.
    """
    room_for_all = F.lit(budget.max_tokens) - F.col("overhead")
    most = F.greatest(room_for_all, F.lit(1))
    target = F.least(
        F.greatest(F.lit(budget.target_tokens) - F.col("overhead"), F.lit(0)), most
    )
    code = F.col("kind") == "Code"
    split = code & (tokens_for_words(F.col("n_words")) > budget.max_tokens)
    body_lines = F.transform(
        F.split(F.regexp_replace("body", r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", "")
    )
    closed = (F.size("lines") >= 2) & F.element_at("lines", -1).rlike(rf"(?U)^{FENCE}")
    inner = F.slice("lines", 2, F.size("lines") - F.when(closed, 2).otherwise(1))
    ticks = F.regexp_extract(F.regexp_replace("open_line", r"(?U)^\s+", ""), r"^(?:(.)\1*)", 0)
    room = F.greatest(
        room_for_all
        - 8
        - tokens_for_words(word_count(F.col("open_line")))
        - tokens_for_words(word_count(F.col("fence"))),
        F.lit(1),
    )
    prepared = (
        blocks_of(documents, key)
        .withColumn("prefix", heading_prefix(F.col("path")))
        .withColumn("overhead", tokens_for_words(word_count(F.col("prefix"))))
        .withColumn("n_words", F.when(code, word_count(F.col("prefix")) + word_count(F.col("body"))))
        .withColumn("split", split)
        .withColumn("lines", F.when(F.col("split"), body_lines))
        .withColumn("open_line", F.element_at("lines", 1))
        .withColumn("fence", F.when(ticks == "", "```").otherwise(ticks))
    )
    info = F.col("kind") == "Info"
    units = F.when(info, _prose_units(F.col("body"), target, most)).when(
        F.col("split"), _code_units(F.array_join(inner, "\n"), F.col("room"))
    )
    first = _with_cuts(
        prepared.withColumn("room", room).withColumn("units", units), "units", "cuts", info
    )
    second = _with_cuts(
        first.withColumn("parts", F.when(F.col("split"), _code_parts("units", "cuts", F.col("room")))),
        "parts", "part_cuts", F.lit(False),
    )
    pieces = (
        F.when(info, _prose_pieces("units", "cuts", most))
        .when(F.col("split"), F.transform("part_cuts", lambda c: _joined("parts", c, "\n")))
        .otherwise(F.array("body"))
    )
    part_path = F.concat(
        "path", F.lit(" (part "), (F.col("part_no") + 1).cast("string"), F.lit(")")
    )
    return (
        exploded(
            second.select(
                key, "block_no", "path", "kind", "prefix", "split", "open_line", "fence",
                pieces.alias("pieces"),
            ),
            "pieces", "part_no", "piece",
        )
        .withColumn("own_path", F.when(F.col("split"), part_path).otherwise(F.col("path")))
        .select(
            key,
            "block_no",
            "part_no",
            normalize_heading_path(F.col("own_path")).alias("heading_path"),
            F.col("kind").alias("chunk_type"),
            F.when(
                F.col("split"),
                F.concat(
                    heading_prefix(F.col("own_path")),
                    F.concat_ws("\n", "open_line", "piece", "fence"),
                    F.lit("\n"),
                ),
            )
            .otherwise(F.concat("prefix", "piece"))
            .alias("text"),
        )
    )


def running_offsets(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Rows with ``offset``, the sum of ``n`` over all smaller keys.

    The table is range-partitioned and fixed by a checkpoint; one row per
    partition then carries the sum of the partitions before it, so no task sums
    more than its own range.
    """
    placed = checkpointed(
        counts.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    )
    totals = placed.groupBy("_part").agg(F.sum(n).alias("_total"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start")
    )
    before = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn("offset", F.col("_start") + F.coalesce(F.sum(n).over(before), F.lit(0)))
        .drop("_part", "_start")
    )


def with_global_index(
    rows: DataFrame, key: str, local_order: list[str], name: str = "chunk_idx"
) -> DataFrame:
    """Dense 0-based position of every row, documents by ``key``, rows by ``local_order``.

    The rows are fixed once by a checkpoint; the order between documents comes
    from the far smaller table of rows per document.
    """
    fixed = checkpointed(rows)
    counts = fixed.groupBy(key).agg(F.count("*").alias("n"))
    local = Window.partitionBy(key).orderBy(*local_order)
    return (
        fixed.join(running_offsets(counts, key).select(key, "offset"), key)
        .withColumn(name, F.col("offset") + F.row_number().over(local) - 1)
        .drop("offset")
    )


def reassemble_pages(
    chunks: DataFrame, page: str = "source_url", order: str = "chunk_idx", text: str = "text",
    run: int = 256,
) -> DataFrame:
    """Page text from its chunks, in order, joined by blank lines.

    Runs of chunks join first, spread over many tasks even for one large page;
    the final step joins one string per run.
    """
    def joined(value: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("_at", value)))
        return F.array_join(F.transform(ordered, lambda x: x[value]), "\n\n")

    runs = (
        chunks.select(page, F.col(order).alias("_at"), F.col(text).alias("_text"))
        .withColumn("_run", F.floor(F.col("_at") / run))
        .groupBy(page, "_run")
        .agg(joined("_text").alias("_text"), F.count("*").alias("_n"))
        .withColumnRenamed("_run", "_at")
    )
    return runs.groupBy(page).agg(joined("_text").alias("text"), F.sum("_n").alias("n_chunks"))
