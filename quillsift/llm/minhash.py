"""Operator 11: near-duplicates by a multi-index Hamming join of MinHash signatures.

A signature holds ``VALUES`` minima of ``BITS`` bits over a document's set of word shingles. The distance
of two signatures is the number of values in which they differ; documents are candidates up to a
distance of ``RADIUS``.

1. Documents with one set become one node. Only nodes and signatures are written; sets are made
   again, for one document of each node that a comparison asks for.
2. A signature is split into chunks of ``CHUNK`` values. By the pigeonhole principle two signatures
   within the radius differ in at most ``ERRORS`` values of some chunk. So each node gets a key for
   every way to leave out ``ERRORS`` values of a chunk, and every pair within the radius shares a key.
3. Nodes with one key are a block. All are compared with its lead, the node that shares most keys
   with others (altered copies lie around it): first by signatures, then by full sets.
4. Blocks whose other nodes still lie in several components are dealt into cells and compared there
   by signatures, but for the nodes of the block's largest component among each other. Nodes tied by
   pairs within the radius, over all blocks, come together once with their sets, in cells again,
   and are compared until they are joined.
5. Components of all links give the result.

Every link is confirmed on full sets. A pair of similarity s is missed with the chance that more than
``RADIUS`` of ``VALUES`` values differ, each with probability 1 - s: 2e-7 for 0.8, less for
closer pairs. ``miss_chance`` gives it, and parameters beyond 1e-5 are refused.

No block, cell or group is held whole by a task or listed as pairs: blocks are combined by
aggregation, joins split hot keys, cells hold ``CELL_NODES`` signatures or ``CELL_SHINGLES`` shingles
of each side.

Null and empty texts and those without words have no shingles and no links. Rows with a null id count
like others, but name a component (and are kept) only if it has no other id. Repeated rows keep their own row. An
empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.arrow_text import id_and_text, slices
from quillsift.llm.components import Tops, components
from quillsift.llm.exact_dedup import broadcast_within
from quillsift.llm.ngram_join import Recent
from quillsift.llm.shingles import set_digest, shingle_sets
from quillsift.llm.word_hash import mix
from quillsift.session import checkpointed

SIZE, PERCENT = 4, 80
VALUES, CHUNK, ERRORS, BITS = 20, 4, 2, 32
#: Chunks times (errors + 1), less one: the largest distance at which some chunk has at most ERRORS.
RADIUS = VALUES // CHUNK * (ERRORS + 1) - 1
CELL_NODES = 2048
CELL_SHINGLES = 1 << 20
_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MASKS = list(combinations(range(CHUNK), CHUNK - ERRORS))
_CELL = ("block", "kind", "low", "high")


def miss_chance(percent: int) -> float:
    """Chance that a pair of this similarity lies beyond the radius."""
    same = percent / 100
    return sum(math.comb(VALUES, k) * (1 - same) ** k * same ** (VALUES - k) for k in range(RADIUS + 1, VALUES + 1))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``VALUES`` minima for each set; none may be empty."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
    minima = [np.minimum.reduceat(mix(flat ^ seed), begins) for seed in _SEEDS]
    return (np.stack(minima, axis=1) & np.uint64((1 << BITS) - 1)).astype(np.uint32)


def chunk_keys(rows: np.ndarray) -> np.ndarray:
    """Keys of each signature: every chunk with every way to leave out ``ERRORS`` of its values."""
    keys = []
    for chunk in range(VALUES // CHUNK):
        for number, mask in enumerate(_MASKS):
            key = np.full(len(rows), chunk * len(_MASKS) + number + 1, dtype=np.uint64)
            for place in mask:
                key = mix(key * np.uint64(0xD1342543DE82EF95) + rows[:, chunk * CHUNK + place])
            keys.append(key)
    return np.stack(keys, axis=1)


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, VALUES)


def signed_rows(rows: DataFrame, size: int) -> DataFrame:
    """(id, n, node, signature) per document; a task gives a set it met before only its node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Recent()
        for part in slices(batches):
            sets = list(shingle_sets(part.column("text"), size))
            nodes = [set_digest(s) for s in sets]
            fresh = [n for n, (s, node) in enumerate(zip(sets, nodes, strict=True)) if len(s) and seen.first(node)]
            signed: list[bytes | None] = [None] * len(sets)
            if fresh:
                for n, row in zip(fresh, signatures([sets[n] for n in fresh]), strict=True):
                    signed[n] = row.tobytes()
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [part.column("id"), sizes, pa.array(nodes, pa.int64()), pa.array(signed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "node", "signature"])

    return rows.mapInArrow(run, "id long, n long, node long, signature binary")


def set_rows(rows: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of documents with words; a task gives each set once or seldom more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Recent()
        for part in slices(batches):
            sets = [(set_digest(s), s) for s in shingle_sets(part.column("text"), size) if len(s)]
            sets = [(node, s.tobytes()) for node, s in sets if seen.first(node)]
            if sets:
                nodes, hashes = zip(*sets, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.binary())], ["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes binary")


def key_rows(nodes: DataFrame) -> DataFrame:
    """(block, node): every key of every node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(_unpacked(batch.column("signature")))
                own = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(own)], ["block", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "block long, node long")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """(block, node, lead) of all keys that several nodes share."""
    keys = key_rows(nodes)
    shared = keys.groupBy("block").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = checkpointed(keys.join(shared, "block"))
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    lead = members.join(weight, "node").groupBy("block").agg(F.max(F.struct("weight", "node")).alias("lead"))
    return checkpointed(members.select("block", "node").join(lead.select("block", F.col("lead.node").alias("lead")), "block"))


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def within_radius(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures lie within the radius."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, second = (_unpacked(batch.column(c)) for c in ("signature_a", "signature_b"))
                kept = (first != second).sum(axis=1) <= RADIUS
                yield batch.select(["a", "b"]).filter(pa.array(kept))

    return _with_both(pairs, nodes, "signature").mapInArrow(run, "a long, b long")


@dataclass
class Corpus:
    """The texts (id, text), their ``signed_rows`` and the shingle size."""

    rows: DataFrame
    signed: DataFrame
    size: int

    def sets(self, asked: DataFrame) -> DataFrame:
        """(node, hashes) of the nodes asked for, from the texts of one document each.

        Their ids are broadcast where counted to be few, so that other texts do not travel.
        """
        asked = checkpointed(asked.select("node").distinct())
        first = self.signed.join(asked, "node").groupBy("node").agg(F.min("id").alias("id"))
        ids = checkpointed(first.select("id"))
        texts = self.rows.where("id is not null").join(broadcast_within(ids.where("id is not null")), "id", "left_semi")
        if not ids.where("id is null").isEmpty():
            texts = texts.unionByName(self.rows.where("id is null"))
        found = set_rows(texts.select("text"), self.size)
        return found.join(broadcast_within(asked), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, corpus: Corpus, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    pairs = checkpointed(pairs)
    sets = checkpointed(corpus.sets(pairs.select(F.explode(F.array("a", "b")).alias("node"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for packed_a, packed_b in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                first = np.frombuffer(packed_a.as_buffer(), dtype=np.uint64)
                second = np.frombuffer(packed_b.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(first, second, assume_unique=True))
                kept.append(100 * common >= percent * (len(first) + len(second) - common))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return _with_both(pairs, sets, "hashes").mapInArrow(run, "a long, b long")


def dealt(members: DataFrame, weight: Column, limit: int) -> DataFrame:
    """``members`` (block, node, label, ...) of blocks with several labels, dealt into cells.

    The label of most weight is a block's bulk. Parts ``low`` and ``high`` of the other nodes meet in a
    cell of kind 0; part ``low`` of them meets part ``high`` of the bulk in a cell of kind 1, and itself
    where ``high`` is 0. The bulk is never dealt with itself. A cell has parts of about ``limit`` weight,
    so a block within the limit is one cell and each of its nodes one row.
    """
    by_label = members.groupBy("block", "label").agg(F.sum(weight).alias("weight"))
    shape = by_label.groupBy("block").agg(
        F.max(F.struct("weight", "label")).alias("bulk"), F.sum("weight").alias("all"), F.count(F.lit(1)).alias("labels")
    )
    shape = shape.where("labels > 1").select(
        "block",
        F.col("bulk.label").alias("bulk"),
        F.ceil((F.col("all") - F.col("bulk.weight")) / limit).cast("int").alias("parts"),
        F.ceil(F.col("bulk.weight") / limit).cast("int").alias("bulk_parts"),
    )
    rows = members.join(shape, "block").withColumn("is_bulk", F.col("label") == F.col("bulk"))
    part = F.pmod(F.xxhash64("node"), F.when(F.col("is_bulk"), F.col("bulk_parts")).otherwise(F.col("parts"))).cast("int")
    rows = rows.withColumn("part", part)

    def numbers(count: str) -> Column:
        return F.sequence(F.lit(0), F.col(count) - 1)

    def cell(kind: int, low: Column, high: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))

    own = F.col("part")
    others = F.filter(numbers("parts"), lambda p: p != own)
    among = F.transform(others, lambda p: cell(0, F.least(own, p), F.greatest(own, p)))
    with_bulk = F.transform(numbers("bulk_parts"), lambda p: cell(1, own, p))
    as_bulk = F.transform(numbers("parts"), lambda p: cell(1, p, own))
    cells = F.when(F.col("is_bulk"), as_bulk).otherwise(F.concat(among, with_bulk))
    rows = rows.withColumn("cell", F.explode(cells))
    return rows.select("*", "cell.kind", "cell.low", "cell.high").drop("cell", "bulk", "parts", "bulk_parts")


def near_pairs(
    rows: np.ndarray, labels: np.ndarray, bulk: np.ndarray, parts: np.ndarray, cell: tuple
) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j) within the radius and of different labels, each pair of the cell's parts once."""
    _, kind, low, high = cell
    first = np.flatnonzero(~bulk & (parts == low))
    against = np.flatnonzero(bulk if kind else parts == high)
    among = kind == 1 and high == 0
    if among:
        against = np.concatenate([first, against])
    for at, i in enumerate(first.tolist()):
        rest = against[at + 1 :] if among else against
        rest = rest[labels[rest] != labels[i]]
        found = rest[(rows[rest] != rows[i]).sum(axis=1) <= RADIUS]
        if len(found):
            yield i, found


def _cells(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(cell, rows of ``names``) of one cell after the other."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in (*_CELL, *names)), strict=True):
            if row[:4] != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = row[:4], []
            rows.append(row[4:])
    if len(rows) > 1:
        yield key, rows


def ties(members: DataFrame, nodes: DataFrame, cell_nodes: int) -> DataFrame:
    """(a, b) that connect whatever pairs within the radius and of different labels connect.

    A cell gives fewer rows than it has nodes; all blocks together tie each node into one group.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _cells(batches, ("node", "label", "is_bulk", "part", "signature")):
            names, labels, bulk, parts, packed = zip(*rows, strict=True)
            signed = np.frombuffer(b"".join(packed), dtype=np.uint32).reshape(-1, VALUES)
            tied, held = Tops(), set()
            for i, found in near_pairs(signed, np.array(labels), np.array(bulk), np.array(parts), key):
                held.update((i, *found.tolist()))
                for j in found.tolist():
                    tied.join(i, j)
            # Each group as a star around its smallest node, so that few rounds find the components.
            least: dict[int, int] = {}
            for i in held:
                top = tied.top(i)
                least[top] = min(names[i], least.get(top, names[i]))
            pairs = [(least[tied.top(i)], names[i]) for i in held if names[i] != least[tied.top(i)]]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    cells = dealt(members, F.lit(1), cell_nodes).join(nodes, "node").repartition(*_CELL)
    return cells.sortWithinPartitions(*_CELL, "node").mapInArrow(run, "a long, b long").distinct()


def group_links(groups: DataFrame, corpus: Corpus, percent: int, cell_shingles: int) -> DataFrame:
    """Links (a, b) that join the labels of each group (block, node, label, signature) as all its links would."""
    sets = checkpointed(corpus.sets(groups))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _cells(batches, ("node", "label", "is_bulk", "part", "signature", "hashes")):
            nodes, labels, bulk, parts, packed, hashes = zip(*rows, strict=True)
            sets = [np.frombuffer(h, dtype=np.uint64) for h in hashes]
            signed = np.frombuffer(b"".join(packed), dtype=np.uint32).reshape(-1, VALUES)
            joined, links = Tops(), []
            for i, found in near_pairs(signed, np.array(labels), np.array(bulk), np.array(parts), key):
                for j in found.tolist():
                    if joined.top(labels[i]) != joined.top(labels[j]):
                        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                            joined.join(labels[i], labels[j])
                            links.append((nodes[i], nodes[j]))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sized = groups.join(sets.select("node", (F.octet_length("hashes") / 8).cast("long").alias("n")), "node")
    cells = dealt(sized, F.greatest("n", F.lit(cell_shingles // CELL_NODES)), cell_shingles).drop("n").join(sets, "node")
    cells = cells.repartition(*_CELL).sortWithinPartitions(*_CELL, "node")
    return cells.mapInArrow(run, "a long, b long").distinct()


def relabelled(nodes: DataFrame, labels: DataFrame, crossing: DataFrame) -> DataFrame:
    """(node, label) of all nodes after links (a, b) between components; only components are joined."""
    every = nodes.select("node").join(labels, "node", "left")
    every = checkpointed(every.select("node", F.coalesce("label", "node").alias("label")))
    links = crossing
    for side in ("a", "b"):
        of_side = every.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        links = links.join(of_side, side)
    tops = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    tops = tops.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return every.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    percent: int = PERCENT,
    cell_nodes: int = CELL_NODES,
    cell_shingles: int = CELL_SHINGLES,
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per document."""
    if miss_chance(percent) > 1e-5:
        raise ValueError(f"a similarity of {percent} % is too low for a radius of {RADIUS} in {VALUES}")
    rows = id_and_text(docs, id_col, text_col)
    corpus = Corpus(rows, checkpointed(signed_rows(rows, size)), size)
    signed = corpus.signed.where("signature is not null").select("node", "signature")
    nodes = checkpointed(signed.dropDuplicates(["node"]))
    blocks = blocks_of(nodes)
    stars = blocks.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = checkpointed(confirmed(within_radius(stars, nodes), corpus, percent))
    labels = components(links)

    # The lead has been compared with all of its block.
    members = blocks.where("node <> lead").select("block", "node").join(labels, "node", "left")
    members = members.select("block", "node", F.coalesce("label", "node").alias("label"))
    several = members.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    members = members.join(several.where("low <> high").select("block"), "block")
    members = checkpointed(members)
    tied = components(checkpointed(ties(members, nodes, cell_nodes))).withColumnRenamed("label", "block")
    groups = checkpointed(tied.join(members.select("node", "label").distinct(), "node").join(nodes, "node"))
    crossing = checkpointed(group_links(groups, corpus, percent, cell_shingles))
    if not crossing.isEmpty():
        labels = relabelled(nodes, labels, crossing)

    documents = corpus.signed.select("id", "n", "node")
    named = documents.where("n > 0").groupBy("node").agg(F.min("id").alias("least")).join(labels, "node", "left")
    named = named.select("node", "least", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = named.join(least, "label").select("node", "component_id")
    linked = documents.where("n > 0").join(by_node, "node").select("id", "n", "component_id")
    alone = documents.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    found = linked.unionByName(alone).withColumnRenamed("n", "n_shingles")
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
