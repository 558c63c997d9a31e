"""Operator 7: n-gram Jaccard join by count-vector R-trees.

Two documents link when their sets of ``size``-word shingles have a Jaccard similarity of
``percent`` / 100 or more. The join is exact up to collisions of 64-bit hashes:

1. Documents with one and the same set become one node, its digest.
2. Similar sets share one of their first ``n - ceil(n * percent / 100) + 1`` shingles in any
   common order. The order used puts rare shingles first, by counters over all documents
   (2**20 of them, whatever the input), so what many documents share hardly ever routes.
3. Nodes that share such a shingle form a block. Each node is first compared with its block's
   most common node only (the one with the most frequent shingles, which altered copies lie
   around); links found this way join most copies at once.
4. In blocks that still hold several components, count vectors (shingles per hash group) are
   the points of an R-tree; the sum of coordinate minima bounds the overlap. Nodes tied by pairs
   of different components that survive the bound come together again with their sets, once for
   all blocks that tie the same nodes, and are compared until they are joined. Large blocks are
   cut into cells, every pair of parts in a cell, so no task holds more than about ``CELL_NODES``
   count vectors or sets of ``CELL_SHINGLES`` shingles (or one larger set) of each part.
5. Components of all links give the result.

Pairs inside a component already linked are not compared: no link between components is lost,
and copies are never expanded into all pairs.

Null and empty texts and those without words have no shingles and no links. Rows with a null id
count like others, but name a component only if it has no other id; repeated rows keep their
own row. An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.arrow_text import id_and_text, slices
from quillsift.llm.components import Tops, components
from quillsift.llm.exact_dedup import broadcast_within
from quillsift.llm.rtree import folded, least_overlap, overlap_bound, partners
from quillsift.llm.shingles import group_counts, groups_for, pack_counts, set_digest, shingle_sets, unpack_counts
from quillsift.session import checkpointed

SIZE, PERCENT = 4, 85
COUNTERS = 1 << 20
COUNTER_BLOCKS = 16
BLOOM_BITS = 1 << 26
CELL_NODES = 2048
CELL_SHINGLES = 1 << 20
SEEN = 100_000
OUT_ROWS = 10_000
#: Text bytes whose shingles are made at once: some arrays of eight bytes for each of them.
SLICE_BYTES = 1 << 18
_CELL = ("block", "low", "high")


def counter_places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def prefix(hashes: np.ndarray, counters: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles of a set by which every similar set can be found, and how common they are.

    Of a text and its altered copies the text itself has the most common shingles.
    """
    count = len(hashes)
    length = count - (percent * count + 99) // 100 + 1
    common = counters[counter_places(hashes)]
    order = np.lexsort((hashes, common))[:length]
    return hashes[order], int(1000 * np.log2(1.0 + common[order]).mean())


def sets_and_counters(rows: DataFrame, size: int) -> DataFrame:
    """Per document (id, n, node, counts), and packed counters of all shingles as (block, counts)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.uint32)
        for part in slices(batches, limit=SLICE_BYTES):
            sets = list(shingle_sets(part.column("text"), size))
            np.add.at(total, counter_places(np.concatenate(sets)), np.uint32(1))
            yield _sets_batch(part.column("id"), sets)
        if total.any():
            blocks = [zlib.compress(b.tobytes(), 1) for b in np.split(total, COUNTER_BLOCKS)]
            yield _counter_batch(blocks)

    return rows.mapInArrow(run, "id long, n int, node long, counts binary, block int")


_COLUMNS = ["id", "n", "node", "counts", "block"]


def _sets_batch(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    points = [pack_counts(group_counts(s, groups_for(len(s)))) for s in sets]
    columns = [
        ids,
        pa.array([len(s) for s in sets], pa.int32()),
        pa.array([set_digest(s) for s in sets], pa.int64()),
        pa.array(points, pa.binary()),
        pa.nulls(len(sets), pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, _COLUMNS)


def _counter_batch(blocks: list[bytes]) -> pa.RecordBatch:
    count = len(blocks)
    none = pa.nulls(count, pa.int64())
    columns = [none, pa.nulls(count, pa.int32()), none, pa.array(blocks, pa.binary()), pa.array(range(count), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, _COLUMNS)


def _summed(rows: DataFrame, combine: np.ufunc, kind: type) -> DataFrame:
    """Packed arrays (block, counts) combined by block, in two steps."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                values = np.frombuffer(zlib.decompress(packed), dtype=kind)
                held[block] = combine(held[block], values) if block in held else values
        if held:
            packed = [zlib.compress(v.tobytes(), 1) for v in held.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"]
            )

    schema = "block int, counts binary"
    return rows.repartition(32).mapInArrow(run, schema).repartition("block").mapInArrow(run, schema)


def _gathered(rows: DataFrame, combine: np.ufunc, kind: type, length: int) -> np.ndarray:
    """The whole array on the driver; its length is fixed."""
    out = np.zeros(length, dtype=kind)
    step = length // COUNTER_BLOCKS
    for row in _summed(rows, combine, kind).collect():
        begin = row["block"] * step
        out[begin : begin + step] = np.frombuffer(zlib.decompress(row["counts"]), dtype=kind)
    return out


class Recent(dict):
    """Keys seen lately; forgets all when full."""

    def first(self, key: int) -> bool:
        if key in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self[key] = True
        return True


def routing_shingles(rows: DataFrame, counters: np.ndarray, size: int, percent: int) -> DataFrame:
    """(shingle, node, n, common): the prefix of every node's set."""
    shared = rows.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Recent()
        for part in slices(batches, limit=SLICE_BYTES):
            found, nodes, sizes, lengths, ranks = [], [], [], [], []
            for hashes in shingle_sets(part.column("text"), size):
                node = set_digest(hashes)
                if len(hashes) and seen.first(node):
                    first, common = prefix(hashes, shared.value, percent)
                    ranks.append(common)
                    found.append(first)
                    nodes.append(node)
                    sizes.append(len(hashes))
                    lengths.append(len(first))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(found).view(np.int64)),
                        pa.array(np.repeat(np.array(nodes, dtype=np.int64), lengths)),
                        pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths)),
                        pa.array(np.repeat(np.array(ranks, dtype=np.int32), lengths)),
                    ],
                    ["shingle", "node", "n", "common"],
                )

    return rows.mapInArrow(run, "shingle long, node long, n int, common int")


def bloom_places(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes = nodes.view(np.uint64)
    mask = np.uint64(BLOOM_BITS - 1)
    return (nodes & mask).astype(np.int64), ((nodes >> np.uint64(32)) & mask).astype(np.int64)


def bloom_of(nodes: DataFrame) -> np.ndarray:
    """A filter of fixed size (8 MB) that holds all nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
        empty = True
        for batch in batches:
            empty = empty and batch.num_rows == 0
            for places in bloom_places(batch.column("node").to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, places >> 3, (128 >> (places & 7)).astype(np.uint8))
        if not empty:
            packed = [zlib.compress(b.tobytes(), 1) for b in np.split(bits, COUNTER_BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(COUNTER_BLOCKS), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"]
            )

    rows = nodes.select("node").mapInArrow(run, "block int, counts binary")
    return _gathered(rows, np.bitwise_or, np.uint8, BLOOM_BITS // 8)


def node_sets(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of the nodes asked for, and of some that were not."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom_of(nodes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, Recent()
        for part in slices(batches, limit=SLICE_BYTES):
            out: list[tuple] = []
            for hashes in shingle_sets(part.column("text"), size):
                node = set_digest(hashes)
                places = [int(p[0]) for p in bloom_places(np.array([node]))]
                if len(hashes) and all(bits[p >> 3] >> (7 - (p & 7)) & 1 for p in places) and seen.first(node):
                    out.append((node, hashes.tobytes()))
            if out:
                keys, packed = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["node", "hashes"]
                )

    return rows.mapInArrow(run, "node long, hashes binary")


def within_bound(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose count vectors allow the similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for size_a, size_b, packed_a, packed_b in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "counts_a", "counts_b")), strict=True):
                first, second = unpack_counts(packed_a), unpack_counts(packed_b)
                groups = min(len(first), len(second))
                bound = overlap_bound(folded(first, groups), folded(second, groups))
                kept.append(bool(bound >= least_overlap(size_a, size_b, percent)))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return _with_both(pairs, points, ("n", "counts")).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, compared on their whole sets, read from ``rows`` again."""
    pairs = checkpointed(pairs)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = checkpointed(node_sets(rows, asked, size).dropDuplicates(["node"]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for packed_a, packed_b in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                first = np.frombuffer(packed_a.as_buffer(), dtype=np.uint64)
                second = np.frombuffer(packed_b.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(first, second, assume_unique=True))
                kept.append(100 * common >= percent * (len(first) + len(second) - common))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return _with_both(pairs, sets, ("hashes",)).mapInArrow(run, "a long, b long")


def _with_both(pairs: DataFrame, table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pairs with columns of both their nodes, suffixed _a and _b."""
    for side in ("a", "b"):
        named = table.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        pairs = pairs.join(named, side)
    return pairs


def cells(members: DataFrame, weight: Column, limit: int) -> DataFrame:
    """The members of each block dealt into parts of about ``limit`` weight; two parts meet in a cell."""
    block = Window.partitionBy("block")
    parted = members.withColumn("parts", F.ceil(F.sum(weight).over(block) / limit).cast("int"))
    parted = parted.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return others.withColumn("low", low).withColumn("high", high).drop("parts", "part", "other")


def open_groups(members: DataFrame, percent: int, cell_nodes: int = CELL_NODES) -> DataFrame:
    """(block, node, n, label) of groups of nodes that the pairs of different components tie
    together which their count vectors allow.

    ``members`` has (block, node, n, label, counts). The groups of a cell are disjoint, so it gives
    no more rows than it has nodes. A group's name is the digest of its nodes: what many
    blocks find again (copies share many shingles) is one group.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches, "counts"):
            labels = [row[1] for row in rows]
            if labels.count(labels[0]) == len(labels):
                continue
            ties = Tops()
            tied = set()
            sizes = np.array([row[2] for row in rows])
            for i, found in partners(sizes, [unpack_counts(row[3]) for row in rows], percent):
                for j in found.tolist():
                    if labels[i] != labels[j]:
                        ties.join(i, j)
                        tied.update((i, j))
            groups: dict[int, list[int]] = {}
            for i in tied:
                groups.setdefault(ties.top(i), []).append(i)
            for group in groups.values():
                name = set_digest(np.array([rows[i][0] for i in group], dtype=np.int64).view(np.uint64))
                out.extend((name, rows[i][0], rows[i][2], labels[i]) for i in group)
            if len(out) >= OUT_ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["block", "node", "n", "label"])

    dealt = cells(members, F.lit(1), cell_nodes).repartition(*_CELL).sortWithinPartitions(*_CELL, "node")
    return dealt.mapInArrow(run, "block long, node long, n int, label long").dropDuplicates(["block", "node"])


def block_links(
    wanted: DataFrame, rows: DataFrame, size: int, percent: int, cell_shingles: int = CELL_SHINGLES
) -> DataFrame:
    """Links (a, b) that join the components of each block as all its links would.

    ``wanted`` is the table of ``open_groups``. Whole sets are compared; pairs that links found
    before in the cell have joined are passed over, so a cell makes fewer links than it has nodes.
    """
    wanted = checkpointed(wanted)
    sets = node_sets(rows, wanted.select("node").distinct(), size).dropDuplicates(["node"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _groups(batches, "hashes"):
            links = _links_of(members, percent)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = cells(wanted, F.col("n"), cell_shingles).join(sets, "node")
    dealt = dealt.repartition(*_CELL).sortWithinPartitions(*_CELL, "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _links_of(members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between rows (node, label, n, hashes) that join as many labels as can be."""
    sets = [np.frombuffer(row[3], dtype=np.uint64) for row in members]
    sizes = np.array([len(s) for s in sets])
    points = [group_counts(s, groups_for(len(s))) for s in sets]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    codes = np.split(codes, np.cumsum(sizes)[:-1])
    marked = np.zeros(int(sizes.sum()), dtype=bool)
    labels = Tops()
    links = []
    for i, found in partners(sizes, points, percent):
        marked[codes[i]] = True
        for j in found.tolist():
            first, second = members[i][1], members[j][1]
            if labels.top(first) == labels.top(second):
                continue
            common = int(np.count_nonzero(marked[codes[j]]))
            if 100 * common >= percent * (int(sizes[i]) + int(sizes[j]) - common):
                labels.join(first, second)
                links.append((members[i][0], members[j][0]))
        marked[codes[i]] = False
    return links


def _groups(batches: Iterable[pa.RecordBatch], value: str) -> Iterator[list[tuple]]:
    """Rows (node, label, n, value) of one cell of two or more after the other."""
    key, rows = None, []
    for batch in batches:
        names = (*_CELL, "node", "label", "n", value)
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if row[:3] != key:
                if len(rows) > 1:
                    yield rows
                key, rows = row[:3], []
            rows.append(row[3:])
    if len(rows) > 1:
        yield rows


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    percent: int = PERCENT,
    cell_nodes: int = CELL_NODES,
    cell_shingles: int = CELL_SHINGLES,
) -> DataFrame:
    """(id, n_shingles, component_id), one row per document."""
    rows = id_and_text(docs, id_col, text_col)
    first = checkpointed(sets_and_counters(rows, size))
    documents = first.where("block is null").select("id", F.col("n").cast("long").alias("n"), "node")
    counters = _gathered(first.where("block is not null"), np.add, np.uint32, COUNTERS)

    block = Window.partitionBy("shingle")
    blocks = (
        routing_shingles(rows, counters, size, percent)
        .withColumn("lead", F.max(F.struct("common", "node", "n")).over(block))
        .withColumn("low", F.min("node").over(block))
        .withColumn("high", F.max("node").over(block))
        .where("low <> high")
        .select("shingle", "node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"))
    )
    blocks = checkpointed(blocks.dropDuplicates(["shingle", "node"]))
    stars = (
        blocks.where("node <> lead")
        .where(f"100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")
        .select(F.col("lead").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    points = first.where("block is null and n > 0").select("node", "n", "counts")
    points = checkpointed(points.join(blocks.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    links = checkpointed(verified(within_bound(stars, points, percent), rows, size, percent))
    labels = components(links)

    members = blocks.select("shingle", "node", "n").join(labels, "node", "left").select(
        "shingle", "node", "n", F.coalesce("label", "node").alias("label")
    )
    # A node has a partner of fitting size only if the next smaller or larger one fits.
    by_size = block.orderBy("n", "node")
    members = (
        members.withColumn("below", F.lag("n").over(by_size))
        .withColumn("above", F.lead("n").over(by_size))
        .where(f"100 * below >= {percent} * n or 100 * n >= {percent} * above")
    )
    open_blocks = members.withColumn("low", F.min("label").over(block)).withColumn("high", F.max("label").over(block))
    open_blocks = open_blocks.where("low <> high").select(F.col("shingle").alias("block"), "node", "label")
    open_blocks = open_blocks.join(points, "node")
    crossing = checkpointed(block_links(open_groups(open_blocks, percent, cell_nodes), rows, size, percent, cell_shingles))
    if not crossing.isEmpty():
        labels = components(links.unionByName(crossing))

    per_node = documents.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = per_node.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    answers = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = named.join(answers, "label").select("node", "component_id")
    linked = documents.where("n > 0").join(by_node, "node").select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = documents.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs``, all columns, of which each group of linked documents has one.

    The smallest id stays. Rows that repeat an id share their fate: they stay if one of them is its
    group's smallest. Rows with a null id stay.
    """
    groups = similar_groups(docs, id_col, text_col, size, percent)
    gone = groups.groupBy("id").agg(F.max(F.col("id") == F.col("component_id")).alias("stays"))
    gone = checkpointed(gone.where("id is not null and not stays").select("id"))
    return docs.join(broadcast_within(gone), docs[id_col].cast("long") == gone["id"], "left_anti")
