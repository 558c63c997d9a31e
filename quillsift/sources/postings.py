"""A stored inverted index in segments of blocks, and its top-k search.

``root/<segment>/blocks`` holds the postings of one append, partitioned by a hash of the term. A block
is one term's postings within one range of ``RANGE`` chunk indexes: packed offsets, frequencies
and lengths, with the largest frequency and the smallest length among them. These two bound every
score of the block under any corpus statistics, so blocks stay valid when segments are added.
``root/<segment>/stats`` holds counts. ``root/INDEX`` names the analyzer and the live segments; it
is replaced by one rename, after a segment is complete.

Search adds the bounds of a query's terms by range, scores the most promising ranges in full, takes
the k-th best score found there as a threshold, and reads of all other blocks only those of ranges
whose bound reaches it. Ranges are disjoint, so every score is complete; results are those of a
scan of the texts, which are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from quillsift.functions.stem import ANALYZERS
from quillsift.operators.batch import QueryBatch
from quillsift.operators.lexical import idf, term_weight
from quillsift.operators.topk import SCORE_DIGITS, TaskTopK, rank_scores
from quillsift.params import SearchParams
from quillsift.session import checkpointed
from quillsift.sources.hadoop_files import HadoopFiles

RANGE = 1024
BUCKETS = 16
#: Ranges scored in full before a query's threshold is known.
SEED_RANGES = 8


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def parts_of(tokens: DataFrame) -> DataFrame:
    """Blocks ``(term, range, at, tf, length)`` of ``(chunk_idx, terms)``, packed where the rows lie.

    A block whose chunks lie in several Arrow batches comes in as many parts.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            ids = batch.column("chunk_idx").to_numpy()
            lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(order.size)
            codes = words.indices.to_numpy().astype(np.int64)
            pairs, tf = np.unique(codes * order.size + np.repeat(place, lengths), return_counts=True)
            code, place = np.divmod(pairs, order.size)
            row = order[place]
            start = ids[row] // RANGE
            fresh = np.concatenate(([True], (code[1:] != code[:-1]) | (start[1:] != start[:-1])))
            first = np.flatnonzero(fresh)
            ends = pa.array(np.append(first, row.size), pa.int32())
            lists = (
                pa.ListArray.from_arrays(ends, pa.array(values, kind))
                for values, kind in (
                    ((ids[row] - start * RANGE).astype(np.int16), pa.int16()),
                    (tf.astype(np.int32), pa.int32()),
                    (lengths[row].astype(np.int32), pa.int32()),
                )
            )
            term = words.dictionary.take(pa.array(code[first]))
            yield pa.RecordBatch.from_arrays([term, pa.array(start[first]), *lists], names=_PART)

    return tokens.mapInArrow(pack, _SCHEMAS["parts"])


def blocks_of(parts: DataFrame) -> DataFrame:
    """Whole blocks, sorted, of parts; the parts are what is shuffled, once."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            table = table.combine_chunks()
            term, start = table["term"], table["range"]
            if len(table) < 2:
                held = table
                continue
            same = pc.and_(pc.equal(term[1:], term[:-1]), pc.equal(start[1:], start[:-1]))
            first = np.flatnonzero(np.concatenate(([True], ~same.to_numpy(zero_copy_only=False))))
            held = table.slice(first[-1])
            yield from merged(table.slice(0, first[-1]), first[:-1])
        if held is not None and len(held):
            yield from merged(held, np.array([0]))

    def merged(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        table = table.combine_chunks()
        lists = [table[name].chunk(0) for name in ("at", "tf", "length")]
        sizes = lists[0].value_lengths().to_numpy()
        at, tf, length = (x.flatten().to_numpy() for x in lists)
        block = np.repeat(np.cumsum(np.bincount(first, minlength=len(table))), sizes).astype(np.int64)
        order = np.argsort(block * RANGE + at, kind="stable")
        starts = np.concatenate(([0], np.cumsum(sizes)))[first]
        ends = np.append(starts, at.size).astype(np.int32)
        at, tf, length = at[order], tf[order], length[order]
        out = table.select(["bucket", "term", "range"]).take(pa.array(first))
        yield pa.RecordBatch.from_arrays(
            [
                *(out[name].combine_chunks() for name in ("bucket", "term", "range")),
                pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts)),
                *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (at, tf, length)),
            ],
            names=_BLOCK,
        )

    dealt = parts.select(bucket_of(F.col("term")).alias("bucket"), *_PART).repartition("bucket", F.pmod("range", F.lit(8)))
    order = ("bucket", "term", "range")
    return dealt.sortWithinPartitions(*order).mapInArrow(merge, _SCHEMAS["merged"]).sortWithinPartitions(*order)


def unpacked() -> Column:
    """A row ``entry`` (at, tf, length) for every posting of a block."""
    parts = F.transform(
        "at",
        lambda at, n: F.struct(at.alias("at"), F.get("tf", n).alias("tf"), F.get("length", n).alias("length")),
    )
    return F.explode(parts).alias("entry")


def postings_of(blocks: DataFrame) -> DataFrame:
    """``(term, chunk_idx, tf, length)`` of stored blocks."""
    return blocks.select("term", "range", unpacked()).select(
        "term",
        (F.col("range") * RANGE + F.col("entry.at")).alias("chunk_idx"),
        F.col("entry.tf").cast("long").alias("tf"),
        F.col("entry.length").alias("length"),
    )


class PostingsIndex:
    """The index below ``root``. Chunk indexes of segments must not overlap, as after an append."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._files = HadoopFiles(spark, self.root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, analyzer: str = "english") -> PostingsIndex:
        """An empty index, instead of whatever index was there."""
        index = cls(spark, root)
        old = index.segments() if index.exists() else []
        ANALYZERS[analyzer]
        index._publish(analyzer, [])
        index._drop(old)
        return index

    def exists(self) -> bool:
        return self._files.exists(f"{self.root}/INDEX")

    def _state(self) -> dict:
        return json.loads(self._files.read(f"{self.root}/INDEX"))

    def segments(self) -> list[str]:
        return self._state()["segments"]

    @property
    def analyzer(self) -> str:
        return self._state()["analyzer"]

    def _publish(self, analyzer: str, segments: list[str]) -> None:
        self._files.write(f"{self.root}/INDEX", json.dumps({"analyzer": analyzer, "segments": segments}))

    def _drop(self, segments: list[str]) -> None:
        for name in segments:
            self._files.delete(f"{self.root}/{name}")

    def append(self, chunks: DataFrame) -> str:
        """Index the chunks ``(chunk_idx, text)`` as one more segment; earlier ones are not touched."""
        analyze = ANALYZERS[self.analyzer]
        text = F.coalesce("text", F.lit(""))
        tokens = chunks.select(F.col("chunk_idx").cast("long").alias("chunk_idx"), analyze(text).alias("terms"))
        return self._add(parts_of(tokens), chunks.agg(F.count(F.lit(1)).alias("chunks")), [])

    def compact(self) -> str:
        """All segments as one; readers see the old segments or the new one."""
        old = self.segments()
        return self._add(self.blocks().select(*_PART), self._table("stats").agg(F.sum("chunks").alias("chunks")), old)

    def _add(self, parts: DataFrame, chunks: DataFrame, replaced: list[str]) -> str:
        name = f"s{uuid.uuid4().hex}"
        target = f"{self.root}/{name}"
        blocks_of(parts).write.partitionBy("bucket").parquet(f"{target}/blocks")
        # The number of terms comes from the blocks, so the text is analyzed once.
        tf = self.spark.read.schema(_SCHEMAS["blocks"]).parquet(f"{target}/blocks").select(
            F.aggregate("tf", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")
        )
        total = tf.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        stats = chunks.select(F.coalesce("chunks", F.lit(0)).alias("chunks")).crossJoin(total)
        stats.coalesce(1).write.parquet(f"{target}/stats")
        state = self._state()
        self._publish(state["analyzer"], [s for s in state["segments"] if s not in replaced] + [name])
        self._drop(replaced)
        return name

    def _table(self, kind: str) -> DataFrame | None:
        parts = [f"{self.root}/{name}" for name in self.segments()]
        tables = [self.spark.read.schema(_SCHEMAS[kind]).parquet(f"{p}/{kind}") for p in parts]
        if not tables:
            return self.spark.createDataFrame([], _SCHEMAS[kind])
        out = tables[0]
        for more in tables[1:]:
            out = out.unionByName(more)
        return out

    def blocks(self) -> DataFrame:
        return self._table("blocks")

    def totals(self) -> tuple[int, int]:
        """Number of chunks and of terms in them."""
        row = self._table("stats").agg(F.sum("chunks").alias("chunks"), F.sum("total").alias("total")).first()
        return row["chunks"] or 0, row["total"] or 0

    def topk(self, batch: QueryBatch, k: int, p: SearchParams = SearchParams()) -> DataFrame:
        """The k best chunks of every query: ``(qid, chunk_idx, score, lexical_rank)``."""
        if batch.analyzer is not ANALYZERS[self.analyzer]:
            raise ValueError(f"the queries are not analyzed as this index: {self.analyzer}")
        return rank_scores(self.scores(batch, k, p), k, "lexical_rank")

    def scores(self, batch: QueryBatch, k: int, p: SearchParams = SearchParams()) -> DataFrame:
        """``(qid, chunk_idx, score)`` of chunks among which each query's k best are."""
        chunks, total = self.totals()
        mean_length = total / chunks if chunks else 1.0
        asked = self._asked(batch, chunks)
        bounds = checkpointed(self._bounds(batch, asked, mean_length, p))
        best = Window.partitionBy("qid").orderBy(F.desc("bound"), "range")
        placed = bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= SEED_RANGES)
        seeds = checkpointed(placed.select("qid", "range"))
        seeded = rank_scores(self._scored(batch, asked, seeds, mean_length, k, p), k, "place")
        seeded = checkpointed(seeded)
        rest = bounds.join(batch.sized(seeds), ["qid", "range"], "left_anti").join(
            batch.sized(threshold(seeded, k)), "qid", "left"
        )
        rest = rest.where(reaches(F.col("bound"))).select("qid", "range")
        more = self._scored(batch, asked, rest, mean_length, k, p)
        return seeded.select("qid", "chunk_idx", "score").unionByName(more)

    def _asked(self, batch: QueryBatch, chunks: int) -> DataFrame:
        """``(qid, term, weight, bucket)`` of the query terms that the index holds."""
        wanted = batch.df.select("qid", F.explode(F.array_distinct(batch.analyzer(F.col("query")))).alias("term"))
        wanted = checkpointed(wanted.withColumn("bucket", bucket_of(F.col("term"))))
        frequency = (
            self._pruned(batch, wanted, self.blocks())
            .join(batch.sized(wanted.select("bucket", "term").distinct()), ["bucket", "term"])
            .groupBy("term")
            .agg(F.sum("entries").alias("df"))
        )
        found = wanted.join(batch.sized(frequency), "term")
        return checkpointed(found.select("qid", "term", "bucket", idf(chunks, F.col("df")).alias("weight")))

    def _pruned(self, batch: QueryBatch, wanted: DataFrame, blocks: DataFrame) -> DataFrame:
        """A small batch's terms lie in known buckets, so other folders are not listed for reading."""
        if not batch.small:
            return blocks
        buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
        return blocks.where(F.col("bucket").isin(buckets))

    def _bounds(self, batch: QueryBatch, asked: DataFrame, mean_length: float, p: SearchParams) -> DataFrame:
        """``(qid, range, bound)``: no chunk of the range scores more for the query."""
        limit = F.col("weight") * term_weight(F.col("max_tf"), F.col("min_length"), mean_length, p)
        blocks = self._pruned(batch, asked, self.blocks()).select("bucket", "term", "range", "max_tf", "min_length")
        return (
            blocks.join(batch.sized(asked), ["bucket", "term"])
            .groupBy("qid", "range")
            .agg(F.sum(limit).alias("bound"))
        )

    def _scored(
        self, batch: QueryBatch, asked: DataFrame, ranges: DataFrame, mean_length: float, k: int, p: SearchParams
    ) -> DataFrame:
        """Scores of all chunks of the ranges; only the blocks of their terms are unpacked."""
        if batch.small:
            return self._scored_by_range(batch, asked, ranges, mean_length, k, p)
        wanted = ranges.join(batch.sized(asked), "qid")
        found = self._pruned(batch, asked, self.blocks()).join(wanted, ["bucket", "term", "range"])
        rows = found.select("qid", "range", "weight", unpacked())
        gain = F.col("weight") * term_weight(F.col("entry.tf"), F.col("entry.length"), mean_length, p)
        chunk = (F.col("range") * RANGE + F.col("entry.at")).alias("chunk_idx")
        return rows.groupBy("qid", chunk).agg(F.sum(gain).alias("score"))

    def _scored_by_range(
        self, batch: QueryBatch, asked: DataFrame, ranges: DataFrame, mean_length: float, k: int, p: SearchParams
    ) -> DataFrame:
        """As ``_scored``, but a task's k best per query alone: blocks of the terms asked for meet by
        range, with the queries that want the range, and are added up there."""
        position = {qid: n for n, qid in enumerate(batch.qids.to_pylist())}
        lists: dict[str, list[tuple[int, float]]] = {}
        for r in asked.collect():
            lists.setdefault(r["term"], []).append((position[r["qid"]], r["weight"]))
        shared = self.spark.sparkContext.broadcast((batch.qids, lists))
        wanted = ranges.groupBy("range").agg(F.collect_set("qid").alias("qids"))
        blocks = (
            self._pruned(batch, asked, self.blocks())
            .join(F.broadcast(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
            .join(ranges.select("range").distinct(), "range", "left_semi")
        )
        rows = blocks.select(*_PART).unionByName(wanted, allowMissingColumns=True)
        # A range's queries, which have no term, come before its blocks. Both sides of the union lie by
        # range already, but read apart by adaptive execution: another key keeps the exchange.
        met = rows.repartition(F.xxhash64("range")).sortWithinPartitions("range", F.asc_nulls_first("term"))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, lists = shared.value
            best, cells, now, open_to = TaskTopK(len(qids), k), None, None, None

            def close() -> None:
                if cells is not None:
                    found = cells[:, open_to]
                    hit = np.flatnonzero(found.any(axis=1))
                    block = np.full((hit.size, len(qids)), np.nan)
                    block[:, open_to] = np.where(found[hit] > 0, found[hit], np.nan)
                    best.offer(now * RANGE + hit, block)

            for part in batches:
                ats, tfs, sizes = (part.column(name) for name in ("at", "tf", "length"))
                wants = part.column("qids")
                for n, (start, term) in enumerate(zip(part.column("range").to_pylist(), part.column("term").to_pylist())):
                    if term is None:
                        close()
                        cells, now = np.zeros((RANGE, len(qids))), start
                        open_to = np.array([position[q] for q in wants[n].as_py()])
                        continue
                    at, tf, size = (x[n].values.to_numpy() for x in (ats, tfs, sizes))
                    gain = term_weight(tf, size, mean_length, p)
                    for query, weight in lists[term]:
                        cells[at, query] += weight * gain
            close()
            yield best.to_batch(qids)

        schema = StructType(
            [StructField("qid", batch.qid_type), StructField("chunk_idx", LongType()), StructField("score", DoubleType())]
        )
        return met.mapInArrow(score, schema)


def threshold(seeded: DataFrame, k: int) -> DataFrame:
    """``(qid, least)``: the k-th best score found so far; queries with fewer have none."""
    return seeded.where(F.col("place") == k).select("qid", F.col("score").alias("least"))


def reaches(bound: Column) -> Column:
    """Whether a bound may reach ``least``; scores that round alike tie."""
    return F.col("least").isNull() | (bound >= F.col("least") - 2 * 10.0**-SCORE_DIGITS)


_SCHEMAS = {
    "blocks": "term string, range long, entries int, max_tf int, min_length int, at array<smallint>, "
    "tf array<int>, length array<int>, bucket int",
    "parts": "term string, range long, at array<smallint>, tf array<int>, length array<int>",
    "merged": "bucket int, term string, range long, entries int, max_tf int, min_length int, at array<smallint>, "
    "tf array<int>, length array<int>",
    "stats": "chunks long, total long",
}
_PART = ["term", "range", "at", "tf", "length"]
_BLOCK = ["bucket", "term", "range", "entries", "max_tf", "min_length", "at", "tf", "length"]
