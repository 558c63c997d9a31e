"""Connected components of a table of links, by labels that fall to the smallest id."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.session import checkpointed

#: Nodes whose tops a task holds at once.
FOREST_NODES = 1 << 18


class Tops:
    """Disjoint sets of values that fall to one top each."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def top(self, value: int) -> int:
        while value in self.above:
            parent = self.above[value]
            if parent in self.above:  # halve the way
                self.above[value] = self.above[parent]
            value = parent
        return value

    def join(self, first: int, second: int) -> bool:
        first, second = self.top(first), self.top(second)
        if first != second:
            self.above[first] = second
        return first != second


def forests(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what those of each partition connect, as stars around the smallest node."""

    def stars(tops: Tops) -> pa.RecordBatch:
        nodes = list(tops.above)
        columns = [pa.array([tops.top(n) for n in nodes], pa.int64()), pa.array(nodes, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = Tops()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                low, high = sorted((tops.top(a), tops.top(b)))
                tops.join(high, low)
            if len(tops.above) > FOREST_NODES:
                yield stars(tops)
                tops = Tops()
        if tops.above:
            yield stars(tops)

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); label is its component's smallest node.

    Each round every node takes the smallest label among its neighbours, then its label's own
    label, so chains shorten by halves. Rounds are checkpointed; no link leaves the executors.
    Before, tasks put stars in place of what their links connect, where these lie and again by the
    outer node, which is in few rows however many the centre is in. So rounds are few, and one on a
    table of one partition: each costs the driver plans, threads and memory.
    """
    links = forests(forests(links.select("a", "b").where("a <> b")).repartition("b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both.distinct())
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = checkpointed(labels.withColumnRenamed("a", "node"))
    while True:
        offered = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("offer"))
        )
        lower = labels.join(offered, labels["node"] == offered["a"]).select(
            "node", "label", F.least("label", "offer").alias("taken")
        )
        parents = labels.select(F.col("node").alias("taken"), F.col("label").alias("above"))
        moved = checkpointed(
            lower.join(parents, "taken", "left").select(
                "node", F.least("taken", "above").alias("label"), F.col("label").alias("before")
            )
        )
        labels = moved.select("node", "label")
        if moved.where("label <> before").isEmpty():
            return labels
