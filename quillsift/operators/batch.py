"""A batch of queries and whether it is small enough to ship to every task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from quillsift.functions.text import terms
from quillsift.functions.validate import query_ok, resolve_max_tokens, resolve_top_k

Analyzer = Callable[[Column], Column]

# A batch over either bound takes the shuffle paths instead of broadcasts.
MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class QueryBatch:
    """Queries ``(qid, query, qvec[, top_k, max_tokens])`` plus their measured size.

    ``rows`` holds the queries on the driver only when their number and bytes are
    within the bounds, and ``df`` then reads from them; it is None for a batch that
    must stay distributed. ``analyzer`` turns text into terms, for the queries and
    for the chunks they are matched with. ``refused`` holds the qids of invalid
    queries, which are answered by a decision alone.
    """

    df: DataFrame
    rows: tuple[Row, ...] | None
    analyzer: Analyzer = terms
    refused: DataFrame | None = None

    @classmethod
    def measure(
        cls,
        queries: DataFrame,
        max_queries: int = MAX_BROADCAST_QUERIES,
        max_bytes: int = MAX_BROADCAST_BYTES,
        analyzer: Analyzer = terms,
    ) -> QueryBatch:
        """Check the queries and fetch them only when they are few and short.

        Invalid queries (null, empty or over the length limit) go to ``refused``,
        so one more row than the bound is itself of bounded size.
        """
        valid = F.coalesce(query_ok(F.col("query")), F.lit(False))
        refused = queries.where(~valid).select("qid")
        have = set(queries.columns)
        top_k = F.col("top_k") if "top_k" in have else F.lit(None).cast("int")
        budget = F.col("max_tokens") if "max_tokens" in have else F.lit(None).cast("int")
        df = queries.where(valid).select(
            "qid",
            "query",
            F.col("qvec").cast("array<double>").alias("qvec"),
            resolve_top_k(top_k).cast("int").alias("top_k"),
            resolve_max_tokens(budget).cast("int").alias("max_tokens"),
        )
        fetched = (
            df.withColumn("terms", F.array_distinct(analyzer(F.col("query"))))
            .limit(max_queries + 1)
            .collect()
        )
        size = sum(len(r["query"].encode()) + 8 * len(r["qvec"]) for r in fetched)
        small = len(fetched) <= max_queries and size <= max_bytes
        if not small:
            return cls(df, None, analyzer, refused)
        arrow = to_arrow_schema(df.schema)
        columns = [pa.array([r[f.name] for r in fetched], f.type) for f in arrow]
        local = df.sparkSession.createDataFrame(pa.Table.from_arrays(columns, schema=arrow))
        return cls(local, tuple(fetched), analyzer, refused)

    @property
    def small(self) -> bool:
        return self.rows is not None

    @property
    def qid_type(self):
        return self.df.schema["qid"].dataType

    @cached_property
    def qids(self) -> pa.Array:
        return pa.array([r["qid"] for r in self.rows], type=to_arrow_type(self.qid_type))

    @cached_property
    def matrix(self) -> np.ndarray:
        return np.array([r["qvec"] for r in self.rows], dtype=np.float64)

    def sized(self, df: DataFrame) -> DataFrame:
        """Mark a table of a few rows per query for broadcast when the batch is small.

        Its row count is the query count times a pool size, so the measured bound
        on the queries bounds it too.
        """
        return F.broadcast(df) if self.small else df
