"""Maximal-marginal-relevance selection over each query's candidate pool."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from quillsift.operators.topk import SCORE_DIGITS
from quillsift.params import SearchParams


def mmr_select(pool: DataFrame, p: SearchParams = SearchParams(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Pick ``top_k`` diverse chunks per query.

    ``pool`` rows: ``qid, qvec, top_k, position, chunk_idx, source_url, rrf,
    dense_rank, lexical_rank, embedding`` plus any extra ``keys``; an optional
    ``relevance`` column replaces the cosine to the query, and an optional
    ``mmr_lambda`` column replaces the parameter. A pool has at most two ranked
    channels of candidates, so a group is small whatever the corpus size.
    """
    ordinal = "relevance" in pool.columns
    own_lambda = "mmr_lambda" in pool.columns
    group = ["qid", *keys]
    schema = StructType(
        [
            *[pool.schema[g] for g in group],
            StructField("mmr_rank", IntegerType()),
            StructField("chunk_idx", LongType()),
            StructField("source_url", StringType()),
            StructField("rrf", DoubleType()),
            StructField("dense_rank", IntegerType()),
            StructField("lexical_rank", IntegerType()),
            StructField("cosine", DoubleType()),
        ]
    )

    def unit(rows: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(rows, axis=-1, keepdims=True)
        return np.divide(rows, norm, out=np.zeros_like(rows), where=norm != 0)

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        known = pc.is_valid(table["embedding"]).to_numpy()
        inner = table.filter(pa.array(known))
        rest = table.filter(pa.array(~known))
        if not ordinal:
            rest = rest.sort_by([("rrf", "descending"), ("position", "ascending")])
        top_k = table["top_k"][0].as_py()
        weight = table["mmr_lambda"][0].as_py() if own_lambda else p.mmr_lambda
        chosen: list[int] = []
        cosines = np.empty(0)
        if len(inner):
            lanes = inner["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            units = unit(lanes.astype(np.float64).reshape(len(inner), -1))
            cosines = units @ unit(np.array(table["qvec"][0].as_py(), dtype=np.float64))
            relevance = inner["relevance"].to_numpy() if ordinal else cosines
            urls = inner["source_url"].to_numpy()
            nearest = np.zeros(len(units))
            same_url = np.zeros(len(units))
            free = np.ones(len(units), dtype=bool)
            while len(chosen) < top_k and free.any():
                spread = (1 - weight) * (nearest + p.url_penalty * same_url)
                score = np.round(weight * relevance - spread, SCORE_DIGITS)
                best = int(np.argmax(np.where(free, score, -np.inf)))
                chosen.append(best)
                free[best] = False
                nearest = np.maximum(nearest, units @ units[best])
                same_url += urls == urls[best]
        filler = rest.slice(0, top_k - len(chosen))
        out = pa.concat_tables([inner.take(pa.array(chosen, pa.int64())), filler])
        made = {
            "mmr_rank": pa.array(range(1, len(out) + 1), pa.int32()),
            "cosine": pa.array([*cosines[chosen], *[None] * len(filler)], pa.float64()),
        }
        names = [f.name for f in schema.fields]
        return pa.table([made[n] if n in made else out[n] for n in names], names=names)

    needed = [
        *group, "qvec", "top_k", "position", "chunk_idx", "source_url", "rrf",
        "dense_rank", "lexical_rank", "embedding",
        *(c for c, used in (("relevance", ordinal), ("mmr_lambda", own_lambda)) if used and c not in group),
    ]
    tasks = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        pool.withColumn("rrf", F.col("rrf").cast("double"))
        .select(*needed)
        .repartition(tasks, *group)
        .groupBy(*group)
        .applyInArrow(pick, schema)
    )
