"""Vector expressions and the embedding interface."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillsift import params

Embedder = Callable[[Column], Column]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 when either norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def byte_embedder(dim: int = params.VECTOR_DIM) -> Embedder:
    """Deterministic stand-in for a model: unit vector of byte sums per bucket."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str) -> np.ndarray:
            raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
            lanes = np.bincount(np.arange(raw.size) % dim, weights=raw, minlength=dim)
            norm = np.sqrt((lanes * lanes).sum())
            return (lanes / norm if norm else lanes).astype(np.float32)

        return texts.map(one)

    return embed


def quantize_half(col: Column) -> Column:
    """Round every lane to half precision, ties to even, as a stored vector would be."""

    def half(lane: Column) -> Column:
        size = F.abs(lane.cast("double"))
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
        rounded = F.rint(size / step) * step
        # From here on the next step up would leave the half-precision range.
        rounded = F.when(size >= 65520, F.lit(float("inf"))).otherwise(rounded)
        return F.when(F.isnan(lane), lane).otherwise(F.signum(lane) * rounded).cast("float")

    return F.transform(col, half)
