"""Table schemas and the additive migration of stored chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

CHUNKS = StructType(
    [
        StructField("chunk_idx", LongType(), False),
        StructField("heading_path", StringType(), False),
        StructField("source_url", StringType(), False),
        StructField("api_version", StringType(), True),
        StructField("chunk_type", StringType(), False),
        StructField("text", StringType(), False),
        StructField("embedding", ArrayType(FloatType()), False),
    ]
)
# Chunks per partition of a stored table.
SPAN = 1_000_000


def span_of(chunk_idx: Column) -> Column:
    return F.floor(chunk_idx / SPAN)


# Rows of a shared bundle: no vectors.
BUNDLE = "idx bigint, heading_path string, source_url string, api_version string, chunk_type string, text string"
INDEX = (
    "schema_version bigint, generated_at string, packages array<struct<docset: string, "
    "version: string, license: string, chunk_count: bigint, freshness: string, "
    "download_url: string, sha256: string, description: string>>"
)
RECEIPT = "schema_version bigint, docset string, package_version string, package_sha256 string, manifest_sha256 string"
SUITE = StructType(
    [
        *[
            StructField(n, StringType())
            for n in ("id", "docset", "query", "intent_family", "split", "query_form", "query_class")
        ],
        StructField(
            "targets",
            ArrayType(
                StructType(
                    [
                        StructField("source_url", StringType()),
                        StructField("heading_path_prefix", StringType()),
                        StructField("grade", IntegerType()),
                    ]
                )
            ),
        ),
    ]
)


class SchemaError(ValueError):
    """A stored table cannot be read as the wanted schema."""


def ensure_schema(df: DataFrame, wanted: StructType = CHUNKS) -> DataFrame:
    """The table with every wanted column; absent nullable ones come as nulls.

    A column of another type, or an absent required one, is an error that asks
    for a rebuild.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for field in wanted.fields:
        if field.name not in have:
            if not field.nullable:
                raise SchemaError(f"column {field.name} is missing: rebuild the docset")
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif have[field.name].simpleString() != field.dataType.simpleString():
            raise SchemaError(
                f"column {field.name} is {have[field.name].simpleString()}, "
                f"not {field.dataType.simpleString()}: rebuild the docset"
            )
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)
