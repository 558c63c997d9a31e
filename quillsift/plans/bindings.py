"""How the provided tables play the roles of the retrieval data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from quillsift.operators.batch import QueryBatch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is one chunk of the page named by its source and language."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_idx"),
        F.concat("source", F.lit("/"), "lang", F.lit(".md")).alias("source_url"),
        F.col("lang").alias("heading_path"),
        F.lit(None).cast("string").alias("api_version"),
        F.lit("Info").alias("chunk_type"),
        "text",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_idx"), "embedding"
    )


def blend_weight(item: Column) -> Column:
    """Weight of the second vector; spreads the queries over the confidence bands."""
    band = item % 4
    return (
        F.when(band == 0, 0.0).when(band == 1, 0.5).when(band == 2, 0.65).otherwise(0.75)
    )


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item is a query: its text, and a blend of two stored vectors."""
    items = table(spark, folder, "benchmark")
    stored = table(spark, folder, "embeddings")
    first = stored.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("_a"))
    second = stored.select((F.col("vec_id") - 1).alias("item_id"), F.col("embedding").alias("_b"))
    weight = blend_weight(F.col("item_id"))
    return (
        items.join(first, "item_id")
        .join(second, "item_id")
        .select(
            F.col("item_id").alias("qid"),
            F.col("text").alias("query"),
            F.zip_with(
                "_a", "_b", lambda a, b: a.cast("double") + weight * b.cast("double")
            ).alias("qvec"),
        )
    )


def batch(spark: SparkSession, folder: str) -> QueryBatch:
    return QueryBatch.measure(queries(spark, folder))


def as_output(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as long, doubles rounded: what a registered query returns."""
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, IntegerType):
            col = col.cast("long")
        elif isinstance(field.dataType, DoubleType):
            col = F.round(col, digits)
        columns.append(col.alias(field.name))
    return df.select(*columns)
