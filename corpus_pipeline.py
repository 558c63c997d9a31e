"""A training-data pipeline over ``documents``: filter, deduplicate and pack.

Each stage works on all that its predecessor kept. ``run`` writes a stage's rows as Parquet into
the shared folder and reads them again as the next one's documents. Stages share executors, so each
asks the session for small Arrow batches (``small_batches``), which stay small for what runs after it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillsift.llm import exact_dedup, language_id, ngram_join, packing, quality
from quillsift.session import shared_folder, small_batches


#: A near copy shares five-word shingles to a Jaccard similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: those without letters, and those unlike every profile."""
    small_batches(spark)
    return language_id.accepted(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below its threshold go."""
    small_batches(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    small_batches(spark)
    return ngram_join.representatives(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents and their places in training sequences."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.balanced_steps(packing.pack_documents(docs, path)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("packing", pack),
]

#: SQL can state neither the trained filters nor the tokenizer; tests/llm compares brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
