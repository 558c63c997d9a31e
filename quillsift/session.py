"""Session settings the engine is tuned for, and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents travel in these batches, so rows are few and bytes capped.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

BATCH_BYTES = 4 * 1024 * 1024


def build_session(app: str = "quillsift", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core on a table too small to give each core a full scan split.

    A larger table is returned as it is, without an exchange; a small one is
    hashed by ``keys`` so that costly expressions on its rows do not all run in
    one task. The size is the optimizer's estimate, so nothing is executed here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) >= cores * split:
        return df
    return df.repartition(cores, *keys)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Mark a table for broadcast after counting that it is small.

    Meant for narrow lookup tables of one row per group. A larger one is returned
    unmarked and joins through a shuffle, where adaptive execution splits hot keys.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` from here on, in whatever the session runs.

    For jobs of several stages that carry whole documents: by Spark's default each task holds batches of
    64 MB on both sides of its Python worker, beside what earlier stages left there. Results stay the same.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the cluster.

    Where it is unset, as in tests, a folder in the warehouse; on a cluster that one must not be a
    machine's own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
