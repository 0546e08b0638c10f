"""Paths all executors share, and how much of a table one Python worker holds at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints/tessella"
BATCH_ROWS, BATCH_BYTES = 256, "4m"


def fresh_path(spark: SparkSession, what: str) -> str:
    """An unused path in the folder that ``spark.checkpoint.dir`` names; a local one only where all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL
    return f"{found.rstrip('/')}/tessella-{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, and safe from lost executors. What is one already stays as it is."""
    if getattr(df, "_is_kept", False):
        return df
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._is_kept = True
    return table


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, for texts. Results are lazy, so this stays set; a smaller limit on rows is left alone."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
