"""Session settings, the shared work folder and stored intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

PARTITION_BYTES = 256 * 1024 * 1024

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app="keelson", master=None, shuffle_partitions=None, data_bytes=None, **conf
) -> SparkSession:
    """A session with adaptive execution.

    ``data_bytes``, the size of the largest table, sets how many shuffle partitions a stage
    starts with: PARTITION_BYTES each, which adaptive execution joins where a stage has less.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if data_bytes:
        initial = max(200, data_bytes // PARTITION_BYTES)
        builder = builder.config(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial)
        )
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the checkpoint folder, else inside the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return spark.sparkContext.getCheckpointDir() or os.path.join(
        spark.conf.get("spark.sql.warehouse.dir"), "keelson-work"
    )


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later branches then read columns of a table instead of repeating the work, and a lost
    executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    target = os.path.join(work_dir(spark), f"keelson-{uuid.uuid4().hex}")
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
