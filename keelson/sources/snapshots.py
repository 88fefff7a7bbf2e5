"""Collected inventories and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelson.config import Policy
from keelson.operators.scope import is_metadata_only
from keelson.functions.digests import processed_bytes
from keelson.schemas import FILE_SNAPSHOT
from keelson.sources.logs import read_log


def read_snapshot(spark: SparkSession, path) -> DataFrame:
    """Snapshot rows that agents collected, with the fixed schema."""
    return spark.read.schema(FILE_SNAPSHOT).parquet(path)


def apply_content_policy(snapshot: DataFrame, policy: Policy) -> DataFrame:
    """Drop content digests where the policy keeps metadata only, and count hashed bytes."""
    bare = is_metadata_only("path", policy) & (F.col("kind") == "file")
    hashed = F.when(
        F.col("kind") == "file", processed_bytes("size", policy.scan_byte_limit, bare)
    ).otherwise(F.lit(0).cast("long"))
    return snapshot.withColumns(
        {
            "checksum": F.when(~bare, F.col("checksum")),
            "processed_bytes": hashed,
        }
    )


def read_audit(spark: SparkSession, path, log_id: str | None = None) -> DataFrame:
    """Audit lines (log_id, seq, line); blank lines keep their number."""
    lines = read_log(spark, path, "audit")
    name = F.col("file") if log_id is None else F.lit(log_id)
    return lines.select(name.alias("log_id"), F.col("line_no").alias("seq"), "line")
