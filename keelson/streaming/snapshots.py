"""Arriving snapshots compared with a stored baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from keelson.config import Policy
from keelson.operators.diff import integrity_diff
from keelson.schemas import FILE_SNAPSHOT
from keelson.session import materialise
from keelson.sinks.baseline import read_baseline
from keelson.sources.logs import path_exists

SCAN = ["host", "scan_id"]
#: Rows of a snapshot with the scan they belong to and how many rows that scan has.
ARRIVING = T.StructType(
    [*FILE_SNAPSHOT.fields, T.StructField("scan_id", T.StringType(), False), T.StructField("scan_rows", T.LongType(), False)]
)
OPEN = "host string, scan_id string, scan_rows bigint, n bigint, first_batch bigint"


@dataclass(frozen=True)
class LiveDiff:
    """Findings of complete host scans as they arrive, for ``foreachBatch``.

    A scan may span batches: its rows wait until all ``scan_rows`` have come, so a host that is only
    partly there never looks as if files were deleted. Rows of scans that a batch does not finish are
    stored once, in that batch's folder, with a small table of the scans still open; the batch that
    finishes a scan reads the folders since its first row. Only the baseline folders of the finished
    hosts are read. Each batch writes folders of its own, so a repeated batch adds nothing.
    """

    baseline: str
    target: str
    policy: Policy = Policy()

    def _folder(self, name: str, batch: int) -> str:
        return f"{self.target}/{name}/batch={batch:012d}"

    def _open(self, spark: SparkSession, batch: int) -> DataFrame:
        """The scans open after a batch."""
        if batch < 0:
            return spark.createDataFrame([], OPEN)
        if not path_exists(spark, self._folder("open", batch)):
            raise ValueError(f"the open scans of batch {batch} are missing in {self.target}")
        return spark.read.schema(OPEN).parquet(self._folder("open", batch))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*ARRIVING.fieldNames()).persist()
        try:
            self._process(spark, rows, batch_id)
        finally:
            rows.unpersist()

    def _process(self, spark: SparkSession, rows: DataFrame, batch_id: int) -> None:
        came = rows.groupBy(*SCAN).agg(
            F.max("scan_rows").alias("scan_rows"), F.count(F.lit(1)).alias("n"),
            F.lit(batch_id).cast("long").alias("first_batch"),
        )
        scans = materialise(
            self._open(spark, batch_id - 1).unionByName(came).groupBy(*SCAN).agg(
                F.max("scan_rows").alias("scan_rows"), F.sum("n").alias("n"),
                F.min("first_batch").alias("first_batch"),
            )
        )
        done, waiting = scans.filter("n >= scan_rows"), scans.filter("n < scan_rows")
        left = rows.join(waiting.select(*SCAN), SCAN, "left_semi")
        left.write.mode("overwrite").parquet(self._folder("rows", batch_id))
        waiting.write.mode("overwrite").parquet(self._folder("open", batch_id))
        current = rows
        first = done.agg(F.min("first_batch")).first()[0]
        since = [self._folder("rows", b) for b in range(batch_id if first is None else first, batch_id)]
        if since:
            current = current.unionByName(spark.read.schema(ARRIVING).parquet(*since))
        current = current.join(done.select(*SCAN), SCAN, "left_semi").select(*FILE_SNAPSHOT.fieldNames())
        stored = read_baseline(spark, self.baseline, hosts=done)
        found = integrity_diff(stored, current, self.policy)
        found.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(self._folder("findings", batch_id))

    def findings(self, spark: SparkSession) -> DataFrame:
        """What all batches found."""
        return spark.read.parquet(f"{self.target}/findings/batch=*")

    def start(self, snapshots: DataFrame, checkpoint: str, every: str | None = None):
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return (
            snapshots.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
