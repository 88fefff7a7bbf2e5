"""Progress rates over the last seconds of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from keelson.functions.formats import format_byte_rate, format_file_rate

WINDOW_MS = 5_000  # fixed value: span of the recent rate
BUCKET_MS = 60_000  # at least; a bucket is never shorter than the window


def scan_rate(samples: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Totals gained since the sample that is at least ``window_ms`` old, per sample.

    That is the last sample at or before t - window, else the first of the run. Totals never
    fall, so the greatest (ts, files, bytes) of a range is its last sample. A run is cut into
    minutes: a sample looks into its own minute and the last seconds before it; further back
    only the last sample per minute matters, so a long run is no single task.
    """
    sample = F.struct("ts_ms", "files", "bytes")
    width = max(BUCKET_MS, window_ms)
    bucket = F.floor(F.col("ts_ms") / width)
    placed = samples.select("run_id", "ts_ms", "files", "bytes", bucket.alias("_bucket"))
    next_start = (F.col("_bucket") + 1) * width
    late = F.col("ts_ms") >= next_start - window_ms

    minutes = placed.groupBy("run_id", "_bucket").agg(
        F.min(sample).alias("_first"),
        F.max(sample).alias("_last"),
        F.max(F.when(~late, sample)).alias("_last_early"),
    )
    run = Window.partitionBy("run_id").orderBy("_bucket")
    before = F.when(
        F.lag("_bucket").over(run) == F.col("_bucket") - 1,
        F.coalesce(F.lag("_last_early").over(run), F.lag("_last", 2).over(run)),
    ).otherwise(F.lag("_last").over(run))
    context = minutes.select(
        "run_id", "_bucket", before.alias("_before"),
        F.first("_first").over(run).alias("_start"),
    )

    copies = placed.withColumn(
        "_copy",
        F.explode(
            F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        ),
    ).withColumn("_bucket", F.col("_bucket") + F.col("_copy"))
    in_range = (
        Window.partitionBy("run_id", "_bucket")
        .orderBy("ts_ms")
        .rangeBetween(Window.unboundedPreceding, -window_ms)
    )
    looked = (
        copies.withColumn("_oldest", F.max(sample).over(in_range))
        .filter(F.col("_copy") == 0)
        .join(context, ["run_id", "_bucket"])
        .withColumn("_oldest", F.coalesce("_oldest", "_before", "_start"))
    )

    def gained(now, then):
        return F.greatest(F.col(now) - then[now], F.lit(0).cast("long"))

    rated = looked.select(
        "run_id", "ts_ms", "files", "bytes",
        (F.col("ts_ms") - F.col("_start.ts_ms")).alias("average_elapsed_ms"),
        gained("files", F.col("_oldest")).alias("recent_files"),
        gained("bytes", F.col("_oldest")).alias("recent_bytes"),
        (F.col("ts_ms") - F.col("_oldest.ts_ms")).alias("recent_elapsed_ms"),
    )
    return rated.withColumns(
        {
            "recent_file_rate": format_file_rate("recent_files", "recent_elapsed_ms"),
            "recent_byte_rate": format_byte_rate("recent_bytes", "recent_elapsed_ms"),
            "average_file_rate": format_file_rate("files", "average_elapsed_ms"),
            "average_byte_rate": format_byte_rate("bytes", "average_elapsed_ms"),
        }
    )
