"""Log lines from text files and exported journals."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keelson.operators.ranking import rank_in_groups
from keelson.schemas import JOURNAL

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names something, on whatever filesystem it lives."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def number_lines(raw: DataFrame) -> DataFrame:
    """Add ``line_no`` to rows (file, block_start, row_id, ...).

    ``row_id`` grows by one per line inside a block. Only counts per block are ordered, so no
    file is ever sorted as a whole; the lines are not shuffled while Spark's measure of the block
    table lets it broadcast.
    """
    blocks = raw.groupBy("file", "block_start").agg(
        F.min("row_id").alias("_first_id"), F.count(F.lit(1)).alias("_lines")
    )
    earlier = Window.partitionBy("file").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = blocks.select(
        "file", "block_start", "_first_id",
        F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"),
    )
    number = F.col("row_id") - F.col("_first_id") + F.col("_before") + 1
    lost = F.raise_error(F.lit("the file splits changed between two passes")).cast("long")
    return raw.join(starts, ["file", "block_start"], "left").withColumn(
        "line_no", F.coalesce(number.cast("long"), lost)
    ).drop("_first_id", "_before", "row_id", "block_start")


def pin_splits(spark: SparkSession) -> None:
    """Keep file splits the same while executors come and go.

    Spark derives the split size of moderate inputs from the cores it has at that moment. Line
    numbers read the files in two passes, which must see the same blocks.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))


def share_listing(spark: SparkSession) -> None:
    """List very many folders in a few tasks a core, each with its share, not in up to 10,000 tasks."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(8 * spark.sparkContext.defaultParallelism))


def runs(keys: pa.Array) -> Iterator[tuple[str | None, int, int]]:
    """(key, start, end) of each run of equal keys."""
    found = pc.run_end_encode(keys)
    yield from ((k, a, b) for k, (a, b) in zip(found.values.to_pylist(), pairwise([0, *found.run_ends.to_pylist()])))


NUMBERED = pa.schema([("file", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])


def number_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines (file, line) of files that are read whole, as they come."""
    file, count = None, 0
    for batch in batches:
        numbers = np.arange(1, batch.num_rows + 1)
        for name, start, end in runs(batch.column("file")):
            if name != file:
                file, count = name, 0
            numbers[start:end] += count - start
            count += end - start
        columns = batch.column("file"), pa.array(numbers), batch.column("line")
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, NUMBERED.types)], schema=NUMBERED)


def unsplit_bytes(spark: SparkSession) -> int:
    """Size up to which Spark never splits a file."""
    conf = spark._jsparkSession.sessionState().conf()
    return min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


def joined_parts(files: DataFrame) -> DataFrame:
    """The same rows in fewer tasks, as Spark gives some 30 small files to each: 8 a core or an eighth."""
    parts = files._jdf.queryExecution().toRdd().getNumPartitions()
    most = max(8 * files.sparkSession.sparkContext.defaultParallelism, parts // 8)
    return files.coalesce(most) if parts > most else files


def read_log(spark: SparkSession, path, source: str) -> DataFrame:
    """Lines of text files: split at ``\\n``, one trailing ``\\r`` dropped, numbered from 1.

    Files that Spark does not split are read once and numbered as they come, without a shuffle; the
    lines of larger ones are counted first, by block.
    """
    pin_splits(spark)
    share_listing(spark)
    text = spark.read.option("lineSep", "\n").text(path)
    name, line = F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\\z", "").alias("line")
    whole = F.col("_metadata.file_size") <= unsplit_bytes(spark)
    small = joined_parts(text.filter(whole).select(name, line))
    small = small.mapInArrow(number_whole, "file string, line_no long, line string")
    large = number_lines(
        text.filter(~whole).select(
            name, F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row_id"), line
        )
    )
    return small.unionByName(large).select(F.lit(source).alias("source"), "file", "line_no", "line")


def read_journal(
    spark: SparkSession, path, source: str, unit=None, container=None, since=None
) -> DataFrame:
    """Messages of an exported journal (JSON lines), numbered by time within each host.

    ``since`` is a UTC time text.
    """
    rows = spark.read.schema(JOURNAL).json(path).filter(F.col("MESSAGE").isNotNull())
    at = F.col("__REALTIME_TIMESTAMP").cast("long")
    if unit is not None:
        rows = rows.filter(F.col("_SYSTEMD_UNIT") == unit)
    if container is not None:
        rows = rows.filter(F.col("CONTAINER_NAME") == container)
    if since is not None:
        rows = rows.filter(at >= F.unix_micros(F.to_timestamp(F.lit(since + "Z"))))
    order = F.concat_ws(
        "\u0000", F.lpad(F.coalesce(at, F.lit(0)).cast("string"), 20, "0"), "__CURSOR", "MESSAGE"
    )
    timed = rows.select(
        F.lit(source).alias("source"),
        F.coalesce("_HOSTNAME", F.lit("journal")).alias("file"),
        F.col("MESSAGE").alias("line"),
        order.alias("_order"),
    )
    return rank_in_groups(timed, ["file"], "_order", "line_no").select(
        "source", "file", F.col("line_no").cast("long").alias("line_no"), "line"
    )
