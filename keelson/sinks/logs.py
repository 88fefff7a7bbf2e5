"""Logs as text files."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from keelson.sources.logs import runs

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: Spark's name for a missing key.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def _local(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system knows it, if it is one of its own file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return target.toUri().getPath() if scheme == "file" else None


def write_logs(lines: DataFrame, path: str) -> None:
    """One text file for each log of (log_id, seq, line), named by the log, below ``path``.

    The lines of a log must come side by side in one task and in order, as ``chain_audit`` gives them.
    Hadoop's local file system starts processes for each file that it creates: the tasks open files of
    a local or mounted path themselves, in folders of their own, and give a file its name when it is
    whole. Other stores are written by Spark, a folder for each log.
    """
    folder = _local(lines.sparkSession, path)
    if folder is None:
        ordered = lines.repartition("log_id").sortWithinPartitions("log_id", "seq")
        ordered.select("log_id", F.col("line").alias("value")).write.partitionBy("log_id").text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        mine = os.path.join(folder, f"part={task.partitionId():05d}")
        unnamed = os.path.join(mine, f"_{task.taskAttemptId()}")
        log, name, out = None, None, None
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for value, start, end in runs(batch.column(0)):
                if out is None or value != log:
                    if out is not None:
                        out.close()
                        os.replace(unnamed, name)
                    os.makedirs(mine, exist_ok=True)
                    log, out = value, open(unnamed, "wb")
                    name = os.path.join(mine, f"log_id={NO_KEY if log is None else quote(log, safe='')}.txt")
                out.write(b"".join(b"%b\n" % (t or b"") for t in texts.slice(start, end - start).to_pylist()))
        if out is not None:
            out.close()
            os.replace(unnamed, name)
        yield pa.RecordBatch.from_pydict({"files": pa.array([], pa.string())})

    lines.select("log_id", "line").mapInArrow(write, "files string").write.format("noop").mode("overwrite").save()
