"""What the operators of this folder share."""

from __future__ import annotations

import ctypes
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keelson import session

#: Shuffle files of a step go when its table is written, not when the driver's memory is collected.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For rows of many megabytes: a task reads and sends them one by one.
ONE_BY_ONE = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
    "spark.sql.parquet.columnarReaderBatchSize": "1",
}


def lean(run):
    """``run`` for mapInArrow, after which the worker hands back memory that it no longer uses.

    Workers are kept for later tasks and stages, which else add theirs to the most of each one before.
    """

    def task(batches):
        yield from run(batches)
        del batches
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return task


def materialise(df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back; its shuffle files are removed.

    ``settings`` of the session hold while it is written.
    """
    conf = df.sparkSession.conf
    settings = {_TIDY: "true", **(settings or {})}
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        return session.materialise(df)
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def py_fold(doc_id, parts: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def slim(docs: DataFrame, *names: str) -> DataFrame:
    """Only ``names``, so that other columns of the input neither travel nor clash."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
