"""Audit events forwarded to a durable sink."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


def forward_audit(
    lines: DataFrame,
    sinks: list[Callable[[DataFrame, int], None]],
    checkpoint: str,
    required: bool = False,
    every: str | None = None,
):
    """Send audit lines to every sink. All sinks are tried; with ``required`` a failure then
    fails the query, and the batch is repeated on restart, otherwise it is logged."""

    def send(batch: DataFrame, batch_id: int) -> None:
        errors = []
        for sink in sinks:
            try:
                sink(batch, batch_id)
            except Exception as error:  # a sink may fail in any way of its own
                errors.append(error)
                log.warning("audit sink failed in batch %s: %s", batch_id, error)
        if errors and required:
            raise RuntimeError(f"audit forwarding failed: {errors[0]}") from errors[0]

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        lines.writeStream.foreachBatch(send)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a folder of its own, so that repeats overwrite it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return write
