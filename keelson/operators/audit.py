"""Hash-chained audit logs: building, verifying, reading fields."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.functions.digests import _col, text_digest
from keelson.schemas import AUDIT_LINES
from keelson.session import materialise

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The hash before the first event, and the layout of the closing hash field.
GENESIS = "0" * 64
HASH_FIELD = ',"hash":"'

# Ways in which a line can fail, in the order they are tested.
CAUSES = [
    "missing previous_hash",
    "chain mismatch",
    "missing hash",
    "unsupported hash layout",
    "hash mismatch",
]

BLOCK_LINES = 65_536
LINE_BATCH = pa.schema([("log_id", pa.string()), ("seq", pa.int64()), ("line", pa.string())])


def json_text(line, key: str) -> Column:
    """Value of the first ``"key":"value"`` in a line, unescaped; null if absent or unclosed."""
    shape = rf'(?s)"{key}":"((?:[^"\\]|\\.)*)"'
    line = _col(line)
    raw = text = F.regexp_extract(line, shape, 1)
    for escape, char in (("n", "\n"), ("r", "\r"), ("t", "\t")):
        # A control escape counts only behind an even number of backslashes.
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\{escape}", f"$1{char}")
    text = F.regexp_replace(text, r"(?s)\\(.)", "$1")
    # Most values hold no escape, and only an empty one may stand for a line without the key.
    return F.when(raw != "", F.when(raw.contains("\\"), text).otherwise(raw)).when(line.rlike(shape), raw)


def payload(line) -> Column:
    """The line without its closing hash field; null for another layout."""
    line = _col(line)
    shape = '(?s)\\A(.*),"hash":"'
    return F.when(
        line.rlike(shape) & line.endswith('"}'),
        F.concat(F.regexp_extract(line, shape, 1), F.lit("}")),
    )


def verify_lines(lines: DataFrame) -> DataFrame:
    """Add ``hash`` and ``cause`` (null when good) to audit lines (log_id, seq, line).

    A line needs only the hash of the line before it. Each line is read once: what the checks need of
    it is stored, hashes and whether its own one is right. Neighbours are found inside blocks of
    BLOCK_LINES numbers; the first line of a block gets the last hash of the earlier blocks, so
    a log of any length is verified by many tasks.
    """
    block = F.floor(F.col("seq") / BLOCK_LINES)
    own_hash, expected = json_text("line", "hash"), text_digest(payload("line"))
    own = materialise(
        lines.filter(F.trim("line") != "").select(
            "log_id", "seq", block.alias("_block"), own_hash.alias("hash"),
            json_text("line", "previous_hash").alias("previous_hash"),
            expected.isNull().alias("_odd"), (own_hash != expected).alias("_wrong"),
        )
    )
    # A missing hash is kept apart from "no line before".
    link = F.coalesce("hash", F.lit(""))
    heads = own.groupBy("log_id", "_block").agg(F.max_by(link, "seq").alias("_last"))
    carried = heads.select(
        "log_id", "_block",
        F.lag("_last").over(Window.partitionBy("log_id").orderBy("_block")).alias("_carried"),
    )
    within = F.lag(link).over(Window.partitionBy("log_id", "_block").orderBy("seq"))
    linked = own.withColumn("_within", within).join(carried, ["log_id", "_block"], "left")
    expected_link = F.coalesce("_within", "_carried", F.lit(GENESIS))
    tests = [
        F.col("previous_hash").isNull(),
        F.col("previous_hash") != expected_link,
        F.col("hash").isNull(),
        F.col("_odd"),
        F.col("_wrong"),
    ]
    cause = F.coalesce(*[F.when(t, F.lit(c)) for t, c in zip(tests, CAUSES)])
    return linked.select("log_id", "seq", "_block", "hash", cause.alias("cause"))


def verify_audit(lines: DataFrame) -> DataFrame:
    """Per log: verified events, last good hash, first bad line and its cause.

    As in a pass from the top, nothing behind the first bad line counts as verified. Blocks are
    summed up where they were checked; a log is then only as long as its number of blocks.
    """
    checked = verify_lines(lines)
    bad = F.col("cause").isNotNull()
    in_block = Window.partitionBy("log_id", "_block")
    good = F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))
    blocks = (
        checked.withColumn("_bad", F.min(F.when(bad, F.col("seq"))).over(in_block))
        .groupBy("log_id", "_block")
        .agg(
            F.count_if(good).alias("events"),
            F.max_by("hash", F.when(good, F.col("seq"))).alias("_last"),
            F.min("_bad").alias("bad_line"),
            F.min_by("cause", F.when(bad, F.col("seq"))).alias("cause"),
        )
        .withColumn("_stop", F.min("bad_line").over(Window.partitionBy("log_id")))
    )
    return (
        blocks.filter(
            F.col("_stop").isNull() | (F.col("_block") <= F.floor(F.col("_stop") / BLOCK_LINES))
        )
        .groupBy("log_id")
        .agg(
            F.sum("events").alias("events"),
            F.coalesce(
                F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_block"))),
                F.lit(GENESIS),
            ).alias("last_hash"),
            F.min("bad_line").alias("bad_line"),
            F.min_by("cause", F.col("bad_line")).alias("cause"),
        )
    )


# Short escapes of audit text; other control characters become \\u00xx.
_ESCAPES = {c: f"\\u{c:04x}" for c in (*range(0x20), *range(0x7F, 0xA0))}
_ESCAPES.update({ord('"'): '\\"', ord("\\"): "\\\\", 10: "\\n", 13: "\\r", 9: "\\t"})


_ODD = re.compile(r'[\x00-\x1f\x7f-\x9f"\\]')


def _quoted(text: str) -> str:
    return f'"{text.translate(_ESCAPES)}"' if _ODD.search(text) else f'"{text}"'


def _seal(event: dict, previous: str) -> tuple[str, str]:
    """The line of one event behind ``previous``, and its hash."""
    body = (
        f'{{"timestamp_unix_ms":{event["timestamp_unix_ms"]},"action":{_quoted(event["action"])},'
        f'"pid":{event["pid"]},"previous_hash":{_quoted(previous)}'
    )
    for field in event["fields"] or ():
        body += f",{_quoted(field['key'])}:{_quoted(field['value'])}"
    digest = hashlib.sha256(f"{body}}}".encode()).hexdigest()
    return f'{body}{HASH_FIELD}{digest}"}}', digest


def _events(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, read column by column."""
    columns = dict(zip(batch.schema.names, batch.columns))
    fields = columns.pop("fields")
    if not (pa.types.is_list(fields.type) and pa.types.is_struct(fields.type.value_type)):
        yield from batch.to_pylist()
        return
    structs = fields.flatten()
    names = [f.name for f in structs.type]
    each = (dict(zip(names, row)) for row in zip(*(c.to_pylist() for c in structs.flatten())))
    lengths = pc.fill_null(pc.list_value_length(fields), 0).to_pylist()
    for n, *row in zip(lengths, *(c.to_pylist() for c in columns.values())):
        yield dict(zip(columns, row), fields=[*islice(each, n)])


def chain_audit(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Audit lines of events (log_id, seq, timestamp_unix_ms, action, pid, fields).

    Each line contains the hash of the one before, so a log is written in sequence; logs are
    independent. Rows stream through in order, and a task keeps one hash, never a whole log.
    ``heads`` (log_id, last_hash) continues existing logs.
    """
    if heads is None:
        linked = events.withColumn("head", F.lit(GENESIS))
    else:
        linked = events.join(
            heads.select("log_id", F.col("last_hash").alias("head")), "log_id", "left"
        ).withColumn("head", F.coalesce("head", F.lit(GENESIS)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, previous = None, None
        for batch in batches:
            lines = []
            for event in _events(batch):
                if event["log_id"] != log:
                    log, previous = event["log_id"], event["head"]
                line, previous = _seal(event, previous)
                lines.append(line)
            columns = batch.column("log_id"), batch.column("seq"), pa.array(lines, pa.string())
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, LINE_BATCH.types)], schema=LINE_BATCH)

    conf = events.sparkSession.conf
    width = conf.get(
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
        conf.get("spark.sql.shuffle.partitions"),
    )
    # A fixed number of tasks: their work is Python's, not the few bytes they read.
    ordered = (
        linked.select("log_id", "seq", "timestamp_unix_ms", "action", "pid", "fields", "head")
        .repartition(int(width), "log_id")
        .sortWithinPartitions("log_id", "seq")
    )
    return ordered.mapInArrow(write, AUDIT_LINES)
