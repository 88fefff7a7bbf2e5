"""Live log audit on Structured Streaming."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from keelson.config import LogAudit, LogSource
from keelson.operators import logreport as R
from keelson.operators.rules import match_events
from keelson.session import materialise
from keelson.sources.logs import path_exists

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOG = ["source", "file"]


def stream_text(spark: SparkSession, path: str, source: str) -> DataFrame:
    """New text files of a folder as lines. Streams carry no line numbers of their own: a
    producer that numbers its lines sends them as a column instead."""
    text = spark.readStream.option("lineSep", "\n").text(path)
    return text.select(
        F.lit(source).alias("source"),
        F.col("_metadata.file_path").alias("file"),
        F.regexp_replace("value", "\r\\z", "").alias("line"),
    )


def live_events(lines: DataFrame, audit: LogAudit, source: LogSource) -> DataFrame:
    """Match events as lines arrive: stateless, append mode, Catalyst only."""
    return match_events(lines, source, audit.rules_of(source))


def merge_groups(groups: DataFrame, by) -> DataFrame:
    """Combine partial groups of the same logs; order is (file, line number)."""
    start = F.struct("file", F.col("first.line_no"))
    newest = F.coalesce("last", "first")
    end = F.struct("file", newest["line_no"])
    merged = groups.groupBy(*by, "key").agg(
        F.min_by("description", start).alias("description"),
        F.max("risk").alias("risk"),
        F.sum("count").alias("count"),
        F.min_by("first", start).alias("first"),
        F.max_by(newest, end).alias("_last"),
    )
    return merged.withColumn("last", F.when(F.col("count") > 1, F.col("_last"))).drop("_last")


STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LINE_BLOCK = 1024  # lines of a wide log that share a part
WIDE_LINES = 65_536  # lines of a batch from which on a log is wide

TOTALS = "line_count bigint, last_reset bigint"
GROUP = (
    "description string, risk int, count bigint, first_at array<bigint>, first_line string, "
    "last_at array<bigint>, last_line string"
)
CHANGES = f"source string, file string, part int, key string, {GROUP}"
_AT = ["line_no", "rule_idx", "selector_idx"]
_Change = Row(*[f.split()[0] for f in CHANGES.split(", ")])


class LogState(StatefulProcessor):
    """What one part of one log has collected since its last reset.

    ``totals`` counts the lines (in the log's first part) and holds the last reset; ``groups`` maps a
    key to its count, risk, first and last line. A reset clears what stands before it; later lines
    numbered before it are not counted. A batch has few rows for each of very many parts: rows are
    read one by one, without a table of each part's, and each question to the state store takes as long
    as many rows, so a group is asked for only if it can be there.
    """

    def init(self, handle):
        self.totals = handle.getValueState("totals", TOTALS)
        self.groups = handle.getMapState("groups", "key string", GROUP)

    def handleInputRows(self, key, rows, timer_values):
        # All rows of the batch are needed before the first event counts: a reset may come last.
        state = self.totals.get()
        line_count, reset = state if state else (0, None)
        known = newest = -1 if reset is None else reset
        events = []
        for row in rows:
            line_count += row["lines"]
            if row["reset"] is not None and row["reset"] > newest:
                newest = row["reset"]
            if row["key"] is not None and row["line_no"] > newest:
                events.append(row)
        changed = {}
        for row in events:
            if row["line_no"] > newest:
                at = [row[c] for c in _AT]
                new = (row["description"], row["risk"], 1, at, row["line"], at, row["line"])
                name = row["key"]
                changed[name] = merged(changed[name], new) if name in changed else new
        if not state:
            held = {}
        elif newest > known:
            held, ended = {}, []
            for k, v in self.groups.iterator():
                if v[5][0] > newest:
                    if k[0] in changed:
                        held[k[0]] = v
                elif k[0] not in changed:
                    ended.append(k)
            for k in ended:
                self.groups.removeKey(k)
        else:
            held = {name: self.groups.getValue((name,)) for name in changed}
        # A part that neither has new lines nor a new reset keeps its totals as they are.
        totals = (line_count, newest if newest >= 0 else None)
        if not state or totals != tuple(state):
            self.totals.update(totals)
        for name, new in changed.items():
            if held.get(name) is not None:
                new = merged(held[name], new)
            self.groups.updateValue((name,), new)
            yield _Change(*key, name, *new)

    def close(self):
        pass


def merged(old, new) -> tuple:
    """Two groups of one key as one."""
    first, last = (old if old[3] <= new[3] else new), (old if old[5] >= new[5] else new)
    return first[0], max(old[1], new[1]), old[2] + new[2], first[3], first[4], last[5], last[6]


def _marked(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """Add ``_wide``, true for rows of wide logs and null for others."""
    named = wide.select(*[F.col(c).alias(f"_{c}") for c in LOG], F.lit(True).alias("_wide"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LOG]
    return rows.join(F.broadcast(named), same, "left").drop(*[f"_{c}" for c in LOG])


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a folder its name, in one step where the file system has one."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(new).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(new).getParent())
    if not files.rename(path(old), path(new)):
        raise OSError(f"cannot rename {old} to {new}")


class _Rocks:
    """The state store that keyed state needs, set while a query starts or its state is read."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(_PROVIDER, None)
        self.conf.set(_PROVIDER, STATE)

    def __exit__(self, *error):
        if self.before is None:
            self.conf.unset(_PROVIDER)
        else:
            self.conf.set(_PROVIDER, self.before)


@dataclass(frozen=True)
class RunningReport:
    """Grouped report over an endless log, held in keyed state.

    A log's state is one part, until a batch brings WIDE_LINES lines of it: from then on it is cut into
    ``parts`` by blocks of line numbers, so neither a hot log nor a hot key becomes one task, and a
    reset reaches all of them. Very many small logs cost one part each. A batch counts its logs, stores
    its rows with their parts, and a second stream takes these into the state; it reads and writes the
    state of its own logs only. A repeated batch finds its rows stored and adds nothing. Lines are
    (source, file, line_no, line) and reach later batches in order per file. The groups that a batch
    changed are appended to ``target``/changes.
    """

    audit: LogAudit
    source: LogSource
    target: str
    parts: int = 16

    @property
    def checkpoint(self) -> str:
        """Of the state; the stream of lines has its own."""
        return f"{self.target}/groups"

    def _events(self, lines: DataFrame, wide: DataFrame) -> DataFrame:
        pattern = self.audit.group_pattern(self.source) or r"[^\s\S]"
        events = match_events(lines, self.source, self.audit.rules_of(self.source))
        block = F.pmod(F.xxhash64(F.floor(F.col("line_no") / LINE_BLOCK)), F.lit(self.parts)).cast("int")
        return _marked(events, wide).select(
            *LOG, F.when(F.col("_wide"), block).otherwise(0).alias("part"), F.lit(0).cast("bigint").alias("lines"),
            F.lit(None).cast("bigint").alias("reset"), R.group_key(pattern).alias("key"),
            F.col("selector_desc").alias("description"), "risk", "line",
            *[F.col(c).cast("bigint").alias(c) for c in _AT],
        )

    def _totals(self, lines: DataFrame) -> DataFrame:
        """Lines of each log, in its first part, and its last reset, in every part."""
        counted = R.log_totals(lines, self.source.reset or None)
        every = F.when(F.col("last_reset").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(self.parts - 1)))
        none = {"key": "string", "description": "string", "risk": "int", "line": "string", **{c: "bigint" for c in _AT}}
        rows = counted.select("*", F.explode(every).alias("part"))
        return rows.select(
            *LOG, "part", F.when(F.col("part") == 0, F.col("line_count")).otherwise(0).alias("lines"),
            F.col("last_reset").alias("reset"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
        )

    def _wide(self, totals: DataFrame, batch_id: int) -> DataFrame:
        """The logs that are wide as of a batch; there are few, as each has very many lines."""
        spark = totals.sparkSession
        now = totals.filter(F.col("lines") >= WIDE_LINES).select(*LOG)
        if not now.isEmpty():
            now.write.mode("overwrite").parquet(f"{self.target}/wide/{batch_id:012d}")
        if not path_exists(spark, f"{self.target}/wide/*"):
            return now.limit(0)
        return spark.read.schema(now.schema).parquet(f"{self.target}/wide/*").distinct()

    def _take(self, lines: DataFrame, batch_id: int) -> None:
        """A batch's rows are stored once, under a name that only a whole set of rows has; the state takes them."""
        spark = lines.sparkSession
        rows = f"{self.target}/rows/{batch_id:012d}"
        if not path_exists(spark, rows):
            totals = materialise(self._totals(lines))
            wide = self._wide(totals, batch_id)
            used = _marked(totals, wide).filter("part = 0 OR _wide").drop("_wide")
            unnamed = f"{self.target}/unnamed"
            self._events(lines, wide).unionByName(used).write.mode("overwrite").parquet(unnamed)
            _rename(spark, unnamed, rows)
        schema = spark.read.parquet(rows).schema
        dealt = spark.readStream.schema(schema).parquet(f"{self.target}/rows/*")
        changes = dealt.groupBy(*LOG, "part").transformWithState(LogState(), CHANGES, "Append", "None")
        writer = (
            changes.writeStream.format("parquet").outputMode("append")
            .option("path", f"{self.target}/changes").option("checkpointLocation", self.checkpoint)
        )
        with _Rocks(spark):
            taken = writer.trigger(availableNow=True).start()
        taken.awaitTermination()

    def start(self, lines: DataFrame, every: str | None = None):
        """Run once over what is there, or with a period such as ``1 minute``."""
        lines = lines.select(*LOG, "line_no", "line")
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return (
            lines.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.target}/checkpoint")
            .trigger(**trigger).start()
        )

    def state(self, spark: SparkSession, name: str, batch: int | None = None) -> DataFrame:
        """A state variable of every part of every log, as of the last or a given batch."""
        reader = spark.read.format("statestore").option("stateVarName", name)
        with _Rocks(spark):
            return (reader if batch is None else reader.option("batchId", batch)).load(self.checkpoint)

    def report(self, spark: SparkSession, by=("source",), batch: int | None = None):
        """Report rows and summary as of the last or a given batch."""
        value = F.col("user_map_value")
        example = lambda end: F.struct(value[f"{end}_at"][0].alias("line_no"), value[f"{end}_line"].alias("line"))
        groups = self.state(spark, "groups", batch).select(
            "key.source", "key.file", F.col("user_map_key.key").alias("key"), value["description"].alias("description"),
            value["risk"].alias("risk"), value["count"].alias("count"), example("first").alias("first"),
            F.when(value["count"] > 1, example("last")).alias("last"),
        )
        groups = merge_groups(groups, by)
        totals = self.state(spark, "totals", batch).select("key.source", "key.file", "value.*")
        matched = groups.groupBy(*by).agg(F.sum("count").alias("match_count"))
        summary = (
            totals.groupBy(*by)
            .agg(F.sum("line_count").alias("line_count"), F.max(F.col("last_reset").isNotNull()).alias("reset_occurred"))
            .join(matched, list(by), "left").na.fill(0, ["match_count"])
        )
        return R.top_groups(groups, self.source.top, by), summary
