"""Log reports: resets, grouped and simple reports, counts and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.config import LogSource
from keelson.functions.text import filled, first_match
from keelson.operators.ranking import first_in_groups

# The wording of the two reports.
NO_FAILURES = "No failures for {description}"
SIMPLE_HEADER = "{count} events were detected in {description}\n"
RULE_HEADER = "Rule: {name} - {description}\n"
NO_PROBLEMS = "No problems found"
RESET_NOTE = "Encountered reset marker in logs, discarded prior logs.\n\n"
GROUP_LINE = "{description} {key} (occurred: {count})\n"
FIRST_LINE = "  FIRST line: {line_no} {line}\n"
LAST_LINE = "  LAST {line_no} {line}\n"

# A log is one file of one source: line numbers and resets belong to it.
LOG = ["source", "file"]
ARRIVAL = ["file", "line_no", "rule_idx", "selector_idx"]
# Spark limits a ranked window per partition before the shuffle up to this many rows.
GROUP_LIMIT = 1000


def log_totals(lines: DataFrame, marker: str | None = None, by=("source",)) -> DataFrame:
    """Per log, its number of lines and of the last line holding the reset marker, if any.

    Without a marker only the columns naming the log are read.
    """
    reset = F.lit(None).cast("long")
    if marker:
        reset = F.max(F.when(F.col("line").contains(marker), F.col("line_no")))
    return lines.groupBy(*dict.fromkeys([*LOG, *by])).agg(
        F.count(F.lit(1)).alias("line_count"), reset.alias("last_reset")
    )


def apply_reset(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Events after the last reset of their log; ``totals`` come from ``log_totals``."""
    resets = totals.filter(F.col("last_reset").isNotNull()).select(*LOG, "last_reset")
    return (
        events.join(resets, LOG, "left")
        .filter(F.col("last_reset").isNull() | (F.col("line_no") > F.col("last_reset")))
        .drop("last_reset")
    )


def group_key(pattern: str) -> Column:
    """Text of the first match in the reported line, else the selector's description."""
    return F.coalesce(first_match("line", pattern), F.col("selector_desc"))


def group_events(events: DataFrame, pattern: str, by=("source",)) -> DataFrame:
    """Count, highest risk, first and last example per group key.

    All aggregates combine before the shuffle, so a key that holds most events sends one row
    per task.
    """
    order = F.struct(*ARRIVAL)
    example = F.struct("line_no", "line")
    keyed = events.withColumn("key", group_key(pattern))
    return (
        keyed.groupBy(*by, "key")
        .agg(
            F.min_by(F.struct("selector_desc", example.alias("example")), order).alias("_first"),
            F.max_by(example, order).alias("_last"),
            F.max("risk").alias("risk"),
            F.count(F.lit(1)).alias("count"),
        )
        .select(
            *by,
            "key",
            F.col("_first.selector_desc").alias("description"),
            "risk",
            "count",
            F.col("_first.example").alias("first"),
            F.when(F.col("count") > 1, F.col("_last")).alias("last"),
        )
    )


def first_rows(df: DataFrame, by, order, top: int, out="position") -> DataFrame:
    """The first ``top`` rows per group, numbered.

    Up to GROUP_LIMIT rows Spark itself cuts each partition to ``top`` rows of a group before the
    shuffle. For more, the rows are numbered in ranges that follow their count, so that no task
    gathers what many tasks have kept.
    """
    by = list(by)
    if top > GROUP_LIMIT:
        return first_in_groups(df, by, order, top, out)
    ranked = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(out, ranked).filter(F.col(out) <= top)


def top_groups(groups: DataFrame, top: int, by=("source",)) -> DataFrame:
    """Groups by falling risk, then falling count, then key."""
    order = [F.col("risk").desc(), F.col("count").desc(), F.col("key")]
    return first_rows(groups, by, order, top)


def top_events(events: DataFrame, top: int, by=("source",)) -> DataFrame:
    """The first ``top`` events in order of arrival, listed by rule and then by rising risk."""
    kept = first_rows(events, by, [F.col(c) for c in ARRIVAL], top, out="arrival")
    rule_place = F.min("rule_idx").over(Window.partitionBy(*by, "rule_name"))
    listed = Window.partitionBy(*by).orderBy("rule_place", "risk", "arrival")
    return (
        kept.withColumn("rule_place", rule_place)
        .withColumn("position", F.row_number().over(listed))
        .drop("rule_place")
    )


def log_summary(totals: DataFrame, events: DataFrame, by=("source",)) -> DataFrame:
    """Lines, matches and whether a reset occurred, per source.

    A reset sets the matches back to zero but not the lines: ``events`` are those after it.
    """
    counted = totals.groupBy(*by).agg(
        F.sum("line_count").alias("line_count"),
        F.max(F.col("last_reset").isNotNull()).alias("reset_occurred"),
    )
    matched = events.groupBy(*by).agg(F.count(F.lit(1)).alias("match_count"))
    return counted.join(matched, list(by), "left").select(
        *by, "line_count", F.coalesce("match_count", F.lit(0).cast("long")).alias("match_count"),
        "reset_occurred",
    )


def _joined(rows: DataFrame, by, text: Column) -> DataFrame:
    """Concatenate at most ``top`` texts per source in their order."""
    return (
        rows.select(*by, F.struct("position", text.alias("text")).alias("_part"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
        .select(*by, F.array_join(F.col("_parts.text"), "").alias("body"))
    )


def render_grouped(groups: DataFrame, summary: DataFrame, by=("source",)) -> DataFrame:
    """Text of the grouped report; ``groups`` are already limited by ``top_groups``."""
    text = F.concat(
        filled(GROUP_LINE, description=F.col("description"), key=F.col("key"),
              count=F.col("count")),
        filled(FIRST_LINE, line_no=F.col("first.line_no"), line=F.col("first.line")),
        F.coalesce(
            filled(LAST_LINE, line_no=F.col("last.line_no"), line=F.col("last.line")), F.lit("")
        ),
    )
    note = F.when(F.col("reset_occurred"), F.lit(RESET_NOTE)).otherwise("")
    return summary.join(_joined(groups, by, text), list(by), "left").select(
        *summary.columns,
        F.when(F.col("body").isNull(), F.lit(NO_PROBLEMS))
        .otherwise(F.concat(note, F.col("body")))
        .alias("report"),
    )


def render_simple(
    listed: DataFrame, summary: DataFrame, source: LogSource, by=("source",)
) -> DataFrame:
    """Text of the simple report; ``listed`` comes from ``top_events``."""
    before = F.lag("rule_name").over(Window.partitionBy(*by).orderBy("position"))
    headed = listed.withColumn("_heads", ~before.eqNullSafe(F.col("rule_name")))
    header = filled(RULE_HEADER, name=F.col("rule_name"), description=F.col("rule_description"))
    text = F.concat(F.when(F.col("_heads"), header).otherwise(""), F.col("line"), F.lit("\n"))
    name = F.lit(source.description)
    body = _joined(headed, by, text)
    return summary.join(body, list(by), "left").select(
        *summary.columns,
        F.when(F.col("match_count") == 0, filled(NO_FAILURES, description=name))
        .otherwise(
            F.concat(
                filled(SIMPLE_HEADER, count=F.col("match_count"), description=name),
                F.coalesce("body", F.lit("")),
            )
        )
        .alias("report"),
    )
