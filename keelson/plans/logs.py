"""A complete log scan: lines in, events, report rows, summary and text out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from keelson.config import LogAudit, LogSource
from keelson.operators import logreport as R
from keelson.operators.rules import match_events
from keelson.session import materialise
from keelson.sources.logs import path_exists, read_journal, read_log


@dataclass(frozen=True)
class LogScan:
    """Results of one source."""

    source: LogSource
    events: DataFrame
    rows: DataFrame  # groups or listed events, already limited to the source's top
    summary: DataFrame
    report: DataFrame


def scan_lines(lines: DataFrame, audit: LogAudit, source: LogSource, by=("source",)) -> LogScan:
    """Scan lines (source, file, line_no, line) with the rules of ``source``.

    Matches are few beside the lines but several results read them: they are written
    once, so that the rules run once over the text.
    """
    events = match_events(lines, source, audit.rules_of(source))
    totals = R.log_totals(lines, source.reset, by)
    events, totals = materialise(events), materialise(totals)
    if source.reset:
        events = R.apply_reset(events, totals)
    summary = R.log_summary(totals, events, by)
    pattern = audit.group_pattern(source)
    if pattern is not None:
        rows = R.top_groups(R.group_events(events, pattern, by), source.top, by)
        report = R.render_grouped(rows, summary, by)
    else:
        rows = R.top_events(events, source.top, by)
        report = R.render_simple(rows, summary, source, by)
    return LogScan(source, events, rows, summary, report)


def open_lines(spark, source: LogSource) -> DataFrame:
    if source.kind == "journal":
        return read_journal(
            spark, source.path, source.name, source.unit, source.container, source.since
        )
    return read_log(spark, source.path, source.name)


def scan_logs(spark, audit: LogAudit, name: str | None = None, path: str | None = None) -> LogScan:
    """Scan one source chosen by source name, rule name and/or path."""
    source = audit.choose(name, path)
    return scan_lines(open_lines(spark, source), audit, source)


def scan_all_logs(spark, audit: LogAudit) -> DataFrame:
    """Report rows of every configured source that exists, as one job."""
    reports = [
        scan_lines(open_lines(spark, source), audit, source).report
        for source in audit.sources
        if source.path and path_exists(spark, source.path)
    ]
    if not reports:
        raise ValueError("none of the configured log sources exists")
    return reduce(DataFrame.unionByName, reports)
