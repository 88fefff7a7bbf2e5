"""Alert rows: who is to be told what. Delivery belongs to the caller's ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keelson.config import AlertPolicy
from keelson.functions.text import filled

DETAIL_LIMIT = 1000  # fixed value: finding lines in one message

# Subjects and phrases of the messages.
SCAN_OK = "File Integrity Monitor Succeeded"
SCAN_ALERT = "ALERT: File Integrity Monitor detected problems"
LOG_OK = "Log scan succeeded: "
LOG_ALERT = "ALERT: Log scan detected problems: "
NO_RECIPIENT = "Unable to send email: no recipient address is configured"
NO_SENDER = "Unable to send email: email_from_address is not configured"
SCAN_TEXT = "The file Integrity monitor {action} scanned {directories} directories and {files} files.\n"
SCAN_FOUND = "\nDetected {found} problems with the following files.\n\n"
SCAN_OMITTED = "{omitted} additional findings omitted from email details"
LOG_TEXT = "The log scan '{source}' checked {lines} log lines and matched {matches} problems.\n\nSource: {label}\n"
LOG_NONE = "\nNo problems found.\n"


def _blank_as_null(text: str) -> Column:
    return F.lit(text or None).cast("string")


def _recipient(success: Column, policy: AlertPolicy) -> Column:
    fail = _blank_as_null(policy.fail_to)
    return F.when(success, F.coalesce(_blank_as_null(policy.success_to), fail)).otherwise(fail)


def _routed(df: DataFrame, key, success, recipient, subject, body, policy) -> DataFrame:
    wanted = F.when(success, F.lit(policy.send_on_success)).otherwise(F.lit(policy.send_on_fail))
    error = F.when(recipient.isNull(), NO_RECIPIENT).when(
        F.lit(not policy.from_address), NO_SENDER
    )
    return df.filter(wanted).select(
        key,
        success.alias("success"),
        F.lit(policy.from_address).alias("sender"),
        recipient.alias("recipient"),
        subject.alias("subject"),
        body.alias("body"),
        error.alias("error"),
    )


def capped_details(messages: DataFrame, limit: int = DETAIL_LIMIT) -> DataFrame:
    """Per host, the first ``limit`` messages in path order and how many were left out."""
    from keelson.operators.logreport import first_rows

    total = messages.groupBy("host").agg(F.count(F.lit(1)).alias("_total"))
    kept = first_rows(messages, ["host"], [F.col("path"), F.col("message")], limit)
    listed = kept.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("position", "message"))).alias("_listed"),
        F.count(F.lit(1)).alias("_kept"),
    )
    return total.join(listed, "host").select(
        "host",
        F.col("_listed.message").alias("details"),
        (F.col("_total") - F.col("_kept")).alias("omitted"),
    )


def scan_alerts(
    summary: DataFrame, details: DataFrame, policy: AlertPolicy, action: str = "File Integrity Scan"
) -> DataFrame:
    """Alerts of integrity scans: summary rows (host, directories, files, total) with details."""
    found = F.coalesce("total", F.lit(0))
    success = found == 0
    omitted = F.when(
        F.col("omitted") > 0,
        F.array(filled(SCAN_OMITTED, omitted=F.col("omitted"))),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.coalesce("details", F.array().cast("array<string>")), omitted)
    text = filled(SCAN_TEXT, action=F.lit(action), directories=F.col("directories"), files=F.col("files"))
    body = F.when(success, text).otherwise(
        F.concat(
            text, filled(SCAN_FOUND, found=found),
            F.array_join(F.transform(lines, lambda d: F.concat(d, F.lit("\n"))), ""),
        )
    )
    joined = summary.join(details, "host", "left")
    subject = F.when(success, SCAN_OK).otherwise(SCAN_ALERT)
    return _routed(joined, "host", success, _recipient(success, policy), subject, body, policy)


def log_alerts(
    reports: DataFrame, policy: AlertPolicy, report_to: str | None = None, labels: dict | None = None
) -> DataFrame:
    """Alerts of log scans: rows (source, line_count, match_count, report).

    ``labels`` tells what each source reads (``LogSource.label``); others show their name.
    """
    label = F.col("source")
    for name, text in (labels or {}).items():
        label = F.when(F.col("source") == name, text).otherwise(label)
    success = F.col("match_count") == 0
    recipient = F.coalesce(_blank_as_null(report_to or ""), _recipient(success, policy))
    subject = F.concat(F.when(success, LOG_OK).otherwise(LOG_ALERT), F.col("source"))
    text = filled(
        LOG_TEXT, source=F.col("source"), lines=F.col("line_count"), matches=F.col("match_count"), label=label
    )
    body = F.concat(text, F.when(success, F.lit(LOG_NONE)).otherwise(F.concat(F.lit("\n"), F.col("report"))))
    return _routed(reports, "source", success, recipient, subject, body, policy)
