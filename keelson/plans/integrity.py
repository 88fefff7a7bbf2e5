"""A complete integrity scan: policy, comparison, moves, findings, summary, verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from keelson.config import ConfigError, Policy
from keelson.functions.labels import finding_message
from keelson.operators.alerts import capped_details
from keelson.operators.diff import (
    integrity_diff,
    integrity_summary,
    is_clean,
    policy_finding,
    scan_stats,
)
from keelson.operators.scope import monitored
from keelson.session import materialise


@dataclass(frozen=True)
class IntegrityScan:
    findings: DataFrame
    stats: DataFrame
    summary: DataFrame  # stats, counts of findings and the verdict per host
    details: DataFrame  # message lines per host, limited, with the number omitted


def integrity_scan(
    baseline: DataFrame,
    current: DataFrame,
    policy: Policy = Policy(),
    mounts: DataFrame | None = None,
    scope: str | None = None,
    failures: DataFrame | None = None,
    stored_config_hash: str | None = None,
    config_rows: DataFrame | None = None,
    strict: bool = False,
    distinct: bool = False,
) -> IntegrityScan:
    """Compare a current snapshot with the baseline as one scan.

    ``config_rows`` are the snapshot rows of the configuration file per host, its hash as
    checksum. Where a known stored hash differs from it there is a finding with the reason
    ``policy``, or with ``strict`` an error.
    """
    covered = monitored(current, policy, mounts)
    findings = integrity_diff(baseline, covered, policy, scope, distinct)
    if stored_config_hash is not None and config_rows is not None:
        drifted = config_rows.filter(F.col("checksum") != stored_config_hash)
        if strict and not drifted.isEmpty():
            raise ConfigError("the configuration changed since the baseline was made")
        findings = findings.unionByName(policy_finding(drifted, stored_config_hash))
    findings = materialise(findings)  # summary, details and the caller all read them
    stats = scan_stats(covered, failures)
    counted = integrity_summary(findings)
    numbers = ["modified", "added", "deleted", "moved", "total"]
    # Every finding counts as a failure, as unreadable files do.
    summary = (
        stats.join(counted, "host", "full_outer")
        .na.fill(0)
        .withColumn("failed", F.col("failed") + F.col("total"))
    )
    messages = findings.select(
        "host", "path",
        finding_message("kind", "path", "previous_path", "reasons").alias("message"),
    )
    return IntegrityScan(
        findings,
        stats,
        is_clean(summary).select(*stats.columns, *numbers, "clean"),
        capped_details(messages),
    )
