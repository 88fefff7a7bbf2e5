"""Trust of files and their parents, policy lint, configuration checks, health report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keelson.config import VIRTUAL_FILESYSTEMS, Policy
from keelson.functions.formats import format_bytes, octal, utc_text
from keelson.functions.paths import ancestors, parent, path_under
from keelson.operators.scope import risky_mounts

GROUP_WORLD_WRITE = 0o022


def _issues(kind: str, privileged: bool) -> Column:
    """What is wrong with a snapshot row that should be a trusted ``kind``."""
    mode = F.col("mode").bitwiseAND(0o777)
    writable = mode.bitwiseAND(GROUP_WORLD_WRITE) != 0
    checks = [F.when(writable, F.concat(F.lit("group/world writable, mode "), octal(mode)))]
    if privileged:
        checks.append(F.when(F.col("uid") != 0, F.lit("not owned by root")))
    return (
        F.when(F.col("kind") == "symlink", F.array(F.lit("symlink")))
        .when(F.col("kind") != kind, F.array(F.lit(f"not a {kind}")))
        .otherwise(F.array_compact(F.array(*checks)))
    )


def trust_issues(
    snapshot: DataFrame,
    targets: DataFrame,
    privileged: bool = True,
    must_exist: bool = True,
    kind: str = "file",
) -> DataFrame:
    """Issues of targets (host, path) of one ``kind`` and of every directory above them.

    The targets and their distinct ancestors are few: the snapshot is reduced to them first, and
    only what is left is judged. A directory absent from the snapshot is not an issue; a missing
    target file is, unless ``must_exist`` is off.
    """
    wanted = targets.select("host", "path").distinct()
    folders = (
        wanted.select("host", parent("path").alias("_dir"))
        .filter(F.col("_dir").isNotNull())
        .distinct()
        .withColumn("path", F.explode(ancestors("_dir", include_root=True)))
    )
    known = snapshot.join(wanted, ["host", "path"], "left_semi").select(
        "host", "path", _issues(kind, privileged).alias("_own")
    )
    looked = wanted.join(known, ["host", "path"], "left")
    missing = F.array(F.lit("not found")) if must_exist and kind == "file" else F.lit(None)
    files = looked.select(
        "host", F.col("path").alias("target"), "path",
        F.explode(F.coalesce("_own", missing)).alias("issue"),
    )
    placed = (wanted if must_exist else looked.filter(F.col("_own").isNotNull())).select(
        "host", F.col("path").alias("target"), parent("path").alias("_dir")
    )
    bad_parents = snapshot.join(
        folders.select("host", "path").distinct(), ["host", "path"], "left_semi"
    ).select("host", "path", F.explode(_issues("directory", privileged)).alias("issue"))
    # Each directory is expanded once, however many targets it holds.
    chains = (
        folders.join(bad_parents, ["host", "path"])
        .groupBy("host", "_dir")
        .agg(F.collect_list(F.struct("path", "issue")).alias("_found"))
    )
    parents = (
        placed.join(chains, ["host", "_dir"])
        .select("host", "target", F.explode("_found").alias("_f"))
        .select("host", "target", "_f.path", "_f.issue")
    )
    return files.unionByName(parents)


def data_trust_issues(
    snapshot: DataFrame, folders: DataFrame, privileged: bool = True
) -> DataFrame:
    """Issues of data directories (host, path), the files in them and the directories above.

    ``target`` is the data directory. What it does not hold is not an issue.
    """
    wanted = folders.select("host", F.col("path").alias("target")).distinct()
    held = (
        snapshot.filter(F.col("kind") != "directory")
        .withColumn("target", parent("path"))
        .join(wanted, ["host", "target"], "left_semi")
        .select("host", "target", "path", F.explode(_issues("file", privileged)).alias("issue"))
    )
    return trust_issues(snapshot, folders, privileged, kind="directory").unionByName(held)


def _paths(column) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def policy_warnings(policies: DataFrame) -> DataFrame:
    """One row (host, warning, detail) per questionable setting.

    ``policies`` has host, scan_paths, db_path, exclusions, excluded_filesystems, metadata_rules
    and scan_byte_limit.
    """

    def one(test, code, detail=None):
        found = F.struct(
            F.lit(code).alias("warning"),
            (F.lit("") if detail is None else detail).alias("detail"),
        )
        return F.array_compact(F.array(F.when(test, found)))

    def each(paths, test, code):
        return F.transform(
            F.filter(paths, test),
            lambda p: F.struct(F.lit(code).alias("warning"), p.alias("detail")),
        )

    def rooted(path):
        return (path == "/") | path.rlike(r"\A.:[/\\]")

    limit = F.col("scan_byte_limit")
    found = F.concat(
        one(F.size(_paths("scan_paths")) == 0, "no_scan_paths"),
        one(limit > 0, "partial_hashing", format_bytes(limit)),
        one(F.size(_paths("excluded_filesystems")) == 0, "no_excluded_filesystems"),
        each(
            _paths("scan_paths"),
            lambda p: F.coalesce(path_under(p, F.col("db_path")), F.lit(False)),
            "scan_path_in_db_path",
        ),
        each(_paths("exclusions"), rooted, "root_excluded"),
        each(
            _paths("metadata_rules"),
            lambda p: rooted(F.regexp_replace(p, r"(?<=.)[/\\]\*\z", "")),
            "root_metadata_only",
        ),
    )
    return policies.select("host", F.explode(found).alias("_w")).select("host", "_w.*")


def duplicate_sources(sources: DataFrame, keys=()) -> DataFrame:
    """Source names used more than once in one configuration."""
    return (
        sources.groupBy(*keys, "name")
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") > 1)
    )


def unknown_rules(references: DataFrame, rules: DataFrame, keys=()) -> DataFrame:
    """References (source, rule_name) to rules that do not exist."""
    names = rules.select(*keys, F.col("name").alias("rule_name")).distinct()
    return references.join(names, [*keys, "rule_name"], "left_anti")


def config_pin(configs: DataFrame, expected: str) -> DataFrame:
    """Whether the configuration hash is the pinned one; a malformed pin fails."""
    if len(expected) != 64 or any(c not in "0123456789abcdefABCDEF" for c in expected):
        raise ValueError("the pinned configuration hash must have 64 hex digits")
    ok = F.lower("config_hash") == expected.lower()
    return configs.withColumn("status", F.when(ok, "ok").otherwise("mismatch"))


def preview(issues: DataFrame, order, by=("host",), shown: int = 5) -> DataFrame:
    """The first issues per host, and how many more there are."""
    from keelson.operators.logreport import first_rows

    by = list(by)
    total = issues.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    kept = first_rows(issues, by, [F.col(c) for c in order], shown)
    return kept.join(total, by).withColumn(
        "omitted", F.greatest(F.col("total") - shown, F.lit(0).cast("long"))
    )


def _check(df: DataFrame, check: str, failed, detail) -> DataFrame:
    return df.select(
        "host",
        F.lit(check).alias("check"),
        F.when(failed, "fail").otherwise("ok").alias("status"),
        detail.cast("string").alias("detail"),
    )


def _count_check(hosts: DataFrame, rows: DataFrame, check: str, weight=True) -> DataFrame:
    """ok with none, else fail (or, without weight, warn) with the number of rows."""
    counted = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    bad = "fail" if weight else "warn"
    return hosts.join(counted, "host", "left").select(
        "host", F.lit(check).alias("check"),
        F.when(n > 0, bad).otherwise("ok").alias("status"), n.cast("string").alias("detail"),
    )


def health_report(
    hosts: DataFrame,
    manifests: DataFrame,
    drift: DataFrame,
    audits: DataFrame,
    mounts: DataFrame,
    policies: DataFrame,
    gaps: DataFrame,
    policy: Policy = Policy(),
    trust: DataFrame | None = None,
    pins: DataFrame | None = None,
) -> DataFrame:
    """Rows (host, check, status, detail) of everything that should be in order.

    ``manifests``: verified manifest rows per host (with ``mismatches``); ``drift``: from
    ``config_drift``; ``audits``: from ``verify_audit`` with the host as log, or ``audits_of_hosts``;
    ``gaps``: from ``coverage_gaps``; ``trust``: from ``trust_issues``; ``pins``: from ``config_pin``.
    """
    known = hosts.select("host").distinct()
    stored = known.join(manifests, "host", "left")
    absent = F.col("generation").isNull()
    wrong = F.coalesce(F.size("mismatches"), F.lit(0)) > 0
    state = (
        F.when(absent, "missing")
        .when(wrong, F.array_join("mismatches", ", "))
        .otherwise("ok")
    )
    logs = known.join(audits.withColumnRenamed("log_id", "host"), "host", "left")
    broken = F.col("bad_line").isNotNull()
    parts = [
        _check(stored, "baseline", absent | wrong, state),
        _check(stored, "records", F.lit(False), F.coalesce("records", F.lit(0))),
        _check(stored, "generation", F.lit(False), F.coalesce("generation", F.lit(0))),
        _check(stored, "created", F.lit(False), F.coalesce(utc_text("created_unix_ms"),
                                                           F.lit(""))),
        _check(
            stored,
            "scan_byte_limit",
            F.lit(False),
            F.when(F.coalesce("scan_byte_limit", F.lit(0)) == 0, "whole file").otherwise(
                format_bytes("scan_byte_limit")
            ),
        ),
        _check(drift, "config_drift", F.col("status") != "ok", F.col("status")),
        _check(
            logs,
            "audit_chain",
            broken,
            F.when(broken, F.concat(F.lit("line "), F.col("bad_line").cast("string"), F.lit(": "),
                                    F.col("cause"))).otherwise(
                F.concat(F.coalesce("events", F.lit(0)).cast("string"), F.lit(" events"))
            ),
        ),
        # Costly mounts are reported but do not make a host fail.
        _count_check(known, risky_mounts(mounts, policy, VIRTUAL_FILESYSTEMS), "risky_mounts",
                     weight=False),
        _count_check(known, policy_warnings(policies), "policy"),
        _count_check(known, gaps, "coverage"),
    ]
    if trust is not None:
        parts.append(_count_check(known, trust, "trust"))
    if pins is not None:
        parts.append(_check(pins, "config_pin", F.col("status") != "ok", F.col("status")))
    return reduce(DataFrame.unionByName, parts)


def audits_of_hosts(audits: DataFrame, hosts: DataFrame) -> DataFrame:
    """Verification results of all logs of a host as one: ``hosts`` names each log's host.

    The events of its logs are added up; of broken ones the first log, by name, is shown.
    """
    broken = F.struct("log_id", "bad_line", "cause", "last_hash")
    return (
        audits.join(hosts.select("log_id", "host"), "log_id")
        .groupBy("host")
        .agg(
            F.sum("events").alias("events"),
            F.min(F.when(F.col("bad_line").isNotNull(), broken)).alias("_broken"),
        )
        .select(
            F.col("host").alias("log_id"), "events", F.col("_broken.last_hash").alias("last_hash"),
            F.col("_broken.bad_line").alias("bad_line"), F.col("_broken.cause").alias("cause"),
        )
    )


def health_verdict(report: DataFrame) -> DataFrame:
    """Number of failed checks per host."""
    failures = F.count_if(F.col("status") == "fail")
    return report.groupBy("host").agg(
        failures.alias("failures"), (failures == 0).alias("healthy")
    )
