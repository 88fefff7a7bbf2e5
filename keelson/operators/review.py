"""Review of findings: views, actions, roll-ups, approvals and the next baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.functions.paths import ancestors, parent, path_under
from keelson.operators.diff import IDENTITY, one_per_path
from keelson.session import materialise

UNDO_LIMIT = 100  # fixed value: actions a session remembers


def matches_filter(text: str) -> Column:
    """Case-insensitive search in path, kind and state."""
    if not text:
        return F.lit(True)
    wanted = text.lower()
    return (
        F.lower("path").contains(wanted)
        | F.col("kind").contains(wanted)
        | F.col("state").contains(wanted)
    )


def filter_findings(findings: DataFrame, view: str = "all", text: str = "") -> DataFrame:
    shown = findings if view == "all" else findings.filter(F.col("state") == view)
    return shown.filter(matches_filter(text))


def state_counts(findings: DataFrame, by=("host",)) -> DataFrame:
    return findings.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("count"))


def directory_impact(findings: DataFrame, by=("host",)) -> DataFrame:
    """For each directory above some finding: the unreviewed findings at or under it.

    Findings are counted per parent first; only distinct directories are expanded into their
    ancestors. A finding that is itself such a directory counts for it too, and a path that is
    above nothing is no directory.
    """
    by = list(by)
    open_ = (F.col("state") == "unreviewed").cast("long")
    places = F.array(
        F.struct(parent("path").alias("directory"), F.lit(True).alias("under")),
        F.struct(F.col("path").alias("directory"), F.lit(False).alias("under")),
    )
    per_place = (
        findings.select(*by, open_.alias("n"), F.explode(places).alias("_p"))
        .select(*by, "n", "_p.*")
        .filter(F.col("directory").isNotNull() & (F.col("directory") != "/"))
        .groupBy(*by, "directory", "under")
        .agg(F.sum("n").alias("n"))
    )
    reached = F.when(F.col("under"), ancestors("directory")).otherwise(F.array("directory"))
    return (
        per_place.select(*by, "under", "n", F.explode(reached).alias("directory"))
        .groupBy(*by, "directory")
        .agg(F.sum("n").alias("affects"), F.max("under").alias("_above"))
        .filter("_above")
        .drop("_above")
    )


def exclusion_targets(findings: DataFrame, by=("host",)) -> DataFrame:
    """Paths that could be excluded for a finding: itself, then every directory above it.

    The targets of a directory are put together once and then joined to its findings, whose paths and
    states are stored, as three steps read them.
    """
    by = list(by)
    findings = materialise(findings.select(*by, "path", "state"))
    impact = directory_impact(findings, by)
    directories = findings.select(*by, parent("path").alias("_dir")).distinct().filter(
        F.col("_dir").isNotNull() & (F.col("_dir") != "/")
    )
    above = (
        directories.select(*by, "_dir", F.posexplode(ancestors("_dir")).alias("level", "directory"))
        .join(impact, [*by, "directory"])
        .groupBy(*by, "_dir")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (F.col("level") + 1).alias("level"),
                        F.col("directory").alias("target"),
                        F.lit(True).alias("directory"),
                        F.col("affects"),
                    )
                )
            ).alias("_above")
        )
    )
    itself = F.struct(
        F.lit(0).alias("level"), F.col("path").alias("target"), F.lit(False).alias("directory"),
        F.lit(1).cast("long").alias("affects"),
    )
    return (
        findings.withColumn("_dir", parent("path"))
        .join(above, [*by, "_dir"], "left")
        .select(
            *by, "path",
            F.explode(
                F.when(F.col("_above").isNull(), F.array(itself)).otherwise(
                    F.concat(F.array(itself), F.col("_above"))
                )
            ).alias("_t"),
        )
        .select(*by, "path", "_t.*")
    )


def retained_actions(actions: DataFrame, limit: int = UNDO_LIMIT) -> DataFrame:
    """The last actions of each session, which are those that can be undone."""
    newest = Window.partitionBy("session_id").orderBy(F.col("action_id").desc())
    return (
        actions.filter(~F.col("undone"))
        .withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= limit)
        .drop("_age")
    )


def undo_last(actions: DataFrame) -> DataFrame:
    """Mark the newest action of each session as undone."""
    live = actions.filter(~F.col("undone")).groupBy("session_id").agg(
        F.max("action_id").alias("_last")
    )
    return actions.join(live, "session_id", "left").select(
        *[
            (F.col("undone") | F.coalesce(F.col("action_id") == F.col("_last"), F.lit(False))).alias(
                "undone"
            )
            if c == "undone"
            else F.col(c)
            for c in actions.columns
        ]
    )


def sparse_ids(ids) -> Column:
    """Ids sorted and without repeats."""
    return F.array_sort(F.array_distinct(F.col(ids) if isinstance(ids, str) else ids))


def affected_counts(actions: DataFrame) -> DataFrame:
    return actions.select(
        "session_id", "action_id", "kind",
        F.size(sparse_ids(F.coalesce("affected", F.array().cast("array<long>")))).alias("affected"),
    )


def replay_actions(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """States of findings (with ``session_id``) after the actions that were not undone.

    The last mark of a finding decides. Excluding a target touches unreviewed findings only, so
    it never overrides a mark, in whatever order they came; otherwise the stored state stays.
    """
    live = actions.filter(~F.col("undone"))
    marks = (
        live.filter(F.col("kind").isin("approve", "flag"))
        .select("session_id", "action_id", "kind", F.explode("affected").alias("finding_id"))
        .groupBy("session_id", "finding_id")
        .agg(F.max_by("kind", "action_id").alias("_mark"))
    )
    targets = (
        live.filter((F.col("kind") == "exclude") & (F.col("target") != ""))
        .select("session_id", F.coalesce(F.nullif(F.rtrim("target", F.lit("/")), F.lit("")),
                                         F.lit("/")).alias("_target"))
        .distinct()
    )
    # Whether a folder lies under a target is settled once per folder.
    placed = findings.withColumn("_dir", parent("path"))
    folders = (
        placed.select("session_id", "_dir")
        .distinct()
        .withColumn("_target", F.explode(ancestors("_dir", include_root=True)))
        .join(targets, ["session_id", "_target"], "left_semi")
        .select("session_id", "_dir", F.lit(True).alias("_under"))
        .distinct()
    )
    itself = targets.select("session_id", F.col("_target").alias("path"), F.lit(True).alias("_at"))
    covered = F.coalesce("_under", "_at", F.lit(False))
    hit = covered & (F.col("state") == "unreviewed") & F.col("_mark").isNull()
    state = (
        F.when(F.col("_mark") == "approve", "approved")
        .when(F.col("_mark") == "flag", "flagged")
        .when(hit, "excluded")
        .otherwise(F.col("state"))
    )
    action = (
        F.when(F.col("_mark").isNotNull(), F.col("_mark"))
        .when(hit, "exclude")
        .otherwise(F.col("action"))
    )
    return (
        placed.join(marks, ["session_id", "finding_id"], "left")
        .join(folders, ["session_id", "_dir"], "left")
        .join(itself, ["session_id", "path"], "left")
        .withColumns({"state": state, "action": action})
        .select(*findings.columns)
    )


def approved(findings: DataFrame) -> DataFrame:
    return findings.filter((F.col("action") == "approve") & (F.col("state") == "approved"))


def approval_paths(findings: DataFrame, by=("host",)) -> DataFrame:
    """Distinct paths to ``remove`` from and to ``add`` to the baseline."""
    return changed_paths(approved(findings), by)


def changed_paths(approvals: DataFrame, by=("host",)) -> DataFrame:
    """The same of findings known to be approved."""
    content = approvals.filter(~F.array_contains("reasons", "policy"))
    both = F.array(
        F.struct(F.lit("add").alias("change"), F.col("path").alias("path")),
        F.struct(F.lit("remove").alias("change"), F.coalesce("previous_path", "path").alias("path")),
    )
    return content.select(*by, F.explode(both).alias("_c")).select(*by, "_c.*").distinct()


def exclusion_list(actions: DataFrame, by=("session_id",)) -> DataFrame:
    """Distinct targets of the exclude actions."""
    return (
        actions.filter(
            ~F.col("undone") & (F.col("kind") == "exclude") & (F.col("target") != "")
        )
        .select(*by, "target")
        .distinct()
    )


def plan_apply(findings: DataFrame, exclusions: DataFrame | None = None, by=("host",)) -> DataFrame:
    """Sizes of what applying a review would change."""
    by = list(by)
    approved = (F.col("action") == "approve") & (F.col("state") == "approved")
    policy = F.array_contains("reasons", "policy")
    content = approved & ~policy
    planned = findings.groupBy(*by).agg(
        F.count_distinct(F.when(content, F.col("path"))).alias("approved_add"),
        F.count_distinct(F.when(content, F.coalesce("previous_path", "path"))).alias(
            "approved_remove"
        ),
        F.max(approved & policy).alias("config_hash_updated"),
    )
    planned = planned.withColumn(
        "approvals",
        F.greatest("approved_add", "approved_remove")
        + F.col("config_hash_updated").cast("long"),
    )
    if exclusions is None:
        return planned.withColumn("exclusions", F.lit(0).cast("long"))
    counted = exclusions.groupBy(*by).agg(F.count_distinct("target").alias("exclusions"))
    return planned.join(counted, by, "left").na.fill(0, ["exclusions"])


def check_byte_limits(stored: int, configured: int) -> None:
    """Digests of different byte limits cannot be mixed in one baseline."""
    if stored != configured:
        raise ValueError(
            f"the baseline was made with scan_byte_limit {stored}, the policy says {configured}"
        )


def apply_review(baseline: DataFrame, current: DataFrame, findings: DataFrame) -> DataFrame:
    """The next baseline: approved old paths leave, approved present paths enter."""
    return apply_changes(baseline, current, approval_paths(findings))


def apply_changes(baseline: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """``baseline`` after the ``changes`` (host, change, path)."""
    out = changes.filter(F.col("change") == "remove").select(*IDENTITY)
    into = changes.filter(F.col("change") == "add").select(*IDENTITY)
    fresh = one_per_path(current.join(into, IDENTITY, "left_semi"))
    return baseline.join(out, IDENTITY, "left_anti").unionByName(fresh.select(*baseline.columns))


def accept(baseline: DataFrame, current: DataFrame, scope: str, aliases=()) -> DataFrame:
    """The next baseline with everything under ``scope`` taken from the current snapshot."""
    inside = path_under("path", scope)
    for alias in aliases:
        inside = inside | path_under("path", alias)
    fresh = one_per_path(current.filter(inside)).select(*baseline.columns)
    return baseline.filter(~inside).unionByName(fresh)


def accept_counts(baseline: DataFrame, current: DataFrame, scope: str, by=("host",)) -> DataFrame:
    inside = path_under("path", scope)
    old = baseline.groupBy(*by).agg(
        F.count_if(~inside).alias("preserved"), F.count_if(inside).alias("removed")
    )
    new = one_per_path(current.filter(inside)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("accepted")
    )
    return (
        old.join(new, list(by), "full_outer")
        .na.fill(0, ["preserved", "removed", "accepted"])
        .withColumn("records", F.col("preserved") + F.col("accepted"))
    )


def merge_exclusions(existing: list[str], additions: list[str]) -> list[str]:
    """Existing exclusions first, then new ones, each once."""
    return list(dict.fromkeys([*existing, *additions]))
