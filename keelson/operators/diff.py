"""Comparison of two snapshots: reasons, moves, findings and their summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.config import Policy
from keelson.functions.labels import evidence
from keelson.functions.paths import component_order
from keelson.operators.ranking import PART_ROWS, rank_in_groups
from keelson.operators.scope import in_scope, is_metadata_only
from keelson.schemas import SNAPSHOT_PAYLOAD
from keelson.session import materialise

IDENTITY = ["host", "path"]
# Sorts compare their first column by value and the rest row by row. Hosts repeat and paths share
# long beginnings, so a hash goes first; the columns behind it keep the match exact.
HASHED = ["_hash", *IDENTITY]
NO_REASONS = "array<string>"


def one_per_path(snapshot: DataFrame) -> DataFrame:
    """One row per (host, path); the greatest payload wins, so repeats are deterministic."""
    payload = [c for c in snapshot.columns if c not in HASHED]
    return (
        _hashed(snapshot)
        .groupBy(*HASHED)
        .agg(F.max(F.struct(*payload)).alias("_row"))
        .select(*IDENTITY, "_row.*")
    )


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("_hash", F.xxhash64(*IDENTITY))


def latest_snapshot(history: DataFrame, at="scan_ts") -> DataFrame:
    """The last seen row per (host, path) of a history of snapshots."""
    payload = [c for c in history.columns if c not in (*IDENTITY, at)]
    return (
        history.groupBy(*IDENTITY)
        .agg(F.max(F.struct(F.col(at), *payload)).alias("_row"))
        .select(*IDENTITY, "_row.*")
    )


def _differences(before: Column, after: Column, metadata_only: Column) -> list[tuple[str, Column]]:
    """What can differ between two snapshot structs, with its test, in reporting order.

    Size and times say nothing about directories; the optional fields count only where both
    sides recorded them; content is not compared where the policy says metadata only.
    """

    def differs(field):
        return ~before[field].eqNullSafe(after[field])

    def both_differ(field):
        return F.coalesce(before[field] != after[field], F.lit(False))

    not_directories = ~((before["kind"] == "directory") & (after["kind"] == "directory"))
    return [
        ("checksum", ~metadata_only & differs("checksum")),
        ("kind", differs("kind")),
        ("size", not_directories & differs("size")),
        ("modified_time", not_directories & differs("mtime_ns")),
        ("permissions", both_differ("mode")),
        ("owner", both_differ("uid")),
        ("group", both_differ("gid")),
        ("created_time", not_directories & both_differ("btime_ns")),
        ("metadata_change_time", not_directories & both_differ("ctime_ns")),
        ("security_metadata", both_differ("security_hash")),
    ]


def modification_reasons(before: Column, after: Column, metadata_only: Column) -> Column:
    """Names of what differs between two snapshot structs, in reporting order."""
    tests = _differences(before, after, metadata_only)
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def _side(snapshot, name, scope=None, distinct=False):
    """Columns (hash, host, path) and the rest of the row as a struct."""
    if scope is not None:
        snapshot = snapshot.filter(in_scope("path", scope))
    payload = F.struct(*SNAPSHOT_PAYLOAD)
    if distinct:
        return _hashed(snapshot).select(*HASHED, payload.alias(name))
    return _hashed(snapshot).groupBy(*HASHED).agg(F.max(payload).alias(name))


def snapshot_changes(
    baseline: DataFrame,
    current: DataFrame,
    policy: Policy = Policy(),
    scope: str | None = None,
    distinct: bool = False,
    colocated: bool = False,
) -> DataFrame:
    """Rows that were modified, added or deleted: host, path, kind, reasons, before, after.

    One full outer join on (host, path); paths are unique per side, so no join key is hot.
    ``distinct=True`` says that both sides already hold one row per path, as stored baselines do.
    ``colocated=True`` joins on (host, path) alone, which spares a side bucketed by them its
    shuffle.
    """
    left = _side(baseline, "before", scope, distinct)
    right = _side(current, "after", scope, distinct)
    if colocated:
        left, right = left.drop("_hash"), right.drop("_hash")
    sides = (F.col("before"), F.col("after"), is_metadata_only("path", policy))
    # Most rows are equal: plain tests decide that inside generated code, and reasons are put
    # together for the rest only.
    differs = reduce(lambda x, y: x | y, [test for _, test in _differences(*sides)])
    kind = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "deleted")
        .when(differs, "modified")
    )
    reasons = F.when(F.col("kind") == "modified", modification_reasons(*sides)).otherwise(
        F.array().cast(NO_REASONS)
    )
    return (
        left.join(right, IDENTITY if colocated else HASHED, "full_outer")
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select(*IDENTITY, "kind", reasons.alias("reasons"), "before", "after")
    )


def pair_moves(changes: DataFrame, stored: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Turn added and deleted rows of equal content into moves.

    Rows of one host with equal (checksum, size, kind) pair in path order, the k-th deleted with
    the k-th added; the rest stay as they are, and so do rows without a checksum. Ranks instead
    of a self-join keep the plan linear: each pair is one group of at most two rows.

    Only host, content, path and kind of the rows that can move are shuffled by content. A deleted
    row that has found its mate takes the mate's path as its key, and one full join of the added and
    the deleted rows by that key makes the moves and leaves the others alone. All keys have a hash in
    front, so that sorting compares numbers. Rows that cannot move pass untouched.

    With ``stored`` the changes are a table; contents with more than ``hot_rows`` rows, such as empty
    files, are then looked for and ranked in ranges.
    """
    checksum = F.coalesce("after.checksum", "before.checksum")
    candidate = F.col("kind").isin("added", "deleted") & checksum.isNotNull()
    deleted = F.col("kind") == "deleted"
    pairs = _paired(_contents(changes.filter(candidate), checksum), stored, hot_rows)
    path_hash = F.xxhash64("host", "path")
    left = (
        changes.filter(candidate & deleted).select("host", "path", "before", path_hash.alias("_hash"))
        .join(pairs.withColumnRenamed("_old", "path").withColumn("_hash", path_hash), ["_hash", "host", "path"], "left")
    )
    # A path that was deleted is not among the added ones: without a mate it meets nothing.
    left = left.select(
        "host", F.coalesce("_new", "path").alias("_at"), F.col("path").alias("_old"), "before"
    ).withColumn("_hash", F.xxhash64("host", "_at"))
    right = changes.filter(candidate & ~deleted).select(
        "host", F.col("path").alias("_at"), F.col("path").alias("_new"), "after", path_hash.alias("_hash")
    )
    met = right.join(left, ["_hash", "host", "_at"], "full_outer")
    both = F.col("_new").isNotNull() & F.col("_old").isNotNull()
    kind = F.when(both, "moved").when(F.col("_old").isNull(), "added").otherwise("deleted")
    met = met.select(
        "host", F.col("_at").alias("path"), F.when(both, F.col("_old")).alias("previous_path"),
        kind.alias("kind"), F.array().cast(NO_REASONS).alias("reasons"), "before", "after",
    )
    apart = changes.filter(~F.coalesce(candidate, F.lit(False)))
    apart = apart.withColumn("previous_path", F.lit(None).cast("string"))
    return apart.select(*met.columns).unionByName(met)


_PARTS = ["host", "_checksum", "_size", "_type"]
_CONTENT = ["_hash", *_PARTS]


def _contents(candidates: DataFrame, checksum: Column) -> DataFrame:
    """What pairing needs of each row: its content, hash first, path and kind."""
    return candidates.select(
        *IDENTITY,
        "kind",
        checksum.alias("_checksum"),
        F.coalesce("after.size", "before.size").alias("_size"),
        F.coalesce("after.kind", "before.kind").alias("_type"),
        component_order("path").alias("_order"),
    ).withColumn("_hash", F.xxhash64(*_PARTS))


def _paired(keyed: DataFrame, stored: bool, hot_rows: int | None) -> DataFrame:
    """(host, _new, _old): the k-th added and the k-th deleted path of each content."""
    deleted = F.col("kind") == "deleted"
    so_far = Window.partitionBy(*_CONTENT).orderBy("_order").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rank = F.when(deleted, F.count_if(deleted).over(so_far)).otherwise(F.count_if(~deleted).over(so_far))
    sides = [*_CONTENT, "kind"]
    hot = keyed.groupBy(*sides).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > (hot_rows or PART_ROWS))
    if not stored or hot.isEmpty():
        ranked = keyed.withColumn("_rank", rank)
    else:
        contents = hot.select(*_CONTENT).distinct()
        many = rank_in_groups(keyed.join(contents, _CONTENT, "left_semi"), sides, "_order", "_rank", hot_rows)
        ranked = keyed.join(contents, _CONTENT, "left_anti").withColumn("_rank", rank).unionByName(many)
    return (
        ranked.groupBy(*_CONTENT, "_rank")
        .agg(
            F.max(F.when(~deleted, F.col("path"))).alias("_new"),
            F.max(F.when(deleted, F.col("path"))).alias("_old"),
        )
        .filter(F.col("_new").isNotNull() & F.col("_old").isNotNull())
        .select("host", "_new", "_old")
    )


def as_findings(changes: DataFrame) -> DataFrame:
    """Finding rows, unreviewed, with evidence of both sides."""
    shown = F.coalesce("after", "before")
    return changes.select(
        F.xxhash64("host", "path", "kind").alias("finding_id"),
        "host",
        "kind",
        "path",
        "previous_path",
        shown["size"].alias("size"),
        shown["mtime_ns"].alias("modified_ns"),
        "reasons",
        evidence(F.col("before")).alias("before"),
        evidence(F.col("after")).alias("after"),
        F.lit("unreviewed").alias("state"),
        F.lit("none").alias("action"),
    )


def integrity_diff(
    baseline: DataFrame,
    current: DataFrame,
    policy: Policy = Policy(),
    scope: str | None = None,
    distinct: bool = False,
    hot_rows: int | None = None,
    colocated: bool = False,
) -> DataFrame:
    """Findings between two snapshots.

    Changes are few beside the rows compared, but several steps read them: they are written
    once, at every size, so that the comparison itself runs once.
    """
    changes = materialise(snapshot_changes(baseline, current, policy, scope, distinct, colocated))
    return as_findings(pair_moves(changes, True, hot_rows))


def number_findings(findings: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Give the findings of each host the ids 1..n in path order."""
    ordered = findings.withColumn(
        "_order", F.concat_ws("\u0001", component_order("path"), "kind")
    )
    return (
        rank_in_groups(ordered.drop("finding_id"), ["host"], "_order", "finding_id", hot_rows)
        .withColumn("finding_id", F.col("finding_id").cast("long"))
        .drop("_order")
    )


def policy_finding(config_rows: DataFrame, stored_hash: str) -> DataFrame:
    """Findings for a changed policy: ``config_rows`` are the snapshot rows of the configuration
    file per host with its current hash as checksum. Of the old file only the hash is known."""
    payload = F.struct(*SNAPSHOT_PAYLOAD)
    only_hash = F.struct(
        *[
            (F.lit(stored_hash) if name == "checksum" else F.lit(None))
            .cast(config_rows.schema[name].dataType)
            .alias(name)
            for name in SNAPSHOT_PAYLOAD
        ]
    )
    return as_findings(
        config_rows.select(
            *IDENTITY,
            F.lit(None).cast("string").alias("previous_path"),
            F.lit("modified").alias("kind"),
            F.array(F.lit("policy")).alias("reasons"),
            only_hash.alias("before"),
            payload.alias("after"),
        )
    )


def integrity_summary(findings: DataFrame, by=("host",)) -> DataFrame:
    counts = [
        F.count_if(F.col("kind") == kind).alias(kind)
        for kind in ("modified", "added", "deleted", "moved")
    ]
    return findings.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("total"))


def is_clean(summary: DataFrame, failed="failed", total="total") -> DataFrame:
    """Add ``clean``: no findings and no failed files."""
    return summary.withColumn("clean", (F.col(total) == 0) & (F.col(failed) == 0))


def deleted_sweep(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline rows whose path was not seen."""
    return baseline.join(current.select(*IDENTITY).distinct(), IDENTITY, "left_anti")


def inspect_paths(
    baseline: DataFrame, current: DataFrame, paths: DataFrame, policy: Policy = Policy()
) -> DataFrame:
    """Stored and present state of the listed (host, path) rows, with verdict and reasons."""
    wanted = paths.select(*IDENTITY).distinct()
    stored = _side(baseline.join(wanted, IDENTITY, "left_semi"), "before").drop("_hash")
    present = _side(current.join(wanted, IDENTITY, "left_semi"), "after").drop("_hash")
    only_policy = is_metadata_only("path", policy)
    reasons = F.when(
        F.col("before").isNotNull() & F.col("after").isNotNull(),
        modification_reasons(F.col("before"), F.col("after"), only_policy),
    ).otherwise(F.array().cast(NO_REASONS))
    verdict = (
        F.when(F.col("before").isNull() & F.col("after").isNull(), "unknown")
        .when(F.col("before").isNull(), "not baselined")
        .when(F.col("after").isNull(), "not on disk")
        .when(F.size("reasons") > 0, "compromised")
        .otherwise("intact")
    )
    return (
        wanted.join(stored, IDENTITY, "left")
        .join(present, IDENTITY, "left")
        .withColumn("reasons", reasons)
        .withColumn("verdict", verdict)
    )


def scan_stats(snapshot: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Directories, other entries, bytes, hashed bytes and failures per host.

    ``failures`` has one row per entry that could not be read, with its host.
    """
    directory = F.col("kind") == "directory"
    stats = snapshot.groupBy("host").agg(
        F.count_if(directory).alias("directories"),
        F.count_if(~directory).alias("files"),
        F.sum(F.when(~directory, F.col("size")).otherwise(0)).alias("bytes"),
        F.sum("processed_bytes").alias("processed_bytes"),
    )
    if failures is None:
        return stats.withColumn("failed", F.lit(0).cast("long"))
    failed = failures.groupBy("host").agg(F.count(F.lit(1)).alias("failed"))
    return stats.join(failed, "host", "full_outer").na.fill(0)


def stable_rows(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows measured before and after hashing into (stable, failed).

    Stable files kept identity (device, inode), length and modification time.
    """
    same = F.lit(True)
    for field in ("dev", "inode", "size", "mtime_ns"):
        same = same & F.col(f"before_{field}").eqNullSafe(F.col(f"after_{field}"))
    return measured.filter(same), measured.filter(~same)
