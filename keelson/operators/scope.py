"""Which paths a policy covers, and on which filesystem they live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keelson.config import Policy
from keelson.functions.paths import MANY_ROOTS, _col, ancestors, parent, path_under, under_any


def is_excluded(path, policy: Policy) -> Column:
    return under_any(path, policy.excluded_roots)


def is_metadata_directory(path, policy: Policy) -> Column:
    return _col(path).isin(policy.metadata_directories) if policy.metadata_directories else F.lit(
        False
    )


def is_metadata_only(path, policy: Policy) -> Column:
    return is_metadata_directory(path, policy) | under_any(path, policy.metadata_roots)


def in_scope(path, scope: str | None) -> Column:
    return F.lit(True) if scope is None else path_under(path, scope)


def mounts_per_host(mounts: DataFrame) -> DataFrame:
    """One row per host with its mounts, the most specific first.

    The kernel limits the mounts of a host, so the arrays are bounded.
    """
    entry = F.struct(
        (-F.size(F.filter(F.split("mountpoint", "/"), lambda p: p != ""))).alias("depth"),
        F.col("mountpoint"),
        F.col("fs_type"),
    )
    return mounts.groupBy("host").agg(F.array_sort(F.collect_set(entry)).alias("_mounts"))


def _stem(root) -> Column:
    bare = F.rtrim(_col(root), F.lit("/"))
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def with_mount(df: DataFrame, mounts: DataFrame, path="path") -> DataFrame:
    """Add ``_mount``, the struct (depth, mountpoint, fs_type) of the most specific mount over each
    path, null where none is known.

    Paths are looked up by folder: each distinct folder is expanded into its ancestors once, and
    these meet the mountpoints by equality. A path that is a mountpoint itself is looked up as such.
    """
    entry = F.struct(
        (-F.size(F.filter(F.split("mountpoint", "/"), lambda p: p != ""))).alias("depth"),
        F.col("mountpoint"),
        F.col("fs_type"),
    )
    points = mounts.groupBy("host", _stem("mountpoint").alias("_above")).agg(
        F.min(entry).alias("_mount")
    )
    folders = (
        df.select("host", parent(path).alias("_folder"))
        .filter(F.col("_folder").isNotNull())
        .distinct()
        .withColumn("_above", F.explode(ancestors("_folder", include_root=True)))
        .join(points, ["host", "_above"])
        .groupBy("host", "_folder")
        .agg(F.min("_mount").alias("_around"))
    )
    own = points.select("host", F.col("_above").alias("_at"), F.col("_mount").alias("_own"))
    return (
        df.withColumns({"_folder": parent(path), "_at": _col(path)})
        .join(folders, ["host", "_folder"], "left")
        .join(own, ["host", "_at"], "left")
        .select(*[F.col(f"`{c}`") for c in df.columns],
                F.coalesce("_own", "_around").alias("_mount"))
    )


def with_fs_type(df: DataFrame, mounts: DataFrame, path="path") -> DataFrame:
    """Add ``fs_type`` of the most specific mountpoint over each path, null where none is known."""
    return (
        with_mount(df, mounts, path)
        .withColumn("fs_type", F.col("_mount.fs_type"))
        .drop("_mount")
    )


def nearest_root(path, roots) -> Column:
    """The most specific root over a path, null if there is none."""
    path = _col(path)
    stems = sorted({r.rstrip("/") or "/" for r in roots}, key=len, reverse=True)
    if len(stems) > MANY_ROOTS:
        over = F.filter(ancestors(path, include_root=True), lambda a: a.isin(stems))
        return F.try_element_at(over, F.lit(1))
    none = F.lit(None).cast("string")
    return F.coalesce(none, *[F.when(path_under(path, stem), F.lit(stem)) for stem in stems])


def monitored(df: DataFrame, policy: Policy, mounts: DataFrame | None = None) -> DataFrame:
    """Rows that a walk from the scan paths would reach.

    A row is dropped when it is excluded, or when an excluded filesystem is mounted on it or on
    a directory between its scan path and it. The directory of a metadata rule is kept although
    excluded, provided that the walk passes through its parent or starts at it.

    Scan paths and mountpoints over a row are all prefixes of its path. A walk from some scan
    path arrives exactly if the longest scan path is longer than the longest such mountpoint.
    Scan paths that themselves lie on an excluded filesystem start no walk on that host.
    """
    path = F.col("path")
    root = nearest_root(path, policy.scan_paths)
    arrives = root.isNotNull()
    if mounts is not None and policy.excluded_filesystems:
        left_out = mounts.filter(F.col("fs_type").isin(list(policy.excluded_filesystems)))
        df = with_mount(df, left_out).join(_fewer_walks(mounts, policy), "host", "left")
        mounted = F.col("_mount.mountpoint")
        own = F.try_element_at(F.filter("_roots", lambda r: path_under(path, r)), F.lit(1))
        root = F.when(F.col("_roots").isNull(), root).otherwise(own)
        arrives = root.isNotNull() & (mounted.isNull() | (F.length(root) > F.length(mounted)))
    excluded = is_excluded(path, policy)
    passed = ~F.coalesce(is_excluded(parent(path), policy), F.lit(False))
    kept = is_metadata_directory(path, policy) & (passed | (path == root))
    return df.filter(arrives & (~excluded | F.coalesce(kept, F.lit(False)))).drop("_mount", "_roots")


def _fewer_walks(mounts: DataFrame, policy: Policy) -> DataFrame:
    """The scan paths that start a walk, the longest first, of each host where some do not."""
    left_out = list(policy.excluded_filesystems)
    stems = sorted({r.rstrip("/") or "/" for r in policy.scan_paths}, key=len, reverse=True)

    def walked(root):
        over = F.filter("_mounts", lambda m: path_under(root, m["mountpoint"]))
        on = F.try_element_at(over, F.lit(1))["fs_type"]
        return ~F.coalesce(on.isin(left_out), F.lit(False))

    roots = F.filter(F.array(*map(F.lit, stems)).cast("array<string>"), walked)
    return (
        mounts_per_host(mounts)
        .select("host", roots.alias("_roots"))
        .filter(F.size("_roots") < len(stems))
    )


def excluded_by_filesystem(df: DataFrame, policy: Policy, mounts: DataFrame) -> DataFrame:
    """Rows living on a filesystem type that the policy excludes."""
    typed = with_fs_type(df, mounts)
    return typed.filter(F.col("fs_type").isin(list(policy.excluded_filesystems)))


def under_targets(df: DataFrame, targets: DataFrame, keys=(), path="path") -> DataFrame:
    """Rows of ``df`` at or under some target (columns ``keys`` and ``target``), each once.

    The prefix test becomes an equality join on ancestors, which each distinct folder is expanded
    into once. A path that is a target itself is looked up as such.
    """
    keys = list(keys)
    stems = targets.select(*keys, _stem("target").alias("_above")).distinct()
    folders = (
        df.select(*keys, parent(path).alias("_folder"))
        .filter(F.col("_folder").isNotNull())
        .distinct()
        .withColumn("_above", F.explode(ancestors("_folder", include_root=True)))
        .join(stems, [*keys, "_above"], "left_semi")
        .select(*keys, "_folder")
        .distinct()
        .withColumn("_inside", F.lit(True))
    )
    own = stems.select(*keys, F.col("_above").alias("_at"), F.lit(True).alias("_named"))
    return (
        df.withColumns({"_folder": parent(path), "_at": _col(path)})
        .join(folders, [*keys, "_folder"], "left")
        .join(own, [*keys, "_at"], "left")
        .filter(F.coalesce("_inside", "_named", F.lit(False)))
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


def coverage_gaps(paths: DataFrame, policy: Policy) -> DataFrame:
    """Paths that should be content-monitored but are not, with the reason."""
    covered = under_any("path", policy.scan_paths) & ~is_excluded("path", policy)
    problem = F.when(~covered, F.lit("not_covered")).when(
        is_metadata_only("path", policy), F.lit("metadata_only")
    )
    return paths.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def risky_mounts(mounts: DataFrame, policy: Policy, costly) -> DataFrame:
    """Mounts of costly filesystem types that a scan would enter."""
    point = F.col("mountpoint")
    above_roots = {"/"}
    for root in policy.scan_paths:
        parts = root.rstrip("/").split("/")
        above_roots.update("/".join(parts[: i + 1]) for i in range(1, len(parts)))
    reachable = under_any(point, policy.scan_paths) | point.isin(sorted(above_roots))
    return mounts.filter(
        reachable
        & F.col("fs_type").isin(list(costly))
        & ~is_excluded(point, policy)
        & ~F.col("fs_type").isin(list(policy.excluded_filesystems))
    ).select("host", "mountpoint", "fs_type")
