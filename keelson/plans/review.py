"""From an accepted scope or a finished review to the next stored baseline generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelson.config import Policy
from keelson.operators import review as V
from keelson.session import materialise
from keelson.sinks import baseline as B


def _newest(spark: SparkSession, path: str, policy: Policy):
    """Manifest row and records of the newest generation; its byte limit must be the policy's."""
    manifest = B.newest_manifest(spark, path)
    V.check_byte_limits(manifest["scan_byte_limit"], policy.scan_byte_limit)
    return manifest, B.read_baseline(spark, path, manifest["generation"])


def accept_stored(
    spark: SparkSession,
    path: str,
    current: DataFrame,
    scope: str,
    policy: Policy = Policy(),
    aliases=(),
) -> int:
    """Write the generation in which everything under ``scope`` is as in ``current``.

    The hash of the configuration is carried over: accepting files does not accept a policy.
    """
    manifest, stored = _newest(spark, path, policy)
    accepted = V.accept(stored, current, scope, aliases)
    return B.write_baseline(accepted, path, manifest["config_hash"], policy.scan_byte_limit)


def apply_stored(
    spark: SparkSession,
    path: str,
    current: DataFrame,
    findings: DataFrame,
    config_hash: str | None = None,
    policy: Policy = Policy(),
) -> int:
    """Write the generation that the approved findings make.

    ``config_hash``, the hash of the present configuration, replaces the stored one only if the
    finding of the changed policy was approved. The approvals are read once, from a table.
    """
    manifest, stored = _newest(spark, path, policy)
    approved = materialise(V.approved(findings).select("host", "path", "previous_path", "reasons"))
    policy_too = not approved.filter(F.array_contains("reasons", "policy")).isEmpty()
    if policy_too and config_hash is None:
        raise ValueError("a policy change is approved, but the present configuration hash is not given")
    following = V.apply_changes(stored, current, V.changed_paths(approved))
    kept = config_hash if policy_too else manifest["config_hash"]
    return B.write_baseline(following, path, kept, policy.scan_byte_limit)
