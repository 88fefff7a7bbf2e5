"""Explicit schemas of every table the engine reads or writes."""

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _table(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


FILE_SNAPSHOT = _table(
    ("host", _S, False),
    ("path", _S, False),
    ("kind", _S, False),
    ("checksum", _S, True),
    ("size", _L, False),
    ("mode", _L, True),
    ("uid", _L, True),
    ("gid", _L, True),
    ("mtime_ns", _L, False),
    ("btime_ns", _L, True),
    ("ctime_ns", _L, True),
    ("security_hash", _S, True),
    ("processed_bytes", _L, False),
)

BASELINE_MANIFEST = _table(
    ("generation", _L, False),
    ("records", _L, False),
    ("scan_byte_limit", _L, False),
    ("created_unix_ms", _L, False),
    ("config_hash", _S, True),
    ("content_hash", _S, False),
)

EVIDENCE = _table(
    ("checksum", _S, True),
    ("kind", _S, True),
    ("size", _L, True),
    ("permissions_octal", _S, True),
    ("owner", _L, True),
    ("group", _L, True),
    ("modified_ns", _L, True),
    ("created_ns", _L, True),
    ("metadata_changed_ns", _L, True),
    ("security_metadata_hash", _S, True),
)

FINDINGS = _table(
    ("finding_id", _L, False),
    ("host", _S, False),
    ("kind", _S, False),
    ("path", _S, False),
    ("previous_path", _S, True),
    ("size", _L, False),
    ("modified_ns", _L, False),
    ("reasons", T.ArrayType(_S), False),
    ("before", EVIDENCE, True),
    ("after", EVIDENCE, True),
    ("state", _S, False),
    ("action", _S, False),
)

REVIEW_ACTIONS = _table(
    ("session_id", _S, False),
    ("action_id", _L, False),
    ("kind", _S, False),
    ("target", _S, True),
    ("affected", T.ArrayType(_L), True),
    ("undone", _B, False),
    ("applied", _B, False),
)

LOG_LINES = _table(
    ("source", _S, False), ("file", _S, False), ("line_no", _L, False), ("line", _S, False)
)

AUDIT_LINES = _table(("log_id", _S, False), ("seq", _L, False), ("line", _S, False))

AUDIT_EVENTS = _table(
    ("log_id", _S, False),
    ("seq", _L, False),
    ("timestamp_unix_ms", _L, False),
    ("action", _S, False),
    ("pid", _L, False),
    ("fields", T.ArrayType(_table(("key", _S, False), ("value", _S, False))), True),
)

MOUNTS = _table(("host", _S, False), ("mountpoint", _S, False), ("fs_type", _S, False))

SCAN_SAMPLES = _table(
    ("run_id", _S, False), ("ts_ms", _L, False), ("files", _L, False), ("bytes", _L, False)
)

JOURNAL = _table(
    ("MESSAGE", _S, True),
    ("_SYSTEMD_UNIT", _S, True),
    ("CONTAINER_NAME", _S, True),
    ("_HOSTNAME", _S, True),
    ("__REALTIME_TIMESTAMP", _S, True),
    ("__CURSOR", _S, True),
)

# Columns of a snapshot row other than its identity (host, path).
SNAPSHOT_PAYLOAD = [f.name for f in FILE_SNAPSHOT.fields if f.name not in ("host", "path")]
