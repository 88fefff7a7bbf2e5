"""Exported registry tables as snapshot rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keelson.functions.digests import registry_key_digest, registry_value_digest
from keelson.functions.formats import filetime_ns
from keelson.schemas import FILE_SNAPSHOT


def key_path(root, subkey) -> Column:
    root, subkey = (F.col(c) if isinstance(c, str) else c for c in (root, subkey))
    base = F.concat(F.lit("registry://"), root)
    tail = F.replace(subkey, F.lit("\\"), F.lit("/"))
    return F.when(subkey == "", base).otherwise(F.concat(base, F.lit("/"), tail))


def value_name(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.replace(F.replace(name, F.lit("#"), F.lit("%23")), F.lit("/"), F.lit("%2F"))


def _row(df, path, checksum, size, mtime) -> DataFrame:
    given = {
        "host": F.col("host"), "path": path, "kind": F.lit("special"), "checksum": checksum,
        "size": size, "mtime_ns": mtime, "processed_bytes": size,
    }
    return df.select(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FILE_SNAPSHOT.fields
        ]
    )


def registry_rows(keys: DataFrame, values: DataFrame) -> DataFrame:
    """Snapshot rows of keys (host, root, subkey, subkeys, values, last_write: 100 ns ticks since
    1601) and values (host, root, subkey, name, value_kind, data)."""
    written = filetime_ns("last_write")
    key_rows = _row(
        keys, key_path("root", "subkey"), registry_key_digest("subkeys", "values", written),
        F.lit(0), written,
    )
    value_rows = _row(
        values,
        F.concat(key_path("root", "subkey"), F.lit("#"), value_name("name")),
        registry_value_digest("value_kind", "data"),
        F.octet_length(F.col("data").cast("binary")),
        F.lit(0),
    )
    return key_rows.unionByName(value_rows)
