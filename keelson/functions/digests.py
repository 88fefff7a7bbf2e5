"""Digest columns. SHA-256 throughout: Spark computes it natively inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_SLICE = 2**31 - 1


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_digest(text) -> Column:
    return F.sha2(F.encode(_col(text), "utf-8"), 256)


def content_digest(content, byte_limit: int = 0) -> Column:
    """Digest of the first ``byte_limit`` bytes; 0 means the whole content."""
    content = _col(content).cast("binary")
    if byte_limit and byte_limit <= MAX_SLICE:
        content = F.substring(content, 1, byte_limit)
    return F.sha2(content, 256)


def processed_bytes(size, byte_limit: int = 0, metadata_only=None) -> Column:
    size = _col(size)
    read = F.least(size, F.lit(byte_limit).cast("long")) if byte_limit else size
    if metadata_only is None:
        return read
    return F.when(metadata_only, F.lit(0).cast("long")).otherwise(read)


def symlink_digest(target) -> Column:
    return text_digest(target)


def hex_digest(raw) -> Column:
    return F.lower(F.hex(_col(raw)))


def parse_digest(text) -> Column:
    """The 32 bytes of a 64-digit hex digest, null for anything else."""
    text = _col(text)
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def security_hash(dev, inode, nlink, kind, inode_flags=None, xattrs=None, error=None) -> Column:
    """Digest of the identity and extended attributes of a file.

    Links are not counted for directories. Where collection failed, ``error`` (text) enters the
    digest, so that a failure yields a stable value of its own and never null.
    """
    parts = [
        F.lit("security-metadata"),
        F.concat(F.lit("dev="), _col(dev).cast("string")),
        F.concat(F.lit("inode="), _col(inode).cast("string")),
        F.when(_col(kind) != "directory", F.concat(F.lit("nlink="), _col(nlink).cast("string"))),
    ]
    if inode_flags is not None:
        parts.append(F.concat(F.lit("flags="), _col(inode_flags).cast("string")))
    if xattrs is not None:
        entries = F.transform(
            F.array_sort(F.map_entries(_col(xattrs))),
            lambda e: F.concat(F.hex(e["key"]), F.lit("="), F.hex(e["value"])),
        )
        parts.append(F.concat(F.lit("xattrs="), F.array_join(entries, ",")))
    if error is not None:
        parts.append(F.concat(F.lit("error="), _col(error)))
    return text_digest(F.concat_ws("|", *parts))


def registry_key_digest(subkeys, values, mtime_ns) -> Column:
    return text_digest(F.concat_ws("|", F.lit("registry-key"), *[
        _col(c).cast("string") for c in (subkeys, values, mtime_ns)]))


def registry_value_digest(value_kind, data) -> Column:
    data = _col(data).cast("binary")
    return text_digest(F.concat_ws("|", F.lit("registry-value"), _col(value_kind).cast("string"),
                                   F.octet_length(data).cast("string"), F.hex(data)))
