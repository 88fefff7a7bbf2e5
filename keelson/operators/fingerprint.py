"""Order-free fingerprint of a snapshot table and its verification against a manifest.

The fingerprint is a multiset hash: every row's digest of 512 bits is cut into limbs of 20 bits, and
each limb is added up over all rows. Sums of parts of a table add up to those of the whole, so they
combine in every task and no row or digest is shuffled; a row that stands twice counts twice. 64-bit
sums hold more than 10^12 rows. The content hash is the digest of the count and the sums. It shows any
change of rows; for proof against a writer who may choose very many rows, keep checkpoints off the host.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from keelson.functions.digests import text_digest
from keelson.schemas import FILE_SNAPSHOT

LIMB = 5  # hex digits of a limb
DIGITS = 128
LIMBS = -(-DIGITS // LIMB)


def row_digest() -> Column:
    """512 bits over all columns of a snapshot row as hex; null differs from every text."""
    fields = [
        F.coalesce(F.concat(F.lit("="), F.col(f.name).cast("string")), F.lit("-"))
        for f in FILE_SNAPSHOT.fields
    ]
    text = F.concat_ws("\u001f", *fields)
    return F.concat(*[text_digest(F.concat(F.lit(half), text)) for half in "01"])


def sums(digest: str = "_digest") -> dict[str, Column]:
    """The aggregates of a fingerprint over rows that hold their ``digest``."""
    limb = lambda k: F.conv(F.substring(digest, 1 + k * LIMB, LIMB), 16, 10).cast("long")
    added = {f"_limb{k}": F.coalesce(F.sum(limb(k)), F.lit(0).cast("long")) for k in range(LIMBS)}
    return {"records": F.count(F.lit(1)), **added}


def content_hash(found: dict) -> str:
    """The content hash of collected ``sums``."""
    return hashlib.sha256(":".join(str(found[name]) for name in sums()).encode()).hexdigest()


def fingerprint(snapshot: DataFrame, by=()) -> DataFrame:
    """Rows (by, records, content_hash), one in all without ``by``."""
    added = sums()
    rows = snapshot.withColumn("_digest", row_digest()).groupBy(*by)
    found = rows.agg(*[column.alias(name) for name, column in added.items()])
    text = F.concat_ws(":", *[F.col(name).cast("string") for name in added])
    return found.select(*by, "records", text_digest(text).alias("content_hash"))


EMPTY = hashlib.sha256(":".join(["0"] * (1 + LIMBS)).encode()).hexdigest()


def verify_baseline(
    snapshot: DataFrame,
    manifest: DataFrame,
    by=("host",),
    scan_byte_limit: int | None = None,
    config_hash: str | None = None,
) -> DataFrame:
    """Manifest rows with ``mismatches``: the names of what does not agree with the records.

    ``by`` are the columns, present on both sides, that tell whose records a manifest describes.
    """
    by = list(by)
    found = fingerprint(snapshot, by).select(
        *by, F.col("records").alias("_records"), F.col("content_hash").alias("_content")
    )
    records = F.coalesce("_records", F.lit(0))
    content = F.coalesce("_content", F.lit(EMPTY))
    tests = [("record_count", F.col("records") != records)]
    if scan_byte_limit is not None:
        tests.append(("scan_byte_limit", F.col("scan_byte_limit") != F.lit(scan_byte_limit)))
    if config_hash is not None:
        tests.append(("config_hash", ~F.col("config_hash").eqNullSafe(F.lit(config_hash))))
    tests.append(("content_hash", F.col("content_hash") != content))
    mismatches = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    return manifest.join(found, by, "left").select(
        *manifest.columns, mismatches.alias("mismatches")
    )


def generation_guard(manifest: DataFrame, minimum: int) -> DataFrame:
    """Fail the query for a generation older than required."""
    message = F.concat(
        F.lit("baseline generation "), F.col("generation").cast("string"),
        F.lit(f" is older than the required {minimum}"),
    )
    checked = F.when(F.col("generation") < minimum, F.raise_error(message).cast("long")).otherwise(
        F.col("generation")
    )
    return manifest.withColumn("generation", checked)
