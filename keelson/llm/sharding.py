"""Extendible hashing: rows go to shards below a byte limit. DataFrame operations only.

A row's hash is 60 bits of its key's md5, continued by 60 bits of the md5 of the whole row. The
directory is addressed by hash prefixes; a bucket splits on its next bit only while it holds more
than ``limit`` bytes and more than one row. Keys that many rows share are thus split by content;
rows equal in every column are dealt to numbered pages, as no bit can tell them apart.

Nulls: a null key hashes like a text of its own, a null payload has size 0. An empty table has no
shards. One row larger than the limit is a shard of its own. Columns of the input that are named
like a column made here are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from keelson.llm.common import materialise

BITS = 60  # of each of the two hash words
DEEPER = 8  # further bits looked at where a bucket is still too large
MADE = ("shard", "shard_depth", "shard_bytes", "shard_rows")


def hash_word(text: Column) -> Column:
    """The first 60 bits of the md5 of ``text``."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(depth: int) -> list[Column]:
    """The first ``depth`` bits, as the leading bits of either word."""
    first, second = F.col("_w1"), F.col("_w2") if depth > BITS else F.lit(0).cast("bigint")
    if depth <= BITS:
        return [F.shiftright(first, BITS - depth).alias("_p1"), second.alias("_p2")]
    return [first.alias("_p1"), F.shiftright(second, 2 * BITS - depth).alias("_p2")]


def _shorten(depth: Column, known: int) -> tuple[Column, Column]:
    """The first ``depth`` bits of a prefix of ``known`` bits."""
    if known <= BITS:
        return F.expr(f"shiftright(_p1, {known} - _depth)"), F.lit(0).cast("bigint")
    return (
        F.expr(f"IF(_depth <= {BITS}, shiftright(_p1, greatest({BITS} - _depth, 0)), _p1)"),
        F.expr(f"IF(_depth <= {BITS}, 0L, shiftright(_p2, {known} - greatest(_depth, {BITS})))"),
    )


def _hashed(df: DataFrame, key: str, size: Column) -> DataFrame:
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.withColumns(
        {
            "_w1": hash_word(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0null"))),
            "_w2": hash_word(whole),
            "_size": F.coalesce(size, F.lit(0)).cast("bigint"),
        }
    )


def _level(rows: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """Cells of ``depth`` bits with the shallowest bucket below ``above`` that fits, if any does."""
    cells = materialise(
        rows.groupBy(*_prefix(depth)).agg(
            F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")
        )
    )
    steps = F.sequence(F.lit(above), F.lit(depth))
    p1, p2 = _shorten(F.col("_depth"), depth)
    nodes = cells.withColumn("_depth", F.explode(steps)).withColumns({"_b1": p1, "_b2": p2})
    fitting = (
        nodes.groupBy("_depth", "_b1", "_b2")
        .agg(F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows"))
        .filter((F.col("_bytes") <= limit) | (F.col("_rows") == 1))
    )
    found = (
        nodes.drop("_bytes", "_rows")
        .join(fitting, ["_depth", "_b1", "_b2"])
        .groupBy("_p1", "_p2")
        .agg(F.min(F.struct("_depth", "_b1", "_b2", "_bytes", "_rows")).alias("_bucket"))
    )
    return materialise(cells.select("_p1", "_p2").join(found, ["_p1", "_p2"], "left"))


def build_directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """The levels of the directory: (bits, cells with their bucket, null where it goes deeper)."""
    total = rows.agg(F.sum("_size")).first()[0]
    if total is None:
        return []
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 2)
    levels, above = [], 0
    while True:
        level = _level(rows, above, depth, limit)
        levels.append((depth, level))
        left = level.filter(F.col("_bucket").isNull()).select("_p1", "_p2")
        if depth == 2 * BITS or left.isEmpty():
            return levels
        rows = rows.withColumns(dict(zip(("_p1", "_p2"), _prefix(depth))))
        rows = rows.join(left, ["_p1", "_p2"], "left_semi").drop("_p1", "_p2")
        above, depth = depth + 1, min(2 * BITS, depth + DEEPER)


def shard(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``df`` with shard (depth-bits-bits-page), shard_depth, shard_bytes and shard_rows."""
    df = df.drop(*[c for c in df.columns if c in MADE])
    columns = df.columns
    rows = _hashed(df, key, size)
    levels = build_directory(rows, limit)
    out = rows.withColumn(
        "_at", F.lit(None).cast("struct<_depth:int,_b1:bigint,_b2:bigint,_bytes:bigint,_rows:bigint>")
    )
    for depth, level in levels:
        cells = level.filter(F.col("_bucket").isNotNull())
        out = (
            out.withColumns(dict(zip(("_p1", "_p2"), _prefix(depth))))
            .join(cells, ["_p1", "_p2"], "left")
            .withColumn("_at", F.coalesce("_at", "_bucket"))
            .drop("_p1", "_p2", "_bucket")
        )
    placed = _named(out.filter(F.col("_at").isNotNull()), columns, F.lit(0), "_bytes", "_rows")
    if not levels or levels[-1][0] < 2 * BITS:
        return placed
    return placed.unionByName(_pages(out.filter(F.col("_at").isNull()), columns, limit))


def _pages(same: DataFrame, columns, limit) -> DataFrame:
    """Rows equal in every column, counted and written out again page by page."""
    held = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(limit) / F.col("_size")))
    pages = (
        same.groupBy(*[F.col(f"`{c}`") for c in columns], "_w1", "_w2", "_size")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_held", held)
        .withColumn("_page", F.explode(F.expr("sequence(0L, (_n - 1) div _held)")))
        .withColumn("_here", F.least("_held", F.expr("_n - _page * _held")))
        .repartition(F.col("_w1"), F.col("_w2"), F.col("_page"))
        .withColumn("_copy", F.explode(F.expr("sequence(1L, _here)")))
        .withColumn(
            "_at",
            F.struct(
                F.lit(2 * BITS).alias("_depth"), F.col("_w1").alias("_b1"), F.col("_w2").alias("_b2"),
                (F.col("_here") * F.col("_size")).alias("_bytes"), F.col("_here").alias("_rows"),
            ),
        )
    )
    return _named(pages, columns, F.col("_page"), "_bytes", "_rows")


def _named(df, columns, page, size, rows):
    at = F.col("_at")
    return df.select(
        *[F.col(f"`{c}`") for c in columns],
        F.concat_ws("-", at["_depth"], at["_b1"], at["_b2"], page).alias("shard"),
        at["_depth"].alias("shard_depth"),
        at[size].alias("shard_bytes"),
        at[rows].alias("shard_rows"),
    )


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard; the limit bounds what one task writes to a folder."""
    df.repartition("shard").write.partitionBy("shard").parquet(path)
