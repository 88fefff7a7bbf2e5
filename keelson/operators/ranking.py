"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.session import materialise

PART_ROWS = 1_000_000  # rows that one task numbers


def rank_in_groups(df: DataFrame, keys, order, out="rank", part_rows: int | None = None) -> DataFrame:
    """``row_number`` of each row within ``keys`` by ``order``: a column name or sort expressions.

    The rows are stored and split into ranges of (keys, order), as many as their count asks for, so
    a group of any size spreads over as many parts as it fills. Each part numbers its groups on its
    own. Only the first group of a part can have begun in an earlier one: the rows it has there are
    counted per part and added as prefix sums. These tables have a row or two per part and are
    broadcast; no group is looked for by its size. ``order`` should be unique in a group and the keys
    not null.
    """
    keys = list(keys)
    order = [F.col(order)] if isinstance(order, str) else list(order)
    stored = materialise(df)
    parts = -(-stored.count() // (part_rows or PART_ROWS))  # counted from the files' footers
    if parts <= 1:
        own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return stored.withColumn(out, own.cast("long"))
    dealt = stored.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt)
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    return (
        dealt.withColumn(out, local)
        .join(F.broadcast(_carried(dealt, keys)), ["_part", *keys], "left")
        .withColumn(out, (F.col(out) + F.coalesce("_before", F.lit(0))).cast("long"))
        .drop("_part", "_before")
    )


def _carried(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """(_part, keys, _before): the rows that the first group of a part has in earlier parts."""
    first = F.min(F.struct(*[F.col(k) for k in keys])).alias("_key") if keys else F.lit(0).alias("_key")
    heads = dealt.groupBy("_part").agg(first)
    named = [F.col("_key")[k].alias(k) for k in keys]
    shared = dealt.select("_part", *keys)
    if keys:
        shared = shared.join(F.broadcast(heads.select(*named).distinct()), keys)
    counted = shared.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("_part", *keys, F.sum("_rows").over(earlier).alias("_before")).filter("_before IS NOT NULL")


def first_in_groups(df: DataFrame, keys, order: list[Column], top: int, out: str) -> DataFrame:
    """The first ``top`` rows of each group, numbered, where ``top`` may be large."""
    return rank_in_groups(df, keys, order, out).filter(F.col(out) <= top)
