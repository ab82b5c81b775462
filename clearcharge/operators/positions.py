"""Exact positions and running sums in ordered groups, however much of the table one group holds.

Rows are dealt over ranges of (group, order), so a group with most of the rows covers most of the ranges; what stands
ahead of each range is added from the ranges' own sums. The dealt rows are written once: later passes see the same
ranges even if a task is run again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcharge.session import broadcast_if_small, materialise

PART_ROWS = 500_000


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[Column], part_rows: int | None = None, value: Column | None = None) -> DataFrame:
    """The rows with `_part`, the number of their range, and `_row`, rising in each range. The order must tell rows
    of a group apart: rows that are equal in it share a range. `value` is worked out once, as `_value`, when rows have
    been dealt: the ranges are found by a pass of their own."""
    rows = part_rows or PART_ROWS
    parts = max(1, -(-df.count() // rows))
    # A shuffle to one range: rows that are few at the end may come from work that takes all tasks.
    ranged = df.repartitionByRange(parts, *by, *order) if parts > 1 else df.repartition(1)
    ranged = ranged.sortWithinPartitions(*by, *order)
    ranged = ranged if value is None else ranged.withColumn("_value", value)
    return materialise(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "dealt", "zstd")


def _ahead(rows: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Each row with the sums over its group's earlier ranges, and `_first`, its group's first row in the range."""
    per_part = rows.groupBy("_part", *by).agg(F.min("_row").alias("_first"), *[v.alias(f"_{name}") for name, v in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = per_part.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], "_first", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_part") == F.col("_p"))
    return rows.join(broadcast_if_small(materialise(totals, "ahead")), same).drop("_p", *[f"_by_{c}" for c in by])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, part_rows: int | None = None, value: str | Column | None = None, before: str | None = None) -> DataFrame:
    """`name`: a row's place in its group, from 1. With `value` (a column, or what to work out of a row), also `before`:
    its sum over the rows that stand before this one."""
    made = isinstance(value, Column)
    rows = dealt(df, by, order, part_rows, value if made else None)
    value = "_value" if made else value
    sums = {"n": F.count("*")} | ({"sum": F.sum(value)} if value else {})
    placed = _ahead(rows, by, sums).withColumn(name, F.col("_n") + F.col("_row") - F.col("_first") + 1)
    if value:
        inside = Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).withColumn(before, F.coalesce("_sum", F.lit(0)) + F.col("_inside")).drop("_sum", "_inside")
    return placed.drop("_part", "_row", "_first", "_n", "_value")


def summed_before(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str, part_rows: int | None = None) -> DataFrame:
    """`name`: the sum of `value` over the rows of the group that stand before this one."""
    return numbered(df, by, order, "_place", part_rows, value, name).drop("_place")
