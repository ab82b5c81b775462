"""Running counts over ordered rows without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 100_000


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Sum of `value` over a key's rows up to the current one. `order` is a dense integer
    position: rows are summed within chunks of it, and chunk totals are summed before them."""
    chunked = df.withColumn("_value", value).withColumn("_chunk", F.floor(F.col(order) / chunk))
    totals = chunked.groupBy(key, "_chunk").agg(F.sum("_value").alias("_total"))
    ahead = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_chunk", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = chunked.withColumn("_inside", F.sum("_value").over(inside)).join(offsets, [key, "_chunk"])
    return summed.withColumn(name, F.col("_before") + F.col("_inside")).drop("_value", "_chunk", "_before", "_inside")
