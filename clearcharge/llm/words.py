"""Items with equal word sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def same_words(items: DataFrame) -> DataFrame:
    """item, head: the smallest item with the same words (ASCII letters lowered). Wordless items are left out."""
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = items.select("item", F.sha2(F.array_join(F.regexp_extract_all(lowered, F.lit(f"({LETTERS})"), F.lit(1)), " "), 256).alias("same"), F.size(F.regexp_extract_all(lowered, F.lit(f"({LETTERS})"), F.lit(1))).alias("n")).filter("n > 0")
    heads = keyed.groupBy("same").agg(F.min("item").alias("head"))
    return keyed.join(heads, "same").select("item", "head").distinct()
