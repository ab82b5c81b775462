"""Newest rows: discoveries, extractions, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv


def newest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The newest row per key. `row_number = 1` is cut inside each task before the shuffle."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_nth = 1").drop("_nth")


def days_before(as_of: Column, then: Column) -> Column:
    """Age in days with fractions."""
    return (F.unix_micros(as_of) - F.unix_micros(then)) / (86_400 * 1_000_000)


def cached_discovery(hospital_files: DataFrame, as_of: Column, within_ttl: bool = True) -> DataFrame:
    """The latest discovery per hospital, with `stale`. A failure recorded by an older
    discovery never counts; past its time to live a row counts only on the read path."""
    last = newest(hospital_files, ["ccn"], F.col("discovered_at").desc())
    current = last.filter(F.col("ok") | (F.col("discovery_version") == fv.DISCOVERY_VERSION))
    ttl = F.when(F.col("ok"), F.lit(fv.SUCCESS_TTL_DAYS)).otherwise(F.lit(fv.FAILURE_TTL_DAYS))
    aged = current.withColumn("stale", days_before(as_of, F.col("discovered_at")) > ttl)
    return aged.filter(~F.col("stale")) if within_ttl else aged


def latest_extraction(fetches: DataFrame, extractions: DataFrame, files: DataFrame) -> DataFrame:
    """Per URL: the newest fetch whose bytes have a good extraction by the current parser."""
    good = extractions.filter(F.col("ok") & (F.col("parser_version") == fv.PARSER_VERSION)).select("checksum", "extraction_id", "charges", "items")
    dated = files.select("checksum", "last_updated_on")
    with_rows = fetches.filter(F.col("checksum").isNotNull()).join(good, "checksum")
    last = newest(with_rows, ["url"], F.col("fetched_at").desc(), F.col("extraction_id"))
    return last.join(dated, "checksum", "left").select(
        "url", "checksum", "etag", "last_modified", "fetched_at", "extraction_id", "charges", "items", "last_updated_on", "size_bytes")


def newest_sources(sources: DataFrame) -> DataFrame:
    return newest(sources, ["name"], F.col("fetched_at").desc())
