"""Build the reference tables beside the old ones, check them, publish only when sound."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge import schemas
from clearcharge.operators import places
from clearcharge.sources import store


class BuildFailed(RuntimeError):
    """A gate was not met; what was published before is untouched."""


def gates(zcta: DataFrame, hospitals: DataFrame, geocoded: bool, min_zips: int = fv.MIN_ZIPS, min_hospitals: int = fv.MIN_HOSPITALS,
          min_address_share: float = fv.MIN_ADDRESS_SHARE, max_unresolved_share: float = fv.MAX_UNRESOLVED_SHARE) -> DataFrame:
    """One row: counts, and the first gate that failed (NULL when all hold)."""
    z = zcta.agg(F.count("*").alias("zips"))
    h = hospitals.agg(
        F.count("*").alias("hospitals"), *[F.count_if(F.col("location_source") == s).alias(s) for s in fv.LOCATION_SOURCES],
        F.count_if(F.col("location_note").isNotNull()).alias("rejected_geocodes"))
    row = z.withColumn("_one", F.lit(1)).join(h.withColumn("_one", F.lit(1)), "_one").drop("_one")
    n = lambda c: F.col(c).cast("string")
    failed = (
        F.when((F.col("zips") < min_zips) | (F.col("hospitals") < min_hospitals), F.concat(F.lit("implausible row counts: "), n("zips"), F.lit(" ZIPs, "), n("hospitals"), F.lit(" hospitals")))
        .when(F.col("unresolved") > F.col("hospitals") * max_unresolved_share, F.concat(n("unresolved"), F.lit(" of "), n("hospitals"), F.lit(" hospitals unresolved")))
        .when(F.lit(geocoded) & (F.col("address") < F.col("hospitals") * min_address_share), F.concat(F.lit("only "), n("address"), F.lit(" of "), n("hospitals"), F.lit(" hospitals located by address; the geocoding result looks wrong"))))
    return row.withColumn("failed", failed)


def with_row_counts(sources: DataFrame, zips: Column, hospitals: Column) -> DataFrame:
    """A given count wins; otherwise the dataset's own loaded rows."""
    known = F.when(F.col("name") == fv.HOSPITAL_DATASET, hospitals).when(F.col("name") == fv.ZIP_DATASET, zips)
    return sources.withColumn("rows", F.coalesce(F.when(F.col("rows") != 0, F.col("rows")), known))


def build(spark: SparkSession, root: str, version: str, raw_hospitals: DataFrame, zcta: DataFrame, coords: DataFrame, sources: DataFrame,
          geocoded: bool, built_at, previous: str | None = None, **limits) -> dict:
    """Write `root/version`, check it, then point `root/current` at it. Tables other than the
    reference ones are carried over from `root/previous` in their current shape."""
    target = f"{root}/{version}"
    store.overwrite(zcta, target, "zcta")
    located = places.locate_hospitals(raw_hospitals, coords, store.read_table(spark, target, "zcta"))
    store.overwrite(located, target, "hospitals")
    checked = gates(store.read_table(spark, target, "zcta"), store.read_table(spark, target, "hospitals"), geocoded, **limits).collect()[0].asDict()
    if checked["failed"]:
        raise BuildFailed(checked["failed"])
    carried = []
    if previous:
        for name in schemas.TABLES:
            if name not in schemas.REFERENCE_TABLES and store.exists(spark, store.table_path(f"{root}/{previous}", name)):
                store.overwrite(store.carry_over(store.read_table(spark, f"{root}/{previous}", name), name), target, name)
                carried.append(name)
    counted = with_row_counts(sources, F.lit(checked["zips"]), F.lit(checked["hospitals"])).withColumn("fetched_at", F.lit(built_at).cast("timestamp"))
    store.append(counted, target, "sources")
    publish(spark, root, version)
    return {**checked, "carried_tables": carried}


def publish(spark: SparkSession, root: str, version: str) -> None:
    """The pointer is a small log: each publication adds a row and deletes nothing, so there is a current version at
    every moment, also after a crash."""
    spark.createDataFrame([(time.time_ns(), version)], "published_at bigint, version string").coalesce(1).write.mode("append").parquet(f"{root}/current")


def current(spark: SparkSession, root: str) -> str:
    return spark.read.parquet(f"{root}/current").agg(F.max_by("version", "published_at")).first()[0]
