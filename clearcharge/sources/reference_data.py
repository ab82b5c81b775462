"""Reference inputs: hospitals, ZIP centroids, geocodes, the catalog, reviews, external index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge import schemas
from clearcharge.functions import geo


def read_hospitals(spark: SparkSession, path: str) -> DataFrame:
    """Eight of the published columns, all text."""
    raw = spark.read.option("header", True).option("escape", '"').option("inferSchema", False).csv(path)
    published = {"Facility ID": "ccn", "Facility Name": "name", "Address": "address", "City/Town": "city", "State": "state",
                 "ZIP Code": "zip", "Hospital Type": "hospital_type", "Hospital Ownership": "ownership"}
    return raw.select(*[(geo.zip5(F.col(f"`{p}`")) if n == "zip" else F.col(f"`{p}`")).alias(n) for p, n in published.items()])


def read_zcta(spark: SparkSession, path: str) -> DataFrame:
    """ZIP centroids; the gazetteer pads its last column, header included."""
    raw = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    number = lambda c: F.trim(F.col(c)).cast("double")
    return raw.select(F.trim("GEOID").alias("zip"), number("INTPTLAT").alias("lat"), number("INTPTLONG").alias("lon"),
                      geo.radius_km(number("ALAND")).alias("radius_km"))


def read_coords(spark: SparkSession, path: str | None) -> DataFrame:
    """Accepted coordinates; no path means none were geocoded."""
    if path is None:
        return spark.createDataFrame([], schemas.COORDS)
    return spark.read.option("header", True).schema(schemas.COORDS).csv(path)


def read_geocoder_response(spark: SparkSession, path: str) -> DataFrame:
    """Ragged response rows with `problem` set where a row is not in the geocoder's format."""
    ddl = "id string, input string, status string, match string, matched string, lonlat string, line string, side string"
    return geocoder_rows(spark.read.schema(ddl).option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def geocoder_rows(rows: DataFrame) -> DataFrame:
    """Longitude comes first in the coordinate cell."""
    known = F.coalesce(F.col("status").isin(*fv.GEOCODER_STATUSES), F.lit(False))
    matched = F.col("status") == "Match"
    located = F.coalesce(F.col("lonlat").contains(","), F.lit(False))
    problem = F.when(~known, F.lit("unexpected geocoder response row")).when(matched & ~located, F.lit("Match row without coordinates"))
    part = lambda i: F.when(matched & located, F.element_at(F.split("lonlat", ","), i)).try_cast("double")
    return rows.select("id", "status", part(2).alias("lat"), part(1).alias("lon"), F.when(matched, F.col("match")).alias("match"), problem.alias("problem"))


def reconcile_geocodes(submitted: DataFrame, returned: DataFrame) -> DataFrame:
    """One row per id with what happened to it: ok, missing, unexpected or duplicate."""
    back = returned.groupBy("id").agg(F.count("*").alias("times"), F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("match").alias("match"))
    sent = submitted.select("id", F.lit(True).alias("sent")).distinct()
    joined = sent.join(back, "id", "full_outer")
    status = F.when(F.col("sent").isNull(), F.lit("unexpected")).when(F.col("times").isNull(), F.lit("missing")).when(
        F.col("times") > 1, F.lit("duplicate")).otherwise(F.lit("ok"))
    return joined.select("id", status.alias("outcome"), "lat", "lon", "match")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Services of a catalog file, in file order. `reviewed` keeps whether evidence is there."""
    ddl = ("services array<struct<id:string,category:string,name:string,codes:array<struct<type:string,code:string>>,"
           "aliases:array<string>,qualifiers:map<string,string>,reviewed:string,notes:string>>")
    raw = spark.read.schema(ddl).option("multiLine", True).json(path).select(F.posexplode("services").alias("pos", "s"))
    reviewed = ~F.coalesce(F.trim("s.reviewed"), F.lit("")).isin("", "false", "null", "{}")
    return raw.select(F.col("pos").cast("bigint").alias("pos"), "s.id", "s.category", "s.name", "s.codes", "s.aliases",
                      F.coalesce("s.qualifiers", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")).alias("qualifiers"),
                      reviewed.alias("reviewed"), "s.notes", F.col("s.reviewed").alias("evidence"))


ANSWER_COLUMNS = ("alias_means_this_service", "headline_is_this_service", "billing_class_if_known", "note", "reviewer", "date")


def read_review_answers(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the review sheet where somebody answered something."""
    sheet = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return answered(sheet)


def answered(sheet: DataFrame) -> DataFrame:
    said = [F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in ("alias_means_this_service", "headline_is_this_service", "note")]
    return sheet.filter(F.coalesce(*said).isNotNull())


def read_external_index(spark: SparkSession, path: str) -> DataFrame:
    row = "struct<npi:string,name:string,url:string,address:string,city:string,state:string,zip:string,publish_date:string>"
    raw = spark.read.schema(f"fetched_on string, rows array<{row}>").option("multiLine", True).json(path)
    return raw.select("fetched_on", F.posexplode("rows").alias("row_no", "r")).select("fetched_on", F.col("row_no").cast("bigint").alias("row_no"), "r.*")


def read_run_recording(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hospitals per ZIP, results per service) of a recorded run."""
    line = ("struct<code_type:string,code:string,other_codes:array<string>,description:string,context:string,cash:double,gross:double,min:double,"
            "max:double,setting:string,billing_class:string,modifiers:string,ref:string,note:string>")
    hospital = "struct<ccn:string,name:string,distance_km:double,approximate:boolean,hospital_type:string,steps:array<string>,ok:boolean,reason:string,mrf_url:string>"
    result = (f"struct<ccn:string,name:string,url:string,file_date:string,verdict:string,detail:string,line_count:bigint,hospital_type:string,headline:{line},lines:array<{line}>>")
    ddl = (f"recorded_on string, zips map<string,array<{hospital}>>, "
           f"services map<string,struct<service:string,codes:string,reviewed:string,notes:string,hospitals:array<{result}>>>")
    raw = spark.read.schema(ddl).option("multiLine", True).json(path)
    listed = raw.select("recorded_on", F.map_keys("services").alias("queries"), F.explode("zips").alias("zip", "hospitals"))
    zips = listed.select("recorded_on", "queries", "zip", F.posexplode("hospitals").alias("pos", "h")).select("recorded_on", "queries", "zip", "pos", "h.*")
    services = raw.select(F.explode("services").alias("query", "s")).select("query", "s.service", "s.codes", F.explode("s.hospitals").alias("r")).select("query", "service", "codes", "r.*")
    return zips, services


def recorded_results(zips: DataFrame, services: DataFrame) -> DataFrame:
    """Recorded results joined to the ZIP's hospitals by name, defaults where nothing was recorded."""
    r = services.select("query", "name", F.struct(*[c for c in services.columns if c != "query"]).alias("rec"))
    asked = zips.withColumn("query", F.explode("queries")).drop("queries")
    joined = asked.join(r, ["query", "name"], "left")
    return joined.select(
        "zip", "query", "pos", "ccn", "name", "distance_km", "approximate", F.coalesce("hospital_type", "rec.hospital_type").alias("hospital_type"),
        F.coalesce("rec.url", "mrf_url").alias("url"), F.col("rec.file_date").alias("file_date"),
        F.coalesce("rec.verdict", F.lit(fv.NOT_SCANNED)).alias("verdict"), F.coalesce("rec.detail", F.lit("")).alias("detail"),
        F.coalesce("rec.line_count", F.lit(0)).alias("line_count"), F.col("rec.headline").alias("headline"),
        F.coalesce("rec.lines", F.array()).alias("lines"))
