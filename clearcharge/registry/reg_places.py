"""Hospitals on the map, nearest-k, and the reference-data gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import geo
from clearcharge.operators import places
from clearcharge.plans import reference_build
from clearcharge.registry import duck, views
from clearcharge.registry.core import register
from clearcharge.session import materialise
from clearcharge.sources import reference_data

K = 5
_ROUND = ("lat", "lon", "zip_radius_km", "distance_km", "uncertainty_km")


def located_hospitals(spark, folder):
    raw, coords, zcta = views.load(spark, folder, "d_raw_hospitals", "d_coords", "d_zcta")
    raw = raw.withColumn("zip", geo.zip5(F.col("zip"))).drop("s_suppkey", "s_nationkey")
    return places.locate_hospitals(raw, coords, zcta), zcta


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in _ROUND else c for c in df.columns])


LOCATED = f"""{views.with_views('d_raw_hospitals', 'd_coords', 'd_zcta')},
checked AS (
    SELECT r.ccn, r.name, r.address, r.city, r.state, lpad(r.zip, 5, '0') AS zip, r.hospital_type, r.ownership, c.lat AS g_lat, c.lon AS g_lon, c.match, z.lat AS z_lat, z.lon AS z_lon, z.radius_km,
           {duck.haversine('c.lat', 'c.lon', 'z.lat', 'z.lon')} AS off_km
    FROM d_raw_hospitals r LEFT JOIN d_coords c ON c.ccn = r.ccn LEFT JOIN d_zcta z ON z.zip = lpad(r.zip, 5, '0')),
judged AS (SELECT *, g_lat IS NOT NULL AND (z_lat IS NULL OR off_km <= 3 * radius_km + 2) AS ok FROM checked),
hospitals AS (
    SELECT ccn, name, address, city, state, zip, hospital_type, ownership, CASE WHEN ok THEN g_lat ELSE z_lat END AS lat, CASE WHEN ok THEN g_lon ELSE z_lon END AS lon,
           CASE WHEN ok THEN 'address' WHEN z_lat IS NOT NULL THEN 'zip' ELSE 'unresolved' END AS location_source, CASE WHEN ok THEN match END AS geocode_match,
           coalesce(radius_km, 0) AS zip_radius_km,
           CASE WHEN match IS NOT NULL AND NOT ok THEN match || ' geocode rejected: ' || format('{{:.0f}}', off_km) || ' km from the ' || zip || ' centroid' END AS location_note
    FROM judged)"""
FEDERAL = ", ".join(f"'{t}'" for t in fv.FEDERAL_TYPES)
NEAREST = f"""{LOCATED},
measured AS (
    SELECT o.zip AS query_zip, h.*, {duck.haversine('o.lat', 'o.lon', 'h.lat', 'h.lon')} AS distance_km
    FROM d_zcta o CROSS JOIN hospitals h WHERE h.location_source <> 'unresolved' AND h.hospital_type NOT IN ({FEDERAL})),
nearest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_zip ORDER BY distance_km, location_source, name, ccn) AS rank FROM measured) WHERE rank <= {K})"""


@register("J1_locate_hospitals", f"{LOCATED} SELECT * REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon, round(zip_radius_km, 6) AS zip_radius_km) FROM hospitals")
def locate(spark, folder):
    return rounded(located_hospitals(spark, folder)[0])


@register("A1_location_counts", f"{LOCATED} SELECT s AS location_source, (SELECT count(*) FROM hospitals WHERE location_source = s) AS n FROM (VALUES ('address'), ('zip'), ('unresolved')) t(s)")
def counted(spark, folder):
    return places.location_counts(located_hospitals(spark, folder)[0])


@register("A14_rejected_geocodes", f"{LOCATED} SELECT count(location_note) AS rejected FROM hospitals")
def rejected(spark, folder):
    return located_hospitals(spark, folder)[0].agg(F.count("location_note").alias("rejected"))


def nearest_k(spark, folder):
    hospitals, zcta = located_hospitals(spark, folder)
    return places.nearest_hospitals(hospitals, zcta, zcta.select("zip"), K)


@register("J7_W1_nearest_hospitals", f"""{NEAREST} SELECT query_zip, CAST(rank AS INT) AS rank, ccn, name, address, city, state, zip, hospital_type, ownership, round(distance_km, 6) AS distance_km,
    round(CASE WHEN location_source = 'zip' THEN zip_radius_km ELSE 0 END, 6) AS uncertainty_km, location_source = 'zip' AS approximate, location_source, geocode_match, location_note FROM nearest""")
def nearest(spark, folder):
    return rounded(nearest_k(spark, folder))


@register("F2_F3_placeable", f"{LOCATED} SELECT ccn, hospital_type FROM hospitals WHERE location_source <> 'unresolved' AND hospital_type NOT IN ({FEDERAL})")
def placeable(spark, folder):
    return places.placeable(located_hospitals(spark, folder)[0]).select("ccn", "hospital_type")


_ZIP_ASKED = "SELECT CAST(10000 + o_custkey * 3 AS STRING) AS zip FROM orders"


@register("F16_unknown_zips", f"{views.with_views('d_zcta')} SELECT DISTINCT zip, zip || ' is not a residential ZIP code in the census ZCTA list' AS reason FROM ({_ZIP_ASKED}) WHERE zip NOT IN (SELECT zip FROM d_zcta)")
def unknown(spark, folder):
    zcta, orders = views.load(spark, folder, "d_zcta", "orders")
    return places.unknown_zips(orders.selectExpr("CAST(10000 + o_custkey * 3 AS STRING) AS zip"), zcta)


@register("F18_hospitals_by_id", f"""{LOCATED}, ids AS (SELECT DISTINCT 'H' || (c_custkey // 5) AS ccn FROM customer)
    SELECT ids.ccn, h.name, h.location_source, round(CASE WHEN location_source = 'zip' THEN zip_radius_km ELSE 0 END, 6) AS uncertainty_km, 0.0::DOUBLE AS distance_km,
           CASE WHEN h.ccn IS NULL THEN 'no hospital with CCN ' || ids.ccn END AS reason FROM ids LEFT JOIN hospitals h ON h.ccn = ids.ccn""")
def by_id(spark, folder):
    hospitals, _ = located_hospitals(spark, folder)
    (customer,) = views.load(spark, folder, "customer")
    ids = customer.select(F.concat(F.lit("H"), F.floor(F.col("c_custkey") / 5).cast("string")).alias("ccn"))
    return rounded(places.hospitals_by_id(hospitals, ids).select("ccn", "name", "location_source", "uncertainty_km", "distance_km", "reason"))


@register("W10_U1_first_come", f"""{NEAREST}, placed AS (SELECT n.*, CAST(query_zip AS BIGINT) * 7919 % 10007 AS zip_pos FROM nearest n)
    SELECT ccn, query_zip, zip_pos, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ccn ORDER BY zip_pos, rank, query_zip) AS nth FROM placed) WHERE nth = 1""")
def first_come(spark, folder):
    near = materialise(nearest_k(spark, folder).select("ccn", "query_zip", "rank"), "nearest")  # read twice
    order = near.select(F.col("query_zip").alias("zip")).distinct().withColumn("zip_pos", F.col("zip").cast("bigint") * 7919 % 10007)
    return places.first_come(near, order).select("ccn", "query_zip", "zip_pos", "rank")


@register("Q1_build_gates", f"""{LOCATED}, n AS (SELECT (SELECT count(*) FROM d_zcta) AS zips, count(*) AS hospitals, count(*) FILTER (WHERE location_source = 'address') AS address,
        count(*) FILTER (WHERE location_source = 'zip') AS zip, count(*) FILTER (WHERE location_source = 'unresolved') AS unresolved, count(location_note) AS rejected_geocodes FROM hospitals)
    SELECT *, CASE WHEN zips < 10 OR hospitals < 10 THEN 'implausible row counts: ' || zips || ' ZIPs, ' || hospitals || ' hospitals' WHEN unresolved > hospitals * 0.001 THEN unresolved || ' of ' || hospitals || ' hospitals unresolved'
        WHEN address < hospitals * 0.5 THEN 'only ' || address || ' of ' || hospitals || ' hospitals located by address; the geocoding result looks wrong' END AS failed FROM n""")
def gated(spark, folder):
    hospitals, zcta = located_hospitals(spark, folder)
    return reference_build.gates(zcta, hospitals, True, min_zips=10, min_hospitals=10, max_unresolved_share=0.001)


@register("K9_source_row_counts", """SELECT r_name AS name, CASE WHEN r_regionkey = 1 THEN 77 ELSE CASE r_regionkey WHEN 0 THEN (SELECT count(*) FROM supplier) WHEN 2 THEN (SELECT count(*) FROM customer) END END AS rows FROM region""")
def source_counts(spark, folder):
    region, supplier, customer = views.load(spark, folder, "region", "supplier", "customer")
    named = region.select("r_name", F.when(F.col("r_regionkey") == 0, fv.HOSPITAL_DATASET).when(F.col("r_regionkey") == 2, fv.ZIP_DATASET).otherwise(F.col("r_name")).alias("name"),
                          F.when(F.col("r_regionkey") == 1, F.lit(77).cast("bigint")).alias("rows"))
    totals = supplier.agg(F.count("*").alias("h")).withColumn("one", F.lit(1)).join(customer.agg(F.count("*").alias("z")).withColumn("one", F.lit(1)), "one")
    joined = named.withColumn("one", F.lit(1)).join(totals, "one")
    return reference_build.with_row_counts(joined, F.col("z"), F.col("h")).select(F.col("r_name").alias("name"), "rows")


_RESPONSE = """SELECT CAST(c_custkey - CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS STRING) AS id,
    CASE c_custkey % 6 WHEN 0 THEN 'No_Match' WHEN 1 THEN 'Tie' WHEN 2 THEN '<html>' ELSE 'Match' END AS status, 'Exact' AS match,
    CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(-95 - c_custkey % 7 AS STRING) || '.5,' || CAST(29 + c_custkey % 5 AS STRING) || '.25' END AS lonlat FROM customer"""


@register("S15_geocoder_rows", f"""SELECT id, status, CASE WHEN status = 'Match' THEN CAST(split_part(lonlat, ',', 2) AS DOUBLE) END AS lat, CASE WHEN status = 'Match' THEN CAST(split_part(lonlat, ',', 1) AS DOUBLE) END AS lon,
    CASE WHEN status = '<html>' THEN 'unexpected geocoder response row' WHEN status = 'Match' AND lonlat IS NULL THEN 'Match row without coordinates' END AS problem FROM ({_RESPONSE})""")
def geocoder(spark, folder):
    views.load(spark, folder, "d_zcta")
    return reference_data.geocoder_rows(spark.sql(_RESPONSE)).select("id", "status", "lat", "lon", "problem")


@register("J12_U2_reconcile", f"""WITH back AS (SELECT id, count(*) AS n FROM ({_RESPONSE}) GROUP BY id), sent AS (SELECT DISTINCT CAST(c_custkey + c_custkey % 2 AS STRING) AS id FROM customer)
    SELECT coalesce(sent.id, back.id) AS id, CASE WHEN sent.id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS outcome FROM sent FULL OUTER JOIN back ON sent.id = back.id""")
def reconciled(spark, folder):
    views.load(spark, folder, "d_zcta")
    sent = spark.sql("SELECT CAST(c_custkey + c_custkey % 2 AS STRING) AS id FROM customer")
    return reference_data.reconcile_geocodes(sent, reference_data.geocoder_rows(spark.sql(_RESPONSE))).select("id", "outcome")
