"""Hospitals on the map and the nearest of them to a ZIP."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions import geo
from clearcharge.session import materialise


def locate_hospitals(raw: DataFrame, coords: DataFrame, zcta: DataFrame) -> DataFrame:
    """Best coordinate per hospital: its geocode unless it lies too far from its ZIP's
    centroid, else the centroid, else none."""
    c = coords.select("ccn", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), F.col("match"), F.lit(True).alias("coded"))
    z = zcta.select("zip", F.col("lat").alias("z_lat"), F.col("lon").alias("z_lon"), "radius_km", F.lit(True).alias("known_zip"))
    joined = raw.join(c, "ccn", "left").join(z, "zip", "left")
    off_km = geo.haversine_km(F.col("g_lat"), F.col("g_lon"), F.col("z_lat"), F.col("z_lon"))
    near = off_km <= fv.GEOCODE_RADII * F.col("radius_km") + fv.GEOCODE_SLACK_KM
    ok = F.coalesce(F.col("coded") & (F.col("known_zip").isNull() | near), F.lit(False))
    return joined.select(
        "ccn", "name", "address", "city", "state", "zip", "hospital_type", "ownership",
        F.when(ok, F.col("g_lat")).otherwise(F.col("z_lat")).alias("lat"),
        F.when(ok, F.col("g_lon")).otherwise(F.col("z_lon")).alias("lon"),
        F.when(ok, F.lit("address")).when(F.col("z_lat").isNotNull(), F.lit("zip")).otherwise(F.lit("unresolved")).alias("location_source"),
        F.when(ok, F.col("match")).alias("geocode_match"), F.coalesce("radius_km", F.lit(0.0)).alias("zip_radius_km"),
        F.when(F.col("match").isNotNull() & ~ok, geo.rejected_note(F.col("match"), off_km, F.col("zip"))).alias("location_note"))


def location_counts(hospitals: DataFrame) -> DataFrame:
    """Hospitals per location source, zeros included."""
    counted = hospitals.agg(*[F.count_if(F.col("location_source") == s).alias(s) for s in fv.LOCATION_SOURCES])
    return counted.unpivot([], list(fv.LOCATION_SOURCES), "location_source", "n")


def placeable(hospitals: DataFrame, include_federal: bool = False) -> DataFrame:
    kept = hospitals.filter(F.col("location_source") != "unresolved")
    return kept if include_federal else kept.filter(~F.coalesce(F.col("hospital_type").isin(*fv.FEDERAL_TYPES), F.lit(False)))


# --- nearest k --------------------------------------------------------------------------
# Cells of a latitude/longitude grid, each level 8 times finer than the one before. Sizes
# are powers of two, so cell numbers are exact.
_TOP_DEGREES = 8.0
_REFINE = 8
_MAX_LEVEL = 4
_CROWD = 4  # points per finest cell aimed at


def _size(level: int) -> float:
    return _TOP_DEGREES / _REFINE**level


def _cell(level: int, lat: str = "lat", lon: str = "lon") -> list[Column]:
    s = _size(level)
    return [F.floor((F.col(lat) + 90) / s), F.floor((F.col(lon) + 180) / s)]


# Candidates an origin meets in one row; more come in several rows.
_LIST = 1_000


def _span(at_low: Column, at_high: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Least and greatest distance in degrees between two intervals."""
    outside = F.greatest(low - at_high, at_low - high, F.lit(0.0))
    return outside, F.greatest(F.abs(at_high - low), F.abs(at_low - high))


def _bounds(level: int, y: Column, x: Column) -> tuple[Column, Column]:
    """Kilometres no point of a cell is nearer than to any origin of a group, and none is farther than. The group's
    origins lie in the box (south, north, west, east)."""
    s = _size(level)
    south, north, west, east = (F.col(c) for c in ("south", "north", "west", "east"))
    lat_low, lat_high = y * s - 90, (y + 1) * s - 90
    lon_low, lon_high = x * s - 180, (x + 1) * s - 180
    near_lat, far_lat = _span(south, north, lat_low, lat_high)
    near_lon = F.least(*[_span(west + turn, east + turn, lon_low, lon_high)[0] for turn in (-360, 0, 360)])
    far_lon = F.least(_span(west, east, lon_low, lon_high)[1], F.lit(180.0))
    narrow = F.cos(F.radians(F.greatest(F.abs(south), F.abs(north))))
    wide = F.cos(F.radians(F.greatest(south, -north, F.lit(0.0))))
    r = fv.EARTH_RADIUS_KM
    sideways = F.asin(F.least(narrow * F.sin(F.radians(F.least(near_lon, F.lit(90.0)))), F.lit(1.0)))
    low = r * F.greatest(F.radians(near_lat), sideways)
    high = r * (F.radians(far_lat) + wide * F.radians(far_lon))
    return low, high


def _keep_reachable(cells: DataFrame, level: int, k: int) -> DataFrame:
    """Cells that can hold one of the k nearest of any origin of a group (gy, gx): those no farther than the distance
    within which the counted cells already guarantee k."""
    low, high = _bounds(level, F.col("y"), F.col("x"))
    bounded = cells.withColumn("low", low).withColumn("high", high)
    group = Window.partitionBy("gy", "gx")
    reached = bounded.withColumn("so_far", F.sum("n").over(group.orderBy("high").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    limit = F.min(F.when(F.col("so_far") >= k, F.col("high"))).over(group)
    near = reached.withColumn("within", limit).filter(F.col("within").isNull() | (F.col("low") <= F.col("within") + 1e-6))
    return near.drop("low", "high", "so_far", "within")


def _groups(origins: DataFrame, level: int) -> DataFrame:
    """Origins of one cell (gy, gx) and the box they lie in."""
    y, x = _cell(level, "o_lat", "o_lon")
    return origins.groupBy(y.alias("gy"), x.alias("gx")).agg(
        F.min("o_lat").alias("south"), F.max("o_lat").alias("north"), F.min("o_lon").alias("west"), F.max("o_lon").alias("east"))


def _parent(name: str) -> Column:
    return F.floor(F.col(name) / _REFINE)


def nearest_hospitals(hospitals: DataFrame, zcta: DataFrame, zips: DataFrame, limit: int = 5, include_federal: bool = False) -> DataFrame:
    """The `limit` hospitals nearest each requested ZIP's centroid, with their rank.

    Works down a grid with the origins of one cell together: at each level a cell of origins keeps only the cells that
    can still hold one of the nearest of any of them, so nothing per origin is shuffled but what it reports. At the end
    each origin measures the hospitals of its cell's list, in its own row. Hospitals at one and the same point are first
    cut to the `limit` that could be reported."""
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    tie = ["location_source", "name", "ccn"]
    at_point = Window.partitionBy("lat", "lon").orderBy(*tie)
    points = placeable(hospitals, include_federal).withColumn("at_point", F.row_number().over(at_point)).filter(F.col("at_point") <= limit)
    points = materialise(points.drop("at_point").withColumn("point", F.monotonically_increasing_id()), "hospital-points")
    origins = zips.select("zip").distinct().join(zcta.select("zip", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon")), "zip").select(
        F.col("zip").alias("origin"), "o_lat", "o_lon")

    def counted(level: int) -> DataFrame:
        y, x = _cell(level)
        return points.groupBy(y.alias("y"), x.alias("x")).agg(F.count("*").alias("n"))

    # Level 0: at most 23 x 46 occupied cells on the whole globe, as one literal array.
    top = [(int(r["y"]), int(r["x"]), int(r["n"])) for r in counted(0).collect()]
    if not top:
        return origins.crossJoin(points.limit(0)).select(*_nearest_columns(F.lit(0.0), F.lit(0)))
    last = min(_MAX_LEVEL, max(1, math.ceil(math.log(sum(n for _, _, n in top) / (_CROWD * len(top)), _REFINE**2))))
    y, x = _cell(last, "o_lat", "o_lon")
    origins = materialise(origins.withColumn("gy", y).withColumn("gx", x), "nearest-origins")
    roots = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(n).alias("n")) for y, x, n in top])
    frontier = _keep_reachable(_groups(origins, 0).select("*", F.inline(roots)), 0, limit)
    for level in range(1, last + 1):
        above = frontier.select(F.col("gy").alias("above_y"), F.col("gx").alias("above_x"), "y", "x", "n")
        inside = _parent("gy").eqNullSafe(F.col("above_y")) & _parent("gx").eqNullSafe(F.col("above_x"))
        kept = _keep_reachable(_groups(origins, level).join(above, inside).drop("above_y", "above_x"), level - 1, limit)
        finer = counted(level).withColumns({"parent_y": _parent("y"), "parent_x": _parent("x")})
        kept = kept.drop("n").withColumnsRenamed({"y": "parent_y", "x": "parent_x"})
        frontier = _keep_reachable(kept.join(finer, ["parent_y", "parent_x"]).drop("parent_y", "parent_x"), level, limit)
    lists = F.greatest(F.ceil(F.sum("n").over(Window.partitionBy("gy", "gx")) / _LIST), F.lit(1))
    y, x = _cell(last)
    met = frontier.select("gy", "gx", "y", "x", lists.alias("lists")).join(points.select("lat", "lon", *tie, "point", y.alias("y"), x.alias("x")), ["y", "x"])
    listed = met.groupBy(F.col("gy").alias("list_y"), F.col("gx").alias("list_x"), F.pmod("point", "lists").alias("part")).agg(
        F.collect_list(F.struct("lat", "lon", *tie, "point")).alias("met"))

    # A list is measured and cut to `limit` in the origin's own row.
    measured = F.transform("met", lambda p: F.struct(
        geo.haversine_km(F.col("o_lat"), F.col("o_lon"), p["lat"], p["lon"]).alias("distance_km"), *[p[c].alias(c) for c in tie], p["point"].alias("point")))
    here = F.col("gy").eqNullSafe(F.col("list_y")) & F.col("gx").eqNullSafe(F.col("list_x"))
    candidates = origins.join(listed, here).select("origin", F.inline(F.slice(F.array_sort(measured), 1, limit)))
    order = Window.partitionBy("origin").orderBy("distance_km", *tie)
    ranked = candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("origin", "rank", "distance_km", "point").join(points, "point").select(*_nearest_columns(F.col("distance_km"), F.col("rank")))


def _nearest_columns(distance: Column, rank: Column) -> list[Column]:
    by_zip = F.col("location_source") == "zip"
    return [
        F.col("origin").alias("query_zip"), rank.alias("rank"), "ccn", "name", "address", "city", "state", "zip", "hospital_type", "ownership",
        distance.alias("distance_km"), F.when(by_zip, F.col("zip_radius_km")).otherwise(F.lit(0.0)).alias("uncertainty_km"),
        by_zip.alias("approximate"), "location_source", "geocode_match", "location_note"]


def unknown_zips(zips: DataFrame, zcta: DataFrame) -> DataFrame:
    """Requested ZIPs the gazetteer does not list, with the reason."""
    return zips.select("zip").distinct().join(zcta.select("zip"), "zip", "left_anti").select(
        "zip", F.concat("zip", F.lit(" is not a residential ZIP code in the census ZCTA list")).alias("reason"))


def hospitals_by_id(hospitals: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested hospitals without a distance; ids nobody has come back with a reason."""
    found = ids.select("ccn").distinct().join(hospitals, "ccn", "left")
    by_zip = F.col("location_source") == "zip"
    return found.select(
        "ccn", "name", "address", "city", "state", "zip", "hospital_type", "ownership", F.lit(0.0).alias("distance_km"),
        F.when(by_zip, F.col("zip_radius_km")).otherwise(F.lit(0.0)).alias("uncertainty_km"),
        F.coalesce(by_zip, F.lit(False)).alias("approximate"), "location_source", "geocode_match", "location_note",
        F.when(F.col("location_source").isNull(), F.concat(F.lit("no hospital with CCN "), F.col("ccn"))).alias("reason"))


def first_come(nearest: DataFrame, zip_order: DataFrame) -> DataFrame:
    """Each hospital once over several ZIP lists, where it came first (list order, then rank, then ZIP)."""
    placed = nearest.join(zip_order.select(F.col("zip").alias("query_zip"), "zip_pos"), "query_zip")
    first = F.row_number().over(Window.partitionBy("ccn").orderBy("zip_pos", "rank", "query_zip"))
    return placed.withColumn("nth", first).filter("nth = 1").drop("nth")
