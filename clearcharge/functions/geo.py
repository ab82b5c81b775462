"""Distances and ZIP geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge.functions.text import fixed


def zip5(value: Column) -> Column:
    return F.lpad(value, 5, "0")


def radius_km(area_m2: Column) -> Column:
    return F.sqrt(area_m2.cast("double") / F.pi()) / 1000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * fv.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def miles_text(km: Column, approximate: Column) -> Column:
    return F.concat(F.when(approximate, F.lit("~")).otherwise(F.lit("")), fixed(km / fv.KM_PER_MILE, 1), F.lit(" mi"))


def rejected_note(match: Column, off_km: Column, zip_code: Column) -> Column:
    return F.concat(match, F.lit(" geocode rejected: "), fixed(off_km, 0), F.lit(" km from the "), zip_code, F.lit(" centroid"))
