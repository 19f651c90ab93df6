"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_MILES = 3958.7613
MILES_PER_DEGREE = 69.0


def miles_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_MILES)


def near_latitude(lat1: Column, lat2: Column, miles: Column | float) -> Column:
    """Cheap necessary condition for being within ``miles``."""
    return F.abs(lat1 - lat2) <= miles / MILES_PER_DEGREE * 1.01
