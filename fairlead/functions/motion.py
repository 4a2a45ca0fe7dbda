"""Column functions on positions and courses. All are built-in expressions; a null in gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # least() would skip a null and turn it into half the circumference
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def angular_diff(a: Column, b: Column) -> Column:
    """Signed turn from a to b in [-180, 180)."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


def bearing(dlat: Column, dlon: Column) -> Column:
    """Planar bearing of a step in [0, 360); 0 for a step of no length."""
    return F.pmod(F.degrees(F.atan2(dlon, dlat)), F.lit(360.0))


def step_length(dlat: Column, dlon: Column) -> Column:
    return F.hypot(dlat, dlon)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
