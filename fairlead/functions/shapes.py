"""Column functions on polygons: ``ring`` is an open ring, array<struct<lat, lon>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(ring: Column) -> Column:
    """array<struct<a, b>>: the ring's sides, the closing one included."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("b"), F.get(ring, F.pmod(i + F.size(ring) - 1, F.size(ring))).alias("a")))


def point_in_polygon(lat: Column, lon: Column, sides: Column) -> Column:
    """Ray casting along the latitude; the small term keeps a level side from dividing by zero."""

    def crosses(e: Column) -> Column:
        la, lb, oa, ob = e["a"]["lat"], e["b"]["lat"], e["a"]["lon"], e["b"]["lon"]
        return ((ob > lon) != (oa > lon)) & (lat < (la - lb) * (lon - ob) / (oa - ob + 1e-12) + lb)

    return F.size(F.filter(sides, crosses)) % 2 == 1


def segment_distance(lat: Column, lon: Column, e: Column) -> Column:
    """Planar distance in degrees to a side; a side of no length is a point."""
    ay, ax, dy, dx = e["a"]["lat"], e["a"]["lon"], e["b"]["lat"] - e["a"]["lat"], e["b"]["lon"] - e["a"]["lon"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - ax) * dx + (lat - ay) * dy) / F.when(square == 0, F.lit(1.0)).otherwise(square))))
    return F.hypot(lon - (ax + t * dx), lat - (ay + t * dy))

