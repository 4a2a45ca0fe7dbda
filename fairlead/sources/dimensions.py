"""Small dimension tables: zones, regions, data sources. All are of fixed size or given by the user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rectangles by (name, south, north, west, east), for each source of zones.
ZONES = {
    "default": ("restricted", [("Restricted Zone A", 12.35, 12.60, 80.25, 80.55), ("Restricted Zone B", 12.85, 13.10, 79.80, 80.10), ("Restricted Zone C", 11.65, 11.90, 80.60, 80.90)]),
    "Historical AIS": (
        "monitoring",
        [("Monitoring Zone A (Øresund)", 55.50, 56.00, 12.50, 13.00), ("Monitoring Zone B (Skagerrak)", 57.50, 58.00, 10.50, 11.00), ("Monitoring Zone C (North Sea)", 55.00, 55.50, 8.00, 8.50)],
    ),
}
#: Fixed values: (name, south, west, north, east, centre lat, centre lon, zoom); the first is the default.
REGIONS = [
    ("India (All Coasts — widest coverage)", 6.0, 66.0, 24.0, 93.0, 15.0, 80.0, 4),
    ("Tamil Nadu / Coromandel Coast", 8.0, 78.0, 13.5, 82.0, 10.8, 80.0, 7),
    ("Bay of Bengal (India East)", 8.0, 80.0, 21.0, 92.0, 14.5, 86.0, 5),
    ("Andhra Pradesh Coast", 13.0, 80.0, 19.5, 85.5, 16.3, 82.5, 6),
    ("Kerala Coast", 8.0, 74.0, 13.0, 77.5, 10.5, 75.8, 7),
    ("Karnataka Coast", 12.5, 73.5, 15.5, 75.5, 14.0, 74.3, 7),
    ("Gujarat Coast", 20.0, 68.0, 24.0, 73.0, 22.0, 70.0, 6),
    ("Maharashtra / Goa Coast", 14.5, 71.5, 20.5, 73.5, 17.5, 72.6, 6),
    ("Danish Waters (project historical region)", 53.5, 3.0, 60.0, 16.5, 56.5, 10.5, 6),
]
#: What a data source shows.
SOURCES = {
    "Simulated": ("Bay of Bengal", 12.5, 80.2, 8, "Restricted Zones (demonstration)"),
    "Historical AIS": ("Danish Waters", 56.5, 10.5, 6, "Monitoring Zones (demonstration)"),
}
ZONE_SCHEMA = "source string, zone_ord int, name string, zone_type string, ring array<struct<lat: double, lon: double>>"
REGION_SCHEMA = "name string, min_lat double, min_lon double, max_lat double, max_lon double, center_lat double, center_lon double, zoom int"


def zones(spark: SparkSession, source: str = "default", path: str | None = None) -> DataFrame:
    """The zones of a source, or those of a JSON or Parquet file of ZONE_SCHEMA; a source without
    zones of its own has the default ones. Rings are open: north-west, north-east, south-east,
    south-west."""
    if path is not None:
        reader = spark.read.schema(ZONE_SCHEMA)
        return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)
    kind, boxes = ZONES.get(source, ZONES["default"])
    rows = [(source, i, n, kind, [(t, w), (t, e), (b, e), (b, w)]) for i, (n, b, t, w, e) in enumerate(boxes)]
    return spark.createDataFrame(rows, ZONE_SCHEMA)


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, REGION_SCHEMA)


def region(name: str) -> tuple:
    """The row of a region; of an unknown one the default's."""
    return next((r for r in REGIONS if r[0] == name), REGIONS[0])


def in_region(df: DataFrame, name: str) -> DataFrame:
    """Positions inside a region's box. The bounds are literals, so Parquet scans get them pushed."""
    _, south, west, north, east, *_ = region(name)
    return df.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def source_meta(name: str) -> dict:
    found = SOURCES.get(name, SOURCES["Simulated"])
    return dict(zip(("region", "center_lat", "center_lon", "zoom", "zone_label"), found))
