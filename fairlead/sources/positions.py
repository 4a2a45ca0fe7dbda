"""Position files: any of the known column names, read as text and coerced in one pass."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names that a source may give a column, lower-cased, and the known names.
TARGET = {
    "mmsi": "vessel_id", "vessel_id": "vessel_id", "vesselid": "vessel_id", "id": "vessel_id", "ship_id": "vessel_id",
    "lat": "latitude", "latitude": "latitude", "y": "latitude",
    "lon": "longitude", "long": "longitude", "lng": "longitude", "longitude": "longitude", "x": "longitude",
    "sog": "speed", "speed": "speed", "speed_over_ground": "speed",
    "cog": "heading", "heading": "heading", "course": "heading", "course_over_ground": "heading",
    "basedatetime": "timestamp", "base_date_time": "timestamp", "timestamp": "timestamp", "time": "timestamp", "datetime": "timestamp", "t": "timestamp",
}
REQUIRED = ("vessel_id", "latitude", "longitude")
DAY_FIRST = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy")


class PositionsNotFound(FileNotFoundError):
    """There is no such position file."""


class MissingColumns(ValueError):
    """A source lacks a column that every position needs."""


def normalise(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed to the known names, without regard to case and outer blanks.

    The first column that fits a name gets it; later ones, and others that would clash with a known
    name, become ``<name>_src``. Columns that fit nothing stay.
    """
    taken, out = set(), []
    for i, name in enumerate(df.columns):
        target = TARGET.get(name.strip().lower())
        if target and target not in taken:
            taken.add(target)
            out.append(target)
        else:
            out.append(f"{name.strip()}_src" if target else name)
    if missing := [c for c in REQUIRED if c not in taken]:
        raise MissingColumns(f"missing {', '.join(missing)}; found {', '.join(df.columns)}")
    return df.toDF(*out)


def number(c: Column) -> Column:
    """A double; what is not a number, and NaN, becomes null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def instant(c: Column) -> Column:
    """A timestamp from day-first text or ISO text; null for anything else."""
    text = c.cast("string")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DAY_FIRST), text.try_cast("timestamp"))


def coerced(df: DataFrame) -> DataFrame:
    """Rows of ``normalise`` with typed columns, and ``rejected``: whether a row can't be a
    position (no id, no place on earth, or a time that can't be read where the source has times).

    Missing or unreadable speed and heading become 0. Without a time column ``timestamp`` is null
    and ``seq`` keeps the order of the rows.
    """
    timed = "timestamp" in df.columns
    id_ = F.trim(F.col("vessel_id").cast("string"))
    lat, lon = number(F.col("latitude")), number(F.col("longitude"))
    zero = lambda n: F.coalesce(number(F.col(n)), F.lit(0.0)) if n in df.columns else F.lit(0.0)
    time = instant(F.col("timestamp")) if timed else F.lit(None).cast("timestamp")
    ok = id_.isNotNull() & ~F.lower(id_).isin("", "nan") & lat.between(-90, 90) & lon.between(-180, 180)
    ok = ok & time.isNotNull() if timed else ok
    own = {"vessel_id": id_, "latitude": lat, "longitude": lon, "speed": zero("speed"), "heading": zero("heading"), "timestamp": time}
    return df.withColumns({"rejected": ~F.coalesce(ok, F.lit(False)), "seq": F.monotonically_increasing_id(), **own})


def ingest_report(rows: DataFrame) -> DataFrame:
    """One row of counts over the rows of ``coerced``: input_rows, dropped_rows, positions, vessels."""
    kept = ~F.col("rejected")
    return rows.agg(F.count("*").alias("input_rows"), F.count_if("rejected").alias("dropped_rows"), F.count_if(kept).alias("positions"), F.countDistinct(F.when(kept, F.col("vessel_id"))).alias("vessels"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Valid positions of a CSV (with header), Parquet or JSON source."""
    try:
        if path.rstrip("/").endswith(".parquet"):
            raw = spark.read.parquet(path)
        elif path.rstrip("/").endswith(".json"):
            raw = spark.read.json(path)
        else:
            raw = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise PositionsNotFound(path) from error
        raise
    return coerced(normalise(raw)).filter("NOT rejected").drop("rejected")
