"""Cleaning of positions with a quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.sources.positions import REQUIRED, MissingColumns, instant, number

KEY = ("vessel_id", "timestamp", "latitude", "longitude")


def judged(df: DataFrame) -> DataFrame:
    """Every input row with typed columns and ``reject_reason``: the first rule that it breaks, in
    order missing_timestamp, missing_id, missing_coordinate, invalid_coordinate, invalid_speed,
    duplicate; null for rows that stay.

    Needs vessel_id, latitude, longitude and timestamp; speed, heading and seq are optional. Equal
    positions (vessel, time, place) count as duplicates of the one with the smallest seq. The
    heading 511 means none; others are taken modulo 360.
    """
    if missing := [c for c in (*REQUIRED, "timestamp") if c not in df.columns]:
        raise MissingColumns(f"missing {', '.join(missing)}")
    have = lambda n: number(F.col(n)) if n in df.columns else F.lit(None).cast("double")
    heading = have("heading")
    seq = F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()
    typed = df.withColumns(
        {
            "vessel_id": F.trim(F.col("vessel_id").cast("string")),
            "timestamp": instant(F.col("timestamp")),
            "latitude": number(F.col("latitude")),
            "longitude": number(F.col("longitude")),
            "speed": have("speed"),
            "heading": F.when(heading != 511, F.pmod(heading, F.lit(360.0))),
            "seq": seq,
        }
    )
    reason = (
        F.when(F.col("timestamp").isNull(), "missing_timestamp")
        .when(F.col("vessel_id").isNull() | F.lower("vessel_id").isin("", "nan"), "missing_id")
        .when(F.col("latitude").isNull() | F.col("longitude").isNull(), "missing_coordinate")
        .when(~(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)), "invalid_coordinate")
        .when(F.col("speed") < 0, "invalid_speed")
    )
    # rejected rows are dealt out by their number: rows without id, time and place are no hot key
    nth = F.row_number().over(Window.partitionBy("_reason", "_apart", *KEY).orderBy("seq"))
    rows = typed.withColumn("_reason", reason).withColumn("_apart", F.when(F.col("_reason").isNotNull(), F.col("seq")))
    return rows.withColumn("reject_reason", F.coalesce("_reason", F.when(nth > 1, "duplicate"))).drop("_reason", "_apart")


def clean(rows: DataFrame, fill_defaults: bool = True) -> DataFrame:
    """The rows of ``judged`` that stay; null speed and heading become 0 if asked for."""
    kept = rows.filter("reject_reason IS NULL").drop("reject_reason")
    return kept.fillna(0.0, ["speed", "heading"]) if fill_defaults else kept


def quality_report(rows: DataFrame) -> DataFrame:
    """One row of counts over the rows of ``judged``; zeros for an empty input."""
    hit = lambda reason: F.count_if(F.col("reject_reason") == reason)
    kept = F.col("reject_reason").isNull()
    return rows.agg(
        F.count("*").alias("input_rows"),
        F.count_if(kept).alias("output_rows"),
        F.count_if(~kept).alias("rows_removed"),
        hit("missing_timestamp").alias("missing_timestamp_rows"),
        hit("missing_id").alias("missing_id_rows"),
        hit("missing_coordinate").alias("missing_coordinate_rows"),
        hit("invalid_coordinate").alias("invalid_coordinate_rows"),
        hit("invalid_speed").alias("invalid_speed_rows"),
        hit("duplicate").alias("duplicate_rows"),
        F.countDistinct(F.when(kept, F.col("vessel_id"))).alias("unique_vessels"),
        F.count_if(kept & F.col("speed").isNull()).alias("speed_fills"),
        F.count_if(kept & F.col("heading").isNull()).alias("heading_fills"),
    )
