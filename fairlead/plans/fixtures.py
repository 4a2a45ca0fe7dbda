"""Views that the queries run on: vessel tracks derived from ``events``, in Spark and in SQL.

Each user is a vessel that reports at one of two rates and moves in one of three ways (transit,
loiter, erratic). ``raw_positions`` adds defects by modulus, ``messages`` feeds JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1704067200000000

EVENTS = f"""
SELECT concat('V', lpad(cast(user_id AS string), 4, '0')) AS vessel_id, user_id, event_id AS seq,
  timestamp_micros({START} + (unix_micros(cast(ts AS timestamp)) - {START}) div (CASE WHEN user_id % 2 = 0 THEN 60 ELSE 300 END)) AS timestamp,
  12.5D + cast((user_id * 37) % 200 - 100 AS double) / 100D + cast(k - 50 AS double) / a AS latitude,
  80.2D + cast((user_id * 53) % 200 - 100 AS double) / 100D
    + CASE WHEN user_id % 3 = 0 THEN cast(event_id AS double) / 20000D ELSE cast((event_id * 7) % 100 - 50 AS double) / a END AS longitude,
  CASE WHEN user_id % 3 = 1 THEN value / 50D ELSE value / 10D END AS speed,
  cast(CASE WHEN event_id % 41 = 0 THEN 511 WHEN user_id % 3 = 0 THEN 80 + event_id % 20 ELSE (event_id * 47) % 360 END AS double) AS heading
FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k, CASE user_id % 3 WHEN 0 THEN 20000D WHEN 1 THEN 5000D ELSE 500D END AS a FROM {{events}})
"""

TRACKS_SQL = f"""
tracks AS (
  SELECT 'V' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS vessel_id, user_id, event_id AS seq,
    {START} + (epoch_us(ts) - {START}) // (CASE WHEN user_id % 2 = 0 THEN 60 ELSE 300 END) AS us,
    CAST(12.5 AS DOUBLE) + CAST((user_id * 37) % 200 - 100 AS DOUBLE) / 100 + CAST(k - 50 AS DOUBLE) / a AS latitude,
    CAST(80.2 AS DOUBLE) + CAST((user_id * 53) % 200 - 100 AS DOUBLE) / 100
      + CASE WHEN user_id % 3 = 0 THEN CAST(event_id AS DOUBLE) / 20000 ELSE CAST((event_id * 7) % 100 - 50 AS DOUBLE) / a END AS longitude,
    CASE WHEN user_id % 3 = 1 THEN value / CAST(50 AS DOUBLE) ELSE value / CAST(10 AS DOUBLE) END AS speed,
    CAST(CASE WHEN event_id % 41 = 0 THEN 511 WHEN user_id % 3 = 0 THEN 80 + event_id % 20 ELSE (event_id * 47) % 360 END AS DOUBLE) AS heading
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(CASE user_id % 3 WHEN 0 THEN 20000 WHEN 1 THEN 5000 ELSE 500 END AS DOUBLE) AS a FROM events)
)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean positions: vessel_id, seq, timestamp, latitude, longitude, speed, heading (511 as
    null)."""
    rows = spark.sql(EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.withColumn("heading", F.when(F.col("heading") != 511, F.col("heading"))).drop("user_id")


#: As ``tracks``: heading 511 is null.
CLEAN_SQL = TRACKS_SQL + ",\nclean AS (SELECT * REPLACE (nullif(heading, 511) AS heading) FROM tracks)"


def raw_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks as a file would have them: text times in two formats, defects, repeated rows."""
    rows = spark.sql(EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    text = F.when(F.col("seq") % 73 == 0, "not-a-date").when(F.col("seq") % 2 == 0, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("timestamp", "dd/MM/yyyy HH:mm:ss"))
    return rows.select(
        F.when(F.col("seq") % 83 == 0, "").otherwise(F.col("vessel_id")).alias("vessel_id"),
        "seq",
        text.alias("timestamp"),
        F.when(F.col("seq") % 97 == 0, 999.0).otherwise(F.col("latitude")).alias("latitude"),
        F.when(F.col("seq") % 89 != 0, F.col("longitude")).alias("longitude"),
        F.when(F.col("seq") % 79 == 0, -1.0).otherwise(F.col("speed")).alias("speed"),
        "heading",
    ).withColumn("copy", F.explode(F.when(F.col("seq") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("seq", F.col("seq") * 2 + F.col("copy")).drop("copy")


RAW_SQL = TRACKS_SQL + """,
raw AS (
  SELECT CASE WHEN t.seq % 83 = 0 THEN '' ELSE vessel_id END AS vessel_id, t.seq * 2 + c.copy AS seq,
    CASE WHEN t.seq % 73 = 0 THEN NULL ELSE us // 1000000 * 1000000 END AS us,
    CASE WHEN t.seq % 97 = 0 THEN CAST(999 AS DOUBLE) ELSE latitude END AS latitude,
    CASE WHEN t.seq % 89 = 0 THEN NULL ELSE longitude END AS longitude,
    CASE WHEN t.seq % 79 = 0 THEN CAST(-1 AS DOUBLE) ELSE speed END AS speed, heading
  FROM tracks t JOIN (SELECT unnest([0, 1]) AS copy) c ON c.copy = 0 OR t.seq % 50 = 0
),
judged AS (
  SELECT vessel_id, seq, us, latitude, longitude, speed, CASE WHEN heading = 511 THEN NULL ELSE ((heading % 360) + 360) % 360 END AS heading,
    CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason, vessel_id, us, latitude, longitude ORDER BY seq) > 1 THEN 'duplicate' ELSE reason END AS reason
  FROM (SELECT *, CASE WHEN us IS NULL THEN 'missing_timestamp' WHEN vessel_id = '' THEN 'missing_id' WHEN latitude IS NULL OR longitude IS NULL THEN 'missing_coordinate'
      WHEN NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) THEN 'invalid_coordinate' WHEN speed < 0 THEN 'invalid_speed' END AS reason FROM raw)
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column ``value``: position messages as JSON, every 7th a static message, every 31st
    damaged."""
    rows = spark.sql(EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    stamp = F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000 UTC"))
    place = F.struct(
        F.lit("PositionReport").alias("MessageType"),
        F.struct(F.col("user_id").alias("MMSI"), stamp.alias("time_utc"), F.col("latitude").alias("latitude"), F.col("longitude").alias("longitude")).alias("MetaData"),
        F.struct(
            F.struct(
                F.col("user_id").alias("UserID"),
                F.when(F.col("seq") % 11 == 0, 999.0).when(F.col("seq") % 13 != 0, F.col("latitude")).alias("Latitude"),
                F.col("longitude").alias("Longitude"),
                F.when(F.col("seq") % 5 != 0, F.col("speed")).alias("Sog"),
                F.col("heading").alias("Cog"),
                F.when(F.col("seq") % 3 != 0, F.col("heading")).alias("TrueHeading"),
                (F.col("seq") % 16).cast("int").alias("NavigationalStatus"),
            ).alias("PositionReport")
        ).alias("Message"),
    )
    static = F.struct(
        F.lit("ShipStaticData").alias("MessageType"),
        F.struct(F.col("user_id").alias("MMSI"), stamp.alias("time_utc")).alias("MetaData"),
        F.struct(
            F.struct(
                F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" SHIP "), F.col("user_id"), F.lit(" "))).otherwise("").alias("Name"),
                (F.col("seq") % 100).cast("int").alias("Type"),
                F.when(F.col("seq") % 3 == 0, F.concat(F.lit("PORT "), F.col("seq") % 10)).otherwise(" ").alias("Destination"),
                (F.col("seq") % 4).cast("double").alias("MaximumStaticDraught"),
                F.struct((F.col("seq") % 13).cast("int").alias("Month"), (F.col("seq") % 29).cast("int").alias("Day"), (F.col("seq") % 25).cast("int").alias("Hour"), (F.col("seq") % 61).cast("int").alias("Minute")).alias("Eta"),
            ).alias("ShipStaticData")
        ).alias("Message"),
    )
    return rows.select("seq", F.when(F.col("seq") % 31 == 0, "{broken").when(F.col("seq") % 7 == 0, F.to_json(static)).otherwise(F.to_json(place)).alias("value"))
