"""Live messages: JSON text to positions and static ship data. All expressions are built in, so the
same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.codes import eta, ship_type
from fairlead.sources.positions import number

#: The nested fields of a message. Numbers come as text too, so all are read as text.
SCHEMA = """MessageType string,
MetaData struct<MMSI: string, ShipName: string, time_utc: string, latitude: string, longitude: string>,
Message struct<
  PositionReport: struct<UserID: string, Latitude: string, Longitude: string, Sog: string, Cog: string, TrueHeading: string, NavigationalStatus: int>,
  ShipStaticData: struct<UserID: string, Name: string, Type: string, Destination: string, MaximumStaticDraught: string, Eta: struct<Month: int, Day: int, Hour: int, Minute: int>>>"""


def parsed(df: DataFrame, value: str = "value") -> DataFrame:
    """``df`` with column ``m``, the message; text that is no message gives one without a type. The parse
    stands in a generator of one row, which the optimiser can't copy into every use of a field."""
    return df.select("*", F.explode(F.array(F.from_json(F.col(value), SCHEMA, {"mode": "PERMISSIVE"}))).alias("m"))


def vessel(mmsi: Column) -> Column:
    """The id as text: whole numbers without a fraction, other text trimmed; blank is null."""
    whole = mmsi.try_cast("decimal(20,0)").cast("string")
    text = F.trim(F.coalesce(whole, mmsi))
    return F.when(~F.lower(text).isin("", "none"), text)


def message_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.fff] +0000 UTC`` or ISO text; null if it can't be read."""
    plain = F.regexp_replace(text, r"\s*(\+0000)?\s*(UTC)?$", "")
    return plain.try_cast("timestamp")


def positions(messages: DataFrame) -> DataFrame:
    """Valid position messages of ``parsed``: vessel_id, latitude, longitude, speed, heading,
    course, nav_status, timestamp (now where the message has none), and the other columns.

    Heading 511 means none. The place falls back to the metadata, the heading to the course.
    """
    p, meta = F.col("m.Message.PositionReport"), F.col("m.MetaData")
    heading = F.coalesce(number(p["TrueHeading"]), number(p["Cog"]))
    own = {
        "vessel_id": vessel(F.coalesce(meta["MMSI"], p["UserID"])),
        "latitude": number(F.coalesce(p["Latitude"], meta["latitude"])),
        "longitude": number(F.coalesce(p["Longitude"], meta["longitude"])),
        "speed": number(p["Sog"]),
        "heading": F.when(heading != 511, F.pmod(heading, F.lit(360.0))),
        "course": number(p["Cog"]),
        "nav_status": p["NavigationalStatus"],
        "timestamp": F.coalesce(message_time(meta["time_utc"]), F.current_timestamp()),
    }
    rows = messages.filter("m.MessageType = 'PositionReport'").withColumns(own).drop("m")
    return rows.filter("vessel_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")


def static_data(messages: DataFrame) -> DataFrame:
    """Static messages of ``parsed``: vessel_id, ship_name, ship_type, destination, eta, draught;
    blank text and a draught of 0 are null."""
    s, meta = F.col("m.Message.ShipStaticData"), F.col("m.MetaData")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    e = s["Eta"]
    own = {
        "vessel_id": vessel(F.coalesce(meta["MMSI"], s["UserID"])),
        "ship_name": F.coalesce(text(s["Name"]), text(meta["ShipName"])),
        "ship_type": ship_type(s["Type"]),
        "destination": text(s["Destination"]),
        "eta": eta(e["Month"], e["Day"], e["Hour"], e["Minute"]),
        "draught": F.nullif(number(s["MaximumStaticDraught"]), F.lit(0.0)),
    }
    return messages.filter("m.MessageType = 'ShipStaticData'").withColumns(own).drop("m").filter("vessel_id IS NOT NULL")


def failures(messages: DataFrame) -> DataFrame:
    """Messages that are neither."""
    return messages.filter("m.MessageType IS NULL OR m.MessageType NOT IN ('PositionReport', 'ShipStaticData')")


def counters(messages: DataFrame) -> DataFrame:
    """One row of what a live view counts over ``parsed`` messages: all of them, valid positions, static
    messages, those that can't be used, vessels seen, and the last position's time."""
    p, s, meta = F.col("m.Message.PositionReport"), F.col("m.Message.ShipStaticData"), F.col("m.MetaData")
    vessels = {"position": vessel(F.coalesce(meta["MMSI"], p["UserID"])), "static": vessel(F.coalesce(meta["MMSI"], s["UserID"]))}
    placed = number(F.coalesce(p["Latitude"], meta["latitude"])).between(-90, 90) & number(F.coalesce(p["Longitude"], meta["longitude"])).between(-180, 180)
    kind = F.col("m.MessageType")
    valid = {"position": (kind == "PositionReport") & vessels["position"].isNotNull() & placed, "static": (kind == "ShipStaticData") & vessels["static"].isNotNull()}
    time = F.coalesce(message_time(meta["time_utc"]), F.current_timestamp())
    rows = messages.select(*(F.coalesce(v, F.lit(False)).alias(k) for k, v in valid.items()), F.when(valid["position"], vessels["position"]).alias("vessel"), F.when(valid["position"], time).alias("time"))
    return rows.agg(
        F.count("*").alias("messages"),
        F.count_if("position").alias("positions"),
        F.count_if("static").alias("static_messages"),
        F.count_if(~F.col("position") & ~F.col("static")).alias("failures"),
        F.countDistinct("vessel").alias("vessels"),
        F.max("time").alias("last_time"),
    )


def merged_static(static: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each vessel: of every field the last value that says something; blanks and
    Unknown never replace one."""
    said = lambda n: F.when(F.lower(F.col(n).cast("string")) != "unknown", F.col(n)) if n == "ship_type" else F.col(n)
    last = lambda n: F.max_by(said(n), F.when(said(n).isNotNull(), F.col(order))).alias(n)
    out = static.groupBy("vessel_id").agg(*(last(n) for n in ("ship_name", "ship_type", "destination", "eta", "draught")))
    return out.withColumn("ship_type", F.coalesce("ship_type", F.lit("Unknown")))


def active(state: DataFrame, as_of: Column, stale_seconds: int) -> DataFrame:
    """Vessels that reported within stale_seconds before ``as_of``; one without a time stays."""
    age = F.unix_micros(as_of) - F.unix_micros("timestamp")
    return state.filter(F.col("timestamp").isNull() | (age <= stale_seconds * 1_000_000))


def evicted(state: DataFrame, as_of: Column, stale_seconds: int) -> DataFrame:
    """One row: how many vessels are stale at ``as_of`` and how many stay."""
    age = F.unix_micros(as_of) - F.unix_micros("timestamp")
    stale = F.coalesce(age > stale_seconds * 1_000_000, F.lit(False))
    return state.agg(F.count_if(stale).alias("evicted"), F.count_if(~stale).alias("active"))
