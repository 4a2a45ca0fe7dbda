"""Trajectories: steps between positions, latest and earlier states, ticks.

All operators share one exchange by vessel_id; positions are ordered by (timestamp, seq). Frames that
``segments.segmented`` has cut are handled segment by segment: their halo rows take part in what looks back, and
``own`` leaves them out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fairlead.functions.motion import angular_diff, bearing, haversine_km, step_length
from fairlead.operators.segments import before_segments, segmented
from fairlead.sources.tables import written


def in_order(df: DataFrame | None = None) -> WindowSpec:
    """A vessel's positions in order; a segment's of a frame that is cut."""
    keys = ["vessel_id", "segment"] if df is not None and "segment" in df.columns else ["vessel_id"]
    return Window.partitionBy(*keys).orderBy("timestamp", "seq")


def own(df: DataFrame) -> DataFrame:
    """The rows of a frame without those that only stand before a segment, and without its columns."""
    return df.filter("NOT halo").drop("segment", "halo") if "segment" in df.columns else df


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 60e6


def steps(df: DataFrame) -> DataFrame:
    """Positions with the step that led to each: dlat, dlon, km, step_deg, bearing, heading_change
    (signed), gap_minutes, dspeed. A vessel's first position has nulls. Positions without coordinates
    are left out, so that those beside them make a step."""
    df = df.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    order = in_order(df)
    before = lambda n: F.lag(n).over(order)
    out = df.withColumns({"_lat": before("latitude"), "_lon": before("longitude"), "_ts": before("timestamp"), "_speed": before("speed"), "_heading": before("heading")})
    dlat, dlon = F.col("latitude") - F.col("_lat"), F.col("longitude") - F.col("_lon")
    return out.withColumns(
        {
            "dlat": dlat,
            "dlon": dlon,
            "km": haversine_km(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude")),
            "step_deg": step_length(dlat, dlon),
            "bearing": bearing(dlat, dlon),
            "heading_change": angular_diff(F.col("_heading"), F.col("heading")),
            "gap_minutes": minutes_between(F.col("_ts"), F.col("timestamp")),
            "dspeed": F.abs(F.col("speed") - F.col("_speed")),
        }
    ).drop("_lat", "_lon", "_ts", "_speed", "_heading")


def turned(df: DataFrame) -> DataFrame:
    """``steps`` with turn: by how much the bearing changed from the step before."""
    return steps(df).withColumn("turn", F.abs(angular_diff(F.lag("bearing").over(in_order(df)), F.col("bearing"))))


def latest_sums() -> list[Column]:
    """What ``latest_of`` needs of a vessel's positions."""
    row = F.struct("latitude", "longitude", "speed", "heading", "timestamp")
    return [F.max_by(row, F.struct("timestamp", "seq")).alias("_latest")]


def latest_of(sums: DataFrame, label: str = "AIS Track") -> DataFrame:
    """The last position of every vessel, rounded, from ``latest_sums``; other columns go along."""
    p = "_latest"
    own = {"latitude": F.round(f"{p}.latitude", 4), "longitude": F.round(f"{p}.longitude", 4), "speed": F.round(f"{p}.speed", 1), "heading": F.round(f"{p}.heading", 1), "timestamp": F.col(f"{p}.timestamp"), "behavior": F.lit(label)}
    return sums.withColumns(own).drop(p)


def latest(df: DataFrame, label: str = "AIS Track") -> DataFrame:
    """One row for each vessel: its last position, rounded."""
    return latest_of(df.groupBy("vessel_id").agg(*latest_sums()), label)


def track(df: DataFrame, vessel_id: str) -> DataFrame:
    """One vessel's positions in order, those without coordinates left out."""
    return df.filter((F.col("vessel_id") == vessel_id) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).orderBy("timestamp", "seq")


def ordered(df: DataFrame) -> DataFrame:
    """Positions dealt out by vessel, each vessel's in order within one task: for writing files that
    readers scan vessel by vessel. No global sort."""
    return df.repartition("vessel_id").sortWithinPartitions("vessel_id", "timestamp", "seq")


def trajectories(df: DataFrame, size: int = 1000) -> DataFrame:
    """(vessel_id, slice, chunk, points): a vessel's points in order, cut by hour (slice) and into
    chunks of at most ``size``, for export; no row grows with a vessel. Rows in order of slice and
    chunk make the trajectory. Points without coordinates are left out, and vessels without points."""
    points = df.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    cut = points.withColumn("slice", F.floor(F.unix_micros("timestamp") / 3600e6).cast("long"))
    place = F.row_number().over(Window.partitionBy("vessel_id", "slice").orderBy("timestamp", "seq")) - 1
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "seq", "latitude", "longitude")))
    return cut.withColumn("chunk", F.floor(place / size).cast("long")).groupBy("vessel_id", "slice", "chunk").agg(ordered.alias("points"))


def recent(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` positions of every vessel, with recency 1 for the latest."""
    back = Window.partitionBy("vessel_id").orderBy(F.desc("timestamp"), F.desc("seq"))
    return df.withColumn("recency", F.row_number().over(back)).filter(F.col("recency") <= n)


def running_state(df: DataFrame, most: int | None = None) -> DataFrame:
    """Positions with what a live view knows at each: previous values, first-seen time and place,
    number of messages so far. A hot vessel is handled in segments: what came before one is carried into it."""
    cut = segmented(df, 1, most)
    order = in_order(cut)
    before = {f"prev_{n}": F.lag(n).over(order) for n in ("latitude", "longitude", "speed", "heading")}
    rows = cut.withColumns({**before, "_n": F.sum((~F.col("halo")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    known = before_segments(cut, ["timestamp", "latitude", "longitude"])
    joined = rows.filter("NOT halo").join(known, ["vessel_id", "segment"])
    return joined.withColumn("messages", F.col("rows_before") + F.col("_n")).select(*df.columns, *before, "first_timestamp", "first_latitude", "first_longitude", "messages")


def ticks(df: DataFrame, n_ticks: int = 60) -> DataFrame:
    """Positions with ``tick``: batches of equal size in order of (timestamp, vessel_id, seq), the
    step being rows div ticks, one at least. Rows without a timestamp come first.

    The dense order is made without one task holding all rows: rows are dealt out by ranges of that
    order, which a written table fixes, counted by range and numbered within theirs from the sum of
    those before. Ranges follow a sample, so neither outlying dates nor ties make a large one.
    """
    order = ["timestamp", "vessel_id", "seq"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ticks")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each range: a bounded table
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    numbered = ranged.withColumn("_place", place).join(F.broadcast(offsets), "_range")
    step = F.greatest(F.lit(1), F.expr(f"_all div {int(n_ticks)}"))
    return numbered.withColumn("tick", F.floor((F.col("_place") + F.col("_before")) / step).cast("int")).drop("_range", "_place", "_before", "_all")


def state_at(df: DataFrame, tick: int) -> DataFrame:
    """The last position of every vessel among ticks up to ``tick``."""
    names = [c for c in df.columns if c != "vessel_id"]
    seen = df.filter(F.col("tick") <= tick).groupBy("vessel_id").agg(F.max_by(F.struct(*names), F.struct("timestamp", "seq")).alias("p"))
    return seen.select("vessel_id", *(F.col(f"p.{n}").alias(n) for n in names))


def progress(df: DataFrame) -> DataFrame:
    """tick, its clock (the latest time consumed so far), rows so far and the share of ticks done."""
    by_tick = df.groupBy("tick").agg(F.max("timestamp").alias("_last"), F.count("*").alias("_n"))
    so_far = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)  # a row for each tick
    whole = Window.partitionBy()
    return by_tick.select("tick", F.max("_last").over(so_far).alias("sim_time"), F.sum("_n").over(so_far).alias("rows_so_far"), ((F.col("tick") + 1) / (F.max("tick").over(whole) + 1)).alias("done"))
