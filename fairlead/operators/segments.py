"""Tracks of hot vessels in segments, so that no task holds all positions of one vessel.

A vessel with many positions is cut into ranges of its order, and each segment starts with a halo: the last
positions before it. What looks back over a few positions (steps, turns, windows of steps) is computed within
segments, halo rows are left out of the result, and rows are the same as for whole vessels. What runs from
a vessel's start is carried by summaries of its earlier segments.

Vessels below the limit stay whole: they are segment 0 and have no halo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.sources.tables import written

#: Vessels with more positions are cut, into segments of about so many.
MOST_ROWS = 1_000_000
BROADCAST_ROWS = 250_000
ORDER = ["vessel_id", "timestamp", "seq"]


def hot_vessels(df: DataFrame, most: int) -> DataFrame | None:
    """(vessel_id, n) of the vessels with more than ``most`` rows, a written table; None without one. There are
    fewer than rows / most."""
    hot = written(df.groupBy("vessel_id").agg(F.count("*").alias("n")).filter(F.col("n") > most), "hot-vessels")
    return None if hot.isEmpty() else hot


def small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def with_halos(cut: DataFrame, halo: int) -> DataFrame:
    """``cut`` (a written table with ``segment``, numbered in order) with ``halo`` (boolean) and, before each
    segment, the last ``halo`` rows of its vessel again. Only the first row and the last ones of each
    segment are put in order over a whole vessel."""
    names = [c for c in cut.columns if c != "segment"]
    within = Window.partitionBy("vessel_id", "segment")
    ends = cut.withColumns({"_a": F.row_number().over(within.orderBy("timestamp", "seq")), "_b": F.row_number().over(within.orderBy(F.desc("timestamp"), F.desc("seq")))})
    ends = ends.filter((F.col("_a") == 1) | (F.col("_b") <= halo))
    before = Window.partitionBy("vessel_id").orderBy("segment", "_a").rowsBetween(-halo, -1)
    heads = ends.withColumn("_rows", F.collect_list(F.struct(*names)).over(before)).filter("_a = 1")
    again = heads.select("segment", F.explode("_rows").alias("_row")).select("_row.*", "segment", F.lit(True).alias("halo"))
    return cut.select(*names, "segment", F.lit(False).alias("halo")).unionByName(again)


def segmented(df: DataFrame, halo: int, most: int | None = None) -> DataFrame:
    """``df`` (vessel_id, timestamp, seq and more) with ``segment`` (long) and ``halo`` (whether the row only stands before
    its segment again). Nulls in timestamp come first, as in the tracks' order."""
    most = most or MOST_ROWS
    hot = hot_vessels(df, most)
    if hot is None:
        return df.withColumns({"segment": F.lit(0).cast("long"), "halo": F.lit(False)})
    hot = small(hot)
    whole = df.join(hot.select("vessel_id"), "vessel_id", "left_anti")
    mine = df.join(hot.select("vessel_id"), "vessel_id", "left_semi")
    parts = max(2, -(-hot.agg(F.sum("n")).first()[0] // most))
    ranged = written(mine.repartitionByRange(parts, *ORDER).withColumn("segment", F.spark_partition_id().cast("long")), "segments")
    cut = with_halos(ranged, halo)
    return whole.withColumns({"segment": F.lit(0).cast("long"), "halo": F.lit(False)}).unionByName(cut.select(*df.columns, "segment", "halo"))


def before_segments(df: DataFrame, first: list[str]) -> DataFrame:
    """(vessel_id, segment, rows_before, and the vessel's first value of each of ``first``) of a segmented frame: a
    row for each segment, from summaries of the segments."""
    values = F.min_by(F.struct(*first), F.struct(F.col("timestamp").isNotNull(), "timestamp", "seq"))
    sums = df.filter("NOT halo").groupBy("vessel_id", "segment").agg(F.count("*").alias("n"), values.alias("f"))
    so_far = Window.partitionBy("vessel_id").orderBy("segment")
    before = F.coalesce(F.sum("n").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.first("f").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    return sums.select("vessel_id", "segment", before.alias("rows_before"), start.alias("f")).select("vessel_id", "segment", "rows_before", *(F.col(f"f.{c}").alias(f"first_{c}") for c in first))
