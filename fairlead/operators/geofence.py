"""Geofencing: positions against zones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.config import DEFAULT, Config
from fairlead.functions.shapes import edges, point_in_polygon, segment_distance
from fairlead.sources.tables import written

#: Up to so many sides of all zones are written out as plain expressions.
FEW_SIDES = 96
#: More zones are looked up by grid; grids of up to so many cells are broadcast.
MANY_ZONES, SMALL_CELLS = 200, 20_000


def verdict(best: Column, cfg: Config) -> dict[str, Column]:
    """The columns that a position gets from its best zone (null: no zone)."""
    inside = F.coalesce(best["inside"], F.lit(False))
    near = ~inside & F.coalesce(best["dist"] <= cfg.near_zone, F.lit(False))
    return {
        "inside": inside,
        "zone_name": F.when(inside, best["name"]).otherwise(""),
        "near": near,
        "nearest_zone": F.coalesce(best["name"], F.lit("")),
        "min_dist_deg": F.when(inside, F.lit(0.0)).otherwise(F.round(best["dist"], 5)),
        "zone_status": F.when(inside, F.concat(F.lit("INSIDE "), best["name"])).when(near, F.concat(F.lit("Near "), best["name"])).otherwise("Open Waters"),
    }


def candidate(lat: Column, lon: Column, zone) -> Column:
    """How a zone compares for a position: the first one that contains it wins, else the nearest,
    else the first of equals. ``zone`` gives a zone's fields."""
    sides = zone("sides")
    inside = point_in_polygon(lat, lon, sides)
    dist = F.when(inside, F.lit(0.0)).otherwise(F.array_min(F.transform(sides, lambda e: segment_distance(lat, lon, e))))
    return F.struct((~inside).alias("outside"), dist.alias("dist"), zone("zone_ord").alias("zone_ord"), inside.alias("inside"), zone("name").alias("name"))


def written_out(lat: Column, lon: Column, order: int, name: str, ring: list[tuple[float, float]]) -> Column:
    """``candidate`` of one known zone as plain arithmetic; whether it contains the position is only
    asked within its box."""
    crossed, dists = F.lit(0), []
    for (la, oa), (lb, ob) in zip([ring[-1], *ring[:-1]], ring):
        dy, dx = lb - la, ob - oa
        if (square := dx * dx + dy * dy) == 0:
            dists.append(F.hypot(lon - oa, lat - la))
            continue
        # the place along the side that is nearest
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - oa) * dx + (lat - la) * dy) / square))
        dists.append(F.hypot(lon - (oa + t * dx), lat - (la + t * dy)))
        if dx:
            crossed = crossed + F.when((F.lit(ob) > lon) != (F.lit(oa) > lon), (lat < (la - lb) * (lon - ob) / (oa - ob + 1e-12) + lb).cast("int")).otherwise(0)
    lats, lons = zip(*ring)
    inside = F.when(lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons)), crossed % 2 == 1).otherwise(False)
    dist = F.when(inside, F.lit(0.0)).otherwise(F.least(*dists) if len(dists) > 1 else dists[0])
    return F.struct((~inside).alias("outside"), dist.alias("dist"), F.lit(order).alias("zone_ord"), inside.alias("inside"), F.lit(name).alias("name"))


def check_zones(df: DataFrame, zones: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``df`` (latitude, longitude) with inside, zone_name, near, nearest_zone, min_dist_deg and
    zone_status. No zones, or no place: open waters, distance null.

    Every position is compared with every zone. Zones of up to FEW_SIDES sides in all are known when
    the plan is made and become plain expressions; more are one array, a scalar subquery. More than
    MANY_ZONES are found by grid, with the same results (``check_zones_by_grid``).
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    known = lat.isNotNull() & lon.isNotNull()
    head = zones.select("zone_ord", "name", "ring").limit(FEW_SIDES // 3 + 1).collect()  # more can't have few sides
    if sum(len(z["ring"]) for z in head) <= FEW_SIDES and all(z["ring"] for z in head):
        each = [written_out(lat, lon, z["zone_ord"], z["name"], [(p["lat"], p["lon"]) for p in z["ring"]]) for z in head]
        if not each:
            none = F.lit(None).cast("struct<outside: boolean, dist: double, zone_ord: int, inside: boolean, name: string>")
            return df.withColumns(verdict(none, cfg))
        rows = df.withColumn("_best", F.when(known, F.array_min(F.array(*each))))
        return rows.withColumns(verdict(F.col("_best"), cfg)).drop("_best")
    if zones.limit(MANY_ZONES + 1).count() > MANY_ZONES:
        return check_zones_by_grid(df, zones, cfg=cfg)
    array = zones.agg(F.array_sort(F.collect_list(F.struct("zone_ord", "name", edges(F.col("ring")).alias("sides")))).alias("_zones")).scalar()
    each = F.transform("_zones", lambda z: candidate(lat, lon, lambda n: z[n]))
    rows = df.withColumn("_zones", array).withColumn("_best", F.when(known, F.array_min(each)))
    return rows.withColumns(verdict(F.col("_best"), cfg)).drop("_zones", "_best")


#: The grid's cells are so wide at first, and so many times wider from level to level; the last is wider than the globe.
CELL, WIDER, LEVELS = 0.5, 4.0, 7


def cells_of(zones: DataFrame, width: float) -> DataFrame:
    """(_y, _x, _near): for the cells of a grid the zones that are within ``width`` of some place in it, as an array."""
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    box = [F.array_min(lats).alias("s"), F.array_max(lats).alias("n"), F.array_min(lons).alias("w"), F.array_max(lons).alias("e")]
    grown = zones.select(F.struct("zone_ord", "name", edges(F.col("ring")).alias("sides")).alias("zone"), *box)
    span = lambda a, b: F.sequence(F.floor((F.col(a) - width) / width), F.floor((F.col(b) + width) / width))
    cells = grown.withColumn("_y", F.explode(span("s", "n"))).withColumn("_x", F.explode(span("w", "e")))
    return cells.groupBy("_y", "_x").agg(F.collect_list("zone").alias("_near"))


def check_zones_by_grid(df: DataFrame, zones: DataFrame, cell: float = CELL, cfg: Config = DEFAULT) -> DataFrame:
    """As ``check_zones``, the same columns, for any number of zones.

    A position first meets the zones that are within a cell's width of its grid cell. If the best of these is no
    farther away than that, no other zone can be nearer; else it meets those of a grid of wider cells, and so
    on, until cells are wider than the globe. Rows are carried along: a level is an equi-join on the cell with one
    row a cell, broadcast if the table is small, and positions that are settled take no part.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    zones = zones.select("zone_ord", "name", "ring").filter(F.size("ring") > 0)
    rows = df.withColumn("_best", F.lit(None).cast("struct<outside: boolean, dist: double, zone_ord: int, inside: boolean, name: string>"))
    widths = [cell * WIDER**level for level in range(LEVELS)]
    grids = [cells_of(zones, width).withColumn("_level", F.lit(level)) for level, width in enumerate(widths)]
    table = written(reduce(DataFrame.union, grids), "zone-cells")
    sizes = {r["_level"]: r["count"] for r in table.groupBy("_level").count().collect()}  # LEVELS rows
    for level, width in enumerate(widths):
        grid = table.filter(F.col("_level") == level).drop("_level")
        open_ = F.col("_best").isNull()
        rows = rows.withColumns({"_y": F.when(open_, F.floor(lat / width)), "_x": F.when(open_, F.floor(lon / width))})
        best = F.array_min(F.transform("_near", lambda z: candidate(lat, lon, lambda n: z[n])))
        rows = rows.join(F.broadcast(grid) if sizes.get(level, 0) <= SMALL_CELLS else grid, ["_y", "_x"], "left").withColumn("_found", F.when(open_, best))
        rows = rows.withColumn("_best", F.coalesce("_best", F.when(F.col("_found.dist") <= width, F.col("_found")))).drop("_y", "_x", "_near", "_found")
    return rows.withColumns(verdict(F.col("_best"), cfg)).drop("_best")
