"""Alerts of successive evaluations: the rules, and a cooldown for each vessel and type."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.config import DEFAULT, Config
from fairlead.functions.texts import LIVE_ALERTS, filled
from fairlead.sources.tables import written


def candidates(cfg: Config = DEFAULT) -> Column:
    """array<struct<alert_type, level, message, reason>> that a risk row calls for, in order."""
    zone, quiet, odd, temporal = (
        F.col("geofence_component") >= cfg.alert_zone,
        F.col("ais_gap_component") >= cfg.alert_gap,
        F.col("behaviour_component") >= cfg.alert_behaviour,
        F.col("temporal_component") >= cfg.alert_temporal,
    )
    strong = sum((c.cast("int") for c in (quiet, odd, temporal)), zone.cast("int"))
    high = F.col("risk_level") == "HIGH"
    columns = {"vessel": F.col("vessel_id"), "zone": F.col("zone_status"), "gap": F.col("ais_gap_minutes"), "score": F.col("overall_score"), "signals": strong}
    medium, top = F.lit("MEDIUM"), F.lit("HIGH")
    cases = {"ZONE_ENTRY": (zone, F.when(high, top).otherwise(medium)), "AIS_GAP": (quiet, medium), "BEHAVIOUR_ANOMALY": (odd, medium), "TEMPORAL_ANOMALY": (temporal, medium), "HIGH_RISK": (high, top), "COMBINED": (strong >= 2, top)}
    alert = lambda kind, level: F.struct(F.lit(kind).alias("alert_type"), level.alias("level"), filled(LIVE_ALERTS[kind][0], **columns).alias("message"), F.lit(LIVE_ALERTS[kind][1]).alias("reason"))
    rules = [(case, alert(kind, level)) for kind, (case, level) in cases.items()]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), a) for c, a in rules)))


def evaluate(risk: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All alerts that the rows of ``risk`` (with a tick) call for, before any cooldown."""
    found = risk.withColumn("_a", F.explode(candidates(cfg)))
    return found.select("vessel_id", "_a.*", "tick", "overall_score")


#: Ticks of a chunk: a vessel's alerts of one type have at most as many rows in it.
CHUNK_TICKS = 4096


def firing(ticks: list[int], last: int | None, wait: int) -> list[int]:
    """The places in ascending ``ticks`` that fire after ``last`` did."""
    out = []
    for i, tick in enumerate(ticks):
        if last is None or tick - last >= wait:
            last = tick
            out.append(i)
    return out


def exits(ticks: list[int], wait: int) -> tuple[list[int], list[int]]:
    """A chunk as a function of the tick that fired last before it: the ticks that can be the first to fire,
    and for each the last one that then fires. Only ticks within ``wait`` of the chunk's first can be, and the one
    after these."""
    last, after = [0] * len(ticks), len(ticks)
    for i in reversed(range(len(ticks))):
        while after > 0 and ticks[after - 1] - ticks[i] >= wait:
            after -= 1  # the first tick that fires after i does
        last[i] = last[after] if after < len(ticks) else ticks[i]
    n = sum(t <= ticks[0] + wait for t in ticks) + 1
    return ticks[:n], last[:n]


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from rows that are sorted by it."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        ids = list(zip(*(held.column(k).to_pylist() for k in keys)))
        cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
        for a, b in zip(cuts, cuts[1:]):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def with_cooldown(alerts: DataFrame, cfg: Config = DEFAULT, chunk: int | None = None) -> DataFrame:
    """Alerts that fire: the first of a vessel and type, then each that is cooldown ticks or more
    after the last that fired. Repeated alerts of one tick fire once.

    Which alerts fire depends on those before, one after the other, but a range of ticks is a function of the last
    tick that fired before it, with at most a cooldown's number of cases. So chunks are first
    summed up as such functions, each on its own; these are composed in order, which tells every chunk where it
    starts; and then each chunk fires on its own. No task holds all alerts of a vessel: a vessel and type
    has a row for each ``chunk`` ticks where it is composed.
    """
    chunk, wait = chunk or CHUNK_TICKS, cfg.cooldown_ticks
    once = written(alerts.withColumn("tick", F.col("tick").cast("long")).dropDuplicates(["vessel_id", "alert_type", "tick"]), "alerts")
    key = ["vessel_id", "alert_type", "_chunk"]
    cut = once.withColumn("_chunk", F.floor(F.col("tick") / chunk))
    ticks = cut.select(*key, "tick").repartition(*key).sortWithinPartitions(*key, "tick")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_key(batches, key):
            starts, ends = exits(part.column("tick").to_pylist(), wait)
            row = {k: part.column(k)[0].as_py() for k in key} | {"starts": starts, "ends": ends}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("vessel_id", pa.string()), ("alert_type", pa.string()), ("_chunk", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            before = []
            for vessel, kind, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("vessel_id", "alert_type", "starts", "ends"))):
                if now != (vessel, kind):
                    now, last = (vessel, kind), None
                before.append(last)
                first = next((i for i, t in enumerate(starts) if last is None or t - last >= wait), None)
                last = last if first is None else ends[first]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(before, pa.int64())], names=[*key, "_last"])

    functions = ticks.mapInArrow(summed, "vessel_id string, alert_type string, _chunk long, starts array<long>, ends array<long>")
    functions = functions.repartition("vessel_id", "alert_type").sortWithinPartitions(*key)
    entries = functions.mapInArrow(composed, "vessel_id string, alert_type string, _chunk long, _last long")
    rows = cut.withColumn("_last", F.lit(None).cast("long")).unionByName(entries.filter("_last IS NOT NULL"), allowMissingColumns=True)
    rows = rows.repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("tick"))
    names = once.columns

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_key(batches, key):
            last = part.column("_last")[0].as_py()
            part = part if last is None else part.slice(1)
            yield from part.select(names).take(pa.array(firing(part.column("tick").to_pylist(), last, wait), pa.int64())).to_batches()

    return rows.mapInArrow(fire, once.schema)


def order() -> list[Column]:
    """Within a tick by falling score, then vessel and type."""
    return [F.col("tick"), F.desc("overall_score"), F.col("vessel_id"), F.col("alert_type")]
