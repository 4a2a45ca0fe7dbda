"""Keyed state of live vessels, and alerts with cooldown, as stateful streaming operators.

State is one entry for each vessel with a bounded track; event-time timers drop vessels that have
been silent for stale_seconds, those that only sent static data too, so state follows the active fleet and
not history. What is dropped comes out as a row, so that a sink can count and remove it.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fairlead.config import DEFAULT, Config

PLACE = "latitude double, longitude double, speed double, heading double, course double, nav_status int"
SAID = "ship_name string, ship_type string, destination string, eta string, draught double"
STATE = f"timestamp timestamp, seq long, {PLACE}, prev_timestamp timestamp, prev_seq long, prev_latitude double, prev_longitude double, prev_speed double, prev_heading double, first_timestamp timestamp, first_seq long, first_latitude double, first_longitude double, messages long, {SAID}, ship_name_at timestamp, ship_type_at timestamp, destination_at timestamp, eta_at timestamp, draught_at timestamp, ship_name_seq long, ship_type_seq long, destination_seq long, eta_seq long, draught_seq long"
POINT = "us long, seq long, latitude double, longitude double, speed double, heading double"
STATIC = [x.split(" ")[0] for x in SAID.split(", ")]

#: Reports, states and their changes go between Spark and Python as one JSON text each, as every cell
#: of a row, and the schema of every value read, costs more there than the work on it. The store keeps of a vessel one value,
#: read and written at once, with a point of the track as six numbers of eight bytes, NaN for a null.
STORED = "state string, track binary"
CHANGED = "vessel_id string, state string, track_points int, track string, evicted boolean"
PACKED = struct.Struct("<2q4d")
IN_ORDER = itemgetter(0, 1)  # of reports: us, seq


def kinds_of(schema: str) -> dict[str, str]:
    return dict(x.split(" ") for x in schema.split(", "))


KEPT = [*kinds_of(STATE), "due", "timer"]  # in milliseconds, when the vessel is stale and when its timer fires; the other times are microseconds
POINTS, NOW = list(kinds_of(POINT)), ["timestamp", "seq", *kinds_of(PLACE)]
READ = kinds_of(f"{PLACE}, {SAID}")  # of a report, after its us and seq
DOUBLES = [i for i, t in enumerate(READ.values(), 2) if t == "double"]
Changed = Row(*kinds_of(CHANGED))


def report_of(text: str) -> tuple:
    """A report's values: us, seq, those of READ. Spark writes an infinite number as text."""
    values = list(json.loads(text).values())
    if "Infinity" in text:
        for i in DOUBLES:
            values[i] = None if values[i] is None else float(values[i])
    return tuple(values)


class VesselState(StatefulProcessor):
    """Latest, previous and first values, a message count, the last points and the static data of each
    vessel. Values follow event time: a position that comes late counts as a message and may become
    the previous or the first one or a point of the track, but never replaces a newer latest one. Of
    each static field the last that says something stays; blanks and Unknown replace none. seq decides
    between reports of one time, in whichever batches they come.

    A vessel whose next position is more than stale seconds after its last one was gone in between: it is
    evicted and starts anew, whether the two come in one batch or a timer has fired before.

    A batch may bring a few rows of each of very many vessels, so a vessel costs one read and one write of the store
    and plain Python. A timer stays where it is when the vessel is heard again; one that fires too early is set anew."""

    def __init__(self, points: int, stale_seconds: int, tracks: bool = True):
        self.points, self.stale, self.tracks = points, stale_seconds, tracks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("vessel", STORED)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        data = sorted((report_of(r["report"]) for r in rows), key=IN_ORDER)
        state, track = self.read()
        for i, n in enumerate(STATIC, len(NOW)):
            said = next((r for r in reversed(data) if r[i] is not None and (n != "ship_type" or r[i].lower() != "unknown")), None)
            if said and (state[f"{n}_at"] is None or said[:2] >= (state[f"{n}_at"], state[f"{n}_seq"])):
                state |= {n: said[i], f"{n}_at": said[0], f"{n}_seq": said[1]}
        placed = [r[: len(NOW)] for r in data if r[2] is not None]
        last = track[-1][0] if track else None
        ends, start = [], 0  # where a silence of more than stale seconds ends
        for i, (us, *_) in enumerate(placed):
            if last is not None and us - last > self.stale * 1_000_000:
                ends.append(i)
            last = us if last is None else max(last, us)
        for end in [*ends, len(placed)]:
            if end > start:
                state, track = self.moved(state, track, placed[start:end])
            if end in ends:
                if state["messages"]:
                    yield self.row(key, state, track, True)
                state, track, start = self.emptied(state), [], end
        state["due"] = (state["timestamp"] if state["messages"] else data[-1][0]) // 1000 + self.stale * 1000
        if state["timer"] is None or state["due"] < state["timer"]:
            if state["timer"] is not None:
                self.handle.deleteTimer(state["timer"])
            self.wake(state)
        self.write(state, track)
        if state["messages"]:
            yield self.row(key, state, track, False)

    def read(self) -> tuple[dict, list[tuple]]:
        found = self.value.get()
        if found is None:
            return dict.fromkeys(KEPT) | {"messages": 0}, []
        return json.loads(found[0]), list(PACKED.iter_unpack(found[1]))

    def write(self, state: dict, track: list[tuple]) -> None:
        self.value.update((json.dumps(state), b"".join(PACKED.pack(*p) for p in track)))

    def wake(self, state: dict) -> None:
        """A timer for when the vessel is stale."""
        self.handle.registerTimer(state["due"])
        state["timer"] = state["due"]

    def emptied(self, state: dict) -> dict:
        """The state of a vessel that starts anew: its static data and its timer stay."""
        return dict.fromkeys(KEPT) | {"messages": 0} | {n: v for n, v in state.items() if n.startswith((*STATIC, "timer"))}

    def moved(self, state: dict, track: list[tuple], placed: list[tuple]) -> tuple[dict, list[tuple]]:
        """State and track after the positions ``placed``, in order."""
        # the newest two of these and of the state decide what is latest and previous
        known = [tuple(state[n] for n in NOW)] if state["messages"] else []
        if state["prev_latitude"] is not None:
            known.insert(0, tuple(state.get(f"prev_{n}") for n in NOW))
        last = sorted([*known, *placed[-2:]], key=IN_ORDER)
        state = state | dict(zip(NOW, last[-1]))
        if len(last) > 1:
            state |= {f"prev_{n}": v for n, v in zip(NOW[:6], last[-2])}
        oldest = placed[0]
        if state["first_timestamp"] is None or oldest[:2] < (state["first_timestamp"], state["first_seq"]):
            state |= {f"first_{n}": v for n, v in zip(NOW[:4], oldest)}
        state["messages"] += len(placed)
        points = [(*p[:4], *(float("nan") if v is None else v for v in p[4:6])) for p in placed[-self.points :]]
        return state, sorted([*track, *points], key=IN_ORDER)[-self.points :]

    def row(self, key, state: dict, track: list[tuple], evicted: bool) -> Row:
        points = [dict(zip(POINTS, (*p[:4], *(v if v == v else None for v in p[4:])))) for p in track if self.tracks]
        return Changed(key[0], json.dumps(state), len(track), json.dumps(points) if self.tracks else None, evicted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, track = self.read()
        if state["due"] > timerValues.getCurrentWatermarkInMs():  # heard since the timer was set
            self.wake(state)
            self.write(state, track)
        else:
            self.value.clear()
            yield self.row(key, state, track, True)

    def close(self) -> None:
        pass


def vessel_state(positions: DataFrame, delay: str = "10 minutes", cfg: Config = DEFAULT, stale_seconds: int | None = None, tracks: bool = True) -> DataFrame:
    """The changed state of vessels after every micro-batch of ``positions`` (timestamp, seq, place; course,
    nav_status and the static fields where it has them). Needs the RocksDB state store. Rows that come
    more than ``delay`` behind the newest, and rows without a time, are dropped; within it they may come in any order. A
    vessel that is silent for stale_seconds of event time is dropped, with a row that says so (evicted; messages is 0 for
    one that only sent static data); a later report starts it anew. track: its last points in order, null without ``tracks``."""
    timed = positions.filter("timestamp IS NOT NULL").withWatermark("timestamp", delay)
    own = lambda n, t: F.nanvl(F.col(n).cast(t), F.lit(None).cast(t)) if t == "double" else F.col(n).cast(t)
    columns = [(own(n, t) if n in positions.columns else F.lit(None).cast(t)).alias(n) for n, t in READ.items()]
    report = F.to_json(F.struct(F.unix_micros("timestamp").alias("us"), "seq", *columns), {"ignoreNullFields": "false"})
    grouped = timed.select("vessel_id", "timestamp", report.alias("report")).groupBy("vessel_id")
    changed = grouped.transformWithState(VesselState(cfg.recent_live, stale_seconds or cfg.stale_seconds, tracks), outputStructType=CHANGED, outputMode="Update", timeMode="EventTime")
    values = F.from_json("state", STATE.replace(" timestamp", " long"))
    rows = changed.withColumn("s", F.explode(F.array(values)))  # parsed once
    shown = [(F.timestamp_micros(f"s.{n}") if t == "timestamp" else F.col(f"s.{n}")).alias(n) for n, t in kinds_of(STATE).items()]
    return rows.select("vessel_id", *shown, "track_points", F.from_json("track", f"array<struct<{POINT}>>").alias("track"), "evicted")


class Cooldown(StatefulProcessor):
    """Fires an alert of a vessel and type unless one fired within the last ticks."""

    def __init__(self, ticks: int):
        self.ticks = ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "tick long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values("tick").drop_duplicates("tick")
        last = self.last.get()[0] if self.last.exists() else None
        fired = []
        for i, tick in enumerate(data["tick"].tolist()):
            if last is None or tick - last >= self.ticks:
                last = tick
                fired.append(i)
        if last is not None:
            self.last.update((last,))
        if fired:
            yield data.iloc[fired]

    def close(self) -> None:
        pass


def cooled_alerts(alerts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Streaming ``with_cooldown``: ticks must arrive in order across batches."""
    columns = ["vessel_id", "alert_type", "level", "message", "reason", "tick", "overall_score"]
    schema = "vessel_id string, alert_type string, level string, message string, reason string, tick long, overall_score int"
    rows = alerts.select(*columns).withColumn("tick", alerts["tick"].cast("long"))
    return rows.groupBy("vessel_id", "alert_type").transformWithStateInPandas(Cooldown(cfg.cooldown_ticks), outputStructType=schema, outputMode="Append", timeMode="None")
