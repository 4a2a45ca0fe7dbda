"""Streams against their batch twins."""

import datetime as dt
import glob
import json
import time

from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fairlead.config import DEFAULT
from fairlead.operators import alert_rules, features, geofence, iforest, tracks
from fairlead.plans import fixtures, queries
from fairlead.sources import dimensions
from fairlead.sources.tables import shared_folder
from fairlead.streaming import jobs, messages, state


def test_message_stream_equals_batch(spark, small, tmp_path):
    lines = fixtures.messages(spark, small)
    lines.select("value").repartition(3).write.text(str(tmp_path / "in"))
    got = []
    jobs.run_available(jobs.live_positions(jobs.message_stream(spark, str(tmp_path / "in"))), lambda df, n: got.append(df.count()), str(tmp_path / "c"))
    assert sum(got) == messages.positions(messages.parsed(lines)).count()


def test_vessel_state(spark, small, tmp_path):
    t = fixtures.tracks(spark, small)
    t.repartitionByRange(3, "timestamp").sortWithinPartitions("timestamp").write.parquet(str(tmp_path / "in"))
    stream = jobs.replay_stream(spark, str(tmp_path / "in"), t.schema, 10)
    rows = []
    jobs.run_available(state.vessel_state(stream, stale_seconds=10**9), lambda df, n: rows.extend(df.collect()), str(tmp_path / "c"), "update")
    latest = {r["vessel_id"]: r for r in rows}
    twin = {r["vessel_id"]: r for r in tracks.latest(t).collect()}
    assert latest.keys() == twin.keys()
    for v, r in latest.items():
        assert abs(r["latitude"] - twin[v]["latitude"]) < 1e-3 and r["timestamp"] == twin[v]["timestamp"]
        assert r["messages"] == t.filter(F.col("vessel_id") == v).count() and r["track_points"] == 50


def test_cooled_alerts(spark, small, tmp_path):
    alerts = alert_rules.evaluate(queries.ticked_risk(spark, small))
    alerts.withColumn("tick", F.col("tick").cast("long")).repartition(1).sortWithinPartitions("tick").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = []
    jobs.run_available(state.cooled_alerts(stream), lambda df, n: got.extend(df.collect()), str(tmp_path / "c"))
    batch = alert_rules.with_cooldown(alerts).collect()
    assert sorted((r["vessel_id"], r["alert_type"], r["tick"]) for r in got) == sorted((r["vessel_id"], r["alert_type"], r["tick"]) for r in batch)


def test_windowed_counts_and_replay(spark, small, tmp_path):
    t = fixtures.tracks(spark, small)
    jobs.write_replay(t, str(tmp_path / "r"), 5)
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("tick").count().count() == 5
    assert jobs.counts_by_window(t, "1 hour", "30 minutes").agg(F.sum("messages")).first()[0] == 2 * t.count()


OBSERVED = "vessel_id string, seq long, timestamp timestamp, latitude double, longitude double, speed double, heading double, course double, nav_status int"


def streamed(spark, folder, batches):
    """The last state after batches of rows, one file a batch, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, OBSERVED).coalesce(1).write.parquet(f"{folder}/all/{i}")
    import glob
    import os
    import shutil

    os.makedirs(f"{folder}/in")
    for i in range(len(batches)):
        (part,) = glob.glob(f"{folder}/all/{i}/part-*.parquet")
        shutil.copy(part, f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
    stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = []
    jobs.run_available(state.vessel_state(stream, "1 day", stale_seconds=10**6), lambda df, n: out.append({r["vessel_id"]: r for r in df.collect()}), f"{folder}/c", "update")
    return out


def at(minute, lat, vessel="A", **more):
    row = {"speed": lat * 2, "heading": 10.0, "course": 20.0, "nav_status": 1} | more
    return (vessel, minute, dt.datetime(2025, 1, 1, 0, minute), lat, 0.0, row["speed"], row["heading"], row["course"], row["nav_status"])


def test_late_positions_never_replace_newer_ones(spark, tmp_path):
    out = streamed(spark, tmp_path, [[at(10, 1.0), at(20, 2.0, heading=None)], [at(5, 0.5), at(15, 1.5)], [at(30, 3.0)]])
    late, last = out[1]["A"], out[2]["A"]
    assert (late["latitude"], late["timestamp"], late["messages"]) == (2.0, dt.datetime(2025, 1, 1, 0, 20), 4)
    assert (late["prev_latitude"], late["prev_speed"], late["first_latitude"], late["track_points"]) == (1.5, 3.0, 0.5, 4)
    assert (last["latitude"], last["prev_latitude"], last["prev_heading"], last["course"], last["nav_status"]) == (3.0, 2.0, None, 20.0, 1)


def test_static_data_is_merged_in_state_and_late_blanks_replace_none(spark, tmp_path):
    static = lambda minute, **s: json.dumps({"MessageType": "ShipStaticData", "MetaData": {"MMSI": 7, "time_utc": f"2025-01-01 00:{minute:02d}:00 +0000 UTC"}, "Message": {"ShipStaticData": s}})
    place = lambda minute, lat: json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": 7, "time_utc": f"2025-01-01 00:{minute:02d}:00 +0000 UTC"}, "Message": {"PositionReport": {"Latitude": lat, "Longitude": 1.0}}})
    lines = [place(1, 1.0), static(2, Name="OLD", Type="70"), static(9, Name=" ", Type="0", Destination="PORT"), static(5, Name="NEW"), place(8, 2.0), "{bad"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    row = jobs.final_state(spark, df, files=3).collect()
    assert [(r["vessel_id"], r["latitude"], r["ship_name"], r["ship_type"], r["destination"]) for r in row] == [("7", 2.0, "NEW", "Cargo", "PORT")]


def test_messages_of_one_time_go_by_their_order(spark):
    """Places and static data of one time, however they fall into batches: seq decides, also between previous ones."""
    meta = {"MMSI": 7, "time_utc": "2025-01-01 00:01:00 +0000 UTC"}
    place = lambda lat: json.dumps({"MessageType": "PositionReport", "MetaData": meta, "Message": {"PositionReport": {"Latitude": lat, "Longitude": 1.0}}})
    static = lambda name: json.dumps({"MessageType": "ShipStaticData", "MetaData": meta, "Message": {"ShipStaticData": {"Name": name}}})
    lines = [(seq, text) for seq in range(1, 9) for text in (place(float(seq)), static(f"S{seq}"))]
    for files, order in ((1, 1), (8, 1), (8, -1)):
        df = spark.createDataFrame(lines[::order], "seq long, value string")
        (r,) = jobs.final_state(spark, df, files=files).collect()
        assert (r["latitude"], r["prev_latitude"], r["first_latitude"], r["ship_name"], r["messages"], r["track_points"]) == (8.0, 7.0, 1.0, "S8", 8, 8)


def test_live_counters(spark, small, tmp_path):
    fixtures.messages(spark, small).select("value").repartition(3).write.text(str(tmp_path / "in"))
    counters = jobs.LiveCounters()
    spark.streams.addListener(counters)
    try:
        watched = jobs.LiveCounters.observed(messages.parsed(jobs.message_stream(spark, str(tmp_path / "in"))))
        jobs.run_available(watched, lambda df, n: df.write.format("noop").mode("overwrite").save(), str(tmp_path / "c"))
        for _ in range(100):
            if counters.counts["messages"] >= 1000:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.counts["messages"] == 1000 and 0 < counters.counts["failures"] < 50 and counters.counts["static_messages"] > 100


def live_parts(spark, small):
    t = fixtures.tracks(spark, small)
    nodes, columns = spark.createDataFrame(queries.FIXED_FOREST, iforest.NODES), ["speed", "displacement_ratio"]
    zones, latest = dimensions.zones(spark), tracks.latest(t)
    base = features.base_features(latest, t, geofence.check_zones(latest, zones))
    return t, zones, nodes, columns, iforest.bounds_of(base, nodes, columns)


def test_a_vessels_live_score_does_not_depend_on_its_companions(spark, small):
    t, zones, nodes, columns, bounds = live_parts(spark, small)
    rescore = jobs.rescorer(zones, (nodes, columns, bounds), queries.FIXED_SEQUENCES)
    fleet = {r["vessel_id"]: r["overall_score"] for r in rescore(t).collect()}
    for vessels in (["V0012"], ["V0001", "V0005"]):
        some = rescore(t.filter(F.col("vessel_id").isin(vessels))).collect()
        assert {r["vessel_id"]: r["overall_score"] for r in some} == {v: fleet[v] for v in vessels}
    with pytest.raises(ValueError):
        jobs.rescorer(zones, (nodes, columns))


def test_stored_forests_have_bounds(spark, small, tmp_path):
    matrix = queries.written(queries.feature_matrix(spark, small), "matrix")
    cfg = replace(DEFAULT, trees=10)
    own, status = iforest.detect(matrix, queries.FEATURES, path=str(tmp_path / "forest"), cfg=cfg)
    nodes, columns, bounds = iforest.stored(spark, str(tmp_path / "forest"))
    again = iforest.score(matrix, nodes, columns, cfg=cfg, bounds=bounds)
    assert status == "trained" and sorted(map(tuple, own.collect())) == sorted(map(tuple, again.collect()))
    assert iforest.stored(spark, str(tmp_path / "none")) is None


def test_live_rescore_leaves_out_who_is_gone(spark, small, tmp_path):
    t, zones, nodes, columns, bounds = live_parts(spark, small)
    last = t.agg(F.max("timestamp")).first()[0]
    silent = (F.col("vessel_id") == "V0003") & (F.unix_micros("timestamp") > F.unix_micros(F.lit(last)) - 4 * 3600 * 10**6)
    rows = queries.by_quarter(t.filter(~silent))
    rescore = jobs.rescorer(zones, (nodes, columns, bounds), queries.FIXED_SEQUENCES)
    for k in range(4):
        rows.filter(F.col("quarter") == k).drop("quarter").write.mode("append").parquet(str(tmp_path / "in"))
        states = state.vessel_state(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")), "1 minute", stale_seconds=3600 * 3)
        jobs.live_rescore(states, rescore, str(tmp_path / "out"), str(tmp_path / "c"))
    found = {r["vessel_id"] for r in jobs.active_risk(spark, str(tmp_path / "out")).collect()}
    ages = {r["vessel_id"]: (last - r["t"]).total_seconds() for r in rows.groupBy("vessel_id").agg(F.max("timestamp").alias("t")).collect()}
    assert "V0003" not in found and found == {v for v, a in ages.items() if a < 3600 * 3}


def test_vessels_with_static_data_alone_are_dropped_too(spark, tmp_path):
    static = "vessel_id string, seq long, timestamp timestamp, latitude double, longitude double, speed double, heading double, ship_name string"
    row = lambda v, hour, lat, name: (v, hour, dt.datetime(2025, 1, 1, hour), lat, 0.0 if lat else None, None, None, name)
    rows = spark.createDataFrame([row("A", 0, None, "ALPHA"), row("B", 0, 1.0, None), row("B", 3, 2.0, None), row("B", 9, 3.0, None), row("C", 9, 1.0, "CHARLIE")], static)
    build = lambda stream: state.vessel_state(stream, "1 minute", stale_seconds=2 * 3600)
    out = jobs.in_batches(rows.withColumn("b", (F.col("seq") >= 9).cast("int")), "b", 2, build, "update").cache()
    gone = sorted((r["vessel_id"], r["messages"]) for r in out.filter("evicted").collect())
    assert gone == [("A", 0), ("B", 1), ("B", 1)]  # B after its first report and after its second
    assert [r["evicted_so_far"] for r in jobs.evictions(out).orderBy("written_in").collect()][-1] == 2
    assert {(r["vessel_id"], r["messages"]) for r in out.filter("NOT evicted AND latitude IN (3.0, 1.0) AND timestamp > '2025-01-01 05:00:00'").collect()} == {("B", 1), ("C", 1)}


def test_late_rows_are_counted(spark, tmp_path):
    rows = [("A", h, dt.datetime(2025, 1, 1, h)) for h in (0, 1, 5, 9)] + [("B", 20, dt.datetime(2025, 1, 1, 0, 30)), ("B", 21, dt.datetime(2025, 1, 1, 9, 30))]
    df = spark.createDataFrame(rows, "vessel_id string, seq long, timestamp timestamp").withColumn("b", (F.col("seq") >= 20).cast("int"))
    counters = jobs.LiveCounters()
    spark.streams.addListener(counters)
    try:
        found = jobs.in_batches(df, "b", 2, lambda s: jobs.counts_by_window(s, "1 hour", delay="1 hour"))
        assert {(r["window_start"].hour, r["messages"], r["vessels"]) for r in found.collect()} == {(0, 1, 1), (1, 1, 1), (5, 1, 1)}
        for _ in range(50):
            if counters.late:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.late == 1


def test_windowed_counts_of_a_batch(spark):
    rows = spark.createDataFrame([("A", dt.datetime(2025, 1, 1, 0, m)) for m in (1, 9, 11)] + [("B", dt.datetime(2025, 1, 1, 0, 2))], "vessel_id string, timestamp timestamp")
    found = {(r["window_start"].minute, r["messages"], r["vessels"]) for r in jobs.counts_by_window(rows).collect()}
    assert found == {(0, 3, 2), (10, 1, 1)}
    each = {(r["vessel_id"], r["window_start"].minute, r["messages"]) for r in jobs.counts_by_window(rows, keys=("vessel_id",)).collect()}
    assert each == {("A", 0, 2), ("A", 10, 1), ("B", 0, 1)}


def test_messages_are_parsed_once(spark, small):
    parsed = messages.parsed(fixtures.messages(spark, small))
    for df in (messages.positions(parsed), messages.static_data(parsed), messages.counters(parsed)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") == 1


def test_a_replay_goes_tick_by_tick_and_goes_on_after_a_stop(spark, small, tmp_path):
    t = fixtures.tracks(spark, small)
    path, got = str(tmp_path / "ticks"), []
    jobs.write_replay(t, path, 6)
    schema = spark.read.parquet(path).drop("folder").schema
    files = [len(list(d.glob("*.parquet"))) for d in sorted((tmp_path / "ticks").glob("folder=*"))]
    keep = lambda df, n: got.extend((n, r["tick"], r["n"]) for r in df.groupBy("tick").agg(F.count("*").alias("n")).collect())
    run = lambda n=None: jobs.replay(spark, path, schema, lambda stream: stream, keep, most=n)
    assert run(2) == len(files) - 2 and [tick for _, tick, _ in got] == [0, 1]
    # stopped between the move of a tick and its batch: it comes first when the replay goes on
    (tmp_path / "ticks" / "folder=2").rename(tmp_path / "ticks-seen" / "in" / "folder=2")
    assert run() == 0 and run() == 0
    assert [(n, tick) for n, tick, _ in got] == [(i, i) for i in range(len(files))]
    assert sum(n for _, _, n in got) == t.count()


def test_a_replay_keeps_vessel_state(spark, small, tmp_path):
    t, path = fixtures.tracks(spark, small), str(tmp_path / "ticks")
    jobs.write_replay(t, path, 4)
    schema = spark.read.parquet(path).drop("folder", "tick").schema
    out = []
    jobs.replay(spark, path, schema, lambda s: state.vessel_state(s, "1 day", stale_seconds=10**9), lambda df, n: out.extend(df.collect()), "update")
    last = {r["vessel_id"]: r["messages"] for r in sorted(out, key=lambda r: r["messages"])}
    assert last == {r["vessel_id"]: r["count"] for r in t.groupBy("vessel_id").count().collect()}


class Store:
    """The state of one vessel, with a list of what is asked of it."""

    def __init__(self):
        self.kept, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.kept

    def update(self, value):
        self.calls.append("update")
        self.kept = value

    def registerTimer(self, at):
        self.calls.append(at)


def test_a_vessel_costs_one_read_and_one_write_a_batch_and_one_timer():
    """Not several of each, and no list of timers: with tens of thousands of vessels in a batch that takes the time."""
    store, processor = Store(), state.VesselState(50, 3600)
    processor.init(store)
    for batch in range(3):
        place = {"latitude": 1.0, "longitude": batch / 2, "speed": "Infinity", "heading": None, "course": None, "nav_status": 3}
        static = {"ship_name": f"S{batch}", "ship_type": "unknown", "destination": None, "eta": None, "draught": 2.5}
        reports = [Row(report=json.dumps({"us": us * 10**6, "seq": us} | place | static)) for us in (batch * 60 + 1, batch * 60)]
        (out,) = processor.handleInputRows(("A",), iter(reports), None)
    assert store.calls == ["get", 3601000, "update", "get", "update", "get", "update"]
    found = json.loads(out["state"])
    assert (found["timestamp"], found["prev_seq"], found["first_seq"], found["messages"]) == (121 * 10**6, 120, 0, 6)
    assert (found["speed"], found["ship_name"], found["ship_type"], found["draught_seq"], found["due"]) == (float("inf"), "S2", None, 121, 3721000)
    assert [p["seq"] for p in json.loads(out["track"])] == [0, 1, 60, 61, 120, 121]


def test_a_vessel_that_is_heard_again_stays_until_its_last_report_is_stale(spark):
    rows = [("A", 0, 0.0, 0), ("B", 0, 0.0, 0), ("A", 1, 1.5, 1), ("B", 1, 3.0, 1), ("B", 2, 3.0 + 31 / 60, 2)]
    times = [(v, seq, dt.datetime(2025, 1, 1) + dt.timedelta(hours=hour), 1.0, 2.0, None, None, b) for v, seq, hour, b in rows]
    df = spark.createDataFrame(times, "vessel_id string, seq long, timestamp timestamp, latitude double, longitude double, speed double, heading double, b int")
    build = lambda stream: state.vessel_state(stream, "1 minute", stale_seconds=2 * 3600)
    out = jobs.in_batches(df, "b", 3, build, "update").filter("evicted AND vessel_id = 'A'").collect()
    assert [(r["messages"], r["timestamp"], len(r["track"])) for r in out] == [(2, dt.datetime(2025, 1, 1, 1, 30), 2)]  # not at 02:00; at 03:30 sharp


def test_a_micro_batch_is_read_by_many_tasks(spark, small, monkeypatch):
    monkeypatch.setattr(jobs, "BLOCK", 20_000)
    before = set(glob.glob(f"{shared_folder(spark)}/live-*"))
    assert jobs.final_state(spark, fixtures.messages(spark, small), files=1).count() == fixtures.tracks(spark, small).select("vessel_id").distinct().count()
    (folder,) = set(glob.glob(f"{shared_folder(spark)}/live-*")) - before
    (file,) = glob.glob(f"{folder}/in/*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 2
