"""Operators on small frames, one rule a test."""

import datetime as dt
import json
import shutil
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairlead.config import DEFAULT
from fairlead.functions import codes, motion
from fairlead.operators import alert_rules, behaviour, cleaning, features, geofence, iforest, reports, risk, sequences, tracks
from fairlead.plans import fixtures, pipeline
from fairlead.sources import dimensions, history, positions
from fairlead.streaming import messages

POSITIONS = "vessel_id string, seq long, timestamp timestamp, latitude double, longitude double, speed double, heading double"


def track(spark, points, vessel="A", minutes=5, start=dt.datetime(2025, 1, 1)):
    """points: (lat, lon, speed, heading)"""
    return spark.createDataFrame([(vessel, i, start + dt.timedelta(minutes=minutes * i), *p) for i, p in enumerate(points)], POSITIONS)


def raw(spark, *rows):
    schema = "vessel_id string, latitude double, longitude double, speed double, heading double, timestamp string"
    return spark.createDataFrame(list(rows), schema)


def reasons(spark, *rows):
    return [r["reject_reason"] for r in cleaning.judged(raw(spark, *rows)).orderBy("seq").collect()]


T = "01/02/2025 10:00:00"


def test_times_are_day_first(spark):
    row = cleaning.clean(cleaning.judged(raw(spark, ("A", 1.0, 2.0, 3.0, 4.0, T)))).first()
    assert row["timestamp"] == dt.datetime(2025, 2, 1, 10)


@pytest.mark.parametrize(
    "row, reason",
    [
        (("A", 1.0, 2.0, 3.0, 4.0, "nonsense"), "missing_timestamp"),
        ((" nan ", 1.0, 2.0, 3.0, 4.0, T), "missing_id"),
        ((None, 1.0, 2.0, 3.0, 4.0, T), "missing_id"),
        (("A", None, 2.0, 3.0, 4.0, T), "missing_coordinate"),
        (("A", float("nan"), 2.0, 3.0, 4.0, T), "missing_coordinate"),
        (("A", 91.0, 2.0, 3.0, 4.0, T), "invalid_coordinate"),
        (("A", 1.0, 2.0, -0.1, 4.0, T), "invalid_speed"),
        (("A", 1.0, 2.0, None, None, T), None),
    ],
)
def test_cleaning_rules(spark, row, reason):
    assert reasons(spark, row) == [reason]


def test_exact_duplicates_keep_the_first(spark):
    row = ("A", 1.0, 2.0, 3.0, 4.0, T)
    assert sorted(map(str, reasons(spark, row, row, row))) == ["None", "duplicate", "duplicate"]


@pytest.mark.parametrize("heading, kept", [(511.0, 0.0), (370.0, 10.0), (-10.0, 350.0), (0.0, 0.0)])
def test_headings(spark, heading, kept):
    assert cleaning.clean(cleaning.judged(raw(spark, ("A", 1.0, 2.0, 3.0, heading, T)))).first()["heading"] == kept


def test_cleaning_twice_changes_nothing(spark, small):
    once = cleaning.clean(cleaning.judged(fixtures.raw_positions(spark, small)))
    assert cleaning.clean(cleaning.judged(once)).count() == once.count()


def test_report_of_nothing_is_zero(spark):
    assert set(cleaning.quality_report(cleaning.judged(raw(spark))).first()) == {0}


def test_missing_columns_are_named(spark):
    with pytest.raises(positions.MissingColumns, match="latitude"):
        positions.normalise(spark.createDataFrame([("A", 1.0)], "MMSI string, LON double"))


def test_aliases_first_wins(spark):
    df = positions.normalise(spark.createDataFrame([("A", 1.0, 2.0, 3.0, 4.0)], "ID string, y double, x double, COG double, Heading double"))
    assert df.columns == ["vessel_id", "latitude", "longitude", "heading", "Heading_src"]


def test_load_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,time,latitude,lon,speed\nA,2025-01-01T00:00:00,1,2,x\nB,2025-01-01T00:00:00,999,2,3\nC,2025-01-01T00:00:00,,2,3\n")
    found = positions.load(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["vessel_id"], r["speed"], r["heading"]) for r in found] == [("A", 0.0, 0.0)]
    with pytest.raises(positions.PositionsNotFound):
        positions.load(spark, str(tmp_path / "none.csv"))


def test_haversine_and_turns(spark):
    one = spark.range(1).select(motion.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), motion.angular_diff(F.lit(350.0), F.lit(10.0)), motion.angular_diff(F.lit(10.0), F.lit(350.0))).first()
    assert abs(one[0] - 111.195) < 0.01 and one[1:] == (20.0, -20.0)


def test_zone_inside_near_and_far(spark):
    rows = spark.createDataFrame([("in", 12.5, 80.4), ("near", 12.7, 80.4), ("far", 20.0, 60.0), ("none", None, 1.0)], "vessel_id string, latitude double, longitude double")
    found = {r["vessel_id"]: r for r in geofence.check_zones(rows, dimensions.zones(spark)).collect()}
    assert found["in"]["zone_status"] == "INSIDE Restricted Zone A" and found["in"]["min_dist_deg"] == 0
    assert found["near"]["zone_status"] == "Near Restricted Zone A" and found["near"]["min_dist_deg"] == 0.1
    assert found["far"]["zone_status"] == found["none"]["zone_status"] == "Open Waters"
    empty = geofence.check_zones(rows, dimensions.zones(spark).filter("false")).collect()
    assert {r["zone_status"] for r in empty} == {"Open Waters"}


def test_grid_equals_all_zones_in_reach(spark, small):
    t = fixtures.tracks(spark, small)
    a = geofence.check_zones(t, dimensions.zones(spark)).select("vessel_id", "seq", "zone_status")
    b = geofence.check_zones_by_grid(t, dimensions.zones(spark)).select("vessel_id", "seq", "zone_status")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_heading_wraps(spark):
    found = behaviour.analyse(track(spark, [(0.0, 0.0, 5.0, 350.0), (0.1, 0.0, 5.0, 10.0)])).first()
    assert found["mean_heading_change"] == 20.0


def test_gap_and_duration(spark):
    df = track(spark, [(0.0, 0.0, 5.0, 0.0)] * 3, minutes=55)
    found = behaviour.analyse(df).first()
    assert (found["max_ais_gap_minutes"], found["significant_gap_count"], found["trajectory_duration_minutes"]) == (55.0, 2, 110.0)
    assert "AIS_GAP" in found["behavior_labels"]


def test_single_point(spark):
    found = behaviour.analyse(track(spark, [(1.0, 1.0, None, None)])).first()
    assert found["behavior_labels"] == ["INSUFFICIENT_DATA"] and found["distance_travelled_km"] == 0


def test_loitering_beats_transit(spark):
    circle = track(spark, [(0.001 * (i % 2), 0.0, 0.2, 0.0) for i in range(20)], "L")
    line = track(spark, [(0.05 * i, 0.0, 9.0, 0.0) for i in range(20)], "T")
    found = {r["vessel_id"]: r for r in behaviour.analyse(circle.union(line)).collect()}
    assert found["L"]["loitering_score"] > 0.6 > found["T"]["loitering_score"]
    assert found["T"]["behavior_labels"] == ["NORMAL_TRANSIT"]


def test_row_order_does_not_matter(spark, small):
    t = fixtures.tracks(spark, small)
    a, b = behaviour.analyse(t), behaviour.analyse(t.orderBy(F.desc("seq")).repartition(3))
    assert a.drop("behavior_labels").exceptAll(b.drop("behavior_labels")).isEmpty()


def test_windows(spark):
    assert sequences.windows(track(spark, [(0.01 * i, 0.0, 8.0, 90.0) for i in range(11)])).select(F.size("features")).collect() == [(60,)]
    assert sequences.windows(track(spark, [(0.01 * i, 0.0, 8.0, 90.0) for i in range(10)])).isEmpty()


def test_erratic_vessel_scores_higher(spark):
    steady = [track(spark, [(0.01 * i, 0.01 * k, 8.0, 90.0) for i in range(14)], f"S{k}") for k in range(6)]
    odd = track(spark, [(0.01 * (i * 7 % 5), 0.02 * (i * 3 % 4), 2.0 * (i % 7), 57.0 * i % 360) for i in range(14)], "X")
    df = odd
    for s in steady:
        df = df.union(s)
    model, _ = sequences.fit(df.filter("vessel_id <> 'X'"))
    found = {r[0]: r[1] for r in sequences.detect(df.select("vessel_id"), df, model=model)[0].collect()}
    assert found["X"] >= max(v for k, v in found.items() if k != "X")


def test_forest_finds_the_outlier_and_is_stored(spark, tmp_path):
    rows = [(f"V{i}", float(i % 5), float(i % 7), 1.0) for i in range(60)] + [("OUT", 90.0, -80.0, 1.0)]
    matrix = spark.createDataFrame(rows, "vessel_id string, f1 double, f2 double, f3 double")
    path = str(tmp_path / "forest")
    scores, status = iforest.detect(matrix, path=path)
    found = {r["vessel_id"]: r["anomaly_score"] for r in scores.collect()}
    assert status == "trained" and found["OUT"] == 1.0 and min(found.values()) == 0.0
    again, status = iforest.detect(matrix, path=path)
    assert status == "loaded" and {r["vessel_id"]: r["anomaly_score"] for r in again.collect()} == found
    _, status = iforest.load_or_train(matrix, ["f2", "f1", "f3"], path)
    assert status == "retrained"


def test_equal_rows_score_zero(spark):
    matrix = spark.createDataFrame([("A", 1.0), ("B", 1.0)], "vessel_id string, f double")
    assert {r["anomaly_score"] for r in iforest.detect(matrix)[0].collect()} == {0.0}


@pytest.mark.parametrize(
    "given, points",
    [
        ({"inside": True}, 30),
        ({"anomaly_score": 1.0}, 25),
        ({"temporal_anomaly_score": 1.0, "temporal_model_status": "scored"}, 15),
        ({"temporal_anomaly_score": 1.0, "temporal_model_status": "insufficient_data"}, 0),
        ({"loitering_score": 1.0}, 20),
        ({"mean_heading_change": 120.0}, 20),
        ({"reported_gap": 60.0, "max_ais_gap_minutes": 60.0}, 10),
        ({"reported_gap": 19.0}, 0),
    ],
)
def test_each_component_alone(spark, given, points):
    df = spark.range(1).select(F.lit("A").alias("vessel_id"), *(F.lit(v).alias(k) for k, v in given.items()))
    assert risk.score(risk.with_defaults(df)).first()["overall_score"] == points


def test_cooldown(spark):
    rows = [("A", "AIS_GAP", t) for t in (0, 1, 6, 6)]
    df = spark.createDataFrame(rows, "vessel_id string, alert_type string, tick long")
    from dataclasses import replace

    fired = alert_rules.with_cooldown(df, replace(DEFAULT, cooldown_ticks=5))
    assert sorted(r["tick"] for r in fired.collect()) == [0, 6]


def test_ship_types(spark):
    found = spark.createDataFrame([("30",), ("52",), ("79",), ("x",), ("0",), (None,)], "c string").select(codes.ship_type(F.col("c"))).collect()
    assert [r[0] for r in found] == ["Fishing", "Tug", "Cargo", "Unknown", "Unknown", "Unknown"]


def message(**p):
    return json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": 123.0, "time_utc": "2025-01-01 00:00:00 +0000 UTC"}, "Message": {"PositionReport": p}})


def test_messages(spark):
    lines = [message(Latitude=1.0, Longitude=2.0, Sog=3.0, TrueHeading=511), message(Latitude=99.0, Longitude=2.0), message(Longitude=2.0), "{bad", '{"MessageType": "Other"}']
    parsed = messages.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    found = messages.positions(parsed).collect()
    assert [(r["vessel_id"], r["latitude"], r["heading"], r["timestamp"]) for r in found] == [("123", 1.0, None, dt.datetime(2025, 1, 1))]
    assert messages.failures(parsed).count() == 2


def test_static_data_is_not_clobbered(spark):
    rows = [("A", 1, "NAME", "Cargo", None, "eta", 2.0), ("A", 2, None, "Unknown", "PORT", None, None)]
    df = spark.createDataFrame(rows, "vessel_id string, seq long, ship_name string, ship_type string, destination string, eta string, draught double")
    assert tuple(messages.merged_static(df).first()) == ("A", "NAME", "Cargo", "PORT", "eta", 2.0)


def test_history(spark, tmp_path, small):
    t = fixtures.tracks(spark, small).limit(200).cache()
    got = pipeline.run(t, dimensions.zones(spark), models=False)
    anomaly = got.latest.select("vessel_id", F.lit(0.5).alias("anomaly_score"), F.lit(False).alias("is_anomalous"))
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    write = lambda: store.write_run(got.latest, got.features, anomaly, got.risk, got.alerts, "feed", "bay", t)
    first, second = write(), write()
    assert first["positions"] == t.count() and second["positions"] == 0
    assert first["vessels"] == second["vessels"] == got.latest.count()
    row = store.summary().first()
    assert row["vessels"] == first["vessels"] and row["risk_scores"] == 2 * first["risk_scores"]
    assert store.recent_risk(3).count() == 3
    t.unpersist()


def test_histogram_and_report(spark, small):
    t = fixtures.tracks(spark, small)
    got = pipeline.run(t, dimensions.zones(spark), models=False)
    assert reports.score_histogram(got.risk).agg(F.sum("vessels")).first()[0] == 15
    temporal = got.latest.select("vessel_id", F.lit(0.0).alias("temporal_anomaly_score"), F.lit("scored").alias("temporal_model_status"))
    assert reports.vessel_report("V0001", got.risk, got.features, got.behaviour, temporal).count() == 1


def test_features_without_a_track(spark):
    latest = spark.createDataFrame([("A", 5.0)], "vessel_id string, speed double")
    none = track(spark, [(1.0, 1.0, 1.0, 1.0)], "B")
    geo = spark.createDataFrame([], "vessel_id string, inside boolean, min_dist_deg double")
    row = features.base_features(latest, none, geo).first()
    assert (row["displacement_ratio"], row["loitering_score"], row["zone_proximity_norm"]) == (1.0, 0.0, 0.0)


def test_windows_of_a_long_track(spark):
    points = [(0.01 * i, 0.0, 8.0, 90.0) for i in range(100)]
    points[90] = (5.0, 7.0, 60.0, 270.0)
    df = track(spark, points)
    assert sequences.windows(df).count() == 90
    assert sequences.windows(df, replace(DEFAULT, windows_per_vessel=50)).count() == 50
    model, _ = sequences.fit(track(spark, points[:90]))
    assert sequences.detect(df.select("vessel_id"), df, model=model)[0].first()["temporal_anomaly_score"] == 1.0
    assert sequences.errors(df, model).count() == 90
    assert sequences.errors(df, model, replace(DEFAULT, windows_per_vessel=50)).count() == 50


def test_windows_in_blocks_equal_window_rows(spark, small, monkeypatch):
    t = fixtures.tracks(spark, small)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # windows span many batches
    try:
        model = sequences.Model([0.0] * 60, [1.0] * 60, [[0.0]] * 60, 1.0)
        for cfg in (DEFAULT, replace(DEFAULT, windows_per_vessel=5)):
            square = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x) / 60
            want = sorted((r[0], round(r[1], 6)) for r in sequences.windows(t, cfg).select("vessel_id", square).collect())
            assert sorted((r[0], round(r[1], 6)) for r in sequences.errors(t, model, cfg).collect()) == want
        n, sums, products = sequences.moments(t, DEFAULT)
        rows = np.array([r[0] for r in sequences.windows(t).select("features").collect()])
        assert n == len(rows) and np.allclose(sums, rows.sum(0)) and np.allclose(products, rows.T @ rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_quantile_is_exact(spark):
    for values in ([3.0], [1.0] * 500, [float(x % 97) ** 3 for x in range(700)], [0.0] * 300 + [1e9, 5.0]):
        table = spark.createDataFrame([(x,) for x in values], "x double")
        for q in (0.0, 0.5, 0.95, 1.0):
            assert abs(sequences.quantile(table, "x", q, buckets=8, few=20) - float(np.quantile(values, q))) < 1e-6
    assert sequences.quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None


def test_large_matrix_draws_few_rows_for_each_tree(spark):
    matrix = spark.range(5000).select(F.concat(F.lit("V"), "id").alias("vessel_id"), (F.col("id") % 83).cast("double").alias("f"))
    cfg = replace(DEFAULT, trees=8, tree_rows=64)
    roots = iforest.fit(matrix, ["f"], cfg=cfg).filter("depth = 0").collect()
    assert len(roots) == 8 and all(r["size"] == 64 for r in roots)


def test_forest_arrays_walk_like_a_plain_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    nodes = pd.DataFrame([(t, *n) for t in (0, 3, 9) for n in iforest.build_tree(x[rng.integers(0, 300, 64)], rng, 6)], columns=[c.split()[0] for c in iforest.NODES.split(", ")])

    def path(tree, row):
        found = nodes[nodes["tree"] == tree].set_index("node")
        n = found.loc[0]
        while n["feature"] >= 0:
            n = found.loc[int(n["left"] if row[int(n["feature"])] < n["threshold"] else n["right"])]
        return n["depth"] + float(iforest.average_path(n["size"]))

    got = iforest.raw_scores(iforest.arrays(nodes), x, 64, rows=70)
    assert np.allclose(got, [2 ** (-np.mean([path(t, r) for t in (0, 3, 9)]) / float(iforest.average_path(64))) for r in x])


def test_ticks_keep_rows_without_a_time_and_outliers(spark):
    rows = [(f"V{i % 3}", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(200)]
    rows += [("V0", 900, None), ("V1", 901, None), ("V1", 902, dt.datetime(1970, 1, 1)), ("V2", 903, dt.datetime(2200, 1, 1))]
    got = {r["seq"]: r["tick"] for r in tracks.ticks(spark.createDataFrame(rows, "vessel_id string, seq long, timestamp timestamp"), 10).collect()}
    order = [900, 901, 902, *range(200), 903]
    assert got == {s: i // (204 // 10) for i, s in enumerate(order)}


def test_rejected_rows_alike_are_all_counted(spark):
    rows = [(None, None, None, None, i) for i in range(50)] + [("A", 1.0, 2.0, "2024-01-01 00:00:00", 60), ("A", 1.0, 2.0, "2024-01-01 00:00:00", 61)]
    report = cleaning.quality_report(cleaning.judged(spark.createDataFrame(rows, "vessel_id string, latitude double, longitude double, timestamp string, seq long"))).first()
    assert (report["missing_timestamp_rows"], report["duplicate_rows"], report["output_rows"]) == (50, 1, 1)


def test_many_sides_go_by_array(spark):
    ring = [(float(np.cos(a)), float(np.sin(a))) for a in np.linspace(0, 6.2, 60)]
    zones = spark.createDataFrame([("z", 0, "round", "t", ring), ("z", 1, "far", "t", [(x + 9, y) for x, y in ring])], dimensions.ZONE_SCHEMA)
    one = zones.filter("zone_ord = 0")
    df = track(spark, [(0.0, 0.0, 1.0, 1.0), (1.05, 0.0, 1.0, 1.0), (0.5, 0.4, 1.0, 1.0), (20.0, 0.0, 1.0, 1.0)])
    plans = [geofence.check_zones(df, z) for z in (one, zones)]
    assert [len(p.columns) for p in plans] == [len(df.columns) + 6] * 2
    assert [[(r["inside"], r["near"]) for r in p.orderBy("seq").collect()] for p in plans] == [[(True, False), (False, True), (True, False), (False, False)]] * 2
    none = geofence.check_zones(df, zones.filter("false")).collect()
    assert {(r["zone_status"], r["min_dist_deg"], r["nearest_zone"]) for r in none} == {("Open Waters", None, "")}


def test_failing_sink_does_not_break(spark, tmp_path, small):
    got = pipeline.run(fixtures.tracks(spark, small), dimensions.zones(spark), models=False)
    (tmp_path / "file").write_text("no folder")
    store = history.HistoryStore(spark, str(tmp_path / "file"))
    told = store.try_write_run(got.latest, got.features, got.latest.select("vessel_id", F.lit(0.5).alias("anomaly_score"), F.lit(False).alias("is_anomalous")), got.risk, got.alerts, "feed", "bay")
    assert told["written"] is False and told["error"] and got.risk.count() == 15


def test_pipeline_is_one_pass(spark, small):
    t = fixtures.tracks(spark, small)
    plan = pipeline.fleet(t, dimensions.zones(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(vessel_id") == 1 and plan.count("FileScan parquet") == 1 and "Python" not in plan
    risk_plan = pipeline.run(t, dimensions.zones(spark), models=False).risk._jdf.queryExecution().executedPlan().toString()
    assert risk_plan.count("FileScan parquet") == 1 and "Exchange" not in risk_plan


def test_recent_and_trajectories(spark):
    df = track(spark, [(float(i), 0.0, 1.0, 1.0) for i in range(5)])
    assert sorted(r["latitude"] for r in tracks.recent(df, 2).collect()) == [3.0, 4.0]
    assert [p["latitude"] for p in tracks.trajectories(df).first()["points"]] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_trajectory_rows_are_bounded(spark):
    df = track(spark, [(float(i % 80), 0.0, 1.0, 1.0) for i in range(50)], minutes=1).union(track(spark, [(float(i), 0.0, 1.0, 1.0) for i in range(30)], minutes=5, vessel="B"))
    chunks = tracks.trajectories(df, size=7).orderBy("vessel_id", "slice", "chunk").collect()
    assert max(len(r["points"]) for r in chunks) == 7
    for vessel, n in (("A", 50), ("B", 30)):
        assert [p["seq"] for r in chunks if r["vessel_id"] == vessel for p in r["points"]] == list(range(n))


def test_source_metadata_has_a_default():
    assert dimensions.source_meta("Historical AIS")["region"] == "Danish Waters"
    assert dimensions.source_meta("nowhere") == dimensions.source_meta("Simulated")


def test_geometry_alone_leaves_other_metrics_at_zero(spark):
    df = track(spark, [(0.01 * i, 0.0, 1.0, 1.0) for i in range(5)])
    bare = df.withColumns({"speed": F.lit(None).cast("double"), "heading": F.lit(None).cast("double"), "timestamp": F.lit(None).cast("timestamp")})
    row = behaviour.analyse(bare).first()
    assert row["distance_travelled_km"] > 4 and row["position_count"] == 5
    assert {row[n] for n in ("avg_speed", "max_speed", "speed_std", "mean_heading_change", "max_ais_gap_minutes", "trajectory_duration_minutes", "stationary_ratio")} == {0.0}


def test_history_without_positions_and_streamed_alerts(spark, tmp_path, small):
    got = pipeline.run(fixtures.tracks(spark, small), dimensions.zones(spark), models=False)
    anomaly = got.latest.select("vessel_id", F.lit(0.5).alias("anomaly_score"), F.lit(False).alias("is_anomalous"))
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    for _ in range(2):
        counts = store.write_run(got.latest, got.features, anomaly, got.risk, got.alerts, "feed", "bay")
    assert counts["positions"] == 0 and store.table("positions").filter("timestamp IS NULL").count() == 15  # null equals null
    run = store.table("risk_scores").first()["run_id"]
    alerts = spark.createDataFrame([("A", "HIGH", "m", "r", "AIS_GAP", 3)], "vessel_id string, level string, message string, reason string, alert_type string, tick int")
    before = store.table("alerts").count()
    store.append_alerts(alerts, run)
    row = store.table("alerts").filter("vessel_id = 'A'").first()
    assert store.table("alerts").count() == before + 1 and row["created_at"] is not None and row["tick"] == 3
    assert store.alert_panel(3).first()["level"] == "HIGH"
    risk_, alerts_ = store.vessel_recent("V0001")
    assert risk_.count() == 2 and {r["vessel_id"] for r in risk_.collect()} == {"V0001"}


def test_sequence_model_is_stored_and_retrained_when_it_does_not_fit(spark, tmp_path, small):
    t, path = fixtures.tracks(spark, small), str(tmp_path / "m")
    vessels = t.select("vessel_id").distinct()
    first, status = sequences.detect(vessels, t, path)
    again, loaded = sequences.detect(vessels, t, path)
    assert (status, loaded) == ("trained", "loaded") and sorted(first.collect()) == sorted(again.collect())
    _, status = sequences.detect(vessels, t, path, cfg=replace(DEFAULT, sequence_length=8))
    assert status == "retrained"
    assert {r[2] for r in sequences.detect(vessels, t.limit(0))[0].collect()} == {"insufficient_data"}


def test_tracks_are_written_in_order(spark, small):
    t = tracks.ordered(fixtures.tracks(spark, small).orderBy(F.desc("seq")))
    for rows in t.rdd.glom().collect():
        assert [(r["vessel_id"], r["timestamp"], r["seq"]) for r in rows] == sorted((r["vessel_id"], r["timestamp"], r["seq"]) for r in rows)
    assert tracks.track(t, "V0003").count() == t.filter("vessel_id = 'V0003'").count()


def test_alert_orders(spark):
    rows = spark.createDataFrame([("MEDIUM", 90, "A"), ("HIGH", 60, "C"), ("HIGH", 60, "B")], "level string, overall_score int, vessel_id string")
    assert [r["vessel_id"] for r in rows.orderBy(*risk.alert_order()).collect()] == ["B", "C", "A"]
    ticks = spark.createDataFrame([(1, 5, "A", "X"), (1, 9, "B", "X"), (0, 1, "C", "X")], "tick long, overall_score int, vessel_id string, alert_type string")
    assert [r["vessel_id"] for r in ticks.orderBy(*alert_rules.order()).collect()] == ["C", "B", "A"]


def test_many_zones_by_grid_equal_all_pairs(spark):
    import random

    rng = random.Random(6)
    rings = []
    for i in range(260):
        la, lo, r = rng.uniform(-80, 80), rng.uniform(-175, 175), rng.choice([0.02, 0.2, 3.0])
        rings.append(("x", i, f"Z{i}", "k", [(la + rng.uniform(0, r), lo), (la, lo + r), (la - r, lo), (la, lo - r)] if i % 9 else [(la, lo), (la, lo + r), (la + r, lo)]))
    rings += [("x", 260, "twin", "k", rings[0][4]), ("x", 261, "empty", "k", [])]
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(300 + i, r[4][0][0] - 0.001, r[4][0][1] + 0.001) for i, r in enumerate(rings[:260])] + [(900, None, 1.0), (901, 1.0, None)]
    df = spark.createDataFrame(places, "seq long, latitude double, longitude double")
    own = lambda zones, found: sorted(map(str, found(df, spark.createDataFrame(zones, dimensions.ZONE_SCHEMA)).collect()))
    few = rings[:150]  # below the limit: every position with every zone
    assert own(few, geofence.check_zones_by_grid) == own(few, geofence.check_zones)
    assert own(few, lambda d, z: geofence.check_zones_by_grid(d, z, cell=40.0)) == own(few, geofence.check_zones)
    many = own(rings, geofence.check_zones)  # by grid
    import fairlead.operators.geofence as module

    limit, module.MANY_ZONES = module.MANY_ZONES, 10**6
    try:
        assert many == own([r for r in rings if r[4]], geofence.check_zones)
    finally:
        module.MANY_ZONES = limit
    assert own([], geofence.check_zones_by_grid) == own([], geofence.check_zones)


def test_written_tables_of_a_run_are_cleared(spark, tmp_path, monkeypatch):
    from fairlead.sources import tables

    monkeypatch.setattr(tables, "shared_folder", lambda spark: str(tmp_path))
    one, two = tables.written(spark.range(3), "one"), tables.written(spark.range(4), "two")
    tables.discard(one)
    assert two.count() == 4 and len(list(tmp_path.glob("*/*"))) == 1
    (tmp_path / "other").mkdir()
    tables.clear_run(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


def test_forest_scores_follow_a_plain_forest(spark):
    """Scores of the distributed forest against one grown in numpy from random samples of the same rows."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(6, 0.5, (6, 3))])
    df = spark.createDataFrame([(f"V{i}", *map(float, r)) for i, r in enumerate(x)], "vessel_id string, a double, b double, c double")
    cfg = replace(DEFAULT, trees=100, tree_rows=128)
    columns = ["a", "b", "c"]
    got = {r["vessel_id"]: r["raw"] for r in iforest.raw_table(df, iforest.fit(df, columns, cfg=cfg), columns, cfg=cfg).collect()}
    depths = np.zeros(len(x))
    for _ in range(100):
        sample = x[rng.choice(len(x), 128, replace=False)]

        def depth(points, rows, level):
            """Path lengths of ``points`` in a tree grown from ``rows``."""
            if level >= 7 or len(rows) <= 1:
                return np.full(len(points), level + float(iforest.average_path(len(rows))))
            f = rng.integers(3)
            t = rng.uniform(rows[:, f].min(), rows[:, f].max())
            left, out = points[:, f] < t, np.empty(len(points))
            out[left], out[~left] = depth(points[left], rows[rows[:, f] < t], level + 1), depth(points[~left], rows[rows[:, f] >= t], level + 1)
            return out

        depths += depth(x, sample, 0)
    plain = 2 ** (-depths / 100 / float(iforest.average_path(128)))
    mine = np.array([got[f"V{i}"] for i in range(len(x))])
    assert np.corrcoef(mine, plain)[0, 1] > 0.95 and np.abs(mine - plain).mean() < 0.03
    assert set(np.argsort(-mine)[:6]) == set(range(500, 506))


def test_sequence_model_equals_a_plain_fit(spark, small):
    import numpy as np

    t = fixtures.tracks(spark, small)
    rows = np.array([r["features"] for r in sequences.windows(t).collect()])
    z = (rows - rows.mean(0)) / np.where(rows.std(0) < 1e-12, 1, rows.std(0))
    _, _, v = np.linalg.svd(z, full_matrices=False)
    errors = ((z - z @ v[:32].T @ v[:32]) ** 2).mean(1)
    model, found = sequences.fit(t)
    assert np.allclose(sorted(r["error"] for r in found.collect()), np.sort(errors), atol=1e-6)
    assert abs(model.reference - np.quantile(errors, 0.95)) < 1e-6 and len(model.components[0]) == 32


def test_sequence_model_of_the_first_windows(spark, small):
    t = fixtures.tracks(spark, small)
    cfg = replace(DEFAULT, windows_per_vessel=20, training_windows=130)
    x = np.array([r["features"] for r in sorted(sequences.windows(t, cfg).collect(), key=lambda r: (r["vessel_id"], r["start"]))[:130]])
    model, found = sequences.fit(t, cfg)
    assert np.allclose(model.mean, x.mean(0)) and found.count() == sequences.errors(t, model, cfg).count() > 130
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
    c = np.array(model.components)
    left = np.maximum(0, ((z * z).sum(1) - ((z @ c) ** 2).sum(1)) / x.shape[1])
    assert np.isclose(model.reference, np.quantile(left, 0.95))
    every, _ = sequences.fit(t, replace(cfg, training_windows=10**6))
    assert np.allclose(every.mean, sequences.fit(t, replace(cfg, training_windows=None))[0].mean)


def test_a_forest_without_its_nodes_is_trained_anew(spark, tmp_path):
    matrix = spark.createDataFrame([(f"v{i}", float(i), float(i % 7)) for i in range(40)], "vessel_id string, f1 double, f2 double")
    path, cfg = str(tmp_path / "m"), replace(DEFAULT, trees=5)
    assert iforest.load_or_train(matrix, ["f1", "f2"], path, cfg=cfg)[1] == "trained"
    shutil.rmtree(f"{path}/nodes")
    assert iforest.load_or_train(matrix, ["f1", "f2"], path, cfg=cfg)[1] == "retrained"
    assert iforest.load_or_train(matrix, ["f1", "f2"], path, cfg=cfg)[1] == "loaded"
