"""The history: manifest, vessels' log, positions by day."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from fairlead.sources import history
from fairlead.sources.manifest import Manifest

DAY = dt.datetime(2025, 1, 1)


def run_of(spark, vessels, places):
    """Frames of a small run: places are (vessel, hours since DAY or None, latitude)."""
    v = spark.createDataFrame([(x,) for x in vessels], "vessel_id string")
    latest = v.withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0), "speed": F.lit(3.0), "heading": F.lit(4.0)})
    anomaly = v.withColumns({"anomaly_score": F.lit(0.5), "is_anomalous": F.lit(False)})
    risk = v.withColumns({"overall_score": F.lit(7), "risk_level": F.lit("LOW"), "behavior": F.lit("b"), "zone_status": F.lit("z")})
    alerts = v.withColumns({"level": F.lit("HIGH"), "message": F.lit("m"), "reason": F.lit("r")})
    rows = [(x, None if h is None else DAY + dt.timedelta(hours=h), lat, 2.0, 3.0, 4.0) for x, h, lat in places]
    positions = spark.createDataFrame(rows, "vessel_id string, timestamp timestamp, latitude double, longitude double, speed double, heading double")
    return latest, v.withColumn("f", F.lit(1)), anomaly, risk, alerts, "feed", "bay", positions


def test_a_version_is_put_once(spark, tmp_path):
    one, two = Manifest(spark, str(tmp_path / "m")), Manifest(spark, str(tmp_path / "m"))
    assert one.versions() == [] and one.put(1, {"run_id": "a"}) and not two.put(1, {"run_id": "b"}) and two.put(2, {"run_id": "b"})
    assert [(v["version"], v["run_id"]) for v in one.versions()] == [(1, "a"), (2, "b")]


def test_a_run_that_comes_second_sees_what_the_first_wrote(spark, tmp_path):
    class Slow(history.HistoryStore):
        """Another run gets in after this one has looked at the manifest."""

        other = None

        def known_positions(self, versions, places):
            found = super().known_positions(versions, places)
            if self.other is not None:
                other, self.other = self.other, None
                history.HistoryStore(self.spark, self.path).write_run(*other)
            return found

    store = Slow(spark, str(tmp_path / "h"))
    store.write_run(*run_of(spark, ["A"], [("A", 0, 1.0)]))
    store.other = run_of(spark, ["B", "C"], [("B", 1, 1.0), ("C", None, 1.0)])
    counts = store.write_run(*run_of(spark, ["B", "D"], [("A", 0, 1.0), ("B", 1, 1.0), ("C", None, 1.0), ("D", 30, 1.0)]))
    assert counts["positions"] == 1  # the first run's, and those that came meanwhile, are known
    assert sorted(r["vessel_id"] for r in store.table("vessels").collect()) == ["A", "B", "C", "D"]
    assert sorted(r["vessel_id"] for r in store.table("positions").collect()) == ["A", "B", "C", "D"]
    assert store.table("runs").count() == 3 and store.table("risk_scores").count() == 5


def test_two_writers_at_once(spark, tmp_path):
    stores = [history.HistoryStore(spark, str(tmp_path / "h")) for _ in range(2)]
    runs = [run_of(spark, [f"V{k}", "X"], [(f"V{k}", 0, 1.0), ("X", 0, 1.0)]) for k in range(2)]
    threads = [threading.Thread(target=s.write_run, args=r) for s, r in zip(stores, runs)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["vessel_id"] for r in stores[0].table("vessels").collect()) == ["V0", "V1", "X"]
    assert stores[0].table("positions").count() == 3 and stores[1].table("runs").count() == 2


def test_the_vessels_log_is_merged_in_proportion(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history.HistoryStore, "LOG_RUNS", 2)
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    written = []
    for k in range(5):
        vessels = [f"V{i}" for i in range(20)] if k < 2 else ["V1", "W"]
        written.append(store.write_run(*run_of(spark, vessels, []))["vessels"])
    assert written == [20, 20, 2, 2, 2]  # a run writes its own vessels
    versions = store.manifest.versions()
    assert [bool(v["compacted"]) for v in versions] == [False, False, True, False, False, False]  # small runs don't merge all again
    rows = {r["vessel_id"]: r for r in store.table("vessels").collect()}
    assert len(rows) == 21 and rows["V1"]["first_seen"] < rows["V1"]["last_seen"] and rows["V2"]["last_seen"] < rows["W"]["first_seen"]


def test_only_days_that_can_clash_are_read(spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    store.write_run(*run_of(spark, ["A"], [("A", 24 * d, 1.0) for d in range(6)] + [("A", None, 1.0)]))
    places = history.with_day(run_of(spark, ["A"], [("A", 49, 1.0), ("A", 48, 1.0)])[-1].withColumn("source", F.lit("feed")))
    known = store.known_positions(store.manifest.versions(), places)
    assert [r["day"] for r in known.select("day").distinct().collect()] == ["2025-01-03"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2025-01-03" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(known.inputFiles()) > 1  # of all days; those read:
    assert known.select(F.input_file_name()).distinct().count() == 1
    counts = store.write_run(*run_of(spark, ["A"], [("A", 48, 1.0), ("A", 49, 1.0), ("A", None, 1.0), ("A", None, 1.0)]))
    assert counts["positions"] == 1 and store.table("positions").count() == 8


def test_a_run_that_breaks_off_does_not_show(spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path / "h"))
    store.write_run(*run_of(spark, ["A"], [("A", 0, 1.0)]))
    broken = list(run_of(spark, ["B"], [("B", 0, 1.0)]))
    broken[4] = broken[4].withColumn("level", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(history.HistoryError):
        store.write_run(*broken)
    assert store.table("vessels").count() == store.table("features").count() == store.table("runs").count() == 1
