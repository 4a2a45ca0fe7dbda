"""Tracks cut into segments, and cooldown composed over chunks, give the rows of whole vessels."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fairlead.config import DEFAULT
from fairlead.operators import alert_rules, behaviour, segments, sequences, tracks
from fairlead.plans import pipeline
from fairlead.sources import dimensions

START = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """Vessel A has a third of all rows, some without a place, and rows of equal times; the last one is short."""
    rng = random.Random(4)
    sizes = {"A": 180, "B": 60, "C": 150, "D": 90, "E": 59, "F": 1}
    rows = []
    for v, n in sizes.items():
        minute = 0
        for k in range(n):
            minute += rng.choice([0, 1, 1, 2, 45])
            place = (None, 1.0) if rng.random() < 0.05 else (rng.uniform(12, 13), rng.uniform(80, 81))
            rows.append((v, k, START + dt.timedelta(minutes=minute), *place, rng.choice([None, 0.5, rng.uniform(0, 20)]), rng.choice([None, rng.uniform(0, 360)])))
    return spark.createDataFrame(rows, "vessel_id string, seq long, timestamp timestamp, latitude double, longitude double, speed double, heading double").repartition(3)


def rounded(df):
    return sorted((tuple(round(v, 7) if isinstance(v, float) else str(v) for v in r) for r in df.collect()), key=repr)


def test_no_segment_holds_a_hot_vessel(spark, hot):
    cut = segments.segmented(hot, 10, 50).cache()
    sizes = cut.filter("NOT halo").groupBy("vessel_id", "segment").count().collect()
    assert sum(r["count"] for r in sizes) == hot.count() and len([r for r in sizes if r["vessel_id"] == "A"]) > 1
    assert max(r["count"] for r in sizes) < 180 / 2
    assert cut.filter("halo").groupBy("vessel_id", "segment").count().agg(F.max("count")).first()[0] == 10
    assert {r["segment"] for r in sizes if r["vessel_id"] == "F"} == {0}


@pytest.mark.parametrize("most", [7, 50])
def test_steps_and_turns_of_segments(spark, hot, most):
    placed = hot.filter("latitude IS NOT NULL")
    whole = tracks.turned(hot)
    assert rounded(tracks.own(tracks.turned(segments.segmented(placed, 2, most))).select(whole.columns)) == rounded(whole)
    assert rounded(behaviour.metrics(segments.segmented(placed, 1, most))) == rounded(behaviour.metrics(hot))


@pytest.mark.parametrize("most", [7, 50])
def test_running_state_of_segments(spark, hot, most):
    assert rounded(tracks.running_state(hot, most)) == rounded(tracks.running_state(hot, 10**6))


def test_windows_of_segments(spark, hot):
    placed = hot.filter("latitude IS NOT NULL")
    for most in (7, 50):
        cut = segments.segmented(placed, DEFAULT.sequence_length, most)
        assert rounded(sequences.windows(cut)) == rounded(sequences.windows(placed))
        model, _ = sequences.fit(placed)
        assert rounded(sequences.errors(cut, model)) == rounded(sequences.errors(placed, model))


def test_the_fleet_of_segments(spark, hot):
    zones = dimensions.zones(spark)
    placed = hot.filter("latitude IS NOT NULL")
    assert rounded(pipeline.matrix_of(pipeline.fleet(segments.segmented(placed, 2, 50), zones))) == rounded(pipeline.matrix_of(pipeline.fleet(placed, zones)))


def test_positions_without_a_place_are_stepped_over(spark):
    rows = [("A", k, START + dt.timedelta(minutes=k), lat, 80.0, 5.0, 0.0) for k, lat in enumerate([12.0, None, 12.1, None, None, 12.2])]
    df = spark.createDataFrame(rows, "vessel_id string, seq long, timestamp timestamp, latitude double, longitude double, speed double, heading double")
    found = {r["seq"]: (r["dlat"] and round(r["dlat"], 6), r["gap_minutes"]) for r in tracks.steps(df).collect()}
    assert found == {0: (None, None), 2: (0.1, 2.0), 5: (0.1, 3.0)}
    assert behaviour.metrics(df).first()["position_count"] == 3


def test_the_last_rows_of_a_vessel_are_limited_before_the_shuffle(spark, hot):
    plan = tracks.recent(hot, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def greedy(ticks, wait):
    out, last = [], None
    for t in sorted(set(ticks)):
        if last is None or t - last >= wait:
            out.append(t)
            last = t
    return out


def test_a_chunk_is_a_function_of_what_fired_before():
    rng = random.Random(7)
    for _ in range(300):
        ticks = sorted({rng.randint(0, 60) for _ in range(rng.randint(1, 40))})
        wait = rng.randint(1, 15)
        starts, ends = alert_rules.exits(ticks, wait)
        for before in [None, *range(ticks[0] - 20, ticks[0])]:
            fired = alert_rules.firing(ticks, before, wait)
            first = next((i for i, t in enumerate(starts) if before is None or t - before >= wait), None)
            assert (ends[first] if first is not None else before) == (ticks[fired[-1]] if fired else before)


@pytest.mark.parametrize("chunk", [3, 16, 4096])
def test_cooldown_of_a_hot_vessel_is_composed_over_chunks(spark, chunk):
    rng = random.Random(8)
    ticks = {"A": [rng.randint(-50, 900) for _ in range(700)], "B": [5], "C": list(range(0, 300, 7)), "D": list(range(100))}
    rows = [(v, "AIS_GAP", "LOW", "m", "r", t, 1) for v, own in ticks.items() for t in own] + [("A", "COMBINED", "HIGH", "m", "r", 3, 1)]
    df = spark.createDataFrame(rows, "vessel_id string, alert_type string, level string, message string, reason string, tick int, overall_score int")
    found = {}
    for r in alert_rules.with_cooldown(df, chunk=chunk).filter("alert_type = 'AIS_GAP'").collect():
        found.setdefault(r["vessel_id"], []).append(r["tick"])
    assert {v: sorted(t) for v, t in found.items()} == {v: greedy(own, DEFAULT.cooldown_ticks) for v, own in ticks.items()}
