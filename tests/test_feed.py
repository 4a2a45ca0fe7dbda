"""The live source: restart from its checkpoint, and the box that is asked of the provider."""

import json

from pyspark.sql import functions as F

from fairlead.plans import fixtures
from fairlead.streaming import feed, jobs, messages


def place(i, lat, lon):
    return json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": i, "latitude": lat, "longitude": lon, "time_utc": "2025-01-01 00:00:00 +0000 UTC"}, "Message": {"PositionReport": {"Latitude": lat, "Longitude": lon}}})


def test_ranges_of_a_log_cover_each_line_once(tmp_path):
    path = tmp_path / "log"
    lines = ["a", "bb", "", "é" * 40, "last"]
    path.write_text("\n".join(lines) + "\n" + "not yet", encoding="utf-8")
    log = feed.LineLog({"path": str(path)})
    for parts in (1, 2, 3, 7, 1000):
        assert [x for a, b in log.cut(0, log.latest(), parts) for x in log.read(a, b, None)] == [x for x in lines if x]
    assert feed.LineLog({"path": str(tmp_path / "none")}).latest() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, small):
    lines = [r["value"] for r in fixtures.messages(spark, small).collect()]
    log, out = tmp_path / "log", str(tmp_path / "out")

    def run():
        stream = messages.positions(messages.parsed(feed.feed_stream(spark, path=str(log), parts="3")))
        jobs.run_available(stream, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "c"))

    done = 0
    for upto in (300, 301, 301, len(lines)):
        with log.open("a", encoding="utf-8") as f:
            f.writelines(x + "\n" for x in lines[done:upto])
        done = upto
        run()
    want = messages.positions(messages.parsed(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, want.collect()))


def test_the_box_is_asked_of_the_provider(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("\n".join([place(1, 10.0, 80.0), place(2, 50.0, 80.0), place(3, 10.0, -80.0), "{broken", place(4, 12.0, 82.0)]) + "\n")
    seen = []
    stream = feed.feed_stream(spark, box=(5.0, 75.0, 15.0, 85.0), path=str(log))
    jobs.run_available(stream, lambda df, n: seen.extend(r[0] for r in df.collect()), str(tmp_path / "c"))
    assert sorted(json.loads(x)["MetaData"]["MMSI"] for x in seen if x != "{broken") == [1, 4] and "{broken" in seen
    assert spark.createDataFrame([(x,) for x in seen], "value string").filter(F.col("value") == "{broken").count() == 1
