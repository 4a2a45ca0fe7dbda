"""Streaming jobs: message sources, replay by ticks, event-time counts, live risk."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from fairlead.config import DEFAULT, Config
from fairlead.operators.tracks import ticks
from fairlead.plans import pipeline
from fairlead.sources.dimensions import in_region
from fairlead.sources.tables import discard, shared_folder, written
from fairlead.streaming import messages, state

#: A fixed value: the bytes of a row group of written messages.
BLOCK = 4 * 2**20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Messages as they land in a folder of text files, one JSON object a line."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages of a Kafka topic (needs Spark's Kafka package)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def live_positions(stream: DataFrame, region: str | None = None) -> DataFrame:
    """Positions of a message stream, inside a region's box if one is named."""
    rows = messages.positions(messages.parsed(stream))
    return in_region(rows, region) if region else rows


def write_replay(df: DataFrame, path: str, n_ticks: int = 60) -> None:
    """Positions with their tick, as one folder for each tick, for a replay in order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a tick's rows go to several tasks in order of time, not all to one
    ranged = ticks(df, n_ticks).repartitionByRange(parts, "tick", "timestamp", "vessel_id", "seq").sortWithinPartitions("tick", "timestamp", "vessel_id", "seq")
    ranged.withColumn("folder", F.col("tick")).write.partitionBy("folder").mode("overwrite").parquet(path)


def replay(spark: SparkSession, path: str, schema, build: Callable[[DataFrame], DataFrame], each: Callable[[DataFrame, int], None], mode: str = "append", most: int | None = None) -> int:
    """Runs the stream ``build(positions)`` over what ``write_replay`` has left at ``path``, tick by tick in their order;
    ``each`` gets what a micro-batch writes. Returns how many ticks are still to come.

    A tick's folder is moved to where the stream looks when all before it have been handled, so every tick is a micro-batch
    of its own, however many files it has. A replay that stops, or is told to after ``most`` ticks, goes on from
    its checkpoint: a tick that was moved but not handled comes first."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    seen = f"{path}-seen"
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place(f"{seen}/in"))
    stream = build(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{seen}/in"))
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{seen}/checkpoint").start()
    try:
        query.processAllAvailable()
        names = [f.getPath().getName() for f in files.listStatus(place(path)) if f.isDirectory()]
        waiting = sorted((n for n in names if n.startswith("folder=")), key=lambda n: int(n[7:]))
        for name in waiting[:most]:
            files.rename(place(f"{path}/{name}"), place(f"{seen}/in/{name}"))
            query.processAllAvailable()
    finally:
        query.stop()
    return len(waiting[most:]) if most is not None else 0


def replay_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_by_window(df: DataFrame, width: str = "10 minutes", slide: str | None = None, keys: tuple[str, ...] = (), delay: str | None = None) -> DataFrame:
    """window_start, ``keys``, messages and vessels (exact) by tumbling or sliding event-time window.

    State has two levels: a count for each window and vessel (and keys), and from these the window's sums.
    With a ``delay`` the frame gets a watermark: windows are handed out once (append mode) when the newest time is
    ``delay`` past their end, rows that come later are dropped, and state holds open windows only. Without
    one it is a batch frame."""
    timed = df.withWatermark("timestamp", delay) if delay else df
    w = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    own = [k for k in keys if k != "vessel_id"]
    each = timed.groupBy(w.alias("w"), "vessel_id", *own).agg(F.count("*").alias("n"))
    out = each.groupBy("w", *keys).agg(F.sum("n").alias("messages"), F.count("*").alias("vessels"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "messages", "vessels")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of reports of a vessel without a silence of ``gap`` or more between them."""
    s = F.session_window("timestamp", gap)
    return df.groupBy("vessel_id", s.alias("s")).agg(F.count("*").alias("positions")).select("vessel_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "positions")


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, a batch at a time, and returns."""
    df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def in_batches(rows: DataFrame, batch: str, n: int, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What the stream ``build(rows)`` writes when rows come in ``n`` micro-batches, by their column ``batch``, each with
    the number of the micro-batch (``written_in``). The stream stops after each and goes on from its checkpoint."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    schema = rows.drop(batch).schema
    for k in range(n):
        rows.filter(F.col(batch) == k).drop(batch).write.mode("append").parquet(f"{folder}/in")
        out = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        run_available(out, lambda df, i: df.withColumn("written_in", F.lit(i)).write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint", mode)
    return spark.read.parquet(f"{folder}/out")


def evictions(out: DataFrame) -> DataFrame:
    """From the rows that a stream of ``vessel_state`` has written (with ``written_in``): for each micro-batch with
    evictions how many vessels went, and how many have gone so far."""
    each = out.filter("evicted AND messages > 0").groupBy("written_in").agg(F.count("*").alias("evicted"))
    so_far = Window.orderBy("written_in").rowsBetween(Window.unboundedPreceding, 0)  # a row for each micro-batch
    return each.withColumn("evicted_so_far", F.sum("evicted").over(so_far))


def live_messages(stream: DataFrame, region: str | None = None) -> DataFrame:
    """Positions and static data of a message stream as rows of one kind, for one keyed state: static
    rows have no place and the time of their message. seq, the stream's own column of that name (a long) or
    else a hash of the message, decides between messages of one time, so that the result does not depend on
    how they arrive."""
    rows = messages.parsed(stream if "seq" in stream.columns else stream.withColumn("seq", F.xxhash64("value")))
    places = messages.positions(rows)
    places = in_region(places, region) if region else places
    time = F.coalesce(messages.message_time(F.col("m.MetaData.time_utc")), F.current_timestamp())
    static = messages.static_data(rows.withColumn("timestamp", time))
    return places.unionByName(static, allowMissingColumns=True)


def final_state(spark: SparkSession, lines: DataFrame, files: int = 4, delay: str = "3650 days", stale_seconds: int = 10**9) -> DataFrame:
    """The state of every vessel after a whole message stream (``lines``: value, JSON, and seq, the order of
    messages of one time, where there is one) has passed in micro-batches: the last row that the stream wrote
    of each. The stream reads and writes the shared folder. Lines may come in any order within ``delay``; vessels are dropped after
    ``stale_seconds`` only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    lines = lines.select("value", *(c for c in lines.columns if c == "seq"))
    # one file is a micro-batch, which many tasks read: the file is cut where its row groups end
    lines.repartition(files).write.option("parquet.block.size", BLOCK).parquet(f"{folder}/in")
    changed = state.vessel_state(live_messages(replay_stream(spark, f"{folder}/in", lines.schema)), delay, stale_seconds=stale_seconds, tracks=False)
    run_available(changed, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint", "update")
    rows = spark.read.parquet(f"{folder}/out")
    names = [c for c in rows.columns if c not in ("vessel_id", "batch", "track")]
    last = rows.groupBy("vessel_id").agg(F.max_by(F.struct(*names), F.struct("batch", "timestamp", "evicted")).alias("p"))
    return last.filter("NOT p.evicted").select("vessel_id", *(F.col(f"p.{n}").alias(n) for n in names))


def cooled(spark: SparkSession, alerts: DataFrame) -> DataFrame:
    """The alerts that fire, from a stream of ``alerts`` in order of ticks."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    alerts.withColumn("tick", F.col("tick").cast("long")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    run_available(state.cooled_alerts(stream), lambda df, n: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


class LiveCounters(StreamingQueryListener):
    """Counts of running streams, taken from ``observe``-d metrics: messages, positions, failures."""

    NAME = "live"

    def __init__(self) -> None:
        self.counts: dict[str, int] = {"messages": 0, "static_messages": 0, "failures": 0}
        self.late = 0  # rows that came too late for a stateful operator; of partial counts each counts as one

    @classmethod
    def observed(cls, parsed: DataFrame) -> DataFrame:
        """``parsed`` messages, watched."""
        kind = F.coalesce(F.col("m.MessageType"), F.lit(""))
        static = kind == "ShipStaticData"
        return parsed.observe(cls.NAME, F.count(F.lit(1)).alias("messages"), F.count_if(static).alias("static_messages"), F.count_if(~static & (kind != "PositionReport")).alias("failures"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.late += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        row = event.progress.observedMetrics.get(self.NAME)
        for n in self.counts if row is not None else ():
            self.counts[n] += row[n]

    def onQueryTerminated(self, event) -> None:
        pass


def rescorer(zones: DataFrame, forest: tuple | None = None, sequence_model=None, reported_gaps: DataFrame | None = None, cfg: Config = DEFAULT) -> Callable[[DataFrame], DataFrame]:
    """A rescore for ``live_rescore`` with models loaded once: the batch pipeline over vessels' recent positions.

    A vessel's score must not depend on which others are scored with it, so the forest is (nodes, columns, bounds)
    as ``iforest.stored`` gives it, with the bounds of the fleet that it was fitted to; without bounds it is refused.
    The sequence model has its reference with it."""
    if forest is not None and (len(forest) < 3 or forest[2] is None):
        raise ValueError("a live forest needs stored bounds")

    def rescore(positions: DataFrame) -> DataFrame:
        return pipeline.run(positions, zones, reported_gaps, models=forest is not None or sequence_model is not None, forest=forest, sequence_model=sequence_model, cfg=cfg).risk

    return rescore


def points_of(states: DataFrame) -> DataFrame:
    """The positions in the tracks of ``vessel_state`` rows."""
    p = states.select("vessel_id", F.explode("track").alias("p"))
    return p.select("vessel_id", "p.seq", F.timestamp_micros("p.us").alias("timestamp"), "p.latitude", "p.longitude", "p.speed", "p.heading")


def live_rescore(states: DataFrame, rescore: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Rescores the vessels that each micro-batch of ``states`` (see ``vessel_state``) has changed, from the tracks in
    their state, and appends their risk to ``out``; evicted vessels are appended without one. With stored bounds
    the others' scores stay what they are, so the table always has the score of the whole active fleet."""

    def each(changed: DataFrame, n: int) -> None:
        changed = written(changed, "live-changed")
        last = changed.groupBy("vessel_id").agg(F.max_by(F.struct("track", "evicted"), F.struct("timestamp", "evicted")).alias("s")).select("vessel_id", "s.*")
        scored = rescore(points_of(last.filter("NOT evicted"))).select("vessel_id", "overall_score", "risk_level", F.lit(False).alias("evicted"))
        gone = last.filter("evicted").select("vessel_id", F.lit(None).cast("int").alias("overall_score"), F.lit(None).cast("string").alias("risk_level"), "evicted")
        scored.unionByName(gone).withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
        discard(changed)

    run_available(states, each, checkpoint, "update")


def active_risk(spark: SparkSession, out: str) -> DataFrame:
    """The risk of all active vessels from what ``live_rescore`` has appended: each vessel's last row, unless it is gone."""
    last = spark.read.parquet(out).groupBy("vessel_id").agg(F.max_by(F.struct("overall_score", "risk_level", "evicted"), "batch").alias("r"))
    return last.filter("NOT r.evicted").select("vessel_id", "r.overall_score", "r.risk_level")
