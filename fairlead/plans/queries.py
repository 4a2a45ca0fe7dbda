"""One query for each family of operators, over tracks derived from ``events``."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.config import BASE_FEATURES, DEFAULT, FEATURES
from fairlead.functions import codes
from fairlead.operators import alert_rules, behaviour, cleaning, features, geofence, iforest, reports, risk, segments, sequences, tracks
from fairlead.plans import fixtures, pipeline
from fairlead.sources import dimensions, history, positions
from fairlead.sources.tables import shared_folder, written
from fairlead.streaming import jobs, messages, state


def us(name: str = "timestamp"):
    return F.unix_micros(name).alias("us")


def parts(spark: SparkSession, sf_dir: str):
    t = fixtures.tracks(spark, sf_dir)
    return t, tracks.latest(t), dimensions.zones(spark)


# -- sources and cleaning -------------------------------------------------------------------------


def clean_positions(spark, sf_dir):
    rows = cleaning.clean(cleaning.judged(fixtures.raw_positions(spark, sf_dir)))
    return rows.select("vessel_id", "seq", us(), F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.round("speed", 4).alias("speed"), "heading")


def quality_report(spark, sf_dir):
    return cleaning.quality_report(cleaning.judged(fixtures.raw_positions(spark, sf_dir)))


def aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw positions under other names, normalised and coerced."""
    raw = fixtures.raw_positions(spark, sf_dir)
    named = raw.select(F.col("vessel_id").alias(" MMSI "), F.col("timestamp").alias("BaseDateTime"), F.col("latitude").alias("LAT"), F.col("longitude").alias("Long"), F.col("speed").alias("SOG"), F.col("heading").alias("COG"), F.col("heading").alias("Heading"))
    return positions.coerced(positions.normalise(named))


def ingest_report(spark, sf_dir):
    return positions.ingest_report(aliased(spark, sf_dir))


def alias_normalise(spark, sf_dir):
    rows = aliased(spark, sf_dir).filter("NOT rejected")
    return rows.groupBy("vessel_id").agg(F.count("*").alias("n"), F.max(F.unix_micros("timestamp")).alias("last_us"), F.round(F.sum("Heading_src"), 2).alias("headings"))


def region_filter(spark, sf_dir):
    t = fixtures.tracks(spark, sf_dir)
    rows = dimensions.in_region(t, "Tamil Nadu / Coromandel Coast")
    return rows.groupBy("vessel_id").agg(F.count("*").alias("n"))


# -- tracks ---------------------------------------------------------------------------------------


def latest_position(spark, sf_dir):
    rows = tracks.latest(fixtures.tracks(spark, sf_dir))
    return rows.select("vessel_id", "latitude", "longitude", "speed", "heading", us())


def recent_window_20(spark, sf_dir):
    return tracks.recent(fixtures.tracks(spark, sf_dir), DEFAULT.recent_replay).select("vessel_id", "seq", "recency")


def first_seen_prev_value(spark, sf_dir):
    rows = tracks.running_state(fixtures.tracks(spark, sf_dir))
    return rows.select("vessel_id", "seq", F.round("prev_latitude", 5).alias("prev_latitude"), F.round("prev_speed", 3).alias("prev_speed"), F.unix_micros("first_timestamp").alias("first_us"), F.round("first_longitude", 5).alias("first_longitude"), "messages")


def step_metrics(spark, sf_dir):
    rows = tracks.own(tracks.steps(segments.segmented(fixtures.tracks(spark, sf_dir), 1)))
    return rows.select("vessel_id", "seq", F.round("km", 3).alias("km"), F.round("step_deg", 5).alias("step_deg"), F.round("heading_change", 2).alias("heading_change"), F.round("gap_minutes", 3).alias("gap_minutes"))


def trajectory_export(spark, sf_dir):
    rows = tracks.trajectories(fixtures.tracks(spark, sf_dir))
    ends = rows.select("vessel_id", F.size("points").alias("n"), F.get("points", F.lit(0)).alias("a"), F.element_at("points", -1).alias("b"))
    key = lambda p: F.struct(f"{p}.timestamp", f"{p}.seq")
    return ends.groupBy("vessel_id").agg(F.sum("n").cast("int").alias("n_points"), F.min_by("a.seq", key("a")).alias("first_seq"), F.max_by("b.seq", key("b")).alias("last_seq"))


def tick_buckets(spark, sf_dir):
    return tracks.ticks(fixtures.tracks(spark, sf_dir)).groupBy("tick").agg(F.count("*").alias("n"), F.max(F.unix_micros("timestamp")).alias("sim_us"), F.sum("seq").alias("seqs"))


def state_as_of_tick(spark, sf_dir):
    rows = tracks.state_at(tracks.ticks(fixtures.tracks(spark, sf_dir)), 29)
    return rows.select("vessel_id", "seq", "tick")


def tick_progress(spark, sf_dir):
    rows = tracks.progress(tracks.ticks(fixtures.tracks(spark, sf_dir)))
    return rows.select("tick", us("sim_time"), "rows_so_far", F.round("done", 4).alias("done"))


# -- geofence -------------------------------------------------------------------------------------


def geofence_latest(spark, sf_dir):
    _, latest, zones = parts(spark, sf_dir)
    rows = geofence.check_zones(latest, zones)
    return rows.select("vessel_id", "inside", "zone_name", "near", "nearest_zone", F.round("min_dist_deg", 4).alias("min_dist_deg"), "zone_status")


def geofence_all_positions(spark, sf_dir):
    t, _, zones = parts(spark, sf_dir)
    return geofence.check_zones(t, zones).groupBy("vessel_id", "zone_status").agg(F.count("*").alias("n"))


def geofence_grid(spark, sf_dir):
    """All positions against the zones by grid, with the distance to the nearest however far."""
    t, _, zones = parts(spark, sf_dir)
    rows = geofence.check_zones_by_grid(t, zones)
    return rows.select("vessel_id", "seq", "inside", "zone_name", "near", "nearest_zone", "min_dist_deg", "zone_status")


# -- behaviour and features -----------------------------------------------------------------------


def behaviour_metrics(spark, sf_dir):
    return metric_rows(fixtures.tracks(spark, sf_dir))


def behaviour_by_place(spark, sf_dir):
    """Metrics of tracks that have nothing but places, in the order of seq: what needs speeds, headings or times stays 0."""
    none = F.lit(None)
    return metric_rows(fixtures.tracks(spark, sf_dir).withColumns({"timestamp": none.cast("timestamp"), "speed": none.cast("double"), "heading": none.cast("double")}))


def metric_rows(positions: DataFrame) -> DataFrame:
    rows = behaviour.metrics(segments.segmented(positions, 1))
    names = ["distance_travelled_km", "avg_speed", "max_speed", "speed_std", "mean_heading_change", "max_heading_change", "heading_change_std", "stationary_ratio", "loitering_score", "max_ais_gap_minutes", "mean_ais_gap_minutes", "trajectory_duration_minutes", "speed_change_rate", "turning_rate"]
    return rows.select("vessel_id", *(F.round(n, 2).alias(n) for n in names), "significant_gap_count", "position_count")


def behaviour_labels(spark, sf_dir):
    rows = behaviour.analyse(fixtures.tracks(spark, sf_dir))
    return rows.select("vessel_id", F.array_join("behavior_labels", "|").alias("labels"), "behavior_summary")


def base_features(spark, sf_dir):
    t, latest, zones = parts(spark, sf_dir)
    rows = features.base_features(latest, t, geofence.check_zones(latest, zones))
    return rows.select("vessel_id", *BASE_FEATURES)


def feature_matrix(spark, sf_dir):
    t, _, zones = parts(spark, sf_dir)
    return pipeline.matrix_of(pipeline.fleet(segments.segmented(t, pipeline.TURN_HALO), zones))


def feature_json(spark, sf_dir):
    return features.feature_json(feature_matrix(spark, sf_dir))


def feature_json_values(spark, sf_dir):
    """The stored JSON, read back: a row for each feature."""
    rows = feature_json(spark, sf_dir).select("vessel_id", F.explode(F.from_json("feature_json", "map<string, double>")).alias("feature", "value"))
    return rows.select("vessel_id", "feature", F.round("value", 5).alias("value"))


# -- models ---------------------------------------------------------------------------------------


#: The reference's cap on the windows of a vessel, to save time: only where its rows are compared.
PARITY = replace(DEFAULT, windows_per_vessel=50)


def sequence_windows(spark, sf_dir, cfg=PARITY):
    rows = sequences.windows(segments.segmented(fixtures.tracks(spark, sf_dir), cfg.sequence_length), cfg)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("vessel_id").agg(F.count("*").alias("n_windows"), F.max("start").alias("last_start"), F.round(F.sum(total), 1).alias("total"))


def sequence_training(spark, sf_dir):
    """The training matrix under the reference's caps, which are the feature here: how many windows of each vessel are in it."""
    cfg = replace(PARITY, training_windows=5000)
    rows = sequences.training_windows(segments.segmented(fixtures.tracks(spark, sf_dir), cfg.sequence_length), cfg)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("vessel_id").agg(F.count("*").alias("n_windows"), F.round(F.sum(total), 1).alias("total"))


def sequence_windows_all(spark, sf_dir):
    return sequence_windows(spark, sf_dir, DEFAULT)


def temporal_scores(spark, sf_dir):
    t, latest, _ = parts(spark, sf_dir)
    return sequences.detect(latest, segments.segmented(t, DEFAULT.sequence_length))[0]


#: A model of two components, to hold windows, errors and scoring against SQL.
FIXED_MEAN, FIXED_SCALE, FIXED_REFERENCE = [5.0, 0.0, 0.0, 0.0, 1.0, 10.0], [5.0, 60.0, 0.1, 0.1, 5.0, 20.0], 2.0
FIXED_SEQUENCES = sequences.Model(FIXED_MEAN * 10, FIXED_SCALE * 10, [[60**-0.5, (-1) ** i * 60**-0.5] for i in range(60)], FIXED_REFERENCE)


def temporal_fixed_score(spark, sf_dir):
    t, latest, _ = parts(spark, sf_dir)
    rows, _ = sequences.detect(latest, segments.segmented(t, DEFAULT.sequence_length), model=FIXED_SEQUENCES)
    return rows.select("vessel_id", F.round("temporal_anomaly_score", 3).alias("temporal_anomaly_score"), "temporal_model_status")


def iforest_scores(spark, sf_dir):
    return iforest.detect(written(feature_matrix(spark, sf_dir), "matrix"), FEATURES)[0]


def anomaly_ranking(spark, sf_dir):
    """The fixed forest's scores as text, by rank."""
    rows = iforest_fixed_score(spark, sf_dir)
    return reports.anomaly_ranking(rows)


#: A forest of two small trees, to hold scoring against SQL.
FIXED_FOREST = [
    (0, 0, 0, 5.0, 1, 2, 64, 0), (0, 1, -1, 0.0, -1, -1, 32, 1), (0, 2, 1, 0.5, 3, 4, 32, 1), (0, 3, -1, 0.0, -1, -1, 31, 2), (0, 4, -1, 0.0, -1, -1, 1, 2),
    (1, 0, 1, 0.25, 1, 2, 64, 0), (1, 1, -1, 0.0, -1, -1, 2, 1), (1, 2, -1, 0.0, -1, -1, 62, 1),
]


def iforest_fixed_score(spark, sf_dir):
    t, latest, zones = parts(spark, sf_dir)
    base = features.base_features(latest, t, geofence.check_zones(latest, zones))
    nodes = spark.createDataFrame(FIXED_FOREST, iforest.NODES)
    rows = iforest.score(base, nodes, ["speed", "displacement_ratio"], cfg=replace(DEFAULT, tree_rows=64))
    return rows.select("vessel_id", F.round("anomaly_score", 3).alias("anomaly_score"), "is_anomalous")


def minmax_normalise(spark, sf_dir):
    rows = iforest.minmax(behaviour.metrics(fixtures.tracks(spark, sf_dir)), "avg_speed")
    return rows.select("vessel_id", F.round("scaled", 4).alias("scaled"))


# -- risk -----------------------------------------------------------------------------------------


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported gaps of every fifth vessel."""
    t = fixtures.tracks(spark, sf_dir).select("vessel_id").distinct()
    n = F.substring("vessel_id", 2, 10).cast("int")
    return t.filter(n % 5 == 0).select("vessel_id", (n % 70).cast("double").alias("gap_minutes"))


def risk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk with model scores that follow from the vessel's number, so that SQL can tell them."""
    t, _, zones = parts(spark, sf_dir)
    rows = written(pipeline.fleet(segments.segmented(t, pipeline.TURN_HALO), zones), "fleet")
    n = F.substring("vessel_id", 2, 10).cast("int")
    anomaly = rows.select("vessel_id", ((n * 7) % 100 / 100.0).alias("anomaly_score")).withColumn("is_anomalous", F.col("anomaly_score") >= 0.55)
    temporal = rows.select("vessel_id", ((n * 3) % 100 / 100.0).alias("temporal_anomaly_score"), F.when(n % 4 == 0, "insufficient_data").otherwise("scored").alias("temporal_model_status"))
    return risk.score(pipeline.inputs_of(rows, anomaly, temporal, gaps(spark, sf_dir)))


def risk_components(spark, sf_dir):
    names = ["geofence_component", "isolation_component", "temporal_component", "behaviour_component", "ais_gap_component"]
    return risk_rows(spark, sf_dir).select("vessel_id", *(F.round(n, 3).alias(n) for n in names), "ais_gap_minutes")


def risk_scores(spark, sf_dir):
    return risk_rows(spark, sf_dir).select("vessel_id", "overall_score", "risk_level", "behavior", "zone_status", "explanation")


def risk_factor_breakdown(spark, sf_dir):
    rows = risk_rows(spark, sf_dir).select("vessel_id", F.posexplode("factors").alias("place", "f"))
    return rows.select("vessel_id", "f.factor", "f.contribution", "f.max_weight")


def risk_reasons(spark, sf_dir):
    return risk_rows(spark, sf_dir).select("vessel_id", F.array_join("risk_factors", "|").alias("reasons"))


def risk_alerts(spark, sf_dir):
    return risk.alerts(risk_rows(spark, sf_dir)).select("level", "vessel_id", "message", "reason", "overall_score")


def fleet_stats(spark, sf_dir):
    rows = risk_rows(spark, sf_dir)
    return reports.fleet_stats(rows, risk.alerts(rows))


def fleet_ranked(spark, sf_dir):
    return reports.ranked(risk_rows(spark, sf_dir))


def medium_risk_top_factors(spark, sf_dir):
    return reports.high_risk(risk_rows(spark, sf_dir), "MEDIUM")


def score_histogram(spark, sf_dir):
    return reports.score_histogram(risk_rows(spark, sf_dir))


def high_risk_top_factors(spark, sf_dir):
    return reports.high_risk(risk_rows(spark, sf_dir))


def alert_panel(spark, sf_dir):
    """The ten alerts on top, HIGH first."""
    return risk.alerts(risk_rows(spark, sf_dir)).orderBy(*risk.alert_order()).limit(10).select("level", "vessel_id", "reason", "overall_score")


def fleet_enriched(spark, sf_dir):
    t, latest, _ = parts(spark, sf_dir)
    rows = reports.enriched(latest, risk_rows(spark, sf_dir))
    return rows.select("vessel_id", "latitude", "longitude", "overall_score", "risk_level", "behavior", "zone_status")


def live_table(spark, sf_dir):
    """The live table of the fleet: static data and risk with their defaults."""
    _, latest, _ = parts(spark, sf_dir)
    static = messages.merged_static(messages.static_data(parsed(spark, sf_dir))).withColumn("vessel_id", F.concat(F.lit("V"), F.lpad("vessel_id", 4, "0")))
    rows = reports.live_table(latest.drop("behavior"), static, risk_rows(spark, sf_dir).filter("overall_score >= 20"))
    return rows.select("vessel_id", "ship_name", "ship_type", "destination", "overall_score", "risk_level")


def vessel_report(spark, sf_dir):
    """Everything about the vessel with the highest score."""
    t, _, zones = parts(spark, sf_dir)
    rows = written(risk_rows(spark, sf_dir), "risk")
    top = rows.orderBy(F.desc("overall_score"), "vessel_id").first()["vessel_id"]
    own = written(t.filter(F.col("vessel_id") == top), "own-track")  # one vessel's rows: all else is made of them
    of_own = written(pipeline.fleet(segments.segmented(own, pipeline.TURN_HALO), zones), "own-row")
    temporal, _ = sequences.detect(of_own, segments.segmented(own, DEFAULT.sequence_length), model=FIXED_SEQUENCES)
    found = reports.vessel_report(top, rows, pipeline.matrix_of(of_own), of_own.select("vessel_id", "behave.*"), temporal)
    return found.select("vessel_id", "overall_score", "risk_level", F.col("features.path_length_deg").alias("path_length_deg"), F.round("max_ais_gap_minutes", 1).alias("max_ais_gap_minutes"), F.round("temporal_anomaly_score", 3).alias("temporal_anomaly_score"))


def vessel_track(spark, sf_dir):
    """The track of the vessel that reported last."""
    t, latest, _ = parts(spark, sf_dir)
    last = latest.orderBy(F.desc("timestamp"), "vessel_id").first()["vessel_id"]
    return tracks.track(t, last).select("vessel_id", "seq", us(), F.round("latitude", 5).alias("latitude"))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.select("vessel_id", "overall_score", "risk_level", "behavior", "zone_status", F.array_join("risk_factors", "; ").alias("reasons")).orderBy(F.desc("overall_score"), "vessel_id")


def ranked_risk_fixed(spark, sf_dir):
    """The pipeline end to end with fixed models."""
    t, _, zones = parts(spark, sf_dir)
    forest = (spark.createDataFrame(FIXED_FOREST, iforest.NODES), ["speed", "displacement_ratio"])
    return ranked(pipeline.run(t, zones, gaps(spark, sf_dir), forest=forest, sequence_model=FIXED_SEQUENCES, cfg=replace(DEFAULT, tree_rows=64)).risk)


def ranked_risk(spark, sf_dir):
    t, _, zones = parts(spark, sf_dir)
    return ranked(pipeline.run(t, zones, gaps(spark, sf_dir)).risk)


# -- alerts over ticks ----------------------------------------------------------------------------


def ticked_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk rows with a tick, their components from the event's number."""
    rows = fixtures.tracks(spark, sf_dir).select("vessel_id", "seq", F.floor(F.unix_micros("timestamp") / 600e6).cast("long").alias("tick"))
    part = lambda k: ((F.col("seq") * k) % 100 / 100.0)
    rows = rows.withColumns({"geofence_component": F.when(F.col("seq") % 10 == 0, 1.0).otherwise(0.0), "ais_gap_component": part(3), "behaviour_component": part(7), "temporal_component": part(11), "overall_score": ((F.col("seq") * 13) % 101).cast("int"), "ais_gap_minutes": (F.col("seq") % 60).cast("int"), "zone_status": F.lit("Open Waters")})
    return rows.withColumn("risk_level", F.when(F.col("overall_score") >= 55, "HIGH").when(F.col("overall_score") >= 20, "MEDIUM").otherwise("LOW"))


def stream_alert_rules(spark, sf_dir):
    return alert_rules.evaluate(ticked_risk(spark, sf_dir)).groupBy("vessel_id", "alert_type", "level").agg(F.count("*").alias("n"))


def alert_cooldown(spark, sf_dir):
    rows = alert_rules.with_cooldown(alert_rules.evaluate(ticked_risk(spark, sf_dir)))
    return rows.select("vessel_id", "alert_type", "tick")


# -- history --------------------------------------------------------------------------------------


def vessel_upsert(spark, sf_dir):
    t = fixtures.tracks(spark, sf_dir)
    seen = lambda rows, region: rows.groupBy("vessel_id").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")).withColumns({"source": F.lit("feed"), "region": F.lit(region)})
    rows = history.upsert_vessels(seen(t.filter("seq % 3 <> 0"), "old"), seen(t.filter("seq % 2 = 0"), "new"))
    return rows.select("vessel_id", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "source", "region")


def positions_anti_append(spark, sf_dir):
    t = fixtures.tracks(spark, sf_dir).withColumn("source", F.lit("feed"))
    rows = history.new_positions(t.filter("seq % 3 <> 0"), t.filter("seq % 2 = 0").unionByName(t.filter("seq % 4 = 0")))
    return rows.groupBy("vessel_id").agg(F.count("*").alias("n"))


def two_runs(spark: SparkSession, sf_dir: str) -> history.HistoryStore:
    """A history of two equal runs of the pipeline, in the shared folder."""
    t, latest, _ = parts(spark, sf_dir)
    rows = risk_rows(spark, sf_dir)
    anomaly = latest.select("vessel_id", F.lit(0.5).alias("anomaly_score"), F.lit(False).alias("is_anomalous"))
    store = history.HistoryStore(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    for _ in range(2):
        store.write_run(latest, feature_matrix(spark, sf_dir), anomaly, rows, risk.alerts(rows), "feed", "bay", t)
    return store


def history_summary(spark, sf_dir):
    return two_runs(spark, sf_dir).summary()


def history_recent_risk(spark, sf_dir):
    return two_runs(spark, sf_dir).recent_risk(20).select("vessel_id", "overall_score", "risk_level")


def history_vessel(spark, sf_dir):
    """The history of the first vessel of the fleet: its risk in both runs."""
    store = two_runs(spark, sf_dir)
    first = store.table("vessels").agg(F.min("vessel_id")).first()[0]
    return store.vessel_recent(first, 10)[0].select("vessel_id", "overall_score", "behavior")


def dedupe_exact(spark, sf_dir):
    """Positions that come twice, told from those that come once."""
    rows = fixtures.raw_positions(spark, sf_dir).drop("seq")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("positions"))


def alert_rows(spark, sf_dir):
    return alert_rules.evaluate(ticked_risk(spark, sf_dir)).withColumnRenamed("tick", "created_at")


def recent_alerts_topk(spark, sf_dir):
    rows = alert_rows(spark, sf_dir).withColumn("row_ord", F.concat("vessel_id", "alert_type", F.lpad(F.col("overall_score").cast("string"), 3, "0")))
    return history.recent(rows.dropDuplicates(["created_at", "row_ord"]), 20).select("vessel_id", "alert_type", "created_at", "overall_score")


def vessel_recent_topk(spark, sf_dir):
    rows = fixtures.tracks(spark, sf_dir).select("vessel_id", "seq", F.col("timestamp").alias("created_at"))
    return history.recent_by_vessel(rows, 3, order="seq").select("vessel_id", "seq", "rn")


# -- messages -------------------------------------------------------------------------------------


def parsed(spark, sf_dir):
    return messages.parsed(fixtures.messages(spark, sf_dir))


def parse_position_json(spark, sf_dir):
    rows = messages.positions(parsed(spark, sf_dir))
    return rows.select("seq", "vessel_id", F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"), F.round("speed", 3).alias("speed"), "heading", "nav_status", us())


def parse_static_json(spark, sf_dir):
    return messages.static_data(parsed(spark, sf_dir)).select("seq", "vessel_id", "ship_name", "ship_type", "destination", "eta", "draught")


def ship_type_decode(spark, sf_dir):
    rows = fixtures.tracks(spark, sf_dir).select((F.col("seq") % 105 - 3).alias("code"))
    return rows.groupBy(codes.ship_type(F.col("code").cast("string")).alias("ship_type")).agg(F.count("*").alias("n"))


def static_merge(spark, sf_dir):
    return messages.merged_static(messages.static_data(parsed(spark, sf_dir))).select("vessel_id", "ship_name", "ship_type", "destination", "eta", "draught")


def message_counters(spark, sf_dir):
    """What a live view counts over its messages."""
    return messages.counters(parsed(spark, sf_dir)).select("messages", "positions", "static_messages", "failures", "vessels", us("last_time").alias("last_us"))


def evicted_count(spark, sf_dir):
    t, latest, _ = parts(spark, sf_dir)
    as_of = t.agg(F.max("timestamp")).scalar()
    return messages.evicted(latest, as_of, 3600)


def stale_eviction(spark, sf_dir):
    t, latest, _ = parts(spark, sf_dir)
    as_of = t.agg(F.max("timestamp")).scalar()
    return messages.active(latest, as_of, 3600).select("vessel_id")


def session_gaps(spark, sf_dir):
    rows = jobs.sessions(fixtures.tracks(spark, sf_dir))
    return rows.select("vessel_id", us("session_start").alias("start_us"), "positions")


def streaming_state(spark, sf_dir):
    """The fleet's state after the whole message stream has passed, vessel by vessel."""
    rows = jobs.final_state(spark, fixtures.messages(spark, sf_dir))
    names = ["latitude", "longitude", "speed", "prev_latitude", "prev_speed"]
    return rows.select("vessel_id", us(), *(F.round(n, 5).alias(n) for n in names), "nav_status", "prev_heading", us("first_timestamp").alias("first_us"), "messages", "track_points", "ship_name", "ship_type", "destination")


def streaming_alerts(spark, sf_dir):
    """Alerts with cooldown from a stream of ticks."""
    return jobs.cooled(spark, alert_rules.evaluate(ticked_risk(spark, sf_dir))).select("vessel_id", "alert_type", "tick")


def tumbling_counts(spark, sf_dir):
    rows = jobs.counts_by_window(fixtures.tracks(spark, sf_dir), "1 hour")
    return rows.select(us("window_start").alias("start_us"), "messages")


def csv_ingest(spark, sf_dir):
    """The raw positions through a CSV file with other column names."""
    raw = fixtures.raw_positions(spark, sf_dir)
    names = {"vessel_id": "MMSI", "timestamp": "BaseDateTime", "latitude": "LAT", "longitude": " lon ", "speed": "SOG", "heading": "COG"}
    path = f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}.csv"
    raw.select(*(F.col(c).alias(n) for c, n in names.items())).write.option("header", True).csv(path)
    return positions.load(spark, path).groupBy("vessel_id").agg(F.count("*").alias("n"), F.max(F.unix_micros("timestamp")).alias("last_us"), F.round(F.max("speed"), 4).alias("top_speed"))


def order_without_times(spark, sf_dir):
    """The last position of vessels of a source without times: rows keep the order that they come in."""
    rows = positions.coerced(positions.normalise(fixtures.tracks(spark, sf_dir).drop("timestamp", "seq")))
    return tracks.latest(rows).select("vessel_id", F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude"), F.col("timestamp").isNull().alias("untimed"))


def small_run(spark: SparkSession, sf_dir: str) -> tuple:
    """The frames of a run without positions, and without alerts."""
    _, latest, _ = parts(spark, sf_dir)
    own = written(latest, "latest")
    anomaly = own.select("vessel_id", F.lit(0.5).alias("anomaly_score"), F.lit(False).alias("is_anomalous"))
    scored = own.select("vessel_id", F.lit(7).alias("overall_score"), F.lit("LOW").alias("risk_level"), F.lit("b").alias("behavior"), F.lit("z").alias("zone_status"))
    none = spark.createDataFrame([], "vessel_id string, level string, message string, reason string")
    return own, own.select("vessel_id", "speed"), anomaly, scored, none, "feed", "bay"


def history_fallback(spark, sf_dir):
    """What two runs without positions leave: a vessel's place once, without a time."""
    store = history.HistoryStore(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    for _ in range(2):
        store.write_run(*small_run(spark, sf_dir))
    return store.table("positions").groupBy("vessel_id").agg(F.count("*").alias("n"), F.count("timestamp").alias("timed"), F.max("latitude").alias("latitude"))


def streamed_alerts_append(spark, sf_dir):
    """Alerts with cooldown that a stream has appended to a run, by type."""
    store = history.HistoryStore(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    store.write_run(*small_run(spark, sf_dir))
    run = store.table("runs").first()["run_id"]
    store.append_alerts(jobs.cooled(spark, alert_rules.evaluate(ticked_risk(spark, sf_dir))), run)
    return store.table("alerts").filter("created_at IS NOT NULL").groupBy("alert_type").agg(F.count("*").alias("n"), F.max("tick").alias("last_tick"))


def alert_buffer(spark, sf_dir):
    """The panel of eight over the last fifty alerts that fired: HIGH first, then the latest."""
    fired = alert_rules.with_cooldown(alert_rules.evaluate(ticked_risk(spark, sf_dir)).filter("alert_type <> 'ZONE_ENTRY'"))
    last = history.recent(fired.withColumn("row_ord", F.concat("vessel_id", "alert_type")), 50, "tick", "row_ord")
    return reports.alert_panel(last, 8).select("vessel_id", "alert_type", "level", "tick")


def sequence_moments(spark, sf_dir):
    """What the sequence model standardises by: mean and population deviation of each place of a window."""
    n, sums, products = sequences.moments(segments.segmented(fixtures.tracks(spark, sf_dir), DEFAULT.sequence_length), DEFAULT)
    mean = sums / n
    scale = (products.diagonal() / n - mean * mean).clip(0) ** 0.5
    rows = spark.createDataFrame([(i, float(m), float(d)) for i, (m, d) in enumerate(zip(mean, scale))], "place int, mean double, deviation double")
    return rows.select("place", (F.round("mean", 3) + 0.0).alias("mean"), F.round("deviation", 3).alias("deviation"))


def sequence_reference(spark, sf_dir):
    """The error that counts as 1: the exact 95 % quantile of the windows' errors under the fixed model."""
    found = written(sequences.errors(fixtures.tracks(spark, sf_dir), FIXED_SEQUENCES), "sequence-errors")
    return spark.createDataFrame([(sequences.quantile(found, "error", 0.95, few=100), found.count())], "reference double, windows long").select(F.round("reference", 4).alias("reference"), "windows")


def replay_ticks(spark, sf_dir):
    """A replay of twelve ticks as a stream: what each micro-batch saw, one tick after the other."""
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    jobs.write_replay(fixtures.tracks(spark, sf_dir), f"{folder}/ticks", 12)
    keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{folder}/out")
    schema = spark.read.parquet(f"{folder}/ticks").drop("folder").schema
    jobs.replay(spark, f"{folder}/ticks", schema, lambda stream: stream, keep)
    return spark.read.parquet(f"{folder}/out").groupBy("batch", "tick").agg(F.count("*").alias("n"), F.max(F.unix_micros("timestamp")).alias("sim_us"), F.sum("seq").alias("seqs"))


def model_store(spark, sf_dir):
    """What successive runs find in the model store, and how many vessels they score: nothing, a model that fits, one of other
    features or window length, a damaged one."""
    path, cfg = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}", replace(DEFAULT, trees=10)
    matrix, t = written(feature_matrix(spark, sf_dir), "matrix"), fixtures.tracks(spark, sf_dir)
    found = []

    def forest(run: str, columns: list[str]) -> None:
        scores, status = iforest.detect(matrix, columns, f"{path}/forest", cfg=cfg)
        found.append(("forest", run, status, scores.filter("anomaly_score BETWEEN 0 AND 1").count()))

    def sequence(run: str, length: int) -> None:
        own = replace(cfg, sequence_length=length)
        scores, status = sequences.detect(matrix, t, f"{path}/sequences", own)
        found.append(("sequences", run, status, scores.filter("temporal_anomaly_score BETWEEN 0 AND 1").count()))

    forest("empty store", FEATURES), forest("same features", FEATURES), forest("fewer features", FEATURES[:5]), forest("other order", FEATURES[4::-1])
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("overwrite").text(f"{path}/forest/metadata")
    forest("damaged", FEATURES)
    sequence("empty store", 10), sequence("same length", 10), sequence("other length", 5)
    return spark.createDataFrame(found, "model string, run string, status string, vessels long")


def by_quarter(rows: DataFrame) -> DataFrame:
    """``rows`` with the quarter of twelve hours that they fall into, the last one open."""
    return rows.withColumn("quarter", F.least(F.lit(3), F.floor((F.unix_micros("timestamp") - fixtures.START) / 10800e6)).cast("int"))


def streaming_counts(spark, sf_dir):
    """Hourly counts by risk level of a stream in four micro-batches. Every tenth row comes a batch late, within the
    watermark's delay; some come last and are dropped where their window has been handed out."""
    score = (F.col("seq") * 13) % 101
    rows = by_quarter(fixtures.tracks(spark, sf_dir)).withColumn("risk_level", F.when(score >= 55, "HIGH").when(score >= 20, "MEDIUM").otherwise("LOW"))
    late = F.when(F.col("seq") % 97 == 0, 3).when(F.col("seq") % 10 == 0, F.least(F.lit(3), F.col("quarter") + 1)).otherwise(F.col("quarter"))
    build = lambda stream: jobs.counts_by_window(stream.select("vessel_id", "timestamp", "risk_level"), "1 hour", keys=("risk_level",), delay="3 hours")
    found = jobs.in_batches(rows.withColumn("_batch", late).drop("quarter"), "_batch", 4, build)
    return found.select(us("window_start").alias("start_us"), "risk_level", "messages", "vessels")


def streaming_evictions(spark, sf_dir):
    """How often each vessel was dropped from the live state for a silence of an hour."""
    build = lambda stream: state.vessel_state(stream, "1 minute", stale_seconds=3600)
    found = jobs.in_batches(by_quarter(fixtures.tracks(spark, sf_dir)), "quarter", 4, build, "update")
    return found.filter("evicted AND messages > 0").groupBy("vessel_id").agg(F.count("*").alias("evictions"))


def live_rescore(spark, sf_dir):
    """Live risk of the fleet from the stream's state, batch by batch; the forest has the bounds of the whole history."""
    t, latest, zones = parts(spark, sf_dir)
    nodes, columns, cfg = spark.createDataFrame(FIXED_FOREST, iforest.NODES), ["speed", "displacement_ratio"], replace(DEFAULT, tree_rows=64)
    base = features.base_features(latest, t, geofence.check_zones(latest, zones))
    rescore = jobs.rescorer(zones, (nodes, columns, iforest.bounds_of(base, nodes, columns, cfg=cfg)), FIXED_SEQUENCES, gaps(spark, sf_dir), cfg)
    folder = f"{shared_folder(spark)}/live-risk-{uuid.uuid4().hex}"
    rows = by_quarter(t)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    for quarters in ((0, 1), (2, 3)):
        rows.filter(F.col("quarter").isin(*quarters)).drop("quarter").write.mode("append").parquet(f"{folder}/in")
        states = state.vessel_state(spark.readStream.schema(t.schema).parquet(f"{folder}/in"), "1 day", cfg, stale_seconds=10**9)
        jobs.live_rescore(states, rescore, f"{folder}/out", f"{folder}/checkpoint")
    return jobs.active_risk(spark, f"{folder}/out")


ALL = [
    clean_positions, quality_report, ingest_report, dedupe_exact, alias_normalise, region_filter, latest_position, recent_window_20, first_seen_prev_value, step_metrics, trajectory_export, tick_buckets, state_as_of_tick,
    tick_progress, geofence_latest, geofence_all_positions, geofence_grid, behaviour_metrics, behaviour_labels, base_features, feature_matrix, feature_json, feature_json_values, sequence_windows, sequence_windows_all, temporal_scores,
    temporal_fixed_score, iforest_scores, iforest_fixed_score, anomaly_ranking, minmax_normalise, risk_components, risk_scores, risk_factor_breakdown, risk_reasons, risk_alerts, fleet_stats, fleet_ranked, medium_risk_top_factors,
    high_risk_top_factors, alert_panel, fleet_enriched, live_table, vessel_report, vessel_track, score_histogram, ranked_risk_fixed, ranked_risk, stream_alert_rules, alert_cooldown, vessel_upsert, positions_anti_append, history_summary, history_recent_risk, history_vessel, recent_alerts_topk, vessel_recent_topk, parse_position_json, parse_static_json,
    ship_type_decode, static_merge, message_counters, evicted_count, stale_eviction, streaming_state, streaming_alerts, session_gaps, tumbling_counts, streaming_counts, streaming_evictions, live_rescore,
    csv_ingest, order_without_times, history_fallback, streamed_alerts_append, alert_buffer, sequence_moments, sequence_reference,
    behaviour_by_place, sequence_training, replay_ticks, model_store,
]
