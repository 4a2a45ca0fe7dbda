"""Reports over risk results: counts, rankings, tables for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fleet_stats(risk: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: vessels by level, and the number of HIGH alerts."""
    level = lambda x: F.count_if(F.col("risk_level") == x)
    counts = risk.agg(F.count("*").alias("total"), level("HIGH").alias("high"), level("MEDIUM").alias("medium"), level("LOW").alias("low"))
    active = alerts.agg(F.count_if(F.col("level") == "HIGH")).scalar()
    return counts.withColumn("active_high_alerts", active)


def enriched(vessels: DataFrame, risk: DataFrame) -> DataFrame:
    """The fleet table with score, level, behaviour and zone status; ``behavior`` of the vessels is
    replaced."""
    return vessels.drop("behavior", "zone_status").join(risk.select("vessel_id", "overall_score", "risk_level", "behavior", "zone_status"), "vessel_id", "left")


def ranked(risk: DataFrame) -> DataFrame:
    """vessel_id, overall_score, risk_level, behavior, zone_status by falling score."""
    return risk.select("vessel_id", "overall_score", "risk_level", "behavior", "zone_status").orderBy(F.desc("overall_score"), "vessel_id")


def high_risk(risk: DataFrame, level: str = "HIGH", top: int = 3) -> DataFrame:
    """Vessels of a level with the names of their first factors, by falling score."""
    names = F.array_join(F.transform(F.slice("factors", 1, top), lambda f: f["factor"]), "; ")
    return risk.filter(F.col("risk_level") == level).select("vessel_id", "overall_score", names.alias("top_factors")).orderBy(F.desc("overall_score"), "vessel_id")


def score_histogram(risk: DataFrame, buckets: int = 10) -> DataFrame:
    """Vessels by bucket of score; bucket 1 starts at 0, 100 counts to the last."""
    bucket = F.least(F.width_bucket("overall_score", F.lit(0.0), F.lit(100.0), F.lit(buckets)), F.lit(buckets))
    return risk.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("vessels"))


def anomaly_ranking(anomaly: DataFrame) -> DataFrame:
    """Scores as text with a flag, highest first."""
    rows = anomaly.orderBy(F.desc("anomaly_score"), "vessel_id")
    return rows.select("vessel_id", F.format_string("%.3f", "anomaly_score").alias("score"), F.when(F.col("is_anomalous"), "yes").otherwise("no").alias("flag"))


def live_table(state: DataFrame, static: DataFrame, risk: DataFrame) -> DataFrame:
    """Live vessels with their static data and risk, defaults where missing, by falling score."""
    out = state.join(static, "vessel_id", "left").join(risk.select("vessel_id", "overall_score", "risk_level"), "vessel_id", "left")
    fills = {"ship_name": "", "ship_type": "Unknown", "destination": "", "eta": "", "overall_score": 0, "risk_level": "LOW"}
    return out.fillna({k: v for k, v in fills.items() if k in out.columns}).orderBy(F.desc("overall_score"), "vessel_id")


def vessel_report(vessel_id: str, risk: DataFrame, features: DataFrame, behaviour: DataFrame, temporal: DataFrame) -> DataFrame:
    """Everything about one vessel in a row."""
    one = lambda df: df.filter(F.col("vessel_id") == vessel_id)
    drop = [c for c in behaviour.columns if c in risk.columns and c != "vessel_id"]
    rest = features.select("vessel_id", F.struct(*(c for c in features.columns if c != "vessel_id")).alias("features"))
    out = one(risk).join(one(rest), "vessel_id", "left").join(one(behaviour.drop(*drop, "loitering_score")), "vessel_id", "left").join(one(temporal), "vessel_id", "left")
    return out.fillna({"temporal_anomaly_score": 0.0, "temporal_model_status": "insufficient_data"})


def alert_panel(alerts: DataFrame, n: int) -> DataFrame:
    """The ``n`` alerts on top: HIGH first, then the latest, then by vessel and type."""
    return alerts.orderBy(F.col("level") != "HIGH", F.desc("tick"), "vessel_id", "alert_type").limit(n)
