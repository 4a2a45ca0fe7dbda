"""Risk scores of vessels with their reasons, and the alerts that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.config import DEFAULT, Config
from fairlead.functions.motion import clamp01
from fairlead.functions.texts import ALERTS, FACTORS, LEVELS, REASONS, filled


def with_scores(out: DataFrame, anomaly: DataFrame | None = None, temporal: DataFrame | None = None, reported_gaps: DataFrame | None = None) -> DataFrame:
    """Vessel rows with model scores and reported gaps, defaults where these are missing."""
    if anomaly is not None:
        out = out.join(anomaly.select("vessel_id", "anomaly_score", "is_anomalous"), "vessel_id", "left")
    if temporal is not None:
        out = out.join(temporal.select("vessel_id", "temporal_anomaly_score", "temporal_model_status"), "vessel_id", "left")
    if reported_gaps is not None:
        out = out.join(reported_gaps.select("vessel_id", F.col("gap_minutes").cast("double").alias("reported_gap")), "vessel_id", "left")
    return with_defaults(out)


def with_defaults(df: DataFrame) -> DataFrame:
    """``df`` with every input column of ``score``, defaults for missing columns and nulls."""
    defaults = {
        "inside": F.lit(False), "near": F.lit(False), "zone_name": F.lit(""), "nearest_zone": F.lit(""), "zone_status": F.lit("Open Waters"),
        "speed": F.lit(0.0), "speed_deviation": F.lit(0.0), "loitering_score": F.lit(0.0), "zone_proximity_norm": F.lit(0.0), "erratic_score": F.lit(0.0),
        "mean_heading_change": F.lit(0.0), "max_ais_gap_minutes": F.lit(0.0), "behavior_labels": F.array().cast("array<string>"), "behavior_summary": F.lit(""),
        "anomaly_score": F.lit(0.0), "is_anomalous": F.lit(False), "temporal_anomaly_score": F.lit(0.0), "temporal_model_status": F.lit("insufficient_data"), "reported_gap": F.lit(0.0),
    }
    return df.withColumns({n: F.coalesce(F.col(n), d) if n in df.columns else d for n, d in defaults.items()})


def whole(x: Column) -> Column:
    """Rounded half to even, as an int."""
    return F.rint(x).cast("int")


def score(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A row for each row of ``with_defaults``: five components in [0, 1], the weighted score of 0
    to 100, its level, the factors behind it, reasons in words, the primary behaviour.

    Each signal counts once; the gap is the larger of the reported one and the track's.
    """
    gap = F.greatest("reported_gap", "max_ais_gap_minutes")
    rows = df.withColumns(
        {
            "_gap": gap,
            "_geo": F.when(F.col("inside"), 1.0).when(F.col("near"), clamp01(F.col("zone_proximity_norm"))).otherwise(0.0),
            "_iso": clamp01(F.col("anomaly_score")),
            "_temp": F.when(F.col("temporal_model_status") == "scored", clamp01(F.col("temporal_anomaly_score"))).otherwise(0.0),
            "_beh": clamp01(F.greatest("loitering_score", "speed_deviation", "erratic_score", F.col("mean_heading_change") / cfg.full_turn)),
        }
    ).withColumn("_gapc", F.when(F.col("_gap") < cfg.gap_min, 0.0).otherwise(F.least(F.col("_gap") / cfg.gap_full, F.lit(1.0))))
    parts = [("_geo", cfg.weight_geofence), ("_iso", cfg.weight_isolation), ("_temp", cfg.weight_temporal), ("_beh", cfg.weight_behaviour), ("_gapc", cfg.weight_gap)]
    total = sum((F.col(n) * w for n, w in parts[1:]), F.col("_geo") * cfg.weight_geofence)
    rows = rows.withColumn("overall_score", whole(F.least(total, F.lit(1.0)) * 100))
    minutes = F.floor("_gap").cast("int")
    by_zone = lambda texts: F.when(F.col("inside"), filled(texts["inside"], zone=F.col("zone_name"))).when(F.col("near"), filled(texts["near"], zone=F.col("nearest_zone")))
    names = [by_zone(FACTORS), *(F.lit(FACTORS[n]) for n in ("isolation", "temporal", "behaviour")), filled(FACTORS["gap"], gap=minutes)]
    factor = lambda name, n, w: F.struct(name.alias("factor"), whole(F.col(n) * w * 100).alias("contribution"), F.lit(round(w * 100)).alias("max_weight"), F.round(n, 4).alias("component"))
    factors = F.filter(F.array(*(factor(name, n, w) for name, (n, w) in zip(names, parts))), lambda x: (x["component"] > 0.01) & x["factor"].isNotNull())
    said = [
        by_zone(REASONS),
        F.when(F.col("_iso") >= cfg.anomaly_threshold, REASONS["isolation"]),
        F.when(F.col("_temp") >= cfg.alert_temporal, REASONS["temporal"]),
        F.when(F.col("loitering_score") >= 0.6, REASONS["loitering"]),
        F.when(F.col("mean_heading_change") >= cfg.high_turning, REASONS["turning"]),
        F.when(F.col("speed_deviation") >= 0.4, REASONS["speed"]),
        F.when(F.col("_gapc") > 0.01, names[4]),
    ]
    reasons = F.array_compact(F.array(*said))
    behavior = (
        F.when(F.col("inside") & (F.col("loitering_score") > 0.50), "Loitering / Zone Violation")
        .when(F.col("inside"), "Zone Violation")
        .when(F.col("loitering_score") > 0.60, "Suspicious Loitering")
        .when(F.col("erratic_score") > 0.50, "Erratic Movement")
        .when(F.col("speed_deviation") > 0.40, "Speed Anomaly")
        .when(F.col("near"), "Proximity to Restricted Zone")
        .when(F.col("is_anomalous"), "Anomalous Behaviour")
        .when(F.col("speed") <= cfg.fishing_speed_max, "Normal Fishing")
        .otherwise("Normal Transit")
    )
    level = F.when(F.col("overall_score") >= cfg.high, "HIGH").when(F.col("overall_score") >= cfg.medium, "MEDIUM").otherwise("LOW")
    told = F.when(level == "HIGH", LEVELS["HIGH"]).when(level == "MEDIUM", LEVELS["MEDIUM"]).otherwise(LEVELS["LOW"])
    components = {"geofence_component": "_geo", "isolation_component": "_iso", "temporal_component": "_temp", "behaviour_component": "_beh", "ais_gap_component": "_gapc"}
    return rows.select(
        "vessel_id",
        "overall_score",
        F.col("overall_score").alias("risk_score"),
        level.alias("risk_level"),
        behavior.alias("behavior"),
        "zone_status",
        *(F.round(c, 4).alias(n) for n, c in components.items()),
        factors.alias("factors"),
        F.when(F.size(reasons) == 0, F.array(F.lit(REASONS["none"]))).otherwise(reasons).alias("risk_factors"),
        told.alias("explanation"),
        whole(F.col("_gap")).alias("ais_gap_minutes"),
        "behavior_summary",
        "behavior_labels",
    )


def alerts(risk: DataFrame) -> DataFrame:
    """Alerts of HIGH and MEDIUM vessels: level, icon, vessel_id, message, reason, overall_score.

    The reason is the factor that contributes most, the first of equals. Order them by
    ``alert_order``.
    """
    best = F.aggregate("factors", F.get("factors", F.lit(0)), lambda a, f: F.when(f["contribution"] > a["contribution"], f).otherwise(a))
    rows = risk.filter("risk_level IN ('HIGH', 'MEDIUM')").withColumn("reason", F.when(F.size("factors") > 0, best["factor"]).otherwise(F.col("behavior")))
    has = lambda c, text: F.col(c).contains(text)
    columns = {"vessel": F.col("vessel_id"), "score": F.col("overall_score"), "zone": F.col("zone_status"), "gap": F.col("ais_gap_minutes"), "reason": F.col("reason")}
    cases = {
        "inside": has("behavior", "Zone Violation") | has("zone_status", "INSIDE"),
        "loitering": has("behavior", "Loitering"),
        "gap": F.col("ais_gap_minutes") >= 20,
        "temporal": has("reason", "Temporal"),
        "speed": has("behavior", "Speed Anomaly"),
        "erratic": has("behavior", "Erratic"),
        "near": has("behavior", "Proximity") | has("zone_status", "Near"),
        "anomalous": has("behavior", "Anomalous"),
    }
    message = F.coalesce(*(F.when(case, filled(ALERTS[n], **columns)) for n, case in cases.items()), filled(ALERTS["other"], **columns))
    icon = F.when(F.col("risk_level") == "HIGH", "🔴").otherwise("🟠")
    return rows.select(F.col("risk_level").alias("level"), icon.alias("icon"), "vessel_id", message.alias("message"), "reason", "overall_score")


def alert_order() -> list[Column]:
    """HIGH first, then by falling score; vessel_id breaks ties."""
    return [F.when(F.col("level") == "HIGH", 0).otherwise(1), F.desc("overall_score"), F.col("vessel_id")]
