"""Behaviour metrics of trajectories, their labels and their numeric projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.config import BEHAVIOUR_FEATURES, DEFAULT, Config
from fairlead.functions.motion import haversine_km
from fairlead.functions.texts import BEHAVIOUR, filled
from fairlead.operators.tracks import own, steps

#: The metrics and the places that they are rounded to; labels are told from unrounded ones.
METRICS = {
    "distance_travelled_km": 3, "avg_speed": 2, "max_speed": 2, "speed_std": 3, "speed_change_rate": 4, "mean_heading_change": 2, "max_heading_change": 2, "heading_change_std": 3,
    "turning_rate": 4, "stationary_ratio": 4, "loitering_score": 4, "max_ais_gap_minutes": 2, "mean_ais_gap_minutes": 2, "trajectory_duration_minutes": 2,
}
COLUMNS = [*METRICS, "significant_gap_count", "position_count", "behavior_labels", "behavior_summary"]


def metric_sums(cfg: Config = DEFAULT) -> list[Column]:
    """What ``metrics_of`` needs of a vessel's steps. Missing speeds, headings or times leave their
    metrics at 0."""
    gap = F.when(F.col("gap_minutes") >= 0, F.col("gap_minutes"))
    turn = F.abs("heading_change")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        zero(F.sum("km")).alias("distance_travelled_km"),
        zero(F.avg("speed")).alias("avg_speed"),
        zero(F.max("speed")).alias("max_speed"),
        zero(F.stddev_pop("speed")).alias("speed_std"),
        zero(F.avg(F.when(gap > 0, F.col("dspeed") / F.when(gap > 0, gap)))).alias("speed_change_rate"),
        zero(F.avg(turn)).alias("mean_heading_change"),
        zero(F.max(turn)).alias("max_heading_change"),
        zero(F.stddev_pop(turn)).alias("heading_change_std"),
        zero(F.avg((F.col("speed") <= cfg.low_speed).cast("int"))).alias("stationary_ratio"),
        zero(F.max(gap)).alias("max_ais_gap_minutes"),
        zero(F.avg(gap)).alias("mean_ais_gap_minutes"),
        F.count_if(gap >= cfg.significant_gap).alias("significant_gap_count"),
        zero(F.sum(gap)).alias("trajectory_duration_minutes"),
        F.count("*").alias("position_count"),
        zero(haversine_km(F.min("latitude"), F.min("longitude"), F.max("latitude"), F.max("longitude"))).alias("_diagonal"),
    ]


def metrics_of(sums: DataFrame) -> DataFrame:
    """Unrounded metrics from ``metric_sums``; other columns go along."""
    mean_gap = F.col("mean_ais_gap_minutes")
    contained = 1 - F.least(F.col("_diagonal") / (F.col("distance_travelled_km") + 1e-6), F.lit(1.0))
    still = 0.4 * F.col("stationary_ratio")
    return sums.withColumns(
        {
            "turning_rate": F.when((F.col("mean_heading_change") > 0) & (mean_gap > 0), F.col("mean_heading_change") / F.when(mean_gap > 0, mean_gap)).otherwise(0.0),
            "loitering_score": F.least(F.lit(1.0), F.when((F.col("position_count") >= 2) & (F.col("distance_travelled_km") > 1e-6), 0.6 * contained + still).otherwise(still)),
        }
    ).drop("_diagonal")


def metrics(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Unrounded metrics of every vessel in one aggregate over its steps."""
    return metrics_of(own(steps(df)).groupBy("vessel_id").agg(*metric_sums(cfg)))


def labels(cfg: Config) -> tuple[Column, Column]:
    """The labels of unrounded metrics and their summary in words."""
    cases = {
        "LOITERING": F.col("loitering_score") >= cfg.loitering_flag,
        "SLOW_MOVEMENT": F.col("stationary_ratio") >= cfg.slow_share,
        "HIGH_TURNING": F.col("mean_heading_change") >= cfg.high_turning,
        "AIS_GAP": (F.col("significant_gap_count") > 0) | (F.col("max_ais_gap_minutes") >= 30.0),
        "SPEED_ANOMALY": F.col("speed_std") >= cfg.speed_anomaly_std,
    }
    rules = [(case, n, filled(BEHAVIOUR[n], gap=F.floor("max_ais_gap_minutes").cast("long"))) for n, case in cases.items()]
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n, _ in rules)))
    words = F.array_join(F.array_compact(F.array(*(F.when(c, w) for c, _, w in rules))), ", ")
    single = F.col("position_count") <= 1
    named = F.when(single, F.array(F.lit("INSUFFICIENT_DATA"))).when(F.size(found) == 0, F.array(F.lit("NORMAL_TRANSIT"))).when(F.size(found) >= 2, F.array_append(found, F.lit("MIXED_SUSPICIOUS"))).otherwise(found)
    said = (
        F.when(single, BEHAVIOUR["single"])
        .when(F.size(found) == 0, BEHAVIOUR["transit"])
        .otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000), F.lit(".")))
    )
    return named, said


def analysed(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows of ``metrics_of`` with their metrics rounded, behavior_labels and behavior_summary."""
    named, said = labels(cfg)
    return rows.withColumns({"behavior_labels": named, "behavior_summary": said}).withColumns({n: F.round(n, d) for n, d in METRICS.items()})


def analyse(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A row for each vessel: its rounded metrics, behavior_labels and behavior_summary."""
    return analysed(metrics(df, cfg), cfg).select("vessel_id", *COLUMNS)


def feature_row(behaviour: DataFrame) -> DataFrame:
    """The numeric columns of ``analyse`` under their feature names, 0 where null."""
    return behaviour.select("vessel_id", *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(b) for b, n in BEHAVIOUR_FEATURES.items()))
