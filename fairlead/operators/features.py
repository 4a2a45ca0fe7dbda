"""The feature matrix: nine base features and twelve behaviour features for each vessel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.config import BASE_FEATURES, BEHAVIOUR_FEATURES, DEFAULT, FEATURES, Config
from fairlead.operators.behaviour import feature_row
from fairlead.operators.tracks import turned


def path_sums() -> list[Column]:
    """What ``path_of`` needs of a vessel's steps and turns (``turned``)."""
    at = F.struct("latitude", "longitude")
    return [
        F.count("step_deg").alias("n_steps"),
        F.coalesce(F.sum("step_deg"), F.lit(0.0)).alias("path_length_deg"),
        F.coalesce(F.var_pop("turn"), F.lit(0.0)).alias("heading_variance"),
        F.coalesce(F.avg("turn"), F.lit(0.0)).alias("bearing_change_rate"),
        F.avg("step_deg").alias("_mean"),
        F.stddev_pop("step_deg").alias("_std"),
        F.min_by(at, F.struct("timestamp", "seq")).alias("_first"),
        F.max_by(at, F.struct("timestamp", "seq")).alias("_last"),
    ]


def path_of(sums: DataFrame) -> DataFrame:
    """Unrounded path measures from ``path_sums``; other columns go along."""
    net = F.hypot(F.col("_last.latitude") - F.col("_first.latitude"), F.col("_last.longitude") - F.col("_first.longitude"))
    path = F.col("path_length_deg")
    erratic = F.when((F.col("n_steps") > 1) & (F.col("_mean") > 1e-8), F.least(F.col("_std") / F.when(F.col("_mean") > 1e-8, F.col("_mean")), F.lit(1.0)))
    return sums.withColumns(
        {"displacement_ratio": F.when(path > 1e-6, F.least(net / F.when(path > 1e-6, path), F.lit(1.0))).otherwise(1.0), "erratic_score": F.coalesce(erratic, F.lit(0.0))}
    ).drop("_first", "_last", "_mean", "_std")


def path_features(df: DataFrame) -> DataFrame:
    """Unrounded path measures of every vessel: from its steps and the turns between them."""
    return path_of(turned(df).groupBy("vessel_id").agg(*path_sums()))


def base_columns(cfg: Config = DEFAULT) -> list[Column]:
    """The nine base features of a row with speed, the columns of ``path_of``, inside and
    min_dist_deg: a single-point track and no zone in reach where these are null."""
    low, high, speed = cfg.fishing_speed_min, cfg.fishing_speed_max, F.coalesce("speed", F.lit(0.0))
    none = F.coalesce("n_steps", F.lit(0)) == 0
    part = lambda n, d: F.when(none, F.lit(d)).otherwise(F.col(n))
    slow = F.greatest(F.lit(0.0), 1 - speed / low)
    loiter = F.when(none, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (1 - F.col("displacement_ratio")) * 0.7 + slow * 0.3))
    dist = F.coalesce("min_dist_deg", F.lit(cfg.proximity_max))
    values = {
        "speed": (speed, 3),
        "speed_deviation": (F.least(F.lit(1.0), F.when(speed < low, (low - speed) / low).when(speed > high, (speed - high) / high).otherwise(0.0)), 4),
        "heading_variance": (part("heading_variance", 0.0), 4),
        "displacement_ratio": (part("displacement_ratio", 1.0), 4),
        "loitering_score": (loiter, 4),
        "path_length_deg": (part("path_length_deg", 0.0), 5),
        "bearing_change_rate": (part("bearing_change_rate", 0.0), 4),
        "zone_proximity_norm": (F.when(F.coalesce("inside", F.lit(False)), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - dist / cfg.proximity_max)), 4),
        "erratic_score": (part("erratic_score", 0.0), 4),
    }
    return [F.round(values[n][0], values[n][1]).alias(n) for n in BASE_FEATURES]


def base_features(latest: DataFrame, positions: DataFrame, geo: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The nine base features of the vessels in ``latest`` (vessel_id, speed)."""
    joined = latest.select("vessel_id", "speed").join(path_features(positions), "vessel_id", "left").join(geo.select("vessel_id", "inside", "min_dist_deg"), "vessel_id", "left")
    return joined.select("vessel_id", *base_columns(cfg))


def feature_json(matrix: DataFrame) -> DataFrame:
    """vessel_id and its features as JSON text."""
    return matrix.select("vessel_id", F.to_json(F.struct(*(c for c in matrix.columns if c != "vessel_id"))).alias("feature_json"))
