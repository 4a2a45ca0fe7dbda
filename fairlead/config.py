"""Thresholds and weights of the vessel analytics, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Speeds in knots, gaps in minutes, angles and distances in degrees.
    low_speed: float = 1.0
    significant_gap: float = 30.0
    high_turning: float = 45.0
    loitering_flag: float = 0.6
    slow_share: float = 0.5
    speed_anomaly_std: float = 6.0
    fishing_speed_min: float = 3.0
    fishing_speed_max: float = 9.0
    near_zone: float = 0.15
    proximity_max: float = 0.30
    anomaly_threshold: float = 0.55
    high: int = 55
    medium: int = 20
    gap_min: float = 20.0
    gap_full: float = 60.0
    full_turn: float = 120.0
    weight_geofence: float = 0.30
    weight_isolation: float = 0.25
    weight_temporal: float = 0.15
    weight_behaviour: float = 0.20
    weight_gap: float = 0.10
    alert_zone: float = 0.99
    alert_gap: float = 0.34
    alert_behaviour: float = 0.60
    alert_temporal: float = 0.55
    cooldown_ticks: int = 10
    recent_replay: int = 20
    recent_live: int = 50
    stale_seconds: int = 300
    sequence_length: int = 10
    windows_per_vessel: int | None = None  # all; the reference stops at 50
    training_windows: int | None = None  # all; the reference stops at 5,000
    temporal_components: int = 32
    trees: int = 200
    tree_rows: int = 256
    seed: int = 42


DEFAULT = Config()

BASE_FEATURES = ["speed", "speed_deviation", "heading_variance", "displacement_ratio", "loitering_score", "path_length_deg", "bearing_change_rate", "zone_proximity_norm", "erratic_score"]
BEHAVIOUR_FEATURES = {
    "b_distance_km": "distance_travelled_km",
    "b_avg_speed": "avg_speed",
    "b_max_speed": "max_speed",
    "b_speed_std": "speed_std",
    "b_mean_heading_change": "mean_heading_change",
    "b_max_heading_change": "max_heading_change",
    "b_stationary_ratio": "stationary_ratio",
    "b_loitering_score": "loitering_score",
    "b_max_gap_minutes": "max_ais_gap_minutes",
    "b_significant_gap_count": "significant_gap_count",
    "b_duration_minutes": "trajectory_duration_minutes",
    "b_position_count": "position_count",
}
FEATURES = [*BASE_FEATURES, *BEHAVIOUR_FEATURES]
