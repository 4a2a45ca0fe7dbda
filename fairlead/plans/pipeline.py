"""The batch pipeline: positions to risk and alerts.

All that is known of a vessel comes from one pass over its positions: one exchange by vessel_id, one
sort and one aggregate. Its row is written, and everything else reads that small table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.config import BEHAVIOUR_FEATURES, DEFAULT, FEATURES, Config
from fairlead.operators import behaviour, features, geofence, iforest, risk, segments, sequences, tracks
from fairlead.sources.tables import written

GEO = ["inside", "near", "zone_name", "nearest_zone", "min_dist_deg", "zone_status"]
LATEST = ["latitude", "longitude", "speed", "heading", "timestamp", "behavior"]


@dataclass
class Results:
    latest: DataFrame
    behaviour: DataFrame
    geo: DataFrame
    features: DataFrame
    anomaly: DataFrame | None
    temporal: DataFrame | None
    risk: DataFrame
    alerts: DataFrame


#: Positions before a segment that its steps, turns and windows of steps look at.
TURN_HALO = 2


def fleet(positions: DataFrame, zones: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A row for each vessel (``positions`` may be cut into segments): vessel_id, its latest position, the columns of GEO, and the structs
    behave (as ``behaviour.analyse``) and base (the base features)."""
    sums = tracks.own(tracks.turned(positions)).groupBy("vessel_id").agg(*tracks.latest_sums(), *behaviour.metric_sums(cfg), *features.path_sums())
    behave = behaviour.analysed(behaviour.metrics_of(sums), cfg)
    behave = behave.withColumn("behave", F.struct(*behaviour.COLUMNS)).drop(*behaviour.COLUMNS)
    placed = geofence.check_zones(tracks.latest_of(features.path_of(behave)), zones, cfg)
    return placed.select("vessel_id", *LATEST, *GEO, "behave", F.struct(*features.base_columns(cfg)).alias("base"))


def matrix_of(rows: DataFrame) -> DataFrame:
    """The feature matrix of the rows of ``fleet``."""
    behave = [F.coalesce(F.col(f"behave.{n}").cast("double"), F.lit(0.0)).alias(b) for b, n in BEHAVIOUR_FEATURES.items()]
    return rows.select("vessel_id", "base.*", *behave).select("vessel_id", *FEATURES)


def inputs_of(rows: DataFrame, anomaly: DataFrame | None = None, temporal: DataFrame | None = None, reported_gaps: DataFrame | None = None) -> DataFrame:
    """What ``risk.score`` needs, from the rows of ``fleet`` and scores by vessel."""
    of_base = ["speed", "speed_deviation", "loitering_score", "zone_proximity_norm", "erratic_score"]
    of_behave = ["mean_heading_change", "max_ais_gap_minutes", "behavior_labels", "behavior_summary"]
    own = rows.select("vessel_id", "inside", "near", "zone_name", "nearest_zone", "zone_status", *(F.col(f"base.{n}") for n in of_base), *(F.col(f"behave.{n}") for n in of_behave))
    return risk.with_scores(own, anomaly, temporal, reported_gaps)


def run(
    positions: DataFrame,
    zones: DataFrame,
    reported_gaps: DataFrame | None = None,
    models: bool = True,
    model_path: str | None = None,
    cfg: Config = DEFAULT,
    forest: tuple[DataFrame, list[str]] | tuple[DataFrame, list[str], tuple[float, float] | None] | None = None,
    sequence_model: sequences.Model | None = None,
) -> Results:
    """All results of a fleet. Without ``models`` both anomaly scores are 0; with a model_path models
    are loaded from there, or trained and stored; forest (nodes, columns and bounds, see ``iforest.score``) and
    sequence_model are taken as they are."""
    positions = segments.segmented(positions.filter("latitude IS NOT NULL AND longitude IS NOT NULL"), max(TURN_HALO, cfg.sequence_length))
    rows = written(fleet(positions, zones, cfg), "fleet")
    matrix = matrix_of(rows)
    anomaly = temporal = None
    if models:
        anomaly = iforest.score(matrix, *forest[:2], cfg=cfg, bounds=forest[2] if len(forest) > 2 else None) if forest else iforest.detect(matrix, path=model_path and f"{model_path}/forest", cfg=cfg)[0]
        temporal, _ = sequences.detect(rows, positions, path=model_path and f"{model_path}/sequences", cfg=cfg, model=sequence_model)
    scored = risk.score(inputs_of(rows, anomaly, temporal, reported_gaps), cfg)
    return Results(rows.select("vessel_id", *LATEST), rows.select("vessel_id", "behave.*"), rows.select("vessel_id", *GEO), matrix, anomaly, temporal, scored, risk.alerts(scored))
