"""DuckDB SQL with the rows of the queries of the same name.

Written apart from the operators: tracks come from ``fixtures.TRACKS_SQL``, the rest is built from
the named parts below.
"""

from __future__ import annotations

from fairlead.plans.fixtures import CLEAN_SQL, RAW_SQL, START, TRACKS_SQL
from fairlead.plans.queries import FIXED_FOREST, FIXED_MEAN, FIXED_REFERENCE, FIXED_SCALE
from fairlead.sources.dimensions import ZONES

W = "(PARTITION BY vessel_id ORDER BY us, seq)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"CASE WHEN {lat1} IS NOT NULL THEN 2 * CAST(6371.0088 AS DOUBLE) * asin(least(CAST(1 AS DOUBLE), sqrt({a}))) END"


def turn(a: str, b: str) -> str:
    return f"((({b} - {a} + 180) % 360 + 360) % 360 - 180)"


def select(parts: str, query: str) -> str:
    return f"WITH {parts}\n{query}"


def rounded(x: str, places: int) -> str:
    """Half up on the decimal digits that a double shows, as Spark rounds."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {places}) AS DOUBLE)"


LATEST = f""",
latest AS (
  SELECT vessel_id, {rounded("p.latitude", 4)} AS latitude, {rounded("p.longitude", 4)} AS longitude, {rounded("p.speed", 1)} AS speed, {rounded("p.heading", 1)} AS heading, p.us AS us
  FROM (SELECT vessel_id, arg_max(struct_pack(latitude := latitude, longitude := longitude, speed := speed, heading := heading, us := us), struct_pack(us := us, seq := seq)) AS p FROM clean GROUP BY vessel_id)
)"""

STEPS = f""",
lagged AS (
  SELECT *, lag(latitude) OVER {W} AS lat0, lag(longitude) OVER {W} AS lon0, lag(us) OVER {W} AS us0, lag(speed) OVER {W} AS speed0, lag(heading) OVER {W} AS heading0 FROM clean
),
steps AS (
  SELECT *, latitude - lat0 AS dlat, longitude - lon0 AS dlon, {haversine("lat0", "lon0", "latitude", "longitude")} AS km, sqrt(pow(latitude - lat0, 2) + pow(longitude - lon0, 2)) AS step_deg,
    (degrees(atan2(longitude - lon0, latitude - lat0)) % 360 + 360) % 360 AS bearing, {turn("heading0", "heading")} AS heading_change, (us - us0) / CAST(60000000 AS DOUBLE) AS gap_minutes, abs(speed - speed0) AS dspeed
  FROM lagged
)"""


def sides() -> str:
    """VALUES of the default zones' sides: ord, name, start lat, lon, end lat, lon."""
    rows = []
    for i, (name, south, north, west, east) in enumerate(ZONES["default"][1]):
        ring = [(north, west), (north, east), (south, east), (south, west)]
        for k in range(4):
            (la, oa), (lb, ob) = ring[k - 1], ring[k]
            rows.append(f"({i}, '{name}', CAST({la} AS DOUBLE), CAST({oa} AS DOUBLE), CAST({lb} AS DOUBLE), CAST({ob} AS DOUBLE))")
    return ", ".join(rows)


def zones(of: str, key: str) -> str:
    """``geo``: the rows of ``of`` (with ``key``) with what the zones say of them."""
    return f""",
sides(ord, name, la, oa, lb, ob) AS (VALUES {sides()}),
each AS (
  SELECT {key}, ord, name, sum(CASE WHEN (ob > longitude) <> (oa > longitude) AND latitude < (la - lb) * (longitude - ob) / (oa - ob + CAST(1e-12 AS DOUBLE)) + lb THEN 1 ELSE 0 END) % 2 = 1 AS inside,
    min(sqrt(pow(longitude - (oa + t * (ob - oa)), 2) + pow(latitude - (la + t * (lb - la)), 2))) AS dist
  FROM (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ((longitude - oa) * (ob - oa) + (latitude - la) * (lb - la)) / ((ob - oa) * (ob - oa) + (lb - la) * (lb - la)))) AS t FROM {of} CROSS JOIN sides)
  GROUP BY {key}, ord, name
),
best AS (SELECT {key}, b.inside AS inside, b.name AS name, CASE WHEN b.inside THEN 0 ELSE b.dist END AS dist
  FROM (SELECT {key}, min(struct_pack(o := NOT inside, d := CASE WHEN inside THEN CAST(0 AS DOUBLE) ELSE dist END, ord := ord, inside := inside, name := name, dist := dist)) AS b FROM each GROUP BY {key})),
geo AS (
  SELECT {key}, inside, CASE WHEN inside THEN name ELSE '' END AS zone_name, NOT inside AND dist <= CAST(0.15 AS DOUBLE) AS near, name AS nearest_zone, round(dist, 5) AS min_dist_deg,
    CASE WHEN inside THEN 'INSIDE ' || name WHEN dist <= CAST(0.15 AS DOUBLE) THEN 'Near ' || name ELSE 'Open Waters' END AS zone_status FROM best
)"""


BEHAVIOUR = f""",
sums AS (
  SELECT vessel_id, coalesce(sum(km), 0) AS distance_travelled_km, coalesce(avg(speed), 0) AS avg_speed, coalesce(max(speed), 0) AS max_speed, coalesce(stddev_pop(speed), 0) AS speed_std,
    coalesce(avg(CASE WHEN gap_minutes > 0 THEN dspeed / gap_minutes END), 0) AS speed_change_rate, coalesce(avg(abs(heading_change)), 0) AS mean_heading_change, coalesce(max(abs(heading_change)), 0) AS max_heading_change,
    coalesce(stddev_pop(abs(heading_change)), 0) AS heading_change_std, avg(CASE WHEN speed <= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS stationary_ratio, coalesce(max(gap_minutes), 0) AS max_ais_gap_minutes,
    coalesce(avg(gap_minutes), 0) AS mean_ais_gap_minutes, count(CASE WHEN gap_minutes >= 30 THEN 1 END) AS significant_gap_count, coalesce(sum(gap_minutes), 0) AS trajectory_duration_minutes, count(*) AS position_count,
    {haversine("min(latitude)", "min(longitude)", "max(latitude)", "max(longitude)")} AS diagonal
  FROM steps GROUP BY vessel_id
),
behave AS (
  SELECT *, CASE WHEN mean_heading_change > 0 AND mean_ais_gap_minutes > 0 THEN mean_heading_change / mean_ais_gap_minutes ELSE 0 END AS turning_rate,
    least(1, CASE WHEN position_count >= 2 AND distance_travelled_km > 1e-6 THEN CAST(0.6 AS DOUBLE) * (1 - least(diagonal / (distance_travelled_km + CAST(1e-6 AS DOUBLE)), 1)) ELSE 0 END + CAST(0.4 AS DOUBLE) * stationary_ratio) AS loitering_score
  FROM sums
)"""

LABELS = """,
flags AS (
  SELECT *, list_filter([CASE WHEN loitering_score >= 0.6 THEN 'LOITERING' END, CASE WHEN stationary_ratio >= 0.5 THEN 'SLOW_MOVEMENT' END, CASE WHEN mean_heading_change >= 45 THEN 'HIGH_TURNING' END,
      CASE WHEN significant_gap_count > 0 OR max_ais_gap_minutes >= 30 THEN 'AIS_GAP' END, CASE WHEN speed_std >= 6 THEN 'SPEED_ANOMALY' END], lambda x: x IS NOT NULL) AS found
  FROM behave
),
labelled AS (
  SELECT *, CASE WHEN position_count <= 1 THEN ['INSUFFICIENT_DATA'] WHEN len(found) = 0 THEN ['NORMAL_TRANSIT'] WHEN len(found) >= 2 THEN list_append(found, 'MIXED_SUSPICIOUS') ELSE found END AS behavior_labels,
    array_to_string(list_transform(found, lambda x: CASE x WHEN 'LOITERING' THEN 'prolonged loitering' WHEN 'SLOW_MOVEMENT' THEN 'sustained low-speed/stationary movement' WHEN 'HIGH_TURNING' THEN 'frequent sharp course changes'
      WHEN 'AIS_GAP' THEN 'significant AIS gap (' || CAST(CAST(floor(max_ais_gap_minutes) AS BIGINT) AS VARCHAR) || ' min)' ELSE 'highly variable speed' END), ', ') AS said
  FROM flags
)"""

FEATURES = f""",
turned AS (SELECT *, abs({turn(f"lag(bearing) OVER {W}", "bearing")}) AS turn FROM steps),
paths AS (
  SELECT vessel_id, count(step_deg) AS n_steps, coalesce(sum(step_deg), 0) AS path, coalesce(var_pop(turn), 0) AS heading_variance, coalesce(avg(turn), 0) AS bearing_change_rate, avg(step_deg) AS m, stddev_pop(step_deg) AS s,
    arg_min(struct_pack(a := latitude, o := longitude), struct_pack(us := us, seq := seq)) AS f, arg_max(struct_pack(a := latitude, o := longitude), struct_pack(us := us, seq := seq)) AS l
  FROM turned GROUP BY vessel_id
),
ratios AS (
  SELECT *, CASE WHEN path > 1e-6 THEN least(sqrt(pow(l.a - f.a, 2) + pow(l.o - f.o, 2)) / path, 1) ELSE 1 END AS displacement, CASE WHEN n_steps > 1 AND m > 1e-8 THEN least(s / m, 1) ELSE 0 END AS erratic FROM paths
),
base AS (
  SELECT vessel_id, round(speed, 3) AS speed, round(least(1, CASE WHEN speed < 3 THEN (3 - speed) / 3 WHEN speed > 9 THEN (speed - 9) / 9 ELSE 0 END), 4) AS speed_deviation,
    round(CASE WHEN n_steps = 0 THEN 0 ELSE heading_variance END, 4) AS heading_variance, round(CASE WHEN n_steps = 0 THEN 1 ELSE displacement END, 4) AS displacement_ratio,
    round(CASE WHEN n_steps = 0 THEN 0 ELSE least(1, (1 - displacement) * CAST(0.7 AS DOUBLE) + greatest(0, 1 - speed / 3) * CAST(0.3 AS DOUBLE)) END, 4) AS loitering_score, round(path, 5) AS path_length_deg,
    round(CASE WHEN n_steps = 0 THEN 0 ELSE bearing_change_rate END, 4) AS bearing_change_rate, round(CASE WHEN inside THEN 1 ELSE greatest(0, 1 - min_dist_deg / CAST(0.3 AS DOUBLE)) END, 4) AS zone_proximity_norm,
    round(CASE WHEN n_steps = 0 THEN 0 ELSE erratic END, 4) AS erratic_score
  FROM latest JOIN ratios USING (vessel_id) JOIN geo USING (vessel_id)
)"""

BASE = CLEAN_SQL + LATEST + STEPS + zones("latest", "vessel_id") + FEATURES

N = "CAST(substr(vessel_id, 2) AS BIGINT)"
RISK = BASE + BEHAVIOUR + LABELS + f""",
inputs AS (
  SELECT b.vessel_id, g.inside, g.near, g.zone_name, g.nearest_zone, g.zone_status, b.speed, b.speed_deviation, b.loitering_score, b.zone_proximity_norm, b.erratic_score, round(l.mean_heading_change, 2) AS mean_heading_change,
    ((n * 7) % 100) / CAST(100 AS DOUBLE) AS iso, CASE WHEN n % 4 = 0 THEN 0 ELSE ((n * 3) % 100) / CAST(100 AS DOUBLE) END AS temp, greatest(round(l.max_ais_gap_minutes, 2), CASE WHEN n % 5 = 0 THEN n % 70 ELSE 0 END) AS gap
  FROM (SELECT *, {N} AS n FROM base) b JOIN geo g USING (vessel_id) JOIN labelled l USING (vessel_id)
),
comps AS (
  SELECT *, CASE WHEN inside THEN 1 WHEN near THEN zone_proximity_norm ELSE 0 END AS c_geo, least(1, greatest(loitering_score, speed_deviation, erratic_score, mean_heading_change / 120)) AS c_beh,
    CASE WHEN gap < 20 THEN 0 ELSE least(gap / 60, 1) END AS c_gap FROM inputs
),
scored AS (
  SELECT *, CAST(round_even(least(CAST(0.3 AS DOUBLE) * c_geo + CAST(0.25 AS DOUBLE) * iso + CAST(0.15 AS DOUBLE) * temp + CAST(0.2 AS DOUBLE) * c_beh + CAST(0.1 AS DOUBLE) * c_gap, 1) * 100, 0) AS INT) AS overall_score FROM comps
),
risk AS (
  SELECT *, CASE WHEN overall_score >= 55 THEN 'HIGH' WHEN overall_score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN inside AND loitering_score > 0.5 THEN 'Loitering / Zone Violation' WHEN inside THEN 'Zone Violation' WHEN loitering_score > 0.6 THEN 'Suspicious Loitering' WHEN erratic_score > 0.5 THEN 'Erratic Movement'
      WHEN speed_deviation > 0.4 THEN 'Speed Anomaly' WHEN near THEN 'Proximity to Restricted Zone' WHEN iso >= 0.55 THEN 'Anomalous Behaviour' WHEN speed <= 9 THEN 'Normal Fishing' ELSE 'Normal Transit' END AS behavior,
    CAST(round_even(gap, 0) AS INT) AS ais_gap_minutes, 'Significant AIS gap (' || CAST(CAST(floor(gap) AS INT) AS VARCHAR) || ' min)' AS gap_text
  FROM scored
),
factors AS (
  SELECT vessel_id, place, factor, CAST(round_even(c * w * 100, 0) AS INT) AS contribution, CAST(round(w * 100) AS INT) AS max_weight FROM (
    SELECT vessel_id, 1 AS place, CASE WHEN inside THEN 'Inside monitoring zone (' || zone_name || ')' WHEN near THEN 'Near monitoring zone (' || nearest_zone || ')' END AS factor, c_geo AS c, CAST(0.3 AS DOUBLE) AS w FROM risk
    UNION ALL SELECT vessel_id, 2, 'Isolation Forest anomaly', iso, CAST(0.25 AS DOUBLE) FROM risk
    UNION ALL SELECT vessel_id, 3, 'Temporal sequence anomaly', temp, CAST(0.15 AS DOUBLE) FROM risk
    UNION ALL SELECT vessel_id, 4, 'Behavioural anomaly (loitering/turning/speed)', c_beh, CAST(0.2 AS DOUBLE) FROM risk
    UNION ALL SELECT vessel_id, 5, gap_text, c_gap, CAST(0.1 AS DOUBLE) FROM risk)
  WHERE factor IS NOT NULL AND round(c, 4) > 0.01
),
reasons AS (SELECT vessel_id, arg_min(factor, struct_pack(c := -contribution, p := place)) AS reason, array_to_string(list(factor ORDER BY place)[1:3], '; ') AS top_factors FROM factors GROUP BY vessel_id),
alerts AS (
  SELECT risk_level AS level, vessel_id, overall_score, coalesce(reason, behavior) AS reason,
    CASE WHEN contains(behavior, 'Zone Violation') OR contains(zone_status, 'INSIDE') THEN vessel_id || ' detected inside monitoring zone — ' || zone_status || '. Suspicious fishing-related behaviour indicators detected.'
      WHEN contains(behavior, 'Loitering') THEN vessel_id || ' sustained loitering behaviour (risk ' || overall_score || '/100). Suspicious fishing-related behaviour indicators detected.'
      WHEN ais_gap_minutes >= 20 THEN vessel_id || ' AIS signal gap of ' || ais_gap_minutes || ' minutes — suspicious reporting-gap behaviour indicator.'
      WHEN contains(coalesce(reason, behavior), 'Temporal') THEN vessel_id || ' elevated temporal sequence anomaly (risk ' || overall_score || '/100).'
      WHEN contains(behavior, 'Speed Anomaly') THEN vessel_id || ' speed anomaly — movement inconsistent with normal fishing.'
      WHEN contains(behavior, 'Erratic') THEN vessel_id || ' erratic course changes — behaviour inconsistent with transit.'
      WHEN contains(behavior, 'Proximity') OR contains(zone_status, 'Near') THEN vessel_id || ' operating close to monitoring zone (' || zone_status || ') — monitor.'
      WHEN contains(behavior, 'Anomalous') THEN vessel_id || ' flagged by anomaly detection (risk ' || overall_score || '/100).'
      ELSE vessel_id || ' risk ' || overall_score || '/100 — ' || coalesce(reason, behavior) || '.' END AS message
  FROM risk LEFT JOIN reasons USING (vessel_id) WHERE risk_level <> 'LOW'
)"""

TICKS = CLEAN_SQL + """,
ticked AS (SELECT *, CAST((row_number() OVER (ORDER BY us, vessel_id, seq) - 1) // greatest(1, (SELECT count(*) FROM clean) // 60) AS INT) AS tick FROM clean)"""

RULES = CLEAN_SQL + """,
tr AS (
  SELECT vessel_id, seq, CAST(floor(us / CAST(600000000 AS DOUBLE)) AS BIGINT) AS tick, seq % 10 = 0 AS zone, (seq * 3) % 100 >= 34 AS quiet, (seq * 7) % 100 >= 60 AS odd, (seq * 11) % 100 >= 55 AS temp, CAST((seq * 13) % 101 AS INT) AS overall_score FROM clean
),
called AS (
  SELECT vessel_id, tick, overall_score, unnest(list_filter([CASE WHEN zone THEN 'ZONE_ENTRY' END, CASE WHEN quiet THEN 'AIS_GAP' END, CASE WHEN odd THEN 'BEHAVIOUR_ANOMALY' END, CASE WHEN temp THEN 'TEMPORAL_ANOMALY' END,
    CASE WHEN overall_score >= 55 THEN 'HIGH_RISK' END, CASE WHEN CAST(zone AS INT) + CAST(quiet AS INT) + CAST(odd AS INT) + CAST(temp AS INT) >= 2 THEN 'COMBINED' END], lambda x: x IS NOT NULL)) AS alert_type FROM tr
)"""

STATIC = CLEAN_SQL + """,
static AS (
  SELECT seq, CAST(user_id AS VARCHAR) AS vessel_id, CASE WHEN seq % 2 = 0 THEN 'SHIP ' || user_id END AS ship_name,
    CASE WHEN c <= 0 THEN 'Unknown' WHEN c = 30 THEN 'Fishing' WHEN c IN (31, 32) THEN 'Towing' WHEN c = 33 THEN 'Dredging' WHEN c = 34 THEN 'Diving Ops' WHEN c = 35 THEN 'Military Ops' WHEN c = 36 THEN 'Sailing' WHEN c = 37 THEN 'Pleasure Craft'
      WHEN c = 50 THEN 'Pilot Vessel' WHEN c = 51 THEN 'Search & Rescue' WHEN c = 52 THEN 'Tug' WHEN c = 53 THEN 'Port Tender' WHEN c = 54 THEN 'Anti-pollution' WHEN c = 55 THEN 'Law Enforcement' WHEN c = 58 THEN 'Medical Transport' WHEN c = 59 THEN 'Non-combatant Ship'
      WHEN c // 10 = 2 THEN 'Wing-in-Ground' WHEN c // 10 = 3 THEN 'Fishing / Special' WHEN c // 10 = 4 THEN 'High-Speed Craft' WHEN c // 10 = 6 THEN 'Passenger' WHEN c // 10 = 7 THEN 'Cargo' WHEN c // 10 = 8 THEN 'Tanker' ELSE 'Other' END AS ship_type,
    CASE WHEN seq % 3 = 0 THEN 'PORT ' || (seq % 10) END AS destination,
    CASE WHEN seq % 13 <> 0 AND seq % 29 <> 0 THEN printf('%02d-%02d %02d:%02d UTC', seq % 13, seq % 29, CASE WHEN seq % 25 = 24 THEN 0 ELSE seq % 25 END, CASE WHEN seq % 61 = 60 THEN 0 ELSE seq % 61 END) END AS eta,
    CASE WHEN seq % 4 <> 0 THEN CAST(seq % 4 AS DOUBLE) END AS draught
  FROM (SELECT *, seq % 100 AS c FROM clean WHERE seq % 7 = 0 AND seq % 31 <> 0)
)"""


def forest() -> str:
    """The score of the fixed forest for speed and displacement_ratio, as one expression."""
    c = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else None
    path = lambda n: f"(CAST(2 AS DOUBLE) * (ln({n} - 1) + CAST(0.5772156649015329 AS DOUBLE)) - CAST(2 AS DOUBLE) * ({n} - 1) / {n})" if c(n) is None else f"CAST({c(n)} AS DOUBLE)"

    def walk(tree: int, node: int) -> str:
        _, _, f, t, left, right, size, depth = next(x for x in FIXED_FOREST if x[:2] == (tree, node))
        if f < 0:
            return f"({depth} + {path(size)})"
        return f"CASE WHEN {('speed', 'displacement_ratio')[f]} < CAST({t} AS DOUBLE) THEN {walk(tree, left)} ELSE {walk(tree, right)} END"

    return f"pow(CAST(2 AS DOUBLE), -(({walk(0, 0)}) + ({walk(1, 0)})) / 2 / {path(64)})"


def fixed_z() -> list[str]:
    """The six standardised step values of the fixed sequence model."""
    values = ["coalesce(speed, 0)", "coalesce(heading_change, 0)", "dlat", "dlon", "km", "greatest(coalesce(gap_minutes, 0), 0)"]
    return [f"(({v}) - CAST({m} AS DOUBLE)) / CAST({d} AS DOUBLE)" for v, m, d in zip(values, FIXED_MEAN, FIXED_SCALE)]


TEMPORAL = f""",
zs AS (
  SELECT vessel_id, us, seq, row_number() OVER {W} AS rn, {" + ".join(fixed_z())} AS s1, {" + ".join(f"pow({z}, 2)" for z in fixed_z())} AS s2, {" ".join(f"{'-' if i % 2 else '+'} ({z})" for i, z in enumerate(fixed_z()))} AS alt
  FROM steps WHERE dlat IS NOT NULL
),
errs AS (
  SELECT vessel_id, rn, greatest(0, (sum(s2) OVER w - pow(sum(s1) OVER w, 2) / 60 - pow(sum(alt) OVER w, 2) / 60) / 60) AS error
  FROM zs WINDOW w AS (PARTITION BY vessel_id ORDER BY us, seq ROWS 9 PRECEDING)
),
temporal AS (
  SELECT vessel_id, coalesce({rounded(f"least(CAST(1 AS DOUBLE), max(error) / CAST({FIXED_REFERENCE} AS DOUBLE))", 4)}, 0) AS temporal_anomaly_score, 'scored' AS temporal_model_status
  FROM errs WHERE rn >= 10 GROUP BY vessel_id
)"""

ISOLATION = f""",
iso_raw AS (SELECT vessel_id, {forest()} AS r FROM base),
isolation AS (SELECT vessel_id, CASE WHEN max(r) OVER () - min(r) OVER () > 1e-12 THEN round((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()), 4) ELSE 0 END AS anomaly_score FROM iso_raw)"""

#: As RISK, with the fixed models' scores.
RISK_FIXED = (
    BASE + ISOLATION + TEMPORAL + RISK.removeprefix(BASE)
    .replace("((n * 7) % 100) / CAST(100 AS DOUBLE) AS iso", "(SELECT anomaly_score FROM isolation x WHERE x.vessel_id = b.vessel_id) AS iso")
    .replace("CASE WHEN n % 4 = 0 THEN 0 ELSE ((n * 3) % 100) / CAST(100 AS DOUBLE) END AS temp", "coalesce((SELECT temporal_anomaly_score FROM temporal x WHERE x.vessel_id = b.vessel_id), 0) AS temp")
)

REASONS = """SELECT vessel_id, CASE WHEN len(r) = 0 THEN ['No elevated risk indicators'] ELSE r END AS reasons FROM (SELECT vessel_id, list_filter([
  CASE WHEN inside THEN 'Inside demonstration monitoring zone (' || zone_name || ')' WHEN near THEN 'Operating near monitoring zone (' || nearest_zone || ')' END, CASE WHEN iso >= 0.55 THEN 'Elevated Isolation Forest anomaly' END,
  CASE WHEN temp >= 0.55 THEN 'Elevated temporal sequence anomaly' END, CASE WHEN loitering_score >= 0.6 THEN 'Loitering behaviour' END, CASE WHEN mean_heading_change >= 45 THEN 'High turning activity' END,
  CASE WHEN speed_deviation >= 0.4 THEN 'Speed anomaly' END, CASE WHEN c_gap > 0.01 THEN gap_text END], lambda x: x IS NOT NULL) AS r FROM risk)"""

BEHAVIOUR_PLACES = {
    "b_distance_km": ("distance_travelled_km", 3), "b_avg_speed": ("avg_speed", 2), "b_max_speed": ("max_speed", 2), "b_speed_std": ("speed_std", 3), "b_mean_heading_change": ("mean_heading_change", 2),
    "b_max_heading_change": ("max_heading_change", 2), "b_stationary_ratio": ("stationary_ratio", 4), "b_loitering_score": ("behave.loitering_score", 4), "b_max_gap_minutes": ("max_ais_gap_minutes", 2),
    "b_significant_gap_count": ("significant_gap_count", 0), "b_duration_minutes": ("trajectory_duration_minutes", 2), "b_position_count": ("position_count", 0),
}

MESSAGES = CLEAN_SQL + """,
heard AS (SELECT *, CAST(user_id AS VARCHAR) AS id, us // 1000000 * 1000000 AS t FROM clean WHERE seq % 31 <> 0 AND seq % 7 <> 0 AND seq % 11 <> 0)"""

METRICS = ["distance_travelled_km", "avg_speed", "max_speed", "speed_std", "mean_heading_change", "max_heading_change", "heading_change_std", "stationary_ratio", "loitering_score", "max_ais_gap_minutes", "mean_ais_gap_minutes", "trajectory_duration_minutes", "speed_change_rate", "turning_rate"]
BASE_PLACES = {"speed": 3, "speed_deviation": 4, "heading_variance": 4, "displacement_ratio": 4, "loitering_score": 4, "path_length_deg": 5, "bearing_change_rate": 4, "zone_proximity_norm": 4, "erratic_score": 4}
MATRIX = (
    "SELECT vessel_id, " + ", ".join(f"round(CAST(base.{n} AS DOUBLE), {d}) AS {n}" for n, d in BASE_PLACES.items())
    + ", " + ", ".join(f"{rounded(f'CAST({c} AS DOUBLE)', d)} AS {n}" for n, (c, d) in BEHAVIOUR_PLACES.items()) + " FROM base JOIN behave USING (vessel_id)"
)
COMPONENTS = {"geofence_component": "c_geo", "isolation_component": "iso", "temporal_component": "temp", "behaviour_component": "c_beh", "ais_gap_component": "c_gap"}

ORACLES: dict[str, str] = {
    "clean_positions": select(RAW_SQL, "SELECT vessel_id, seq, us, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(coalesce(speed, 0), 4) AS speed, coalesce(heading, 0) AS heading FROM judged WHERE reason IS NULL"),
    "quality_report": select(
        RAW_SQL,
        "SELECT count(*) AS input_rows, count(*) FILTER (reason IS NULL) AS output_rows, count(reason) AS rows_removed, "
        + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}_rows" for r in ("missing_timestamp", "missing_id", "missing_coordinate", "invalid_coordinate", "invalid_speed", "duplicate"))
        + ", count(DISTINCT CASE WHEN reason IS NULL THEN vessel_id END) AS unique_vessels, count(*) FILTER (reason IS NULL AND speed IS NULL) AS speed_fills, count(*) FILTER (reason IS NULL AND heading IS NULL) AS heading_fills FROM judged",
    ),
    "alias_normalise": select(RAW_SQL, "SELECT vessel_id, count(*) AS n, max(us) AS last_us, round(sum(heading), 2) AS headings FROM raw WHERE vessel_id <> '' AND us IS NOT NULL AND longitude IS NOT NULL AND latitude BETWEEN -90 AND 90 GROUP BY vessel_id"),
    "region_filter": select(CLEAN_SQL, "SELECT vessel_id, count(*) AS n FROM clean WHERE latitude BETWEEN 8 AND 13.5 AND longitude BETWEEN 78 AND 82 GROUP BY vessel_id"),
    "latest_position": select(CLEAN_SQL + LATEST, "SELECT vessel_id, latitude, longitude, speed, heading, us FROM latest"),
    "recent_window_20": select(CLEAN_SQL, "SELECT vessel_id, seq, CAST(recency AS INT) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY us DESC, seq DESC) AS recency FROM clean) WHERE recency <= 20"),
    "first_seen_prev_value": select(
        CLEAN_SQL, f"SELECT vessel_id, seq, round(lag(latitude) OVER {W}, 5) AS prev_latitude, round(lag(speed) OVER {W}, 3) AS prev_speed, first_value(us) OVER {W} AS first_us, round(first_value(longitude) OVER {W}, 5) AS first_longitude, row_number() OVER {W} AS messages FROM clean"
    ),
    "step_metrics": select(CLEAN_SQL + STEPS, "SELECT vessel_id, seq, round(km, 3) AS km, round(step_deg, 5) AS step_deg, round(heading_change, 2) AS heading_change, round(gap_minutes, 3) AS gap_minutes FROM steps"),
    "trajectory_export": select(CLEAN_SQL, "SELECT vessel_id, CAST(count(*) AS INT) AS n_points, arg_min(seq, struct_pack(us := us, seq := seq)) AS first_seq, arg_max(seq, struct_pack(us := us, seq := seq)) AS last_seq FROM clean GROUP BY vessel_id"),
    "tick_buckets": select(TICKS, "SELECT tick, count(*) AS n, max(us) AS sim_us, CAST(sum(seq) AS BIGINT) AS seqs FROM ticked GROUP BY tick"),
    "state_as_of_tick": select(TICKS, "SELECT vessel_id, arg_max(seq, struct_pack(us := us, seq := seq)) AS seq, arg_max(tick, struct_pack(us := us, seq := seq)) AS tick FROM ticked WHERE tick <= 29 GROUP BY vessel_id"),
    "tick_progress": select(TICKS, "SELECT tick, max(last) OVER (ORDER BY tick) AS us, CAST(sum(n) OVER (ORDER BY tick) AS BIGINT) AS rows_so_far, round((tick + 1) / CAST(max(tick) OVER () + 1 AS DOUBLE), 4) AS done FROM (SELECT tick, max(us) AS last, count(*) AS n FROM ticked GROUP BY tick)"),
    "geofence_latest": select(CLEAN_SQL + LATEST + zones("latest", "vessel_id"), "SELECT vessel_id, inside, zone_name, near, nearest_zone, round(min_dist_deg, 4) AS min_dist_deg, zone_status FROM geo"),
    "geofence_all_positions": select(CLEAN_SQL + zones("clean", "vessel_id, seq"), "SELECT vessel_id, zone_status, count(*) AS n FROM geo GROUP BY ALL"),
    "geofence_grid": select(CLEAN_SQL + zones("clean", "vessel_id, seq"), "SELECT vessel_id, seq, inside, zone_name, near, nearest_zone, min_dist_deg, zone_status FROM geo"),
    "behaviour_metrics": select(CLEAN_SQL + STEPS + BEHAVIOUR, f"SELECT vessel_id, {', '.join(f'round(CAST({n} AS DOUBLE), 2) AS {n}' for n in METRICS)}, significant_gap_count, position_count FROM behave"),
    "behaviour_labels": select(
        CLEAN_SQL + STEPS + BEHAVIOUR + LABELS,
        "SELECT vessel_id, array_to_string(behavior_labels, '|') AS labels, CASE WHEN position_count <= 1 THEN 'Only one position available — insufficient for behaviour analysis.' WHEN len(found) = 0 THEN 'Consistent transit movement — no notable suspicious indicators.' ELSE upper(said[1]) || substr(said, 2) || '.' END AS behavior_summary FROM labelled",
    ),
    "base_features": select(BASE, f"SELECT vessel_id, {', '.join(f'round(CAST({n} AS DOUBLE), {d}) AS {n}' for n, d in BASE_PLACES.items())} FROM base"),
    "feature_matrix": select(BASE + BEHAVIOUR, MATRIX),
    "feature_json_values": select(BASE + BEHAVIOUR, f"SELECT vessel_id, feature, round(value, 5) AS value FROM (UNPIVOT ({MATRIX}) ON COLUMNS(* EXCLUDE (vessel_id)) INTO NAME feature VALUE value)"),
    "temporal_fixed_score": select(CLEAN_SQL + STEPS + TEMPORAL, f"""SELECT v.vessel_id, {rounded("coalesce(temporal_anomaly_score, 0)", 3)} AS temporal_anomaly_score, coalesce(temporal_model_status, 'insufficient_data') AS temporal_model_status
FROM (SELECT DISTINCT vessel_id FROM clean) v LEFT JOIN temporal USING (vessel_id)"""),
    "ranked_risk_fixed": select(RISK_FIXED, f"SELECT vessel_id, overall_score, risk_level, behavior, zone_status, array_to_string(r.reasons, '; ') AS reasons FROM risk JOIN ({REASONS}) r USING (vessel_id)"),
    "anomaly_ranking": select(BASE + ISOLATION, f"SELECT vessel_id, printf('%.3f', {rounded('anomaly_score', 3)}) AS score, CASE WHEN anomaly_score >= 0.55 THEN 'yes' ELSE 'no' END AS flag FROM isolation"),
    "high_risk_top_factors": select(RISK, "SELECT vessel_id, overall_score, top_factors FROM risk JOIN reasons USING (vessel_id) WHERE risk_level = 'HIGH'"),
    "alert_panel": select(RISK, "SELECT level, vessel_id, reason, overall_score FROM alerts ORDER BY level <> 'HIGH', overall_score DESC, vessel_id LIMIT 10"),
    "fleet_enriched": select(RISK, "SELECT vessel_id, l.latitude, l.longitude, overall_score, risk_level, risk.behavior, risk.zone_status FROM latest l JOIN risk USING (vessel_id)"),
    "vessel_track": select(CLEAN_SQL + LATEST, "SELECT vessel_id, seq, us, round(latitude, 5) AS latitude FROM clean WHERE vessel_id = (SELECT vessel_id FROM latest ORDER BY us DESC, vessel_id LIMIT 1)"),
    "vessel_report": select(
        RISK + TEMPORAL,
        f"""SELECT risk.vessel_id, overall_score, risk_level, base.path_length_deg, {rounded(rounded("behave.max_ais_gap_minutes", 2), 1)} AS max_ais_gap_minutes, {rounded("coalesce(temporal_anomaly_score, 0)", 3)} AS temporal_anomaly_score
FROM risk JOIN base USING (vessel_id) JOIN behave USING (vessel_id) LEFT JOIN temporal USING (vessel_id) ORDER BY overall_score DESC, risk.vessel_id LIMIT 1""",
    ),
    "message_counters": select(
        MESSAGES,
        """SELECT count(*) AS messages, (SELECT count(*) FROM heard) AS positions, count(*) FILTER (seq % 7 = 0 AND seq % 31 <> 0) AS static_messages, count(*) - (SELECT count(*) FROM heard) - count(*) FILTER (seq % 7 = 0 AND seq % 31 <> 0) AS failures,
  (SELECT count(DISTINCT id) FROM heard) AS vessels, (SELECT max(t) FROM heard) AS last_us FROM clean""",
    ),
    "evicted_count": select(CLEAN_SQL + LATEST, "SELECT count(*) FILTER ((SELECT max(us) FROM clean) - us > 3600000000) AS evicted, count(*) FILTER ((SELECT max(us) FROM clean) - us <= 3600000000) AS active FROM latest"),
    "sequence_windows": select(
        CLEAN_SQL + STEPS,
        f"""SELECT vessel_id, count(*) AS n_windows, max(start) AS last_start, round(sum(total), 1) AS total FROM (
  SELECT vessel_id, CAST(rn - 10 AS INT) AS start, sum(v) OVER (PARTITION BY vessel_id ORDER BY us, seq ROWS 9 PRECEDING) AS total, rn
  FROM (SELECT vessel_id, us, seq, speed + coalesce(heading_change, 0) + dlat + dlon + km + greatest(gap_minutes, 0) AS v, row_number() OVER {W} AS rn FROM steps WHERE dlat IS NOT NULL)) WHERE rn >= 10 AND start < 50 GROUP BY vessel_id""",
    ),
    "sequence_windows_all": select(
        CLEAN_SQL + STEPS,
        f"""SELECT vessel_id, count(*) AS n_windows, max(start) AS last_start, round(sum(total), 1) AS total FROM (
  SELECT vessel_id, CAST(rn - 10 AS INT) AS start, sum(v) OVER (PARTITION BY vessel_id ORDER BY us, seq ROWS 9 PRECEDING) AS total, rn
  FROM (SELECT vessel_id, us, seq, speed + coalesce(heading_change, 0) + dlat + dlon + km + greatest(gap_minutes, 0) AS v, row_number() OVER {W} AS rn FROM steps WHERE dlat IS NOT NULL)) WHERE rn >= 10 GROUP BY vessel_id""",
    ),
    "iforest_fixed_score": select(
        BASE, f"SELECT vessel_id, round(s, 3) AS anomaly_score, round(s, 4) >= 0.55 AS is_anomalous FROM (SELECT vessel_id, CASE WHEN max(r) OVER () - min(r) OVER () > 1e-12 THEN round((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()), 4) ELSE 0 END AS s FROM (SELECT vessel_id, {forest()} AS r FROM base))"
    ),
    "minmax_normalise": select(CLEAN_SQL + STEPS + BEHAVIOUR, "SELECT vessel_id, round((avg_speed - min(avg_speed) OVER ()) / (max(avg_speed) OVER () - min(avg_speed) OVER ()), 4) AS scaled FROM behave"),
    "risk_components": select(RISK, f"SELECT vessel_id, {', '.join(f'round(round(CAST({c} AS DOUBLE), 4), 3) AS {n}' for n, c in COMPONENTS.items())}, ais_gap_minutes FROM risk"),
    "risk_scores": select(
        RISK,
        "SELECT vessel_id, overall_score, risk_level, behavior, zone_status, CASE risk_level WHEN 'HIGH' THEN 'Multiple or strong suspicious fishing-related behaviour indicators detected.' WHEN 'MEDIUM' THEN 'Some suspicious behaviour indicators present; monitor.' ELSE 'No significant suspicious behaviour indicators.' END AS explanation FROM risk",
    ),
    "risk_factor_breakdown": select(RISK, "SELECT vessel_id, factor, contribution, max_weight FROM factors"),
    "risk_reasons": select(
        RISK,
        """SELECT vessel_id, CASE WHEN len(r) = 0 THEN 'No elevated risk indicators' ELSE array_to_string(r, '|') END AS reasons FROM (SELECT vessel_id, list_filter([
  CASE WHEN inside THEN 'Inside demonstration monitoring zone (' || zone_name || ')' WHEN near THEN 'Operating near monitoring zone (' || nearest_zone || ')' END, CASE WHEN iso >= 0.55 THEN 'Elevated Isolation Forest anomaly' END,
  CASE WHEN temp >= 0.55 THEN 'Elevated temporal sequence anomaly' END, CASE WHEN loitering_score >= 0.6 THEN 'Loitering behaviour' END, CASE WHEN mean_heading_change >= 45 THEN 'High turning activity' END,
  CASE WHEN speed_deviation >= 0.4 THEN 'Speed anomaly' END, CASE WHEN c_gap > 0.01 THEN gap_text END], lambda x: x IS NOT NULL) AS r FROM risk)""",
    ),
    "risk_alerts": select(RISK, "SELECT level, vessel_id, message, reason, overall_score FROM alerts"),
    "fleet_stats": select(RISK, "SELECT count(*) AS total, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low, (SELECT count(*) FROM alerts WHERE level = 'HIGH') AS active_high_alerts FROM risk"),
    "fleet_ranked": select(RISK, "SELECT vessel_id, overall_score, risk_level, behavior, zone_status FROM risk"),
    "medium_risk_top_factors": select(RISK, "SELECT vessel_id, overall_score, top_factors FROM risk JOIN reasons USING (vessel_id) WHERE risk_level = 'MEDIUM'"),
    "score_histogram": select(RISK, "SELECT CAST(least(overall_score // 10 + 1, 10) AS INT) AS bucket, count(*) AS vessels FROM risk GROUP BY 1"),
    "stream_alert_rules": select(RULES, "SELECT vessel_id, alert_type, CASE WHEN alert_type IN ('HIGH_RISK', 'COMBINED') OR (alert_type = 'ZONE_ENTRY' AND overall_score >= 55) THEN 'HIGH' ELSE 'MEDIUM' END AS level, count(*) AS n FROM called GROUP BY ALL"),
    "alert_cooldown": "WITH RECURSIVE " + RULES + """,
seen AS (SELECT DISTINCT vessel_id, alert_type, tick FROM called),
fired AS (
  SELECT vessel_id, alert_type, min(tick) AS tick FROM seen GROUP BY vessel_id, alert_type
  UNION ALL
  SELECT f.vessel_id, f.alert_type, min(s.tick) FROM fired f JOIN seen s ON s.vessel_id = f.vessel_id AND s.alert_type = f.alert_type AND s.tick >= f.tick + 10 GROUP BY f.vessel_id, f.alert_type
)
SELECT vessel_id, alert_type, tick FROM fired""",
    "vessel_upsert": select(
        CLEAN_SQL,
        """SELECT vessel_id, least(o.a, n.a) AS first_us, greatest(o.b, n.b) AS last_us, 'feed' AS source, CASE WHEN n.b IS NULL OR o.b >= n.b THEN 'old' ELSE 'new' END AS region
FROM (SELECT vessel_id, min(us) AS a, max(us) AS b FROM clean WHERE seq % 3 <> 0 GROUP BY vessel_id) o FULL JOIN (SELECT vessel_id, min(us) AS a, max(us) AS b FROM clean WHERE seq % 2 = 0 GROUP BY vessel_id) n USING (vessel_id)""",
    ),
    "positions_anti_append": select(CLEAN_SQL, "SELECT vessel_id, count(*) AS n FROM clean WHERE seq % 2 = 0 AND seq % 3 = 0 GROUP BY vessel_id"),
    "recent_alerts_topk": select(RULES, "SELECT DISTINCT vessel_id, alert_type, tick AS created_at, overall_score FROM called ORDER BY tick DESC, vessel_id || alert_type || lpad(CAST(overall_score AS VARCHAR), 3, '0') DESC LIMIT 20"),
    "vessel_recent_topk": select(CLEAN_SQL, "SELECT vessel_id, seq, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY us DESC, seq DESC) AS rn FROM clean) WHERE rn <= 3"),
    "parse_position_json": select(
        CLEAN_SQL,
        """SELECT seq, CAST(user_id AS VARCHAR) AS vessel_id, round(latitude, 5) AS latitude, round(longitude, 5) AS longitude, CASE WHEN seq % 5 <> 0 THEN round(speed, 3) END AS speed, heading, CAST(seq % 16 AS INT) AS nav_status, us // 1000000 * 1000000 AS us
FROM clean WHERE seq % 31 <> 0 AND seq % 7 <> 0 AND seq % 11 <> 0""",
    ),
    "parse_static_json": select(STATIC, "SELECT seq, vessel_id, ship_name, ship_type, destination, eta, draught FROM static"),
    "ship_type_decode": select(STATIC.replace("seq % 100 AS c FROM clean WHERE seq % 7 = 0 AND seq % 31 <> 0", "seq % 105 - 3 AS c FROM clean"), "SELECT ship_type, count(*) AS n FROM static GROUP BY ship_type"),
    "static_merge": select(
        STATIC,
        "SELECT vessel_id, arg_max(ship_name, CASE WHEN ship_name IS NOT NULL THEN seq END) AS ship_name, coalesce(arg_max(ship_type, CASE WHEN ship_type <> 'Unknown' THEN seq END), 'Unknown') AS ship_type, arg_max(destination, CASE WHEN destination IS NOT NULL THEN seq END) AS destination, arg_max(eta, CASE WHEN eta IS NOT NULL THEN seq END) AS eta, arg_max(draught, CASE WHEN draught IS NOT NULL THEN seq END) AS draught FROM static GROUP BY vessel_id",
    ),
    "stale_eviction": select(CLEAN_SQL + LATEST, "SELECT vessel_id FROM latest WHERE (SELECT max(us) FROM clean) - us <= 3600000000"),
    "session_gaps": select(
        CLEAN_SQL,
        f"SELECT vessel_id, min(us) AS start_us, count(*) AS positions FROM (SELECT *, sum(fresh) OVER {W} AS s FROM (SELECT *, CASE WHEN us - lag(us) OVER {W} < 1800000000 THEN 0 ELSE 1 END AS fresh FROM clean)) GROUP BY vessel_id, s",
    ),
    "tumbling_counts": select(CLEAN_SQL, "SELECT us // 3600000000 * 3600000000 AS start_us, count(*) AS messages FROM clean GROUP BY 1"),
}
STATIC_LAST = (
    "SELECT vessel_id, arg_max(ship_name, CASE WHEN ship_name IS NOT NULL THEN k END) AS ship_name, arg_max(ship_type, CASE WHEN ship_type <> 'Unknown' THEN k END) AS ship_type, arg_max(destination, CASE WHEN destination IS NOT NULL THEN k END) AS destination "
    "FROM (SELECT static.*, struct_pack(t := us // 1000000, s := static.seq) AS k FROM static JOIN clean ON static.seq = clean.seq) GROUP BY vessel_id"
)
ORACLES["streaming_alerts"] = ORACLES["alert_cooldown"]
ORACLES["streaming_state"] = select(
    STATIC,
    f"""SELECT id AS vessel_id, p.t AS us, round(p.latitude, 5) AS latitude, round(p.longitude, 5) AS longitude, round(p.speed, 5) AS speed, round(q.latitude, 5) AS prev_latitude, round(q.speed, 5) AS prev_speed, p.nav_status, q.heading AS prev_heading, first_us, messages,
  CAST(least(messages, 50) AS INT) AS track_points, ship_name, ship_type, destination
FROM (SELECT id, list(struct_pack(t := t, latitude := latitude, longitude := longitude, speed := CASE WHEN seq % 5 <> 0 THEN speed END, heading := heading, nav_status := CAST(seq % 16 AS INT)) ORDER BY t DESC, seq DESC) AS ps, min(t) AS first_us, count(*) AS messages,
    ps[1] AS p, ps[2] AS q FROM (SELECT *, CAST(user_id AS VARCHAR) AS id, us // 1000000 * 1000000 AS t FROM clean WHERE seq % 31 <> 0 AND seq % 7 <> 0 AND seq % 11 <> 0) GROUP BY id)
  LEFT JOIN ({STATIC_LAST}) s ON s.vessel_id = id""",
)
ORACLES["live_table"] = select(
    RISK + STATIC.removeprefix(CLEAN_SQL),
    f"""SELECT l.vessel_id, coalesce(ship_name, '') AS ship_name, coalesce(ship_type, 'Unknown') AS ship_type, coalesce(destination, '') AS destination, coalesce(overall_score, 0) AS overall_score, coalesce(risk_level, 'LOW') AS risk_level
FROM latest l LEFT JOIN (SELECT 'V' || lpad(vessel_id, 4, '0') AS vessel_id, arg_max(ship_name, CASE WHEN ship_name IS NOT NULL THEN seq END) AS ship_name, arg_max(ship_type, CASE WHEN ship_type <> 'Unknown' THEN seq END) AS ship_type, arg_max(destination, CASE WHEN destination IS NOT NULL THEN seq END) AS destination
    FROM static GROUP BY vessel_id) s USING (vessel_id) LEFT JOIN (SELECT vessel_id, overall_score, risk_level FROM risk WHERE overall_score >= 20) r USING (vessel_id)""",
)
ORACLES["ingest_report"] = select(
    RAW_SQL,
    "SELECT count(*) AS input_rows, count(*) FILTER (NOT ok) AS dropped_rows, count(*) FILTER (ok) AS positions, count(DISTINCT CASE WHEN ok THEN vessel_id END) AS vessels "
    "FROM (SELECT *, vessel_id <> '' AND us IS NOT NULL AND longitude IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AS ok FROM raw)",
)
ORACLES["dedupe_exact"] = select(TRACKS_SQL, "SELECT CAST(CASE WHEN seq % 50 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n, count(*) AS positions FROM tracks GROUP BY 1")
ORACLES["history_summary"] = select(
    RISK,
    "SELECT count(*) AS vessels, (SELECT count(*) FROM (SELECT DISTINCT vessel_id, us, latitude, longitude FROM clean)) AS positions, 2 * count(*) AS risk_scores, 2 * (SELECT count(*) FROM alerts) AS alerts, 2 * (SELECT count(*) FROM alerts WHERE level = 'HIGH') AS high_alerts FROM risk",
)
ORACLES["history_recent_risk"] = select(RISK, "SELECT vessel_id, overall_score, risk_level FROM risk CROSS JOIN (VALUES (1), (2)) runs(run) ORDER BY run DESC, vessel_id DESC LIMIT 20")
ORACLES["history_vessel"] = select(RISK, "SELECT vessel_id, overall_score, behavior FROM risk CROSS JOIN (VALUES (1), (2)) WHERE vessel_id = (SELECT min(vessel_id) FROM risk)")
HOUR = 3_600_000_000
ORACLES["streaming_counts"] = select(
    CLEAN_SQL,
    f"""SELECT ws AS start_us, risk_level, count(*) AS messages, count(DISTINCT vessel_id) AS vessels
FROM (SELECT *, CASE WHEN seq % 97 = 0 THEN 3 WHEN seq % 10 = 0 THEN least(3, quarter + 1) ELSE quarter END AS b FROM (
    SELECT *, us // {HOUR} * {HOUR} AS ws, least(3, (us - {START}) // (3 * {HOUR})) AS quarter,
      CASE WHEN (seq * 13) % 101 >= 55 THEN 'HIGH' WHEN (seq * 13) % 101 >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM clean)) r,
  (SELECT max(us) // 1000 * 1000 - 3 * {HOUR} AS last, max(us) FILTER (seq % 97 <> 0 AND (us - {START}) // (3 * {HOUR}) + CAST(seq % 10 = 0 AS INT) <= 2) // 1000 * 1000 - 3 * {HOUR} AS before FROM clean) marks
WHERE ws + {HOUR} <= marks.last AND NOT (b = 3 AND ws + {HOUR} <= marks.before) GROUP BY ws, risk_level""",
)
ORACLES["streaming_evictions"] = select(
    CLEAN_SQL,
    f"""SELECT vessel_id, count(*) AS evictions FROM (SELECT vessel_id, us, lead(us) OVER {W} AS after, (SELECT max(us) FROM clean) AS last FROM clean)
WHERE after - us > {HOUR} OR (after IS NULL AND us // 1000 + {HOUR} // 1000 <= last // 1000 - 60000) GROUP BY vessel_id""",
)
ORACLES["live_rescore"] = select(
    f"bounds AS (SELECT min(r) AS low, max(r) AS high FROM (WITH {BASE} SELECT {forest()} AS r FROM base)),\n"
    + RISK_FIXED.replace("clean AS (SELECT * REPLACE (nullif(heading, 511) AS heading) FROM tracks)", f"clean AS (SELECT * REPLACE (nullif(heading, 511) AS heading) FROM tracks QUALIFY row_number() OVER {W.replace('us, seq', 'us DESC, seq DESC')} <= 50)").replace(
        ISOLATION.split("isolation AS ")[1], "(SELECT vessel_id, greatest(0, least(1, round((r - low) / (high - low), 4))) AS anomaly_score FROM iso_raw, bounds)"
    ),
    "SELECT vessel_id, overall_score, risk_level FROM risk",
)
ORACLES["csv_ingest"] = select(RAW_SQL, "SELECT vessel_id, count(*) AS n, max(us) AS last_us, round(max(speed), 4) AS top_speed FROM raw WHERE vessel_id <> '' AND us IS NOT NULL AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90 GROUP BY vessel_id")
ORACLES["order_without_times"] = select(CLEAN_SQL, f"SELECT vessel_id, {rounded('arg_max(latitude, seq)', 4)} AS latitude, {rounded('arg_max(longitude, seq)', 4)} AS longitude, true AS untimed FROM clean GROUP BY vessel_id")
ORACLES["history_fallback"] = select(CLEAN_SQL + LATEST, "SELECT vessel_id, 1 AS n, 0 AS timed, latitude FROM latest")
FIRED = ORACLES["alert_cooldown"].removesuffix("SELECT vessel_id, alert_type, tick FROM fired")
ORACLES["streamed_alerts_append"] = FIRED + "SELECT alert_type, count(*) AS n, max(tick) AS last_tick FROM fired GROUP BY alert_type"
ORACLES["alert_buffer"] = FIRED + """SELECT vessel_id, alert_type, level, tick FROM (
  SELECT *, CASE WHEN alert_type IN ('HIGH_RISK', 'COMBINED') THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM fired WHERE alert_type <> 'ZONE_ENTRY' ORDER BY tick DESC, vessel_id || alert_type DESC LIMIT 50)
ORDER BY level <> 'HIGH', tick DESC, vessel_id, alert_type LIMIT 8"""
STEP_VALUES = ["coalesce(speed, 0)", "coalesce(heading_change, 0)", "dlat", "dlon", "km", "greatest(coalesce(gap_minutes, 0), 0)"]
ORACLES["sequence_moments"] = select(
    CLEAN_SQL
    + STEPS
    + f""",
stepped AS (SELECT vessel_id, us, seq, row_number() OVER {W} AS rn, {", ".join(f"{v} AS v{i}" for i, v in enumerate(STEP_VALUES))} FROM steps WHERE dlat IS NOT NULL),
placed AS (SELECT rn, {", ".join(f"lag(v{i}, {9 - k}) OVER {W} AS p{6 * k + i}" for k in range(10) for i in range(6))} FROM stepped)""",
    " UNION ALL ".join(f"SELECT {p} AS place, round(avg(p{p}), 3) + 0.0 AS mean, round(stddev_pop(p{p}), 3) AS deviation FROM placed WHERE rn >= 10" for p in range(60)),
)
ORACLES["sequence_reference"] = select(CLEAN_SQL + STEPS + TEMPORAL, "SELECT round(quantile_cont(error, 0.95), 4) AS reference, count(*) AS windows FROM errs WHERE rn >= 10")
#: Tracks of places alone, in the order of seq.
PLACES_SQL = CLEAN_SQL.replace("nullif(heading, 511) AS heading", "CAST(NULL AS DOUBLE) AS heading, CAST(NULL AS DOUBLE) AS speed, CAST(NULL AS BIGINT) AS us")
ORACLES["behaviour_by_place"] = ORACLES["behaviour_metrics"].replace(CLEAN_SQL, PLACES_SQL)
ORACLES["sequence_training"] = select(
    CLEAN_SQL + STEPS,
    f"""SELECT vessel_id, count(*) AS n_windows, round(sum(total), 1) AS total FROM (
  SELECT vessel_id, total, row_number() OVER (ORDER BY vessel_id, rn) AS place FROM (
    SELECT vessel_id, rn, sum(v) OVER (PARTITION BY vessel_id ORDER BY us, seq ROWS 9 PRECEDING) AS total
    FROM (SELECT vessel_id, us, seq, speed + coalesce(heading_change, 0) + dlat + dlon + km + greatest(gap_minutes, 0) AS v, row_number() OVER {W} AS rn FROM steps WHERE dlat IS NOT NULL)) WHERE rn >= 10 AND rn < 60) WHERE place <= 5000 GROUP BY vessel_id""",
)
ORACLES["replay_ticks"] = select(TICKS.replace("// 60)", "// 12)"), "SELECT tick AS batch, tick, count(*) AS n, max(us) AS sim_us, CAST(sum(seq) AS BIGINT) AS seqs FROM ticked GROUP BY tick")
ORACLES["model_store"] = select(
    CLEAN_SQL,
    """SELECT model, run, status, count(DISTINCT vessel_id) AS vessels FROM clean CROSS JOIN (VALUES ('forest', 'empty store', 'trained'), ('forest', 'same features', 'loaded'), ('forest', 'fewer features', 'retrained'),
  ('forest', 'other order', 'retrained'), ('forest', 'damaged', 'trained'), ('sequences', 'empty store', 'trained'), ('sequences', 'same length', 'loaded'), ('sequences', 'other length', 'retrained')) runs(model, run, status) GROUP BY ALL""",
)
