"""Texts of results, and columns made from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# These texts are what results show and must be word for word as they are. Names in braces are
# filled in.
SHOWN = "Suspicious fishing-related behaviour indicators detected."
ALERTS = {
    "inside": "{vessel} detected inside monitoring zone — {zone}. " + SHOWN,
    "loitering": "{vessel} sustained loitering behaviour (risk {score}/100). " + SHOWN,
    "gap": "{vessel} AIS signal gap of {gap} minutes — suspicious reporting-gap behaviour indicator.",
    "temporal": "{vessel} elevated temporal sequence anomaly (risk {score}/100).",
    "speed": "{vessel} speed anomaly — movement inconsistent with normal fishing.",
    "erratic": "{vessel} erratic course changes — behaviour inconsistent with transit.",
    "near": "{vessel} operating close to monitoring zone ({zone}) — monitor.",
    "anomalous": "{vessel} flagged by anomaly detection (risk {score}/100).",
    "other": "{vessel} risk {score}/100 — {reason}.",
}
LIVE_ALERTS = {
    "ZONE_ENTRY": ("{vessel} inside monitoring zone ({zone}). Suspicious fishing-related behaviour indicators.", "Inside monitoring zone"),
    "AIS_GAP": ("{vessel} significant AIS gap ({gap} min) — suspicious reporting-gap behaviour indicator.", "Significant AIS gap"),
    "BEHAVIOUR_ANOMALY": ("{vessel} strong behavioural anomaly (loitering/turning/speed).", "Behavioural anomaly"),
    "TEMPORAL_ANOMALY": ("{vessel} elevated temporal sequence anomaly.", "Temporal anomaly"),
    "HIGH_RISK": ("{vessel} HIGH risk ({score}/100). " + SHOWN, "HIGH overall risk"),
    "COMBINED": ("{vessel} multiple suspicious indicators detected ({signals} signals).", "Multiple suspicious indicators"),
}
FACTORS = {
    "inside": "Inside monitoring zone ({zone})",
    "near": "Near monitoring zone ({zone})",
    "isolation": "Isolation Forest anomaly",
    "temporal": "Temporal sequence anomaly",
    "behaviour": "Behavioural anomaly (loitering/turning/speed)",
    "gap": "Significant AIS gap ({gap} min)",
}
REASONS = {
    "inside": "Inside demonstration monitoring zone ({zone})",
    "near": "Operating near monitoring zone ({zone})",
    "isolation": "Elevated Isolation Forest anomaly",
    "temporal": "Elevated temporal sequence anomaly",
    "loitering": "Loitering behaviour",
    "turning": "High turning activity",
    "speed": "Speed anomaly",
    "none": "No elevated risk indicators",
}
LEVELS = {
    "HIGH": "Multiple or strong suspicious fishing-related behaviour indicators detected.",
    "MEDIUM": "Some suspicious behaviour indicators present; monitor.",
    "LOW": "No significant suspicious behaviour indicators.",
}
BEHAVIOUR = {
    "LOITERING": "prolonged loitering",
    "SLOW_MOVEMENT": "sustained low-speed/stationary movement",
    "HIGH_TURNING": "frequent sharp course changes",
    "AIS_GAP": "significant AIS gap ({gap} min)",
    "SPEED_ANOMALY": "highly variable speed",
    "single": "Only one position available — insufficient for behaviour analysis.",
    "transit": "Consistent transit movement — no notable suspicious indicators.",
}


def filled(text: str, **columns: Column) -> Column:
    """``text`` with the columns (as text) in place of their names in braces."""
    parts = [columns[p[1:-1]].cast("string") if p.startswith("{") else F.lit(p) for p in re.split(r"(\{[a-z]+\})", text) if p]
    return F.concat(*parts) if len(parts) > 1 else parts[0]
