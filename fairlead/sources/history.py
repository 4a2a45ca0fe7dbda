"""History tables of pipeline runs, as Parquet folders.

Every run appends a folder to each table and then one version to the manifest; readers take what the
manifest names, so a run that broke off does not show, and two runs at once both get in: the one that comes second
looks at what the first has added before it tries again.

vessels is a log of changes that is merged when it is read, so that a run writes its own vessels and not all
that were ever seen; once the log is as large as what is merged, it is merged for good. positions are laid out by
day, so that telling new positions from known ones reads the days of the run only.
"""

from __future__ import annotations

import itertools
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.sources.manifest import Manifest

POSITION_KEY = ["vessel_id", "timestamp", "latitude", "longitude", "source"]


class HistoryError(RuntimeError):
    """The history could not be written or read."""


def upsert_vessels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshot rows (vessel_id, first_seen, last_seen, source, region): the earliest first_seen
    stays, the rest comes from the row seen last."""
    return merged_vessels(old.unionByName(new))


def merged_vessels(log: DataFrame) -> DataFrame:
    """One row for each vessel of a log of such rows."""
    return log.groupBy("vessel_id").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("source", F.struct("last_seen", "source")).alias("source"),
        F.max_by("region", F.struct("last_seen", "region")).alias("region"),
    )


def new_positions(old: DataFrame, new: DataFrame, nulls_equal: bool = True) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``, one for each key. With ``nulls_equal`` a null
    timestamp equals a null one; without, rows with nulls are always new."""
    once = new.dropDuplicates(POSITION_KEY)
    same: Column = F.lit(True)
    for k in POSITION_KEY:
        same = same & (F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) if nulls_equal else F.col(f"n.{k}") == F.col(f"o.{k}"))
    return once.alias("n").join(old.select(*POSITION_KEY).alias("o"), same, "left_anti")


def recent(df: DataFrame, n: int, time: str = "created_at", order: str = "row_ord") -> DataFrame:
    """The last ``n`` rows, latest first."""
    return df.orderBy(F.desc(time), F.desc(order)).limit(n)


def recent_by_vessel(df: DataFrame, n: int, time: str = "created_at", order: str = "row_ord") -> DataFrame:
    """The last ``n`` rows of every vessel, with rn 1 for the latest."""
    w = Window.partitionBy("vessel_id").orderBy(F.desc(time), F.desc(order))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def with_day(df: DataFrame) -> DataFrame:
    """``df`` with the day of its timestamp as text; none where it has none."""
    return df.withColumn("day", F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("none")))


class HistoryStore:
    TABLES = {
        "vessels": "vessel_id string, first_seen timestamp, last_seen timestamp, source string, region string",
        "positions": "vessel_id string, timestamp timestamp, latitude double, longitude double, speed double, heading double, source string, run_id string, day string",
        "features": "vessel_id string, feature_json string, computed_at timestamp, run_id string",
        "anomaly_scores": "vessel_id string, anomaly_score double, is_anomalous boolean, computed_at timestamp, run_id string",
        "risk_scores": "vessel_id string, overall_score int, risk_level string, behavior string, zone_status string, computed_at timestamp, run_id string",
        "alerts": "vessel_id string, level string, message string, reason string, alert_type string, tick long, created_at timestamp, run_id string",
        "runs": "run_id string, source string, region string, written_at timestamp",
    }
    #: Runs after which the vessels' log may be merged, and days up to which a run's are named to prune by.
    LOG_RUNS, MOST_DAYS = 8, 1000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def table(self, name: str) -> DataFrame:
        """A table's rows of complete runs; empty if it is not there yet."""
        return self._of(self.manifest.versions(), name)

    def _of(self, versions: list[dict], name: str) -> DataFrame:
        """A table as of these versions."""
        runs = [v for v in versions if v["run_id"]]
        if name == "runs":
            rows = [(v["run_id"], v["source"], v["region"], datetime.fromisoformat(v["written_at"])) for v in runs]
            return self.spark.createDataFrame(rows, self.TABLES[name])
        if name != "vessels":
            return self._read(name, [v["parts"][name] for v in runs])
        base = [v for v in versions if v["compacted"]][-1:]
        parts = [v["compacted"] for v in base] + [v["parts"][name] for v in runs if not base or v["version"] > base[0]["upto"]]
        return merged_vessels(self._read(name, parts))

    def _read(self, name: str, parts: list[str]) -> DataFrame:
        """The rows in these folders; run_id and day are in their paths."""
        if not parts:
            return self.spark.createDataFrame([], self.TABLES[name])
        reader = self.spark.read.schema(self.TABLES[name]).option("basePath", f"{self.path}/{name}")
        return reader.parquet(*(f"{self.path}/{name}/{p}" for p in parts)).select(*(x.split(" ")[0] for x in self.TABLES[name].split(", ")))

    def _write(self, name: str, part: str, df: DataFrame, by: tuple[str, ...] = ()) -> int:
        """Writes a folder; how many rows it has, counted as they pass."""
        seen = Observation()
        watched = df.drop("run_id").observe(seen, F.count(F.lit(1)).alias("n"))
        watched.write.partitionBy(*by).option("parquet.bloom.filter.enabled#vessel_id", "true").parquet(f"{self.path}/{name}/{part}")
        return seen.get["n"]

    def known_positions(self, versions: list[dict], places: DataFrame) -> DataFrame:
        """The positions of these versions that can clash with ``places`` (with day): of the same days."""
        old = self._of(versions, "positions")
        days = [r["day"] for r in places.select("day").distinct().limit(self.MOST_DAYS + 1).collect()]
        return old.filter(F.col("day").isin(days)) if len(days) <= self.MOST_DAYS else old

    def write_run(self, vessels: DataFrame, features: DataFrame, anomaly: DataFrame, risk: DataFrame, alerts: DataFrame, source: str, region: str, positions: DataFrame | None = None) -> dict[str, int]:
        """Writes one run and returns the rows written to each table. Without positions, the
        vessels' current places are written with a null timestamp. Errors become HistoryError."""
        run, now = uuid.uuid4().hex, datetime.now(timezone.utc)
        stamp, run_id = F.lit(now).cast("timestamp"), F.lit(run).alias("run_id")
        seen = vessels.select("vessel_id", stamp.alias("first_seen"), stamp.alias("last_seen"), F.lit(source).alias("source"), F.lit(region).alias("region"))
        if positions is None:
            positions = vessels.withColumn("timestamp", F.lit(None).cast("timestamp"))
        places = with_day(positions.select("vessel_id", "timestamp", "latitude", "longitude", "speed", "heading", F.lit(source).alias("source")))
        json = features.select("vessel_id", F.to_json(F.struct(*(c for c in features.columns if c != "vessel_id"))).alias("feature_json"))
        extra = {"alert_type": "string", "tick": "long"}
        told = alerts.withColumns({c: F.lit(None).cast(t) for c, t in extra.items() if c not in alerts.columns})
        rows = {
            "vessels": merged_vessels(seen),
            "features": json.select("*", stamp.alias("computed_at"), run_id),
            "anomaly_scores": anomaly.select("vessel_id", "anomaly_score", "is_anomalous", stamp.alias("computed_at"), run_id),
            "risk_scores": risk.select("vessel_id", "overall_score", "risk_level", "behavior", "zone_status", stamp.alias("computed_at"), run_id),
            "alerts": told.select("vessel_id", "level", "message", "reason", "alert_type", "tick", stamp.alias("created_at"), run_id),
        }
        try:
            parts = {name: f"run_id={run}" for name in rows}
            counts = {name: self._write(name, parts[name], df) for name, df in rows.items()}
            known: list[dict] = []
            for k in itertools.count():
                versions = self.manifest.versions()
                # the first time all positions are told from those known, then what is left from those that came meanwhile
                fresh = [v for v in versions if v["version"] > (known[-1]["version"] if known else 0)]
                left = places if k == 0 else with_day(self._read("positions", [parts["positions"]]))
                parts["positions"] = f"run_id={run}/attempt={k}"
                counts["positions"] = self._write("positions", parts["positions"], new_positions(self.known_positions(fresh, left), left).select(*places.columns), ("day",))
                known = versions
                entry = {"run_id": run, "source": source, "region": region, "written_at": now.isoformat(), "parts": parts, "rows": counts}
                if self.manifest.put((known[-1]["version"] if known else 0) + 1, entry):
                    break
            self.merge_log()
        except Exception as error:
            raise HistoryError(str(error)) from error
        return {name: counts[name] for name in ("vessels", "positions", *(n for n in rows if n != "vessels"))}

    def merge_log(self) -> bool:
        """Merges the vessels' log for good once it has LOG_RUNS runs and as many rows as what is merged, so that what
        is written stays in proportion to what runs write. Whether it did; another writer's version comes first."""
        versions = self.manifest.versions()
        base = [v for v in versions if v["compacted"]][-1:]
        log = [v for v in versions if v["run_id"] and (not base or v["version"] > base[0]["upto"])]
        if len(log) < self.LOG_RUNS or sum(v["rows"]["vessels"] for v in log) < (base[0]["rows"]["vessels"] if base else 0):
            return False
        part = f"run_id=merged-{uuid.uuid4().hex}"
        n = self._write("vessels", part, self._of(versions, "vessels").repartitionByRange("vessel_id").sortWithinPartitions("vessel_id"))
        return self.manifest.put(versions[-1]["version"] + 1, {"compacted": part, "upto": versions[-1]["version"], "rows": {"vessels": n}})

    def try_write_run(self, *args, **kwargs) -> dict:
        """As ``write_run``, but errors don't pass: {"written": whether, "counts": ..., "error": text or
        None}, so that a sink that fails never breaks the pipeline's result. A run that broke off has
        no version in the manifest and does not show."""
        try:
            return {"written": True, "counts": self.write_run(*args, **kwargs), "error": None}
        except Exception as error:
            return {"written": False, "counts": {}, "error": str(error)}

    def append_alerts(self, alerts: DataFrame, run_id: str) -> None:
        """Alerts of a stream's batch, stamped now where created_at is missing."""
        created = F.coalesce("created_at", F.current_timestamp()) if "created_at" in alerts.columns else F.current_timestamp()
        alerts.select("vessel_id", "level", "message", "reason", "alert_type", F.col("tick").cast("long").alias("tick"), created.alias("created_at")).write.mode("append").parquet(f"{self.path}/alerts/run_id={run_id}")

    def summary(self) -> DataFrame:
        """One row of counts."""
        one = lambda df, *aggs: df.agg(*aggs).withColumn("_k", F.lit(1))
        n = F.count("*")
        out = one(self.table("vessels"), n.alias("vessels"))
        for name in ("positions", "risk_scores"):
            out = out.join(one(self.table(name), n.alias(name)), "_k")
        alerts = one(self.table("alerts"), n.alias("alerts"), F.count_if(F.col("level") == "HIGH").alias("high_alerts"))
        return out.join(alerts, "_k").drop("_k")

    def alert_panel(self, n: int = 8, buffer: int = 50) -> DataFrame:
        """The ``n`` alerts on top of the last ``buffer``: HIGH first, then the latest."""
        return self.recent_alerts(buffer).orderBy((F.col("level") != "HIGH"), F.desc("created_at"), "vessel_id").limit(n)

    def recent_alerts(self, n: int = 20) -> DataFrame:
        return recent(self.table("alerts"), n, "created_at", "vessel_id")

    def recent_risk(self, n: int = 20) -> DataFrame:
        return recent(self.table("risk_scores"), n, "computed_at", "vessel_id")

    def vessel_recent(self, vessel_id: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
        mine = lambda name: self.table(name).filter(F.col("vessel_id") == vessel_id)
        return recent(mine("risk_scores"), n, "computed_at", "overall_score"), recent(mine("alerts"), n, "created_at", "message")
