"""Sequence anomaly: sliding windows of steps, principal components, reconstruction error.

Steps are lags over each vessel's order. Windows are cut in numpy from the ordered steps as they
pass, ten steps at a time, and never become rows: fitting sums their products, scoring keeps one
number for each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.config import DEFAULT, Config
from fairlead.operators.iforest import compatible, metadata
from fairlead.operators.segments import before_segments
from fairlead.operators.tracks import in_order, steps
from fairlead.sources.tables import written

STEP_FEATURES = ["speed", "heading_change", "dlat", "dlon", "km", "gap_minutes"]
VERSION = 1


def windows(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(vessel_id, start, features): every run of sequence_length steps as one array, the first
    windows_per_vessel of a vessel (None: all). Missing values count as 0. A frame that is cut into segments needs
    halos of sequence_length positions; starts then count on from segment to segment."""
    n = cfg.sequence_length
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    step = F.array(zero(F.col("speed")), zero(F.col("heading_change")), F.col("dlat"), F.col("dlon"), F.col("km"), F.greatest(zero(F.col("gap_minutes")), F.lit(0.0)))
    moved = steps(df).filter("dlat IS NOT NULL").withColumn("step", step)
    order = in_order(df)
    w = F.collect_list("step").over(order.rowsBetween(-(n - 1), 0)).alias("w")
    if "segment" in df.columns:
        moved = moved.join(before_segments(moved, ["seq"]).drop("first_seq"), ["vessel_id", "segment"])
        place = F.col("rows_before") + F.sum((~F.col("halo")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        out = moved.select("vessel_id", "halo", w, place.cast("int").alias("_n")).filter("NOT halo")
    else:
        out = moved.select("vessel_id", w, F.row_number().over(order).alias("_n"))
    out = out.filter(F.size("w") == n).select("vessel_id", (F.col("_n") - n).alias("start"), F.flatten("w").alias("features"))
    return out if cfg.windows_per_vessel is None else out.filter(F.col("start") < cfg.windows_per_vessel)


def step_rows(df: DataFrame) -> DataFrame:
    """(vessel_id, segment, the six step features): every vessel's steps in order, within one task; a segment's
    if the frame is cut (with halos of sequence_length positions, so that its first window ends with its own first step)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    values = {"speed": zero(F.col("speed")), "heading_change": zero(F.col("heading_change")), "dlat": F.col("dlat"), "dlon": F.col("dlon"), "km": F.col("km"), "gap_minutes": F.greatest(zero(F.col("gap_minutes")), F.lit(0.0))}
    moved = steps(df).filter("dlat IS NOT NULL")
    moved = moved if "segment" in df.columns else moved.withColumn("segment", F.lit(0).cast("long"))
    ordered = moved.sortWithinPartitions("vessel_id", "segment", "timestamp", "seq")  # as the window left them
    return ordered.select("vessel_id", "segment", *(values[n].alias(n) for n in STEP_FEATURES))


def blocks(batches: Iterator[pa.RecordBatch], cfg: Config) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows in batches of ``step_rows``: the row of each window's vessel id in an array of ids,
    as ids, and the windows themselves (windows x places). A window may span two batches."""
    n = cfg.sequence_length
    segments = np.empty(0, np.int64)
    ids, rows, count = np.empty(0, object), np.empty((0, len(STEP_FEATURES))), 0  # the last vessel's last steps, and how many it has had
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.concatenate([ids, batch.column(0).to_numpy(zero_copy_only=False)])
        segments = np.concatenate([segments, batch.column(1).to_numpy()])
        rows = np.concatenate([rows, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])])
        fresh = np.r_[True, (ids[1:] != ids[:-1]) | (segments[1:] != segments[:-1])]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
        place = np.arange(len(ids)) - first
        held = count - (len(ids) - batch.num_rows) if len(ids) > batch.num_rows else 0
        place[first == 0] += held  # the first vessel's earlier steps
        ends = np.flatnonzero((place >= n - 1) & (np.arange(len(ids)) >= len(ids) - batch.num_rows))
        if cfg.windows_per_vessel is not None:
            ends = ends[place[ends] - (n - 1) < cfg.windows_per_vessel]
        if len(ends):
            views = np.lib.stride_tricks.sliding_window_view(rows, n, axis=0)[ends - (n - 1)]
            yield ids[ends], views.transpose(0, 2, 1).reshape(len(ends), -1)
        count = int(place[-1]) + 1
        keep = max(first[-1], len(ids) - (n - 1))
        ids, segments, rows = ids[keep:], segments[keep:], rows[keep:]


def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``blocks``, for windows that are rows (vessel_id, features)."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def source(df: DataFrame, cfg: Config, chosen: DataFrame | None) -> tuple[DataFrame, Callable]:
    """The rows that windows are taken from, and what takes them."""
    return (step_rows(df), partial(blocks, cfg=cfg)) if chosen is None else (chosen.select("vessel_id", "features"), as_rows)


@dataclass
class Model:
    """Means and scales by place, components (place x k), and the error that counts as 1."""

    mean: list[float]
    scale: list[float]
    components: list[list[float]]
    reference: float


def errors(df: DataFrame, model: Model, cfg: Config = DEFAULT, chosen: DataFrame | None = None) -> DataFrame:
    """(vessel_id, error) of every window of the positions ``df``, or of those ``chosen`` (vessel_id, features): the mean
    square of what the components leave of it."""
    mean, scale, components = (np.array(x, float) for x in (model.mean, model.scale, model.components))
    rows, taken = source(df, cfg, chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in taken(batches):
            z = (x - mean) / scale
            error = np.maximum(0.0, ((z * z).sum(1) - ((z @ components) ** 2).sum(1)) / len(mean))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(error)], names=["vessel_id", "error"])

    return rows.mapInArrow(run, "vessel_id string, error double")


def training_windows(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The windows that a model is fitted to, as rows (see ``windows``): of all vessels, and with training_windows the first
    so many in order of vessel and start."""
    rows = windows(df, cfg)
    return rows if cfg.training_windows is None else rows.orderBy("vessel_id", "start").limit(cfg.training_windows)


def moments(df: DataFrame, cfg: Config, chosen: DataFrame | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and sums of products of the windows' places, of the windows ``chosen`` (vessel_id, features) if there
    are such. A task sends one row; these are summed in groups, so that a bounded number reaches the driver."""
    places = cfg.sequence_length * len(STEP_FEATURES)
    schema = "salt int, sums binary"
    source_rows, taken = source(df, cfg, chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((places + 1, places + 1))
        for _, x in taken(batches):
            x = np.column_stack([np.ones(len(x)), x])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["salt", "sums"])

    def add(part: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer()) for x in part.column("sums")], axis=0)
        return pa.table([part.column("salt").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["salt", "sums"])

    rows = source_rows.mapInArrow(run, schema).groupBy("salt").applyInArrow(add, schema).collect()
    total = np.sum([np.zeros((places + 1) ** 2), *(np.frombuffer(r["sums"]) for r in rows)], axis=0).reshape(places + 1, places + 1)
    return round(total[0, 0]), total[0, 1:], total[1:, 1:]


def quantile(table: DataFrame, column: str, q: float, buckets: int = 2048, few: int = 20_000) -> float | None:
    """The exact quantile, with linear interpolation, of a written table's column. Counts by bucket
    narrow the range down until few values are left to be sorted; None for an empty table."""
    x = F.col(column)
    n, low, high = table.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n:
        return None

    def nth(k: int, n: int, low: float, high: float) -> float:
        while n > few and low < high:
            rows = table.filter(x.between(low, high))
            bucket = F.least(F.floor((x - low) / (high - low) * buckets), F.lit(buckets - 1))
            for r in sorted(rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()):
                n, low, high = r["n"], r["low"], r["high"]
                if k < n:
                    break
                k -= n
        if low == high:
            return low
        return sorted(r[0] for r in table.filter(x.between(low, high)).select(column).collect())[k]

    k = int(q * (n - 1))
    a = nth(k, n, low, high)
    return a if q * (n - 1) == k else a + (nth(k + 1, n, low, high) - a) * (q * (n - 1) - k)


def fit(df: DataFrame, cfg: Config = DEFAULT) -> tuple[Model | None, DataFrame | None]:
    """A model of the windows of the positions ``df``, and the windows' errors (a written table); None
    without windows. Two passes over the positions; only sums over the 60 places reach the driver. With
    training_windows only so many are fitted to, and a third pass tells which."""
    chosen = None if cfg.training_windows is None else written(training_windows(df, cfg).select("vessel_id", "features"), "sequence-training")
    n, sums, products = moments(df, cfg, chosen)
    if not n:
        return None, None
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-12] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    k = max(1, min(cfg.temporal_components, len(mean), n))
    components = vectors[:, np.argsort(-values, kind="stable")[:k]] if n > 1 else np.zeros((len(mean), 1))
    model = Model(mean.tolist(), scale.tolist(), components.tolist(), 1.0)
    found = written(errors(df, model, cfg), "sequence-errors")
    reference = quantile(found if chosen is None else written(errors(df, model, cfg, chosen), "sequence-errors"), "error", 0.95)
    model.reference = reference if reference > 1e-9 else 1.0
    return model, found


def score(vessels: DataFrame, found: DataFrame | None, model: Model | None) -> DataFrame:
    """(vessel_id, temporal_anomaly_score, temporal_model_status) of all ``vessels``: the largest of a
    vessel's errors against the reference, in [0, 1] with 4 places. Vessels without a window have
    insufficient_data, as have all without a model."""
    ids = vessels.select("vessel_id").distinct()
    if model is None:
        return ids.select("vessel_id", F.lit(0.0).alias("temporal_anomaly_score"), F.lit("insufficient_data").alias("temporal_model_status"))
    most = found.groupBy("vessel_id").agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("error") / model.reference))).alias("s"))
    status = F.when(F.col("s").isNull(), "insufficient_data").otherwise("scored")
    return ids.join(most, "vessel_id", "left").select("vessel_id", F.round(F.coalesce("s", F.lit(0.0)), 4).alias("temporal_anomaly_score"), status.alias("temporal_model_status"))


def save(spark: SparkSession, path: str, model: Model, cfg: Config) -> None:
    meta = {"version": VERSION, "columns": STEP_FEATURES, "sequence_length": cfg.sequence_length, "model": [model.mean, model.scale, model.components, model.reference]}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_or_train(df: DataFrame, path: str, cfg: Config = DEFAULT) -> tuple[Model | None, DataFrame | None, str]:
    """(model, errors, status): the stored model if its sequence length, step features and version
    fit, else a new one; errors only of a new one."""
    spark = df.sparkSession
    meta = metadata(spark, path)
    if compatible(meta, STEP_FEATURES, VERSION, sequence_length=cfg.sequence_length):
        return Model(*meta["model"]), None, "loaded"
    model, found = fit(df, cfg)
    if model is not None:
        save(spark, path, model, cfg)
    return model, found, "retrained" if meta else "trained"


def detect(vessels: DataFrame, df: DataFrame, path: str | None = None, cfg: Config = DEFAULT, model: Model | None = None) -> tuple[DataFrame, str]:
    """(scores, status) of ``vessels`` from the positions ``df``: by ``model``, by the one stored at
    ``path``, or by a new one."""
    found, status = None, "given"
    if model is None:
        model, found, status = load_or_train(df, path, cfg) if path else (*fit(df, cfg), "trained")
    if found is None and model is not None:
        found = errors(df, model, cfg)
    return score(vessels, found, model), status
