"""Isolation forest: fit, score, load or train.

Trees are built from bounded samples, each in a group of its own; rows draw their trees by hash, so
fitting makes and moves about 2.5 * trees * tree_rows rows whatever the size of the matrix. A forest is
a table of nodes; scoring carries it to every task as arrays (their size is bounded by trees and
tree_rows) and walks all trees at once, level by level.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.config import DEFAULT, Config
from fairlead.sources.tables import discard, written

VERSION = 2
EULER = 0.5772156649015329
NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def build_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, size, depth); a leaf has feature -1. Rows
    equal in all features stay together."""
    nodes: list[list] = []
    open_ = [(np.arange(len(x)), 0, None, 0)]
    while open_:
        rows, depth, parent, side = open_.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(rows), depth])
        if parent is not None:
            nodes[parent][3 + side] = me
        if depth >= limit or len(rows) <= 1:
            continue
        low, high = x[rows].min(0), x[rows].max(0)
        choice = np.flatnonzero(high > low)
        if not len(choice):
            continue
        f = int(rng.choice(choice))
        t = float(rng.uniform(low[f], high[f]))
        goes_left = x[rows, f] < t if t > low[f] else x[rows, f] <= t
        nodes[me][1:3] = [f, t if t > low[f] else float(np.nextafter(t, np.inf))]
        open_ += [(rows[~goes_left], depth + 1, me, 1), (rows[goes_left], depth + 1, me, 0)]
    return [tuple(n) for n in nodes]


def fit(matrix: DataFrame, columns: list[str], key: str = "vessel_id", cfg: Config = DEFAULT) -> DataFrame:
    """The forest's NODES. Each tree takes, of the rows that drew it, the tree_rows with the smallest
    hash of (key, tree). A row draws as many trees as 2.5 * tree_rows rows a tree come to; in a small
    matrix every row draws all."""
    n = matrix.count()
    draws = min(1.0, 2.5 * cfg.tree_rows / max(1, n)) * cfg.trees
    values = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    hashed = lambda *salt: F.pmod(F.xxhash64(F.col(key), *(F.lit(x) for x in salt)), F.lit(1_000_003))
    if draws == cfg.trees:
        trees = F.sequence(F.lit(0), F.lit(cfg.trees - 1))
    else:
        # the whole draws, and one more in the share of rows that the rest comes to
        many = int(draws) + (hashed(cfg.seed, "more") < math.ceil((draws - int(draws)) * 1_000_003)).cast("int")
        drawn = F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.col(key), i, F.lit(cfg.seed)), F.lit(cfg.trees)).cast("int"))
        trees = F.when(many > 0, F.array_distinct(drawn))
    rank = F.xxhash64(F.col(key), F.col("tree"), F.lit(cfg.seed))
    drawn = matrix.select(key, values.alias("x"), trees.alias("_trees")).filter("_trees IS NOT NULL").select(key, "x", F.explode("_trees").alias("tree")).withColumn("rank", rank)
    rows, seed = cfg.tree_rows, cfg.seed

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        part = part.sort_values(["rank", key]).head(rows)
        x = np.stack(part["x"].to_numpy())
        nodes = build_tree(x, np.random.default_rng([seed, tree]), math.ceil(math.log2(max(2, len(x)))))
        return pd.DataFrame([(tree, *node) for node in nodes], columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

    return drawn.select(key, "x", "tree", "rank").groupBy("tree").applyInPandas(grow, NODES)


@dataclass
class Forest:
    """The nodes as arrays (tree x node); a leaf leads to itself, ``length`` is its path."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    depth: int
    most: int  # rows of the largest tree


def arrays(nodes: pd.DataFrame) -> Forest:
    nodes = nodes.assign(tree=nodes["tree"].rank(method="dense").astype(int) - 1)
    shape = (int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1) if len(nodes) else (0, 1)
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    leaf = nodes["feature"].to_numpy() < 0

    def table(values: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros(shape, kind)
        out[at] = values
        return out

    own = nodes["node"].to_numpy()
    left, right = (np.where(leaf, own, nodes[c].to_numpy()) for c in ("left", "right"))
    length = nodes["depth"].to_numpy() + average_path(nodes["size"].to_numpy())
    most = int(nodes.loc[nodes["depth"] == 0, "size"].max()) if len(nodes) else 2
    return Forest(table(np.maximum(nodes["feature"].to_numpy(), 0), int), table(nodes["threshold"].to_numpy(), float), table(left, int), table(right, int), table(length, float), int(nodes["depth"].max()) if len(nodes) else 0, most)


def raw_scores(forest: Forest, x: np.ndarray, tree_rows: int, rows: int = 2000) -> np.ndarray:
    """2 ** (- mean path / average path): near 1 for rows that are isolated early."""
    trees = len(forest.feature)
    t, out = np.arange(trees), np.zeros(len(x))
    for a in range(0, len(x) if trees else 0, rows):
        part = x[a : a + rows]
        at, each = np.zeros((len(part), trees), int), np.arange(len(part))[:, None]
        for _ in range(forest.depth):
            at = np.where(part[each, forest.feature[t, at]] < forest.threshold[t, at], forest.left[t, at], forest.right[t, at])
        out[a : a + rows] = forest.length[t, at].mean(axis=1)
    return 2 ** (-out / max(1e-9, float(average_path(min(tree_rows, max(2, forest.most))))))


def raw_table(matrix: DataFrame, nodes: DataFrame, columns: list[str], key: str = "vessel_id", cfg: Config = DEFAULT) -> DataFrame:
    """(key, raw): the raw score of every row, which does not depend on the others."""
    forest = arrays(nodes.toPandas())  # at most trees * 2 * tree_rows nodes
    shared = matrix.sparkSession.sparkContext.broadcast(forest)
    tree_rows = cfg.tree_rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = part[columns].fillna(0.0).to_numpy(float)
            yield pd.DataFrame({key: part[key], "raw": raw_scores(shared.value, x, tree_rows)})

    return matrix.select(key, *columns).mapInPandas(run, f"{key} string, raw double")


def bounds_of(matrix: DataFrame, nodes: DataFrame, columns: list[str], key: str = "vessel_id", cfg: Config = DEFAULT) -> tuple[float, float] | None:
    """The least and the largest raw score of ``matrix``, to be stored with a forest; None without rows."""
    low, high = raw_table(matrix, nodes, columns, key, cfg).agg(F.min("raw"), F.max("raw")).first()
    return None if low is None else (low, high)


def score(matrix: DataFrame, nodes: DataFrame, columns: list[str], key: str = "vessel_id", cfg: Config = DEFAULT, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(key, anomaly_score, is_anomalous): raw scores min-max scaled, 4 places; all 0 if they are equal.
    is_anomalous from the threshold on. Scaled over the rows of ``matrix``, or between the given bounds: then
    a row's score is the same whatever comes with it, and those beyond the bounds count as 0 or 1."""
    raw = raw_table(matrix, nodes, columns, key, cfg)
    if bounds is None:
        scaled = minmax(written(raw, "forest-scores"), "raw")  # its bounds are read too
    else:
        low, high = bounds
        scaled = raw.withColumn("scaled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("raw") - low) / (high - low))) if high - low > 1e-12 else F.lit(0.0))
    return scaled.select(key, F.round("scaled", 4).alias("anomaly_score")).withColumn("is_anomalous", F.col("anomaly_score") >= cfg.anomaly_threshold)


def minmax(df: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """``df`` with ``column`` scaled to [0, 1] over all rows; 0 where all are equal. The bounds are
    a scalar subquery."""
    bounds = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    span = bounds["high"] - bounds["low"]
    return df.withColumn(out, F.when(span > 1e-12, (F.col(column) - bounds["low"]) / F.when(span > 1e-12, span)).otherwise(0.0))


# -- store ----------------------------------------------------------------------------------------


def metadata(spark: SparkSession, path: str) -> dict | None:
    """A stored model's metadata; None if there is none or it can't be read."""
    try:
        return json.loads(spark.read.text(f"{path}/metadata").first()[0])
    except Exception:  # any damage means: train anew
        return None


def nodes_at(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored forest's nodes; None if they are gone, are no Parquet or have other columns."""
    try:
        nodes = spark.read.parquet(f"{path}/nodes")
        return nodes if nodes.columns == spark.createDataFrame([], NODES).columns and nodes.limit(1).count() else None
    except Exception:  # any damage means: train anew
        return None


def compatible(meta: dict | None, columns: list[str], version: int = VERSION, **more) -> bool:
    """Whether a stored model fits: version, number, names and order of columns, and the rest."""
    return bool(meta) and meta.get("version") == version and meta.get("columns") == list(columns) and all(meta.get(k) == v for k, v in more.items())


def save(spark: SparkSession, path: str, nodes: DataFrame, meta: dict) -> None:
    """The nodes first, the metadata last: a store without metadata doesn't count."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], tuple[float, float] | None] | None:
    """(nodes, columns, bounds) of a stored forest, for scoring vessels apart from their fleet; None without one."""
    meta = metadata(spark, path)
    if not meta or meta.get("version") != VERSION:
        return None
    return spark.read.parquet(f"{path}/nodes"), meta["columns"], tuple(meta["bounds"]) if meta.get("bounds") else None


def load_or_train(matrix: DataFrame, columns: list[str], path: str, key: str = "vessel_id", cfg: Config = DEFAULT) -> tuple[DataFrame, str]:
    """(nodes, status): a stored forest if it fits the columns (loaded), else a new one (trained,
    or retrained where one was there)."""
    spark = matrix.sparkSession
    meta = metadata(spark, path)
    if compatible(meta, columns) and (nodes := nodes_at(spark, path)) is not None:
        return nodes, "loaded"
    nodes = written(fit(matrix, columns, key, cfg), "forest")
    kept = {"trees": cfg.trees, "tree_rows": cfg.tree_rows, "seed": cfg.seed, "bounds": bounds_of(matrix, nodes, columns, key, cfg)}
    save(spark, path, nodes, {"version": VERSION, "columns": list(columns), **kept})
    discard(nodes)
    return spark.read.parquet(f"{path}/nodes"), "retrained" if meta else "trained"


def detect(matrix: DataFrame, columns: list[str] | None = None, path: str | None = None, key: str = "vessel_id", cfg: Config = DEFAULT) -> tuple[DataFrame, str]:
    """(scores, status) over all columns beside the key, or those named."""
    columns = columns or [c for c in matrix.columns if c != key]
    nodes, status = load_or_train(matrix, columns, path, key, cfg) if path else (fit(matrix, columns, key, cfg), "trained")
    return score(matrix, nodes, columns, key, cfg), status
