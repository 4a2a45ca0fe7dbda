"""Nearest neighbours by vantage-point trees per shard.

1. Equal vectors become one class with the smallest of their ids, so copies weigh nothing.
2. A vantage-point tree over a bounded sample routes: every class is led down to one of its leaves.
   Leaves are shards; one with too many classes is cut into parts by hash.
3. A query first searches the shard that it is led to, which bounds its distance to the last wanted neighbour.
   Then it visits every other leaf that the triangle inequality does not rule out for that bound.
4. A shard searches with a vantage-point tree of its own. All queries of a block go down together: at
   a node each goes to its own side first, and to the other if its distance to the border is at most its
   bound, divided by ``factor``. A factor of one keeps every side that can hold a neighbour: the search is
   exact. Larger factors rule out more, in the routing tree as well as in the shards' trees.

Shards have at most about SHARD classes and blocks about QUERIES queries, whatever the input; what meets in a task
is one shard with one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import discard, if_small, written

#: Classes of a shard, queries of a block, classes of a tree's leaf, rows that the routing tree is fitted on.
SHARD, QUERIES, LEAF, SAMPLE = 8192, 2048, 256, 4096
#: Distances are rounded; bounds give way by this share.
SLACK = 1e-9
FOUND = "query long, score double, vec_id long"
CELL = ["dim", "leaf", "part"]


class Tree:
    """A vantage-point tree of ``depth`` levels: node i has the children 2i and 2i + 1, the leaves are
    numbered from 0."""

    def __init__(self, x: np.ndarray, depth: int):
        self.depth = depth
        self.points = np.zeros((1 << depth, x.shape[1]))
        self.borders = np.full(1 << depth, np.inf)
        self.rows: dict[int, np.ndarray] = {}
        self.grow(x, 1, np.arange(len(x)))

    def grow(self, x: np.ndarray, node: int, rows: np.ndarray) -> None:
        if node >= 1 << self.depth:
            self.rows[node - (1 << self.depth)] = rows
            return
        inner = np.ones(len(rows), bool)
        if len(rows):
            self.points[node] = x[rows[(node * 7919) % len(rows)]]
            d = distances(x[rows], self.points[node])
            self.borders[node] = np.median(d)
            inner = d <= self.borders[node]
        self.grow(x, 2 * node, rows[inner])
        self.grow(x, 2 * node + 1, rows[~inner])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row is led to."""
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (distances(x, self.points[node]) > self.borders[node])
        return node - (1 << self.depth)

    def visit(self, q: np.ndarray, bounds: np.ndarray, factor: float, at_leaf) -> None:
        """Calls at_leaf(leaf, numbers of queries) for all leaves that queries visit, nearer sides first.
        bounds: distances that matter, which at_leaf may lower."""

        def down(node: int, active: np.ndarray) -> None:
            if not len(active):
                return
            if node >= 1 << self.depth:
                at_leaf(node - (1 << self.depth), active)
                return
            over = distances(q[active], self.points[node]) - self.borders[node]
            inner = over <= 0
            down(2 * node, active[inner])
            down(2 * node + 1, active[~inner])
            may = np.abs(over) * (factor * (1 - SLACK)) <= bounds[active]
            down(2 * node + 1, active[inner & may])
            down(2 * node, active[~inner & may])

        down(1, np.arange(len(q)))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same, their squares summed one component after the other, so that they don't depend on the machine."""
    total = np.zeros(len(x))
    for gap in (x - y).T:
        total += gap * gap
    return np.sqrt(total)


def nearest(x: np.ndarray, order: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int, factor: float, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers (-1: none) of the k rows of x nearest to each q, of those within bounds; equal
    distances by ``order``. Products only sort out what is too far; distances are computed as such."""
    tree = Tree(x, max(0, int(np.ceil(np.log2(max(1, len(x) / leaf))))))
    best, found = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
    limit = bounds.copy()
    xx, qq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)

    def at_leaf(number: int, active: np.ndarray) -> None:
        rows = tree.rows[number]
        for start in range(0, len(rows) if len(active) else 0, leaf):
            part = rows[start : start + leaf]
            sums = qq[active][:, None] + xx[part][None, :]
            i, j = np.nonzero(sums - 2 * (q[active] @ x[part].T) <= np.square(limit[active])[:, None] + SLACK * sums)
            d = np.full((len(active), len(part)), np.inf)
            d[i, j] = distances(q[active[i]], x[part[j]])
            some = np.unique(i)
            own = active[some]
            every = np.hstack([best[own], d[some]])
            which = np.hstack([found[own], np.broadcast_to(part, (len(own), len(part)))])
            which[np.isinf(every)] = -1
            first = np.lexsort((np.where(which < 0, np.inf, order[which]), every), axis=-1)[:, :k]
            best[own], found[own] = np.take_along_axis(every, first, 1), np.take_along_axis(which, first, 1)
            limit[own] = np.minimum(limit[own], best[own, k - 1])

    tree.visit(q, limit, factor, at_leaf)
    return best, found


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid(vector: str):
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def routes(classes: DataFrame, sample: int, shard: int) -> dict[int, Tree]:
    """A routing tree for each dimension in a sample of at most ``sample`` classes, those of smallest hash, with leaves
    of about half a shard and at most one for eight rows of the sample."""
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().orderBy(F.desc("count")).limit(16).collect()}
    rows = classes.select("dim", "vector").orderBy("key").limit(sample).collect()
    out = {}
    for dim, n in counts.items():
        if own := [r["vector"] for r in rows if r["dim"] == dim]:
            out[dim] = Tree(np.array(own, np.float64), max(0, min(int(np.ceil(np.log2(max(1, 2 * n / shard)))), int(np.log2(max(1, len(own) / 8))))))
    return out


def led(df: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """``df`` (with dim and vector) with the leaf of each row; dimensions without a tree have one leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, dims = np.zeros(batch.num_rows, np.int64), batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if (tree := trees.get(int(dim))) is not None:
                    at = np.flatnonzero(dims == dim)
                    leaf[at] = tree.leaves(matrix(batch.column("vector").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return df.mapInArrow(run, df.select("*", F.lit(0).cast("long").alias("leaf")).schema)


def others(queries: DataFrame, trees: dict[int, Tree], factor: float) -> DataFrame:
    """``queries`` (with own leaf and bound) once for each other leaf that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, at, leaves = batch.column("dim").to_numpy(), [], []
            own, bounds = batch.column("leaf").to_numpy(), batch.column("bound").to_numpy()
            for dim in np.unique(dims):
                if (tree := trees.get(int(dim))) is not None:
                    rows = np.flatnonzero(dims == dim)

                    def seen(leaf: int, active: np.ndarray, rows: np.ndarray = rows) -> None:
                        active = rows[active]
                        at.append(active[own[active] != leaf])
                        leaves.append(np.full(len(at[-1]), leaf))

                    tree.visit(matrix(batch.column("vector").take(pa.array(rows))), bounds[rows], factor, seen)
            if at:
                out = batch.take(pa.array(np.concatenate(at)))
                yield out.set_column(out.schema.get_field_index("leaf"), "leaf", pa.array(np.concatenate(leaves).astype(np.int64)))

    return queries.mapInArrow(run, queries.schema)


def searched(shards: DataFrame, asks: DataFrame, k: int, factor: float, leaf: int, block: int) -> DataFrame:
    """FOUND rows: for each query of ``asks`` (query, vec_id, vector, dim, leaf, bound) the k nearest rows of each
    part of the leaf, without its own. Queries of a leaf come in blocks, and each block meets each part."""
    parts = shards.groupBy(CELL).agg(F.count("*").alias("n")).groupBy("dim", "leaf").agg(F.collect_set("part").alias("parts"))
    blocks = asks.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / block).alias("blocks"))
    cells = if_small(written(parts.join(blocks, ["dim", "leaf"]), "vantage-cells"))
    left = shards.join(cells.select("dim", "leaf", "blocks"), ["dim", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = asks.join(cells, ["dim", "leaf"]).withColumn("part", F.explode("parts")).withColumn("block", F.pmod(F.xxhash64("query"), "blocks"))
    keys = [*CELL, "block"]

    def run(key: tuple, classes: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, float, int | None]] = []
        if classes.num_rows and queries.num_rows:
            x, q = matrix(classes.column("vector")), matrix(queries.column("vector"))
            ids = classes.column("ids").to_pylist()
            order = np.array([np.inf if i[0] is None else i[0] for i in ids], np.float64)
            _, found = nearest(x, order, q, queries.column("bound").to_numpy(), k + 1, factor, leaf)
            told = scores(np.repeat(q, k + 1, axis=0), x[found.reshape(-1)]).reshape(found.shape)
            for query, own, point, d, rows in zip(queries.column("query").to_pylist(), queries.column("vec_id").to_pylist(), q, told.tolist(), found.tolist()):
                near = []
                for score, r in zip(d, rows):
                    if r >= 0:
                        members = list(ids[r])
                        if own in members and np.array_equal(point, x[r]):
                            members.remove(own)
                        near += [(score, i is None, i or 0) for i in members]
                out += [(query, score, None if none else i) for score, none, i in sorted(near)[:k]]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], names=["query", "score", "vec_id"])

    left = left.select(*(F.col(c).alias(c) for c in keys), "vector", "ids")
    right = right.select(*(F.col(c).alias(c) for c in keys), "query", "vec_id", "vector", "bound")
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(run, FOUND)


def neighbours(df: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, sample: int = SAMPLE, leaf: int = LEAF, block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by ``every`` the ``k`` rows found
    nearest by Euclidean distance, its own left out, nearest first, ties to smaller vec_id (null last).

    ``factor`` one is exact; larger ones leave out sides of a tree whose border is further than the
    bound divided by it. Vectors that are null, zero, or hold null or non-finite components take no part; vectors of
    another dimension never meet. Equal vectors are all found, each by its id. Repeated rows are candidates of each
    other, and queries each. With fewer than ``k`` candidates all are listed; an empty table
    gives no rows. Other columns are left out, so their names can't clash.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter(valid("vector"))
    rows = rows.select("vec_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"), F.xxhash64("vector").alias("key"))
    nth = F.row_number().over(Window.partitionBy("key", "vector").orderBy(F.asc_nulls_last("vec_id")))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)  # a task keeps as many of each vector before the shuffle
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "vec_id"))), lambda s: s["vec_id"]).alias("ids")
    classes = written(few.groupBy("key", "vector").agg(F.max("dim").alias("dim"), ids), "vantage-classes")
    trees = routes(classes, sample, shard)
    placed = written(led(classes.select("key", "vector", "dim", "ids"), trees), "vantage-leaves")
    discard(classes)
    sizes = if_small(written(placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / shard).alias("parts")), "vantage-parts"))
    shards = placed.join(sizes, ["dim", "leaf"]).withColumn("part", F.pmod("key", "parts")).select(*CELL, "vector", "ids")
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("query"), "vec_id", "vector", "dim", F.lit(float("inf")).alias("bound"))
    queries = written(led(queries, trees), "vantage-queries")
    first = written(searched(shards, queries, k, factor, leaf, block), "vantage-first")
    bounds = first.groupBy("query").agg(F.sort_array(F.collect_list("score")).alias("scores")).select("query", F.get("scores", F.lit(k - 1)).alias("bound"))
    bounded = queries.drop("bound").join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    more = written(others(bounded.select(queries.columns), trees, factor), "vantage-more")
    found = first.union(searched(shards, more, k, factor, leaf, block))
    order = Window.partitionBy("query").orderBy("score", F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(queries.select("query", F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
