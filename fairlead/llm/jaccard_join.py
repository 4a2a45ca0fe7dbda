"""N-gram Jaccard self-join by grouped prefixes.

1. Documents with equal shingle sets become one class; only classes go on.
2. A fixed-size count sketch of all shingles gives every task the same order, rare shingles first.
   Two sets of Jaccard similarity t share a shingle of their prefixes, the first n - ceil(t n) + 1
   shingles in that order.
3. Classes of equal size and prefix are one group. Groups that share a prefix shingle are
   candidates if their sizes and the places of that shingle allow it.
4. First every group meets only the highest ranking groups of its shingles' lists: as many pairs as
   rows. They are expanded to classes and verified on whole sets; the links make components.
5. Then all candidates of different components meet and are verified: a class asks for the cells in
   which a candidate is, and a task compares what meets in two cells, without a list of pairs.
6. Links are joined to components.

Sketch, order, filters and verification are exact: no link is lost, nothing is capped. Large groups
of copies are connected in step 4, so that step 5 has little left. Cells are the classes around one
head, in parts of bounded volume: a text travels once for each pair of cells and never once for each
pair of texts. Shared shingles are counted before they are shuffled, and joins on shingle, class or
node leave skewed keys to Spark to split.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm.common import MIX, discard, if_small, mixed, powers, ragged, slices, word_hashes, written

SKETCH_BITS = 24
CHUNKS = 64
#: Cells of classes that are verified together have about this many, and so many shingles.
CELL, CELL_SHINGLES = 512, 1_000_000
#: Texts are hashed in parts of about so many characters: a hash of each byte takes eight.
CHARS = 500_000


def shingles(texts: list[str], size: int = 3) -> list[np.ndarray]:
    """64-bit hashes of the word shingles of each text, in order and with repetitions.

    A-Z count as a-z; words end at ASCII white space. A text with fewer words than ``size`` has its
    whole sequence as one shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    cuts = np.r_[0, np.cumsum(counts)]
    weights = powers(size + 2)[0]
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        total += words[k : k + len(total)] * weights[k + 1]
    total = mixed(total)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= size:
            out.append(total[a : b - size + 1])
        elif b > a:
            short = np.sum(words[a:b] * weights[1 : b - a + 1], dtype=np.uint64, keepdims=True)
            out.append(mixed(short + np.full(1, b - a, np.uint64) * MIX[2]))
        else:
            out.append(total[:0])
    return out


def sketch(df: DataFrame, text: str, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of all shingles by the first bits of their hash: 2 ** bits small numbers, whatever the
    input. Tasks send theirs, up to 255 each, in chunks, which are summed in two steps."""
    width = (1 << bits) // CHUNKS
    schema = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("salt", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, held, n = np.zeros(1 << bits, np.uint8), [], 0

        def add() -> None:
            seen, times = np.unique(np.concatenate(held), return_counts=True)
            counts[seen] = np.minimum(counts[seen] + times, 255)

        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for a, b in slices(texts, CHARS):
                for x in shingles(texts[a:b], size):
                    held.append((x >> np.uint64(64 - bits)).astype(np.int32))
                    n += len(x)
                if n >= 4_000_000:
                    add()
                    held, n = [], 0
        if n:
            add()
        if counts.any():
            salt = TaskContext.get().partitionId() % 64
            for i, row in enumerate(counts.reshape(CHUNKS, width)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(row.tobytes(), 1)], pa.binary())], names=schema.names)

    def total(part: pa.Table) -> pa.Table:
        counts = np.zeros(width, np.int64)
        for x in part.column("counts"):
            raw = zlib.decompress(x.as_buffer())
            counts += np.frombuffer(raw, "<u2" if len(raw) == 2 * width else "u1")
        return pa.table([part.column("chunk").slice(0, 1), part.column("salt").slice(0, 1), pa.array([zlib.compress(np.minimum(counts, 65535).astype("<u2").tobytes(), 1)], pa.binary())], names=schema.names)

    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism  # so many sketches, whatever the input
    sums = df.select(text).coalesce(tasks).mapInArrow(count, schema)
    for keys in (["chunk", "salt"], ["chunk"]):
        sums = sums.groupBy(*keys).applyInArrow(total, schema)
    out = np.zeros((CHUNKS, width), np.uint16)
    for row in sums.collect():  # CHUNKS rows at most
        out[row["chunk"]] = np.frombuffer(zlib.decompress(row["counts"]), "<u2")
    return out.reshape(-1)


def node_of(shingle_set: np.ndarray) -> int:
    """The class of a set: 63 bits of a digest of its sorted hashes."""
    return int.from_bytes(hashlib.blake2b(shingle_set.astype("<u8").tobytes(), digest_size=8).digest(), "little") >> 1


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix_of(x: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set in the sketch's order, rare ones first."""
    shift = np.uint64(64 - int(len(counts)).bit_length() + 1)
    return x[np.lexsort((x, counts[(x >> shift).astype(np.int64)]))[: prefix_length(len(x), percent)]]


def with_prefixes(df: DataFrame, text: str, size: int, percent: int, shared: Broadcast) -> DataFrame:
    """The other columns of ``df`` with n_shingles, node (null without shingles), prefix (the
    first shingles of the set in the sketch's order) and group (a hash of size and prefix)."""
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("group", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(len(rest)).to_pylist()]
            sizes, nodes, groups, prefixes = [], [], [], []
            for a, b in slices(texts, CHARS):
                for x in shingles(texts[a:b], size):
                    x = np.unique(x)
                    sizes.append(len(x))
                    nodes.append(node_of(x) if len(x) else None)
                    first = prefix_of(x, counts, percent)
                    prefixes.append(first.view(np.int64))
                    groups.append(node_of(np.r_[first, np.uint64(len(x))]) if len(x) else None)
            offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(groups, pa.int64()), lists], names=schema.names)

    return df.select(*rest, text).mapInArrow(run, schema)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for the nodes of an edge table (a, b): label is the smallest node that is
    reachable. Labels move along edges and jump to their label's label until none changes; every
    round is a written table."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), f"{name}-edges")
    start = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
    labels = written(start.select("node", F.col("node").alias("old"), "label"), f"{name}-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        near = labels.drop("old").join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(near.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), f"{name}-labels")
        done = new.filter("old <> label").isEmpty()
        discard(labels)
        labels = new
        if done:
            discard(both)
            return labels.select("node", "label")


def written_if_any(df: DataFrame, name: str) -> DataFrame | None:
    """The written table, or None if it has no rows."""
    table = written(df, name)
    return None if table.isEmpty() else table


def classes_of(full: DataFrame) -> DataFrame:
    """(node, group, n, id, key): a class with the doc_id and text hash of one of its documents."""
    first = F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    found = full.groupBy("node").agg(F.any_value("group").alias("group"), F.any_value("n_shingles").alias("n"), first)
    return found.select("node", "group", "n", F.col("first.doc_id").alias("id"), F.col("first.key").alias("key"))


def hits_of(rows: DataFrame) -> DataFrame:
    """(token, group, n, place, rank) for the prefix shingles that several groups share. rank: how
    many documents have the group's shingles in all; the original of many copies has most. Groups
    are told apart by their hash alone, so that no prefix is shuffled to find them."""
    tokens = rows.select("group", "n_shingles", F.posexplode("prefix").alias("place", "token"))
    tokens = tokens.select("token", "group", F.shiftleft("n_shingles", 32).bitwiseOR(F.col("place")).alias("at"))  # a narrow row
    # of most shingles only their number is shuffled; copies of one group are told from others after that
    shared = written(tokens.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1"), "jaccard-shared")
    met = written(tokens.join(shared, "token").groupBy("token", "group").agg(F.max("at").alias("at"), F.max("m").alias("m")), "jaccard-met")
    discard(shared)
    several = met.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("token")
    hits = written(met.join(several, "token"), "jaccard-hits")
    discard(met)
    ranks = hits.groupBy("group").agg(F.sum("m").alias("rank"))
    places = [F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND((1 << 32) - 1).alias("place")]
    found = written(hits.select("token", "group", *places).join(ranks, "group"), "jaccard-ranked")
    discard(hits)
    return found


def fitting(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= percent * F.greatest(n, m)


def stars(hits: DataFrame, percent: int) -> DataFrame:
    """(group, head, rank of head): each group with the highest ranking group of its shingles' lists,
    one for each band of sizes. A list gives as many pairs as it has rows, not their square."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))
    banded = hits.withColumn("band", band)
    heads = banded.groupBy("token", "band").agg(F.max(F.struct("rank", "group", "n")).alias("head"))
    near = heads.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "head")
    met = banded.join(near, ["token", "band"]).filter((F.col("head.group") != F.col("group")) & fitting(F.col("n"), F.col("head.n"), percent))
    return met.select("group", F.col("head.group").alias("head"), F.col("head.rank").alias("rank")).distinct()


def placed(classes: DataFrame, hits: DataFrame, star: DataFrame) -> DataFrame:
    """``classes`` that can have links, with lead (the smallest class of the group) and cell: the
    classes around one head are dealt out in cells of bounded size."""
    own = hits.groupBy("group").agg(F.max("rank").alias("rank")).select("group", F.col("group").alias("head"), "rank")
    anchors = own.unionByName(star.select("group", "head", "rank")).groupBy("group").agg(F.max(F.struct("rank", "head")).alias("top")).select("group", F.col("top.head").alias("anchor"))
    leads = classes.groupBy("group").agg(F.min("node").alias("lead"), F.count("*").alias("members"))
    known = classes.join(leads, "group").join(anchors, "group", "left").filter("anchor IS NOT NULL OR members > 1").withColumn("anchor", F.coalesce("anchor", "group"))
    sizes = known.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("n").alias("volume"))
    cells = F.greatest(F.ceil(F.col("m") / CELL), F.ceil(F.col("volume") / CELL_SHINGLES))
    return known.join(sizes, "anchor").select("node", "group", "n", "id", "key", "lead", F.xxhash64("anchor", F.pmod("node", cells)).alias("cell"))


class Joined:
    """Which things are in one component, as links come in."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, i: int) -> int:
        up = self.parent
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Joins the components of two; whether they were apart."""
        i, j = self.root(i), self.root(j)
        self.parent[j] = i
        return i != j


def linked(a: int, mates: list[int], sets: dict[int, np.ndarray], joined: Joined, percent: int) -> list[tuple[int, int]]:
    """Those of ``mates`` that are similar to ``a`` and not yet in its component."""
    x, out = sets[a], []
    todo = [b for b in mates if joined.root(b) != joined.root(a)]
    while todo:
        part, volume = [], 0
        while todo and volume < 1_000_000:
            part.append(todo.pop())
            volume += len(sets[part[-1]])
        sizes = np.array([len(sets[b]) for b in part], np.int64)
        y = np.concatenate([sets[b] for b in part])
        same = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
        overlap = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)
        hits = np.array(part, np.int64)[100 * overlap >= percent * (len(x) + sizes - overlap)]
        out += [(a, b) for b in hits.tolist() if joined.join(a, b)]
    return out


def crossing(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between rows (node, cell, label, sorted set) of two cells, or of one, that join labels.
    The overlaps of a row with all of the right cell come from one list of its shingles."""
    if not left or not right:
        return []
    joined, out = Joined(), []
    sizes = np.array([len(r[3]) for r in right], np.int64)
    tokens = np.concatenate([r[3] for r in right])
    owners = np.repeat(np.arange(len(right)), sizes)
    by = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[by], owners[by]
    for node, _, label, x in left:
        if all(joined.root(r[2]) == joined.root(label) for r in right):
            continue
        a = np.searchsorted(tokens, x)
        overlap = np.bincount(owners[ragged(a, np.searchsorted(tokens, x, "right") - a)], minlength=len(right))
        for j in np.flatnonzero(100 * overlap >= percent * (len(x) + sizes - overlap)).tolist():
            if joined.join(label, right[j][2]):
                out.append((node, right[j][0]))
    return out


def texts_of(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """``asked`` (node, id, key and more) with the texts, by id and hash of the text: these tell
    which document it is, also where ids repeat or are null."""
    asked = if_small(written(asked, "jaccard-asked")).withColumnRenamed("key", "_key")
    return docs.join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("_key"))).drop("doc_id", "id", "key", "_key")


def star_links(pairs: DataFrame, places: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of the pairs (a, b) whose whole sets are similar enough, as many as connect them.

    Pairs meet by their two cells. A text goes once to each pair of cells that asks for it, however
    many pairs it is in there; a cell holds a bounded volume.
    """
    cell = places.select("node", "cell")
    both = pairs.join(cell.toDF("a", "u"), "a").join(cell.toDF("b", "v"), "b").select("a", "b", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    lists = written(both.groupBy("u", "v", "a").agg(F.collect_set("b").alias("mates")), "jaccard-pairs")
    asked = lists.select("u", "v", F.explode(F.array_union(F.array("a"), "mates")).alias("node")).distinct().join(places.select("node", "id", "key"), "node")
    texts = texts_of(asked, docs).select("u", "v", "node", "text", F.lit(None).cast("array<bigint>").alias("mates"))
    rows = texts.unionByName(lists.select("u", "v", F.col("a").alias("node"), F.lit("").alias("text"), "mates"))
    rows = rows.repartition("u", "v").sortWithinPartitions("u", "v", F.col("mates").isNotNull())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, joined = None, {}, Joined()
        for batch in batches:
            data = batch.to_pydict()
            for start, end in slices([x or "" for x in data["text"]], CHARS):
                found, out = shingles([x or "" for x in data["text"][start:end]], size), []
                for i in range(start, end):
                    if now != (cells := (data["u"][i], data["v"][i])):
                        now, sets, joined = cells, {}, Joined()
                    if data["mates"][i] is None:
                        sets[data["node"][i]] = np.unique(found[i - start])
                    else:
                        out += linked(data["node"][i], data["mates"][i], sets, joined, percent)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def open_meets(hits: DataFrame, places: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(u, v, node, own, label, id, key): the classes that can be similar to one of another component,
    with each pair of cells (u, v) in which they can meet it; own is their cell.

    A class asks for a cell that has one of its prefix shingles, if sizes and places there allow it:
    a list of m classes in c cells gives m * c rows, not the pairs. A class that is similar to another
    passes at their first shared shingle, and so does the other. Classes of one group share all.
    """
    now = written(places.join(labels, "node", "left").select("node", "group", "n", "cell", "id", "key", F.coalesce("label", "node").alias("label")), "jaccard-open")
    spanned = hits.select("token", "group", "place").join(now.select("node", "group", "n", "cell", "label"), "group").drop("group")
    grouped = now.select(F.xxhash64("group", F.lit("group")).alias("token"), F.lit(0).cast("long").alias("place"), "node", "n", "cell", "label")
    spanned = spanned.unionByName(grouped)
    several = spanned.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
    left = written(spanned.join(several, "token"), "jaccard-open-hits")
    ends = [F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("first"), F.min("label").alias("low"), F.max("label").alias("high")]
    cells = left.groupBy("token", "cell").agg(*ends).withColumnRenamed("cell", "other")
    # union - overlap >= lost, so overlap >= percent / (100 + percent) of both sizes needs:
    room = (F.col("place") + F.col("first")) * (100 + percent) <= (F.col("n") + F.col("most")) * (100 - percent)
    sizes = (F.col("least") * percent <= F.col("n") * 100) & (F.col("most") * 100 >= F.col("n") * percent)
    met = left.join(cells, "token").filter(room & sizes & ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label"))))
    pairs = met.select(F.least("cell", "other").alias("u"), F.greatest("cell", "other").alias("v"), "node").distinct()
    return pairs.join(now.select("node", F.col("cell").alias("own"), "label", "id", "key"), "node")


def open_links(meets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components, as many as connect them, of the classes that meet in two cells."""
    rows = texts_of(meets, docs).select("u", "v", "node", "own", "label", "text").repartition("u", "v").sortWithinPartitions("u", "v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}

        def links() -> Iterator[pa.RecordBatch]:
            out = crossing([r for r in rows.values() if r[1] == now[0]], [r for r in rows.values() if r[1] == now[1]], percent) if now else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

        for batch in batches:
            data = batch.to_pydict()
            for start, end in slices([x or "" for x in data["text"]], CHARS):
                for i, found in enumerate(shingles([x or "" for x in data["text"][start:end]], size), start):
                    if now != (cells := (data["u"][i], data["v"][i])):
                        yield from links()
                        now, rows = cells, {}
                    rows[data["node"][i]] = (data["node"][i], data["own"][i], data["label"][i], np.unique(found))
        yield from links()

    return rows.mapInArrow(check, "a long, b long")


def similar(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row of ``df``: doc_id, key (xxhash64 of its text), n_shingles (size of its
    shingle set), node (its class: equal for equal sets), component (the smallest class reachable by
    links), component_id (the smallest doc_id there) and component_key (of its texts the smallest key).

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets of word
    ``size``-shingles. Null and empty texts, and texts without words, have an empty set, null node
    and component, and are linked with nothing; a text with fewer words than ``size`` has one
    shingle. Repeated rows are linked with each other. A null doc_id is never the smallest, unless no
    other is there. An empty table gives no rows. Very long texts are handled in parts until their
    set is whole; other columns of ``df`` are left out, so their names can't clash.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key"))
    # 2 ** SKETCH_BITS numbers of 2 bytes
    shared = df.sparkSession.sparkContext.broadcast(sketch(docs, "text", size))
    rows = written(with_prefixes(docs, "text", size, percent, shared), "jaccard-rows")
    shared.destroy()  # else driver and executors keep it until the driver happens to collect its garbage
    hits = hits_of(rows.filter("node IS NOT NULL"))
    long, rows = rows, written(rows.drop("prefix"), "jaccard-documents")
    discard(long)  # the prefixes are the larger part
    full = rows.filter("node IS NOT NULL")
    labels = links = None
    classes = written(classes_of(full), "jaccard-classes")
    star = written(stars(hits, percent), "jaccard-stars")
    places = written(placed(classes, hits, star), "jaccard-places")
    leads = places.filter("node = lead").select(F.col("group").alias("head"), F.col("lead").alias("a"))
    first = star.join(leads, "head").join(places.select("group", F.col("node").alias("b")), "group").select("a", "b").union(places.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")))
    first = written_if_any(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-first")
    if first is not None:
        links = written(star_links(first, places, docs, size, percent), "jaccard-links")
        labels = components(links, "jaccard-stars")
        more = written_if_any(open_links(open_meets(hits, places, labels, percent), docs, size, percent), "jaccard-more")
        if more is not None:
            labels = components(links.union(more), "jaccard-components")
    if labels is None:
        labels = classes.select("node", F.lit(None).cast("long").alias("label")).limit(0)
    known = classes.select("node", "id", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = known.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"))
    ends = [F.col("label").alias("component"), F.col("first.id").alias("component_id"), F.col("first.key").alias("component_key")]
    of_node = known.select("node", "label").join(firsts, "label").select("node", *ends)
    own = ["doc_id", "key", "n_shingles", "node"]
    joined = full.select(own).join(of_node, "node").select(*own, "component", "component_id", "component_key")
    alone = rows.filter("node IS NULL").select(*own, F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"), F.col("key").alias("component_key"))
    return joined.unionByName(alone)
