"""Ranked lexical search by pipelined term partitioning.

1. Tasks read whole texts and note, for shards of documents, the postings of those terms that a query
   may have: a shard's header row holds its documents and their lengths, a row for each term its documents
   and frequencies. Which terms a query may have is told by a bit map of fixed size.
2. Sums over these rows give the corpus statistics and every term's document frequency, so its weight.
3. Each term has an owner. Owners are ordered from rare to frequent terms and own about equal
   shares of the postings. Bundles of items carry sparse accumulators, for each item documents of one shard
   and their scores so far, through the owners one after the other: each stage is a cogroup of the bundles
   with its owner's postings, which adds integer contributions.
4. A stage drops what can't win: with r the most that the remaining terms can add to a document,
   and s an item's tenth best score of the shard so far, documents below s - r are out. This is exact.
5. Each bundle ends with the best of each item in its shard, and a rank over shards selects the final ones.

A shard has at most SHARD documents and a bundle at most about BUNDLE items, so no group grows with
the corpus or with the number of items.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import discard, if_small, written

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # of UTF-8: every byte beyond ASCII belongs to a term
PARTS = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
BYTES_AT_ONCE = 4_000_000
#: Documents of a shard, items of a bundle, owners of terms.
SHARD, BUNDLE, OWNERS = 2048, 128, 4
#: Slots of the map that tells which terms queries may have.
SLOTS = 1 << 22
#: Scores: weights times a part below MOST.
MOST = 1_000_000

POSTINGS = "shard long, term binary, docs array<int>, freqs array<int>, ids array<long>, lengths array<long>"


def terms_of(text: str | None) -> Counter[bytes]:
    """The terms of a text and how often they occur; A-Z count as a-z."""
    data = (text or "").encode().lower()
    if len(data) <= BYTES_AT_ONCE:
        return Counter(TERM.findall(data))
    found, at = Counter(), 0
    while at < len(data):
        m = PARTS.search(data, at + BYTES_AT_ONCE)
        end = m.end() if m else len(data)
        found.update(TERM.findall(data[at:end]))
        at = end
    return found


def query_terms(items: DataFrame, text: str) -> DataFrame:
    """(item, term): the terms of each item, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if found := list(terms_of(x.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item", "term"])

    return items.select("item", text).mapInArrow(run, "item long, term binary")


def slots_of(terms: DataFrame) -> np.ndarray:
    """The map of SLOTS flags, whatever the number of terms."""
    out = np.zeros(SLOTS, bool)
    flags = terms.select((F.crc32("term") % SLOTS).cast("int").alias("slot")).distinct()
    words = flags.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    for r in words.collect():  # SLOTS / 64 numbers at most
        out[64 * r["word"] : 64 * r["word"] + 64] = np.unpackbits(np.array([r["bits"]], "<i8").view(np.uint8), bitorder="little")
    return out


def postings(docs: DataFrame, doc_id: str, text: str, wanted: np.ndarray, shard_size: int) -> DataFrame:
    """Rows of POSTINGS: for each shard a header (term null; ids and lengths of its documents) and for each term that
    may be wanted its documents, by place in the shard, and frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))  # SLOTS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(shared.value).view(bool)
        shard = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        lengths: list[int] = []
        lists: dict[bytes, tuple[list[int], list[int]]] = {}
        known: dict[bytes, bool] = {}

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            rows = [{"shard": shard, "ids": ids, "lengths": lengths}, *({"shard": shard, "term": t, "docs": a, "freqs": b} for t, (a, b) in lists.items())]
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 2000], schema)
            shard += 1
            ids.clear(), lengths.clear(), lists.clear()

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(x.as_py())
                for t, n in found.items():
                    may = known.get(t)
                    if may is None:
                        if len(known) > 500_000:
                            known.clear()
                        may = known[t] = bool(flags[zlib.crc32(t) % SLOTS])
                    if may:
                        a, b = lists.setdefault(t, ([], []))
                        a.append(len(ids))
                        b.append(n)
                ids.append(i)
                lengths.append(found.total())
                if len(ids) == shard_size:
                    yield from told()
        if ids:
            yield from told()

    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("docs", ints), ("freqs", ints), ("ids", longs), ("lengths", longs)])
    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, POSTINGS)


def owners(terms: DataFrame, n: int) -> list[int]:
    """Upper bounds of document frequency (powers of two) for the owners: about equal shares of the postings."""
    sizes = {r["bits"]: r["sum"] for r in terms.groupBy(F.length(F.bin("df")).alias("bits")).agg(F.sum("df").alias("sum")).collect()}  # 64 rows at most
    total, seen, bounds = sum(sizes.values()), 0, []
    for bits in sorted(sizes):
        seen += sizes[bits]
        if seen * n >= (len(bounds) + 1) * total and len(bounds) < n - 1:
            bounds.append(1 << bits)
    return bounds


def added(lists: pa.Table, scores: np.ndarray, places: dict[int, int], m: np.ndarray) -> None:
    """Adds to scores (items x documents) what the postings contribute."""
    for docs, freqs, items, weight in zip(*(lists.column(c) for c in ("docs", "freqs", "items", "weight"))):
        at, tf = docs.values.to_numpy(), freqs.values.to_numpy().astype(np.int64)
        part = weight.as_py() * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
        for item in items.values.to_pylist():
            scores[places[item], at] += part


def stage(bundles: DataFrame, lists: DataFrame, owner: int, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """One owner's stage: ``bundles`` with the contributions of its ``lists`` (shard, bundle, docs, freqs,
    items, weight) added, without documents that can't win any more."""
    names = bundles.columns  # shard, bundle, ids (can hold nulls), then what is numbers

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].values.to_numpy() for c in names[3:]}
        scores = np.zeros((len(row["items"]), len(row["lengths"])), np.int64)
        scores[np.repeat(np.arange(len(row["ends"])), np.diff(row["ends"], prepend=0)), row["docs"]] = row["scores"]
        if right.num_rows:
            m = 100 - 90 + (90 * row["lengths"] * n_docs) // max(n_terms, 1)
            added(right, scores, {x: i for i, x in enumerate(row["items"].tolist())}, m)
        rest = row["rests"].reshape(len(scores), -1)[:, owner] * MOST
        least = np.ones(len(scores), np.int64)
        if scores.shape[1] > top:
            least = np.maximum(least, np.partition(scores, -top, axis=1)[:, -top] - rest)
        items, docs = np.nonzero(scores >= least[:, None])
        ends = np.cumsum(np.bincount(items, minlength=len(scores)))
        lists_of = {"ends": ends.astype(np.int32), "docs": docs.astype(np.int32), "scores": scores[items, docs]}
        cells = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) if (x := lists_of.get(c)) is not None else left.column(c) for c in names]
        return pa.table(cells, names=names)

    return bundles.groupBy("shard", "bundle").cogroup(lists.groupBy("shard", "bundle")).applyInArrow(run, bundles.schema)


def best_of(bundles: DataFrame, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each item in each shard, ties by doc_id, null last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, start = [], 0
                for item, end in zip(row["items"], row["ends"]):
                    found = [(-s, row["ids"][d] is None, row["ids"][d] or 0) for d, s in zip(row["docs"][start:end], row["scores"][start:end])]
                    out += [(item, None if none else d, -s) for s, none, d in sorted(found)[:top]]
                    start = end
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["item", "doc_id", "score"])

    return bundles.select("items", "ids", "ends", "docs", "scores").mapInArrow(run, "item long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", top: int = 10, n_owners: int = OWNERS, shard_size: int = SHARD, bundle_size: int = BUNDLE) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank (from 1), doc_id, score (above 0).

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII in the whole text, A-Z as a-z.
    N documents have a term, L terms are in all, df documents have the term. A term weighs w = floor(1000 ln((2N + 2) / (2df + 1)));
    a document of n terms scores the sum of w * ((10^9 tf) div (1000 tf + 8m)) over the item's distinct terms, where m = 10 + (90nN) div L.
    Equal scores rank by doc_id (long; null last).

    Null and empty texts have no terms: such items have no rows, such documents are never found.
    Repeated rows count each: equal documents are listed one by one, equal items each get their rows.
    Very long texts are read in parts that end between terms. Empty tables give no rows. Other columns are
    left out, so their names can't clash.
    """
    spark = docs.sparkSession
    asked = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), text), "lexical-items")
    query = written(query_terms(asked, text), "lexical-terms")
    posted = written(postings(docs, doc_id, text, slots_of(query), shard_size), "lexical-postings")
    sizes = posted.filter("term IS NULL").agg(F.sum(F.expr("size(filter(lengths, x -> x > 0))")).alias("n"), F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("l")).first()
    n_docs, n_terms = sizes["n"] or 0, sizes["l"] or 0
    counted = posted.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    counted = written(counted.join(query.select("term").distinct(), "term", "left_semi"), "lexical-counts")
    bounds = owners(counted, n_owners)
    weight = F.floor(1000.0 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    owner = sum((F.when(F.col("df") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    n_bundles = max(1, -(-query.select("item").distinct().count() // bundle_size))
    known = query.join(if_small(counted.select("term", weight.alias("weight"), owner.alias("owner"))), "term")
    known = written(known.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(n_bundles))), "lexical-queries")
    asks = known.groupBy("owner", "bundle", "term").agg(F.collect_list("item").alias("items"), F.max("weight").alias("weight"))
    asks = if_small(written(asks, "lexical-asks"))
    # what owners after each one can add at most, in weights
    rests = F.flatten(F.collect_list(F.array(*(f"r{k}" for k in range(len(bounds) + 1))))).alias("rests")
    of_item = known.groupBy("bundle", "item").agg(*(F.sum(F.when(F.col("owner") > k, F.col("weight")).otherwise(0)).alias(f"r{k}") for k in range(len(bounds) + 1)))
    of_bundle = if_small(written(of_item.groupBy("bundle").agg(F.collect_list("item").alias("items"), rests), "lexical-bundles"))
    heads = posted.filter("term IS NULL").select("shard", "ids", "lengths", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bundles - 1).cast("long"))).alias("bundle"))
    none = [F.array().cast("array<int>").alias("ends"), F.array().cast("array<int>").alias("docs"), F.array().cast("array<bigint>").alias("scores")]
    bundles = heads.join(of_bundle, "bundle").select("shard", "bundle", "ids", "lengths", "items", "rests", *none)
    for k in range(len(bounds) + 1):
        lists = posted.select("shard", "term", "docs", "freqs").join(asks.filter(F.col("owner") == k), "term").select(F.col("shard").alias("shard"), F.col("bundle").alias("bundle"), "docs", "freqs", "items", "weight")
        bundles = stage(bundles, lists, k, n_docs, n_terms, top)
    best = written(best_of(bundles, top), "lexical-best")
    discard(posted)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(if_small(asked.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")
