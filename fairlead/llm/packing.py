"""Hierarchical multi-length packing.

Every document is tokenised and closed with an end id. Full long windows are cut off its front;
the rest is routed to the tier of the smallest context size that holds it. Each tier packs its
pieces, longest first, into sequences of its own size, and what is left open in long windows is
filled with pieces of shorter tiers, cut where they don't fit. Sequences of the tiers below the longest
are powers of two and so need no padding. The last pieces of a pool are laid into the tiers' sizes,
longest first; what is then left, less than the shortest tier, is carried over to the next pool. Only
at a task's end is it laid into shorter powers of two, fewer than 256 tokens a task.

Sequences are numbered within their task and carry the task's number. Their numbers by task and tier
are summed up, so that the sequences of a tier are numbered over the whole table and steps of equal
size follow: every step of a tier has as many sequences, but for the tier's last. Documents stay in
the task that reads them: pieces are written, not shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm.bpe import tokenizer
from fairlead.llm.common import if_small, ragged, slices, written

TIERS = (2048, 1024, 512, 256)
#: A task packs about this many tokens together; memory is bounded by it.
POOL_TOKENS = 1_000_000
#: Characters that are tokenised together, pieces that go to Spark together, bytes of a row group of the written
#: table: what a task holds beside its pool.
CHARS, PIECES_AT_ONCE, ROW_GROUP = 500_000, 1000, 16 << 20
#: Tokens that one training step takes.
STEP_TOKENS = 65_536

#: A sequence_id is its task's number and, in so many bits, its own in the task.
TASK_BITS = 40
COLUMNS = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("tier", "int"), ("step_group", "long")]


class Packer:
    """Packs pieces (row, start, length) of one task into sequences."""

    def __init__(self, tiers: tuple[int, ...], first: int):
        self.tiers = tiers
        self.next = first
        self.opened = dict.fromkeys(tiers, 0)
        self.out: list[tuple[int, int, int, int, int, int, int]] = []

    def close(self, pieces: list[tuple[int, int, int]], tier: int) -> None:
        """Writes one sequence."""
        nth = self.opened.get(tier, 0)
        self.opened[tier] = nth + 1
        offset = 0
        for row, start, length in pieces:
            self.out.append((row, start, length, self.next, offset, tier, nth))
            offset += length
        self.next += 1

    def pack(self, sizes: np.ndarray, starts: np.ndarray, last: bool) -> list[tuple[int, int, int]]:
        """Packs documents of ``sizes`` tokens from their places ``starts`` on. Unless this is the last
        pool, fewer tokens than the shortest tier may be left: their pieces, ends of their documents."""
        longest = self.tiers[0]
        pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        left: list[tuple[int, int, int]] = []
        for row, (size, start) in enumerate(zip(sizes.tolist(), starts.tolist())):
            while size - start >= longest:
                self.close([(row, start, longest)], longest)
                start += longest
            if rest := size - start:
                pools[min(t for t in self.tiers if t >= rest)].append((row, start, rest))
        for t in self.tiers:
            pools[t].sort(key=lambda p: (p[2], p[0], p[1]))  # the longest are taken from the end
        for i, tier in enumerate(self.tiers):
            below = self.tiers[i:]
            while pools[tier]:
                held, room = [], tier
                while room:
                    fit = next((t for t in below if pools[t] and pools[t][-1][2] <= room), None)
                    pick = fit or next((t for t in reversed(below) if pools[t]), None)
                    if pick is None:
                        break
                    row, start, length = pools[pick].pop()
                    if length > room:  # nothing fits whole: a piece of the shortest tier is cut
                        self.put(pools, (row, start + room, length - room))
                        length = room
                    held.append((row, start, length))
                    room -= length
                if room:
                    left = self.finish(held, last)
                else:
                    self.close(held, tier)
        return left

    def put(self, pools: dict[int, list], piece: tuple[int, int, int]) -> None:
        """Back into its pool, at its place by length."""
        pool = pools[min(t for t in self.tiers if t >= piece[2])]
        low, high = 0, len(pool)
        key = (piece[2], piece[0], piece[1])
        while low < high:
            mid = (low + high) // 2
            x = pool[mid]
            low, high = (mid + 1, high) if (x[2], x[0], x[1]) < key else (low, mid)
        pool.insert(low, piece)

    def finish(self, pieces: list[tuple[int, int, int]], last: bool) -> list[tuple[int, int, int]]:
        """The last pieces of a pool, as sequences of the tiers' sizes, and of shorter powers of two if
        this is the task's last pool; otherwise the rest comes back."""
        total = sum(p[2] for p in pieces)
        pieces = pieces[::-1]
        while total and (last or total >= self.tiers[-1]):
            size = next((t for t in self.tiers if t <= total), 1 << (total.bit_length() - 1))
            held, room = [], size
            while room:
                row, start, length = pieces.pop()
                take = min(length, room)
                if take < length:
                    pieces.append((row, start + take, length - take))
                held.append((row, start, take))
                room -= take
            total -= size
            self.close(held, size)
        return pieces


def with_steps(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """A written table of pieces with step_group in place of _nth, the number of a piece's sequence among those
    of its tier and task. What meets is a number for each task and tier, summed over the very same rows."""
    task = F.shiftright("sequence_id", TASK_BITS)
    counts = pieces.filter("offset = 0").groupBy(task.alias("_task"), F.col("tier").alias("_tier")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("_tier").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select("_task", "_tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")), "packed-steps")
    joined = pieces.join(if_small(bases), (task == F.col("_task")) & (F.col("tier") == F.col("_tier")))
    step = F.floor((F.col("_base") + F.col("_nth")) * F.col("tier") / step_tokens)
    return joined.select([step.alias("step_group") if c == "_nth" else F.col(c) for c in pieces.columns])


def pack(df: DataFrame, path: str, text: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS, keep: tuple[str, ...] = ("doc_id",), pool_tokens: int = POOL_TOKENS, with_ids: bool = False, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece: the columns ``keep`` of its document and COLUMNS, with ``ids``
    (array<int>) if asked for.

    start and length: the piece's place among its document's ids; doc_tokens: their number with
    the end id; offset: its place in the sequence, gapless from 0; step_group: its step among those of
    its tier, each of ``step_tokens`` tokens but for the last. Null and empty texts are
    documents of the end id alone. Repeated rows are packed each on its own. An empty table gives
    no rows. Other columns of ``df`` are left out, so their names can't clash.
    """
    # one pass makes the pieces, and what is counted is what is returned, however the input is dealt out
    pieces = pieces_of(df, path, text, end_id, tiers, keep, pool_tokens, with_ids)
    return with_steps(written(pieces, "packed", **{"parquet.block.size": ROW_GROUP}), step_tokens)


def pieces_of(df: DataFrame, path: str, text: str, end_id: int, tiers: tuple[int, ...], keep: tuple[str, ...], pool_tokens: int, with_ids: bool) -> DataFrame:
    """The pieces of ``pack`` with _nth in place of step_group."""
    fields = [df.schema[c] for c in keep] + [T.StructField("_nth" if n == "step_group" else n, T.IntegerType() if t == "int" else T.LongType()) for n, t in COLUMNS]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    schema = T.StructType(fields)
    names = [*keep, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        packer = Packer(tiers, TaskContext.get().partitionId() << TASK_BITS)
        held: list[pa.RecordBatch] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        froms: list[np.ndarray] = []  # where what is not packed yet starts
        tokens = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, counts, froms, tokens
            if not held:
                return
            flat, sizes = np.concatenate(ids), np.concatenate(counts)
            begins = np.cumsum(sizes) - sizes
            left = packer.pack(sizes, np.concatenate(froms), last)
            out, packer.out = packer.out, []
            row, start, length, sequence, offset, tier, nth = (np.array(x, np.int64) for x in (zip(*out) if out else [()] * 7))
            a = begins[row] + start
            sums = np.fromiter((zlib.crc32(flat[i : i + n]) for i, n in zip(a.tolist(), length.tolist())), np.int64, len(a))
            whole = pa.Table.from_batches(held).combine_chunks()
            cols = [whole.column(c).take(pa.array(row)).combine_chunks() for c in keep]
            cols += [pa.array(x) for x in (start, length, sums, sizes[row], sequence, offset)] + [pa.array(tier.astype(np.int32)), pa.array(nth)]
            for i in range(0, len(a), PIECES_AT_ONCE):
                part = [c.slice(i, PIECES_AT_ONCE) for c in cols]
                if with_ids:
                    x, n = a[i : i + PIECES_AT_ONCE], length[i : i + PIECES_AT_ONCE]
                    part.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat[ragged(x, n)].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(part, names=schema.names)
            rest = np.array([piece[0] for piece in left], np.int64)
            tokens = sum(piece[2] for piece in left)
            held = whole.take(pa.array(rest)).to_batches() if len(rest) else []
            ids, counts = [flat[ragged(begins[rest], sizes[rest])]] * bool(len(rest)), [sizes[rest]] * bool(len(rest))
            froms = [np.array([piece[1] for piece in left], np.int64)] * bool(len(rest))

        for batch in batches:
            texts = [x or "" for x in batch.column(names.index(text)).to_pylist()]
            rest = batch.select(list(range(len(keep)))) if keep else batch
            for a, b in slices(texts, CHARS):
                got, n = t.encode(texts[a:b])
                got = np.insert(got, np.cumsum(n), end_id)
                held.append(rest.slice(a, b - a))
                ids.append(got.astype("<u4"))
                counts.append(n + 1)
                froms.append(np.zeros(len(n), np.int64))
                tokens += len(got)
                if tokens >= pool_tokens:
                    yield from flush(False)
        yield from flush(True)

    return df.select(*keep, text).mapInArrow(run, schema)
