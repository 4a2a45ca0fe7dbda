"""Spelling variants by dense prefix-suffix tiling.

1. Tasks count the words of their texts; counts, not words, are shuffled.
2. Words within one edit of each other, the longer with L code points, share their first or their last
   L // 2 code points, as the edit leaves one half alone. Every word so has four keys: both halves, as
   the longer or equal word (L its length) and as the shorter (L one more).
3. Words of a key meet in a tile: a padded matrix of their code points, compared with itself column by
   column from the front and from the back. Two words are one edit apart if and only if their common prefix
   plus suffix reaches the longer length minus one. A pair counts in the prefix tile if the prefix
   holds the half, in the suffix tile otherwise, so it is found once.
4. Small keys are laid side by side into one tile; a key with many words is cut into blocks, and pairs of
   blocks are tiles of their own. No list of pairs is made: a tile tells for each word how many words are
   near and which of them is the most frequent.
5. Words follow their form's form until none changes; a form is at least twice as frequent, so the
   chains are short, and their length is halved in each round.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm.common import CHARS_AT_ONCE, discard, if_small, written

RUN = re.compile("[a-zÀ-ÿ]+")
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
#: A task holds the counts of so many words before it hands them on.
WORDS_HELD = 400_000
#: Words of a block. A tile has about as many, or two blocks.
BLOCK = 512
#: Tiles of wider words are compared row by row.
NARROW = 200


def parts_of(text: str, limit: int = CHARS_AT_ONCE) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters that end outside of words."""
    at = 0
    while at < len(text):
        m = NO_LETTER.search(text, at + limit)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def spoiled(run: str, doc_id: object, every: int) -> str:
    """``run``, without one of its code points if the checksum of doc_id and run divides by ``every``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(df: DataFrame, text: str, doc_id: str, shortest: int, spoil_every: int | None) -> DataFrame:
    """(word, n) of all words of at least ``shortest`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in parts_of(x.as_py() or ""):
                    # bytes.lower() lowers A-Z alone
                    runs = Counter(w for w in RUN.findall(part.encode().lower().decode()) if len(w) >= shortest)
                    if spoil_every:
                        for w in [w for w in runs if zlib.crc32(f"{'' if i is None else i}:{w}".encode()) % spoil_every == 0]:
                            if len(short := spoiled(w, i, spoil_every)) >= shortest:
                                counts[short] += runs[w]
                            del runs[w]
                    counts.update(runs)
                if len(counts) >= WORDS_HELD:
                    yield from told()
        yield from told()

    rows = df.select(F.col(doc_id), F.col(text)).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def keyed(words: DataFrame) -> DataFrame:
    """(key, u, v, chunk, longest, back, word, n): every word under its keys; (key, u, v) is a tile's cell,
    in which the blocks u and v of a key's words meet; back: the key is the last half, not the first."""
    longest = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longest")
    rows = words.select("word", "n", longest).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    half = F.expr("CASE WHEN back THEN right(word, longest div 2) ELSE left(word, longest div 2) END")
    rows = rows.withColumn("key", F.xxhash64("longest", "back", half))
    hot = written(rows.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK), "spelling-hot")
    split = rows.join(if_small(hot), "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)))
    split = split.withColumn("chunk", F.pmod(F.xxhash64("word"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return split.select("key", F.least("chunk", "other").alias("u"), F.greatest("chunk", "other").alias("v"), "chunk", "longest", "back", "word", "n")


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many first columns are equal, for each row of x with each row of y: both are padded code
    points, equal words apart."""
    if x.shape[1] > NARROW:
        wide = np.zeros((len(x), 1), np.uint8), np.ones((len(y), 1), np.uint8)  # so that a difference is there
        y = np.hstack([y, wide[1]])
        return np.stack([np.argmin(y == row, axis=1) for row in np.hstack([x, wide[0]])]).astype(np.int32)
    out = np.zeros((len(x), len(y)), np.uint8)
    alive = np.ones((len(x), len(y)), bool)
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        alive &= a[:, None] == b[None, :]
        if not alive.any():
            break
        out += alive
    return out.astype(np.int32)


def padded(words: list[str], back: bool) -> np.ndarray:
    """The words' code points (all below 256) as rows, from the front or from the back."""
    width = max(map(len, words))
    raw = b"".join((w[::-1] if back else w).encode("latin-1").ljust(width, b"\0") for w in words)
    return np.frombuffer(raw, np.uint8).reshape(len(words), width)


def near_pairs(tile: dict[str, np.ndarray], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the words of a tile that are one edit apart, each pair of a cell once."""
    chunk, cell = tile["chunk"], tile["cell"]
    crossing = len(cell) > BLOCK and cell[0] == cell[-1] and tile["u"][0] != tile["v"][0]
    x = np.flatnonzero(chunk == tile["u"]) if crossing else np.arange(len(words))
    y = np.flatnonzero(chunk == tile["v"]) if crossing else x
    if not len(x) or not len(y):
        return x[:0], y[:0]
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    front, end = padded(words, False), padded(words, True)
    prefix = common(front[x], front[y])
    both = prefix + common(end[x], end[y])
    a, b = np.nonzero(both >= np.maximum(lengths[x][:, None], lengths[y][None, :]) - 1)
    prefix, a, b = prefix[a, b], x[a], y[b]
    ok = (cell[a] == cell[b]) & (tile["longest"][a] == tile["longest"][b]) & (tile["back"][a] == tile["back"][b])
    ok &= (np.maximum(lengths[a], lengths[b]) == tile["longest"][a]) & (tile["back"][a] == (prefix < tile["longest"][a] // 2))
    ok &= (a < b) | crossing
    ok &= (tile["u"][a] == tile["v"][a]) | (chunk[a] != chunk[b])
    return a[ok], b[ok]


def neighbours(rows: DataFrame) -> DataFrame:
    """(word, n, n_near, least): for the words of each tile how many are near, and of these the negated
    largest n and its smallest word. n is 0 here, so that the rows add up with the words' own."""
    rows = rows.repartition("key", "u", "v").sortWithinPartitions("longest", "key", "u", "v")
    names = ["u", "v", "chunk", "longest", "back", "n"]

    def told(part: pa.Table, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = part.column("word").to_pylist()
        tile = {c: part.column(c).to_numpy() for c in names} | {"cell": cell}
        a, b = near_pairs(tile, words)
        if not len(a):
            return
        a, b = np.r_[a, b], np.r_[b, a]
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((place[b], -tile["n"][b], a))
        a, b = a[order], b[order]
        own, first, times = np.unique(a, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in own]), pa.array(np.zeros(len(own), np.int64)), pa.array(times.astype(np.int64)), pa.array(-tile["n"][b[first]]), pa.array([words[i] for i in b[first]])],
            names=["word", "n", "n_near", "less", "form"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows >= 4 * BLOCK:
                held = yield from cut(held, False)
        if held is not None:
            yield from cut(held, True)

    def cut(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """Tiles of whole cells; the cell that may go on comes back."""
        table = table.combine_chunks()
        ids = np.stack([table.column(c).to_numpy() for c in ("key", "u", "v", "longest")])
        new = np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(axis=0)]
        starts, cell = np.flatnonzero(new), np.cumsum(new)
        starts = np.r_[starts, table.num_rows] if last else starts
        at = 0
        while at < starts[-1]:
            k = np.searchsorted(starts, at + BLOCK, "right") - 1
            end = int(starts[k] if starts[k] > at else starts[k + 1])
            yield from told(table.slice(at, end - at), cell[at:end])
            at = end
        return table.slice(at)

    return rows.mapInArrow(run, T.StructType([T.StructField("word", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n", "n_near", "less")), T.StructField("form", T.StringType())]))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) without cycles: the last of the forms that follow."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = new
        if new.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 5, least: int = 3, times: int = 2, spoil_every: int | None = None) -> DataFrame:
    """Spelling variants among the words of a corpus: word, form, root (string), n, n_near, form_n (long).

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, of at least ``shortest``
    code points and ``least`` occurrences in all texts (n). Two are near if one inserted, deleted or replaced code
    point makes one the other; n_near counts a word's near words. form: of these the most
    frequent one (of equals the smallest), if it is at least ``times`` (2 or more) times as frequent as the word, else null;
    form_n is its n; root: the last form that follows, the word itself without one. ``spoil_every`` deletes
    a code point of every so many-th pair of document and run, by checksum, to test with.

    Null and empty texts have no words; a null doc_id counts as an empty one. Very long texts are counted
    in parts that end between words; very long words are compared row by row. Repeated rows count
    each; an empty table gives no rows; other columns are left out, so their names can't clash.
    """
    counted = written(word_counts(df, text, doc_id, shortest, spoil_every).filter(F.col("n") >= least), "spelling-words")
    own = counted.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("less"), F.lit(None).cast("string").alias("form"))
    rows = own.unionByName(neighbours(keyed(counted)))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("less", "form"))).alias("best")
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    strong = -F.col("best.less") >= times * F.col("n")
    found = written(found.select("word", "n", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "spelling-forms")
    discard(counted)
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
