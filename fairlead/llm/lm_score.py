"""Language-model scores by online logistic context mixing.

A text is a sequence of words and one end. A word's code is a path of splits into halves of equal
mass; the path is coded bit by bit. Several predictors give each bit's log odds: the counts that
hashed contexts of earlier words gathered from all training texts, and counts of the text itself that
grow with every bit seen. They are combined by weights that a small context gates; weights and a
refining table learn online from the text. All bits of a word are mixed so (or the first ``depth``; what they
leave open costs what the word's training count says); which of the words beyond HEAD it is costs what that word's
count says. The sum is the log10 probability of the text, and so its total bits, from which bits per byte follow.

Weights, refining table and a text's own counts start anew in each text, so a score never depends on
how Spark deals the rows out. Word counts are aggregated and joined by Spark and grow with the
corpus; the HEAD commonest words and the context tables, which grow with the training tokens up to
a proven size, go to every task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm.common import ragged, slices, word_hashes, written

HEAD = 262_144
#: So many bits of a word's code are mixed; None: all of them.
DEPTH = None
#: The first bits of a code, as context of the next words.
CLASS_BITS = 5
#: Predictors with counts from the training texts: last word, last two words, classes of the last
#: three, place in the text with the last class. Two more count within the text.
COUNTED = 4
#: A context table has a slot for so many training tokens, and 2 ** MOST_SLOT_BITS bytes at most.
TOKENS_A_SLOT, MOST_SLOT_BITS, SCALE = 8, 22, 20
#: So many bits of a token share a line of a table.
NEAR = 6
#: Gates: level of the bit in the code and place in the text.
LEVELS, PLACES = 8, 4
CELLS = 25
FIRST_STEP, LONGEST_STEP = 16, 1024
RATE, REFINE_RATE, START_WEIGHT = 0.02, 0.02, 0.3
CHARS = 400_000  # that are scored together
#: A counting task adds its 32-bit counts to 64-bit ones after so many bits.
HELD_BITS = 1 << 30
#: A counting task sends its words on when it holds this many different ones.
HELD_WORDS = 500_000
#: Blocks of up to so many bytes stay with a task's process when they are freed.
KEPT_BYTES = 31 << 20
END = np.uint64(0)  # the end token; no word has this hash
#: A text counts its own bits along the first bits of a code; seven at most, as the path and a bit are held in a byte.
OWN_BITS = 7


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def keep_memory() -> None:
    """From here on this process keeps what it frees, up to twice KEPT_BYTES, in place of giving it back to the system and
    getting it page by page again: glibc's allocator takes the largest block that was freed as the measure."""
    np.empty(KEPT_BYTES, np.uint8)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some texts, as hashes of the words (A-Z count as a-z) with END after each text,
    and the number of tokens of each."""
    words, sizes = word_hashes([t or "" for t in texts])
    return np.insert(words, np.cumsum(sizes), END), sizes + 1


# -- counting -----------------------------------------------------------------------------------


def word_counts(training: DataFrame, text: str, group: str | None) -> DataFrame:
    """(word, n, group) of training texts, the end token included: word is a 64-bit hash, n its count,
    group the one that it is commonest in (null if ``group`` is None). Tasks sum before the shuffle."""
    schema = T.StructType([T.StructField("word", T.LongType()), T.StructField("group", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def add(g: str | None, words: np.ndarray, n: np.ndarray) -> None:
            nonlocal size
            parts = held.setdefault(g, [])
            parts.append((words, n))
            size += len(words)
            if sum(len(w) for w, _ in parts[1:]) > len(parts[0][0]):  # merge before they outgrow the first
                before = sum(len(w) for w, _ in parts)
                parts[:] = [summed(np.concatenate([w for w, _ in parts]), np.concatenate([k for _, k in parts]))]
                size += len(parts[0][0]) - before

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for g, parts in held.items():
                words, n = summed(np.concatenate([w for w, _ in parts]), np.concatenate([k for _, k in parts]))
                for a in range(0, len(words), 100_000):
                    w = words[a : a + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array([g] * len(w), pa.string()), pa.array(n[a : a + 100_000])], names=schema.names)
            held.clear()
            size = 0

        for batch in batches:
            texts = batch.column(0).to_pylist()
            groups = batch.column(1).to_pylist() if group else [None] * len(batch)
            for a, b in slices([x or "" for x in texts]):
                words, sizes = tokens_of(texts[a:b])
                kinds = {g: i for i, g in enumerate(dict.fromkeys(groups[a:b]))}
                of = np.repeat(np.array([kinds[g] for g in groups[a:b]]), sizes)
                for g, i in kinds.items():
                    add(g, *np.unique(words[of == i], return_counts=True))
                if size > HELD_WORDS:
                    yield from out()
        yield from out()

    each = training.select(text, *([group] if group else [])).mapInArrow(count, schema)
    sums = each.groupBy("word", "group").agg(F.sum("n").alias("n"))
    return sums.groupBy("word").agg(F.sum("n").alias("n"), F.max_by("group", F.struct("n", "group")).alias("group"))


def summed(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different words with their sums."""
    order = np.argsort(words)
    words, n = words[order], n[order]
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
    return words[first], np.add.reduceat(n, first) if len(first) else n


def head_words(counts: DataFrame, head: int) -> pa.Table:
    """The commonest words, ``head`` at most, by falling count. Counts fall into 32 buckets a
    doubling, so that a bounded number of sums reaches the driver; the bucket that doesn't fit whole
    gives those of the smallest hashes, about as many as there is room for."""
    bucket, mark = F.floor(F.log2("n") * 32).cast("int"), F.pmod(F.xxhash64("word"), F.lit(1 << 31))
    sizes = sorted(counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["b"])
    room, least, part = head, 1 << 30, F.lit(False)
    for r in sizes:
        if r["k"] > room:
            part = (bucket == r["b"]) & (mark < (room << 31) // r["k"])
            break
        room, least = room - r["k"], r["b"]
    found = counts.filter((bucket >= least) | part).select("word", "n", "group", mark.alias("mark")).toArrow()
    return found.sort_by([("n", "descending"), ("mark", "ascending"), ("word", "ascending")]).slice(0, head)


class Code:
    """The words' codes and the costs that do not depend on the context.

    Head words, the end and one symbol for all rare words stand in a row, by group of texts and then
    by falling count, and are split into halves of equal mass again and again. The first ``depth``
    splits are the bits that are mixed; what they leave open costs what the training counts say.
    """

    def __init__(self, head: pa.Table, total: int, kinds: int, depth: int | None = DEPTH):
        """head: (word, n, group) of the commonest words, by falling n; total: training tokens;
        kinds: different words; depth: None for as many bits as it takes to tell all apart."""
        times, groups = head.column("n").to_numpy(), head.column("group").to_pylist()
        words = head.column("word").to_numpy().view(np.uint64)
        n = times.astype(np.float64) + 0.1
        mass: Counter = Counter()
        for g, k in zip(groups, times.tolist()):
            mass[g] += k
        names = {g: i for i, g in enumerate(sorted(mass, key=lambda g: (-mass[g], str(g))))}
        self.rare = len(n)  # all words that are not in the head
        #: of rare words, what all of them and one unknown word have together
        self.rare_mass = max(0.1, total + 0.1 * (kinds + 1) - n.sum())
        self.base = np.r_[np.log10(n / (total + 0.1 * (kinds + 1))), 0.0]
        order = np.lexsort((np.arange(len(n)), np.array([names[g] for g in groups], np.int64), words != END))
        self.split(np.r_[order, self.rare].astype(np.int64), np.r_[n, self.rare_mass], 60 if depth is None else depth)
        bits = max(4, (2 * len(words)).bit_length())
        self.shift, self.table = np.uint64(64 - bits), np.full(1 << bits, self.rare, np.int32)
        self.words = np.r_[words, np.uint64(1)]  # of the rare symbol: a hash that no word has
        at, left = (words >> self.shift).astype(np.int64), np.arange(len(words), dtype=np.int32)
        while len(left):  # open addressing: who finds a place taken moves on
            free = self.table[at] == self.rare
            self.table[at[free]] = left[free]
            again = self.table[at] != left
            left, at = left[again], (at[again] + 1) % len(self.table)

    def split(self, order: np.ndarray, weight: np.ndarray, depth: int) -> None:
        """Sets codes (first bit lowest), their lengths, classes (the first bits) and the cost of the rest."""
        sums = np.r_[0.0, np.cumsum(weight[order])]
        codes, lengths, spans = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), [(0, len(order))]
        for level in range(depth):
            wide = [(a, b) for a, b in spans if b - a > 1]
            if not wide:
                break
            spans = [s for s in spans if s[1] - s[0] == 1]
            for a, b in wide:
                cut = min(max(int(np.searchsorted(sums, (sums[a] + sums[b]) / 2)), a + 1), b - 1)
                codes[cut:b] |= 1 << level
                lengths[a:b] += 1
                spans += [(a, cut), (cut, b)]
        inside = np.zeros(len(order))
        for a, b in spans:
            inside[a:b] = np.log10(weight[order[a:b]] / (sums[b] - sums[a]))
        back = np.argsort(order)
        self.codes, self.lengths, self.inside = codes[back], lengths[back].astype(np.int32), inside[back]
        self.classes = (self.codes & ((1 << CLASS_BITS) - 1)) + 1  # 0: before the text

    def places(self, words: np.ndarray) -> np.ndarray:
        """The head places of words given by hash; ``rare`` for others."""
        at = (words >> self.shift).astype(np.int64)
        out = self.table[at]
        left = np.flatnonzero((out != self.rare) & (self.words[out] != words))
        while len(left):
            at[left] = (at[left] + 1) % len(self.table)
            out[left] = self.table[at[left]]
            left = left[(out[left] != self.rare) & (self.words[out[left]] != words[left])]
        return out


# -- bits ---------------------------------------------------------------------------------------


def hashed(*parts: np.ndarray) -> np.ndarray:
    x = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        x = (x ^ (p.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(16)).astype(np.uint32)


def before(x: np.ndarray, back: int, starts: np.ndarray) -> np.ndarray:
    """Each token's value ``back`` tokens earlier; 0 before its text's start."""
    out = np.zeros_like(x)
    out[back:] = x[:-back]
    for k in range(back):
        at = starts + k
        out[at[at < len(x)]] = 0
    return out


@dataclass
class Lines:
    """The mixed bits of some texts, in order; NEAR bits of a token, or its last few, are a line."""

    lengths: np.ndarray  # of each token, how many bits it has
    codes: np.ndarray  # of each token
    contexts: list[np.ndarray]  # of each token, a hash for each counted predictor
    places: np.ndarray  # of each token, the gate for its place in the text
    token: np.ndarray  # to which token each line belongs
    far: np.ndarray  # the bits of its token before it
    held: np.ndarray  # its bits
    path: np.ndarray  # of what values they are, the first lowest
    mark: np.ndarray  # a hash of the path up to it


@dataclass
class Bits:
    """Each bit of some lines by itself: in order, or step by step as they are mixed."""

    lines: Lines
    line: np.ndarray  # to which line each belongs
    level: np.ndarray  # how many are before it in its line
    inner: np.ndarray  # the path from its line's start
    bit: np.ndarray

    @property
    def token(self) -> np.ndarray:
        """To which token each belongs."""
        return self.lines.token.take(self.line)

    @property
    def node(self) -> np.ndarray:
        """The path so far, in narrow numbers wherever they do."""
        x = self.lines
        far = x.far.take(self.line)
        node = x.codes.take(self.token) & ((1 << far) - 1) | self.inner.astype(np.int64) << far
        return node.astype(np.int32 if x.lengths.max() < 31 else np.int64)


def lines_of(code: Code, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, Lines]:
    """The head places of the tokens of some texts, and their lines."""
    ids = code.places(words)
    starts = np.cumsum(sizes) - sizes
    cls, lengths, codes = code.classes[ids], code.lengths[ids].astype(np.int64), code.codes[ids]
    lines = (lengths + NEAR - 1) // NEAR
    token = np.repeat(np.arange(len(ids)), lines)
    far = (np.arange(len(token)) - (np.cumsum(lines) - lines).take(token)) * NEAR
    held = np.minimum(lengths.take(token) - far, NEAR)
    path, below = codes.take(token), np.left_shift(1, far)
    mark = (path & (below - 1) | below).astype(np.uint32)
    mark *= np.uint32(0x9E3779B1)
    path >>= far
    path &= (1 << NEAR) - 1
    place = np.minimum(np.log2(np.arange(1, len(ids) + 1, dtype=np.float32) - np.repeat(starts, sizes)), 15).astype(np.int16)
    last = [before(cls, k, starts) for k in (1, 2, 3)]
    word = [before(words, k, starts) for k in (1, 2)]
    contexts = [hashed(word[0]), hashed(*word), hashed(*last), hashed(place, last[0])]
    return ids, Lines(lengths, codes, contexts, np.minimum(place // 3, PLACES - 1), token, far, held, path, mark)


def bits_of(code: Code, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, Bits]:
    """The head places of the tokens of some texts, and their bits in order."""
    ids, lines = lines_of(code, words, sizes)
    return ids, spread(lines, np.arange(lines.lengths.sum()))


def spread(lines: Lines, at: np.ndarray) -> Bits:
    """The bits at such places of the order."""
    line = np.repeat(np.arange(len(lines.held)), lines.held).take(at)
    level = (at - (np.cumsum(lines.held) - lines.held).take(line)).astype(np.uint8)
    inner, top = lines.path.astype(np.uint8).take(line), np.left_shift(np.uint8(1), level)
    bit = (inner & top != 0).view(np.uint8)
    inner &= top - np.uint8(1)
    inner |= top
    return Bits(lines, line, level, inner, bit)


def stepwise(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The order in which the bits of texts are mixed, given their numbers of bits: each text's rank, the bits step
    by step, and of each step the number of its texts and the range of its bits. A step is the first bits of
    a text, then as many as there were, at most LONGEST_STEP."""
    order = np.argsort(-sizes, kind="stable")
    ranks = np.empty(len(sizes), np.int64)
    ranks[order] = np.arange(len(sizes))
    begins, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    at, steps, done, start = [np.empty(0, np.int64)], [], 0, 0
    while len(sizes) and done < sizes[0]:
        step = min(max(done, FIRST_STEP), LONGEST_STEP)
        whole, m = int(np.searchsorted(-sizes, -done - step, "right")), int(np.searchsorted(-sizes, -done, "left"))
        at.append((begins[:whole, None] + np.arange(done, done + step)).reshape(-1))
        at.append(ragged(begins[whole:m] + done, sizes[whole:m] - done))
        end = start + len(at[-2]) + len(at[-1])
        steps.append((m, start, end))
        start, done = end, done + step
    return ranks, np.concatenate(at), steps


def first_slots(lines: Lines, k: int, slot_bits: int) -> np.ndarray:
    """The slot in the table of predictor ``k`` that the bits of each line lie around: a hash of its context and the
    path before it. Memory is fetched once for them all."""
    x = lines.contexts[k].take(lines.token)
    x ^= lines.mark
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x >>= np.uint32(32 - slot_bits)
    return x.astype(np.int64)


def slots_of(b: Bits, k: int, slot_bits: int) -> np.ndarray:
    """The slot of each bit in the table of predictor ``k``."""
    slots = first_slots(b.lines, k, slot_bits).take(b.line)
    slots ^= b.inner
    return slots


#: For each path of a line, twice the path to each of its bits plus the bit.
INNER = np.array([[((path & (1 << i) - 1) | 1 << i) * 2 + (path >> i & 1) for i in range(NEAR)] for path in range(1 << NEAR)])


def add_counts(sums: np.ndarray, lines: Lines) -> None:
    """Counts the bits in ``sums`` (predictor, slot, value): those of all lines of a length together, as these are
    the same few patterns again and again."""
    first = [first_slots(lines, k, sums.shape[1].bit_length() - 1) * 2 for k in range(COUNTED)]
    for held in range(1, NEAR + 1):
        which = np.flatnonzero(lines.held == held)
        inner = np.ascontiguousarray(INNER[:, :held]).take(lines.path.take(which), axis=0)
        for k, table in enumerate(sums):
            at = first[k].take(which)[:, None] ^ inner
            np.add.at(table.reshape(-1), at.reshape(-1), np.int32(1))


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log odds of a 1 after such counts."""
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))


def slot_bits_for(total: int) -> int:
    """The context tables grow with the training tokens, up to 2 ** MOST_SLOT_BITS numbers each."""
    return min(MOST_SLOT_BITS, max(12, (total // TOKENS_A_SLOT).bit_length()))


def packed(counts: np.ndarray) -> bytes:
    """Counts, most of them small: a compressed byte for each, 255 if it is not below that, then these whole."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return pa.Codec("zstd", 1).compress(low.tobytes() + counts[low == 255].astype("<i8").tobytes(), asbytes=True)


def add_packed(sums: np.ndarray, data: pa.Buffer) -> None:
    """Adds counts that ``packed`` gave."""
    with pa.CompressedInputStream(pa.BufferReader(data), "zstd") as f:
        raw = f.read()
    low = np.frombuffer(raw, np.uint8, len(sums))
    high = low == 255
    sums += low
    sums[high] += np.frombuffer(raw, "<i8", offset=len(sums)) - 255


def context_tables(training: DataFrame, text: str, code, slot_bits: int, held_bits: int = HELD_BITS) -> np.ndarray:
    """For each counted predictor and slot the log odds of a 1 in the training texts, times 20, as
    small integers. A few times as many tasks as there are cores count, whatever the input; they send
    their counts in chunks, which are summed. Counts don't overflow however much a task reads."""
    schema = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    size = 1 << slot_bits
    width = min(size, 1 << 16)
    chunks = COUNTED * size // width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        c, sums, more, held, any_row = code.value, np.zeros((COUNTED, size, 2), np.int32), None, 0, False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices([x or "" for x in texts], CHARS):
                any_row, (_, lines) = True, lines_of(c, *tokens_of(texts[a:b]))
                add_counts(sums, lines)
                held += int(lines.lengths.sum())
                if held >= held_bits:
                    more = np.zeros(sums.shape, np.int64) if more is None else more
                    more += sums
                    sums[:], held = 0, 0
        for i, part in enumerate(sums.reshape(chunks, -1) if any_row else ()):
            part = part if more is None else part + more.reshape(chunks, -1)[i]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed(part)], pa.binary())], names=schema.names)

    def total(part: pa.Table) -> pa.Table:
        sums = np.zeros(2 * width, np.int64)
        for x in part.column("counts"):
            add_packed(sums, x.as_buffer())
        odds = np.rint(np.clip(stretched(sums[0::2].astype(np.float64), sums[1::2].astype(np.float64)) * SCALE, -127, 127)).astype(np.int8)
        return pa.table([part.column("chunk").slice(0, 1), pa.array([odds.tobytes()], pa.binary())], names=schema.names)

    tasks = 3 * training.sparkSession.sparkContext.defaultParallelism
    rows = training.select(text).coalesce(tasks).mapInArrow(count, schema).groupBy("chunk").applyInArrow(total, schema).toArrow()
    out = np.zeros((chunks, width), np.int8)
    for i, odds in zip(rows.column("chunk").to_pylist(), rows.column("counts")):
        out[i] = np.frombuffer(odds.as_buffer(), np.int8)
    return out.reshape(COUNTED, size)


def pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values by places that are known to be right."""
    return values.take(at, mode="clip")


def sums_of(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of ``x`` by ``row``. Two columns at a time are added, as complex numbers."""
    pairs = x.view(np.complex64)
    sums = np.zeros((pairs.shape[1], n), np.complex64)
    for k, out in enumerate(sums):
        np.add.at(out, row, pairs[:, k])
    return np.ascontiguousarray(sums.T).view(np.float32)


def mixed_cost(lines: Lines, sizes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The natural log of each token's probability; ``sizes``: of each text, its tokens.

    Every text has weights of its own, one set for each gate, that start equal, a refining table of
    (level, probability), and counts of its own bits by path. All learn from every bit, in steps (see
    ``stepwise``); within a step they stand still. All texts go side by side.
    """
    n, gates, paths, cells, half = len(sizes), LEVELS * PLACES, 1 << OWN_BITS, LEVELS * CELLS, CELLS // 2
    ranks, at, steps = stepwise(np.add.reduceat(lines.lengths, np.cumsum(sizes) - sizes))
    b = spread(lines, at)
    # the counted predictors' weights of a gate lie side by side, to be fetched at once
    weights, own_weights = np.full((n * gates, COUNTED), START_WEIGHT, np.float32), np.full(n * gates, START_WEIGHT, np.float32)
    table = np.tile(squash((np.arange(CELLS, dtype=np.float32) - half) / 2), n * LEVELS)
    own = np.zeros(2 * n * paths, np.int64)
    cost = np.empty(len(b.bit), np.float32)
    # of each line: its slots, and the first gate of its text and place
    slots = [first_slots(lines, k, tables.shape[1].bit_length() - 1) for k in range(COUNTED)]
    first_row = (np.repeat(ranks, sizes) * gates + lines.places).take(lines.token)
    # of each bit, in bytes: its level, and its path in a text's own counts (0: deeper than what is counted)
    far = np.minimum(lines.far, 100).astype(np.uint8).take(b.line)
    level = far + b.level
    path = (lines.codes.take(lines.token) & np.left_shift(1, lines.far) - 1).astype(np.uint8).take(b.line)
    path |= np.left_shift(b.inner, np.minimum(far, np.uint8(7)))
    path *= level < OWN_BITS
    path += path
    path += b.bit
    np.minimum(level, np.uint8(LEVELS - 1), out=level)
    for m, start, end in steps:
        part = slice(start, end)
        line, bit, inner = b.line[part], b.bit[part], b.inner[part].astype(np.int64)
        row = pick(first_row, line)
        row += level[part] * np.uint8(PLACES)
        cell = row // PLACES  # levels of texts
        cell *= CELLS
        counted = row // gates  # texts
        counted *= 2 * paths
        counted += path[part]
        x = np.empty((end - start, COUNTED), np.float32)
        for k, odds in enumerate(tables):
            slot = pick(slots[k], line)
            slot ^= inner
            np.multiply(pick(odds, slot), np.float32(1 / SCALE), out=x[:, k])
        held = own[: 2 * m * paths].astype(np.float32)
        odds = stretched(held[0::2], held[1::2])
        odds[::paths] = 0
        own_x = pick(odds, counted >> 1)
        parts = weights.take(row, axis=0, mode="clip")
        parts *= x
        score = parts[:, 0].copy()
        for k in range(1, COUNTED):
            score += parts[:, k]
        score += pick(own_weights, row) * own_x
        p = np.clip(squash(score), np.float32(0.0005), np.float32(0.9995))
        score *= 2
        np.rint(score, out=score)
        np.clip(score, -half, half, out=score)
        score += half
        cell += score.astype(np.int64)
        mixed = pick(table, cell)
        mixed *= np.float32(0.25)
        mixed += np.float32(0.75) * p
        np.clip(mixed, np.float32(0.0005), np.float32(0.9995), out=mixed)
        np.abs(mixed - (1 - bit), out=cost[part])
        error = bit - p
        rate = (RATE / np.sqrt(1 + np.bincount(row, minlength=m * gates))).astype(np.float32)
        own_x *= error
        own_weights[: m * gates] += rate * np.bincount(row, own_x, m * gates)
        for k in range(COUNTED):
            x[:, k] *= error
        weights[: m * gates] += rate[:, None] * sums_of(row, x, m * gates)
        cell += cell
        cell += bit
        seen = np.bincount(cell, minlength=2 * m * cells).reshape(-1, 2)
        times = seen[:, 0] + seen[:, 1]
        hit = np.flatnonzero(times)
        now, times = table[hit], times[hit]
        table[hit] = now + REFINE_RATE * (seen[hit, 1] - times * now) / (1 + REFINE_RATE * times)
        own[: 2 * m * paths] += np.bincount(counted, minlength=2 * m * paths)
    return np.bincount(b.token, np.log(cost, out=cost), len(lines.lengths))


def token_costs(code: Code, tables: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token of some texts, up to what rare words cost among themselves,
    and the tokens' head places."""
    ids, lines = lines_of(code, words, sizes)
    return code.inside[ids] + mixed_cost(lines, sizes, tables) / math.log(10), ids


# -- scoring ------------------------------------------------------------------------------------


def head_scores(df: DataFrame, text: str, code, inputs) -> DataFrame:
    """For each row: row (a number of its own), its other columns, n_tokens, n_bytes, head_known
    (head tokens), head_base, head_score, and its rare words."""
    rest = [c for c in df.columns if c != text]
    own = [("row", T.LongType()), ("n_tokens", T.LongType()), ("n_bytes", T.LongType()), ("head_known", T.LongType()), ("head_base", T.DoubleType()), ("head_score", T.DoubleType())]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(*f) for f in own), T.StructField("rare", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        c, tables = code.value, inputs.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            for a, b in slices([x or "" for x in texts], CHARS):
                words, sizes = tokens_of(texts[a:b])
                starts = np.cumsum(sizes) - sizes
                cost, ids = token_costs(c, tables, words, sizes)
                rare = ids == c.rare
                sums = [np.add.reduceat(x, starts) for x in ((~rare).astype(np.int64), c.base[ids], cost)]
                values = [row + np.arange(b - a), sizes, [len((x or "").encode()) for x in texts[a:b]], *sums]
                kinds = [pa.int64()] * 4 + [pa.float64()] * 2
                offsets = np.r_[0, np.cumsum(np.add.reduceat(rare.astype(np.int64), starts))].astype(np.int32)
                arrays = [pa.array(v, k) for v, k in zip(values, kinds)] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[rare].view(np.int64)))]
                row += b - a
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *arrays], names=schema.names)

    return df.select(*rest, text).mapInArrow(run, schema)


def score(df: DataFrame, text: str = "text", doc_id: str = "doc_id", group: str | None = None, folds: int = 10, head: int = HEAD, depth: int | None = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of
    every row.

    Rows whose crc32 of doc_id as text is 0 modulo ``folds`` are held out; the model learns from
    the others. group: a column that tells kinds of text apart, such as the language; it orders the
    words' codes. depth: how many bits of a word's code are mixed, None for all. A null text
    counts as empty: one end token. A null doc_id counts as the empty text, crc32 0: held out.
    Repeated rows get a row each; an empty table gives none. Without training rows every token has
    the same probability. Very long texts are scored whole, in linear time. Other columns of ``df``
    are left out, so their names can't clash. bits_per_byte is null for empty texts.
    """
    spark = df.sparkSession
    held_out = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0
    docs = df.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"), *([F.col(group).alias("group")] if group else []))
    training = docs.filter("NOT held_out")
    counts = written(word_counts(training, "text", "group" if group else None), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    top = head_words(counts, head)
    code = spark.sparkContext.broadcast(Code(top, sums["total"], sums["kinds"], depth))
    inputs = spark.sparkContext.broadcast(context_tables(training, "text", code, slot_bits_for(sums["total"])))
    rows = written(head_scores(docs.drop("group"), "text", code, inputs), "head-scores")

    lowest = F.lit(sums["total"] + 0.1 * (sums["kinds"] + 1))
    rare = rows.select("row", F.explode("rare").alias("word"))
    cost = rare.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("logs"),
        F.count("*").alias("rare_tokens"),
        F.count("n").alias("rare_known"),
    )
    logs, tokens = F.coalesce("logs", F.lit(0.0)), F.coalesce("rare_tokens", F.lit(0))
    scored = rows.drop("rare").join(cost, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(sums["total"]).cast("long").alias("train_tokens"),
        (F.col("head_base") + logs - tokens * F.log10(lowest)).alias("base_score"),
        (F.col("head_score") + logs - tokens * F.lit(math.log10(code.value.rare_mass))).alias("score"),
        "n_bytes",
    )
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, bits)).drop("n_bytes")
