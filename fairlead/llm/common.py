"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.sources.tables import discard, shared_folder, written  # noqa: F401  shared with the operators

#: Python code looks at this many characters at a time, so that memory does not follow the
#: length of an Arrow batch.
CHARS_AT_ONCE = 2_000_000
#: Tables of up to so many (narrow) rows are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if it has at most ``rows`` rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def slices(texts: list[str], limit: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about ``limit`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the ranges [start, start + length), one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


BASE = 0x9E3779B97F4A7C15
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, one text after the other, and the number of words
    of each. A-Z count as a-z; words end at ASCII white space."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]).lower(), np.uint8)  # of bytes: A-Z alone
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    ends_of_texts = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    white = (data == 32) | (data - np.uint8(9) < 5)
    starts = np.flatnonzero(~white & np.r_[True, white[:-1]])
    ends = np.flatnonzero(white & np.r_[False, ~white[:-1]])
    up, down = powers(len(data) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(BYTES.take(data) * up[: len(data)], dtype=np.uint64)]
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.diff(np.r_[0, np.searchsorted(starts, ends_of_texts)])
