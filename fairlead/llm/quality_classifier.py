"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is a sample of all documents.
With the class prior (the share of good ones) known, the risk on bad documents is what is left of
the unlabelled risk when the positives' share is taken out; held at zero or more, it can't be
driven negative by a model that learns the positives by heart. A small network is fitted to that
risk. The prior is estimated from the positives and the unlabelled set alone: a first network tells the
two apart, and on rows that it has not seen, the share of unlabelled rows above a score, over that of positives,
is at most the share of good ones plus what bad ones score as high. That ratio, where its upper bound of sampling
error is least, estimates the prior; labels of bad documents are not looked at.

Features are dense and cheap: shares of byte-class pairs and a few measures of repetition. Fitting
takes two bounded samples (``sample`` rows each, by hash of doc_id); scoring is one pass over all
documents without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many positives, and so many unlabelled rows, are fitted.
SAMPLE = 6_000

#: Byte classes: letters and bytes from 128 on 0, capitals 1, digits 2, then each of these its own,
#: other bytes the last.
SINGLE = " \n.,!?|#*$%&<>;:'\"-()[]{}=/\\_@+"
KINDS = 3 + len(SINGLE) + 1
CLASS = np.full(256, KINDS - 1, np.int64)
CLASS[97:123] = CLASS[128:] = 0
CLASS[65:91] = 1
CLASS[48:58] = 2
for _i, _c in enumerate(SINGLE):
    CLASS[ord(_c)] = 3 + _i
#: So many rows, and so many columns, of the samples are worked on at once on the driver.
ROWS, COLUMNS = 512, 64
#: Beside the shares of classes and of their pairs.
MEASURES = 9
FEATURES = KINDS + KINDS * KINDS + MEASURES


def features(text: str | None) -> np.ndarray:
    """FEATURES numbers of a text; null and empty texts give zeros."""
    raw = (text or "").encode()
    out = np.zeros(FEATURES, np.float32)
    if not raw:
        return out
    kinds = CLASS[np.frombuffer(raw, np.uint8)]
    out[:KINDS] = np.sqrt(np.bincount(kinds, minlength=KINDS) / len(kinds))
    if len(kinds) > 1:
        out[KINDS : KINDS + KINDS * KINDS] = np.sqrt(np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) / len(kinds))
    words = raw.lower().split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if n:
        pairs = len(set(zip(words, words[1:])))
        repeats = sum(map(eq, words, words[1:]))
        out[-MEASURES:] = (
            math.log1p(n) / 8,
            len(set(words)) / n,
            (pairs + 1) / n,
            repeats / n,
            math.sqrt(repeats / n),
            (len(lines) - len(set(lines))) / max(1, len(lines)),
            min(len(raw) / n / 20, 3),
            math.log1p(len(lines)) / 6,
            n / (n + 20),
        )
    return out


@dataclass
class Model:
    """A network with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    prior: float
    centre: float = 0.0
    slope: float = 1.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Of many rows in parts, so that no copy of all of them is made."""
        if len(x) > ROWS:
            return np.concatenate([self.margins(x[a : a + ROWS]) for a in range(0, len(x), ROWS)])
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        return np.tanh(z @ self.hidden + self.bias) @ self.out + self.shift

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.margins(x) - self.centre) * self.slope, -30, 30)))

    def calibrate(self, unlabelled: np.ndarray) -> None:
        """Sets the scale by the prior: the unlabelled rows fall into its share of good ones and
        the rest; if their mean margins lie well apart with a valley between them, they go to 0.95
        and 0.05. One bell-shaped population is not cut: scores stay those of the fit."""
        m = np.sort(self.margins(unlabelled))
        cut = round(len(m) * (1 - self.prior))
        if not 0 < cut < len(m):
            return
        low, high = float(m[:cut].mean()), float(m[cut:].mean())
        if (gap := high - low) > 1.5 and valley(m, low, high):
            self.centre, self.slope = (high + low) / 2, 6 / gap


def valley(m: np.ndarray, low: float, high: float) -> bool:
    """Whether fewer than half as many of ``m`` lie around the middle of ``low`` and ``high`` as
    around the emptier of these two, each time in a range as wide as a third of their distance."""
    near = lambda x: int((np.abs(m - x) <= (high - low) / 6).sum())
    return 2 * near((low + high) / 2) < min(near(low), near(high))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, within 0.05 to 0.99. Half of the rows
    fit a network that tells the two sets apart, the other half is counted above each score."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.99
    model = fit(positive[::2], unlabelled[::2], None, steps=400)
    p, u = np.sort(model.margins(positive[1::2])), np.sort(model.margins(unlabelled[1::2]))
    above_p = 1 - np.arange(len(p)) / len(p)
    above_u = 1 - np.searchsorted(u, p) / len(u)
    error = math.sqrt(math.log(40) / (2 * len(p))) + math.sqrt(math.log(40) / (2 * len(u)))  # at nine of ten
    best = int(np.argmin((above_u + error) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99))


def standardised(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of both with features of mean 0 and spread 1, the means and the scales. A few columns at a time: the
    samples are the largest thing that the driver holds, and this is their only copy in 32 bits."""
    both = np.empty((len(positive) + len(unlabelled), positive.shape[1]), np.float32)
    mean, scale = np.empty((2, both.shape[1]), np.float32)
    for a in range(0, both.shape[1], COLUMNS):
        part = np.concatenate([x[:, a : a + COLUMNS] for x in (positive, unlabelled)], dtype=np.float32)
        spread = part.std(0)
        mean[a : a + COLUMNS] = part.mean(0)
        scale[a : a + COLUMNS] = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-3), 0)
        both[:, a : a + COLUMNS] = np.clip((part - mean[a : a + COLUMNS]) * scale[a : a + COLUMNS], -6, 6)
    return both, mean, scale


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 800, batch: int = 256, units: int = 16, rate: float = 0.003, seed: int = 7) -> Model:
    """Minimises the non-negative risk with the logistic loss by Adam: prior * R+(P) + max(0,
    R-(U) - prior * R-(P)). While the bracket is negative, its steps go the other way. Without a prior
    the two sets are told apart."""
    rng = np.random.default_rng(seed)
    both, mean, scale = standardised(positive, unlabelled)
    p, u = both[: len(positive)], both[len(positive) :]
    params = [rng.normal(0, 0.3 / math.sqrt(p.shape[1]), (p.shape[1], units)), np.zeros(units), rng.normal(0, 0.3, units), np.array([math.log(prior / (1 - prior)) if prior else 0.0])]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        x = np.concatenate([xp, xu])
        a = np.tanh(x @ params[0] + params[1])
        f = a @ params[2] + params[3]
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        loss_bad = np.logaddexp(0, f)  # of calling a document bad
        d = np.empty_like(f)
        if prior is None:
            d[:batch], d[batch:] = s[:batch] - 1, s[batch:]
        elif loss_bad[batch:].mean() >= prior * loss_bad[:batch].mean():
            d[:batch] = prior * (s[:batch] - 1) - prior * s[:batch]
            d[batch:] = s[batch:]
        else:
            d[:batch] = prior * s[:batch]
            d[batch:] = -s[batch:]
        d /= batch
        back = d[:, None] * params[2] * (1 - a * a)
        grads = [x.T @ back + 1e-4 * params[0], back.sum(0), a.T @ d + 1e-4 * params[2], np.array([d.sum()])]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(mean, scale, params[0].astype(np.float32), params[1].astype(np.float32), params[2].astype(np.float32), float(params[3][0]), prior or 0.5)
    if prior is not None:
        model.calibrate(unlabelled)
    return model


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of doc_id as text is 0 modulo ``folds``; a null doc_id counts as the empty
    text and is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def sampled(df: DataFrame, ids: DataFrame, text: str, doc_id: str, sample: int) -> np.ndarray:
    """Features, in 16 bits, of at most ``sample`` rows: those whose id has the smallest hashes, of rows with the
    same id those with the smallest hashes of their text."""
    chosen = ids.select(doc_id).filter(F.col(doc_id).isNotNull()).distinct().orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.binary())], names=schema.names)

    rows = df.select(doc_id, text).join(F.broadcast(chosen), doc_id).select(F.xxhash64(doc_id).alias("at"), F.xxhash64(text).alias("hash"), text)
    rows = rows.mapInArrow(run, schema).orderBy("at", "hash").limit(sample).toArrow().column("x")
    found = sorted(x.as_py() for x in rows)  # the order of rows must not matter
    return np.frombuffer(b"".join(found), np.float16).reshape(len(found), FEATURES)


def train(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", folds: int = 5, sample: int = SAMPLE) -> Model | None:
    """A model from the rows labelled good that are not held out; None without one. A doc_id counts once, however often
    it is labelled, and not at all if it is labelled bad as well."""
    known = labels.filter(F.col(quality).isNotNull() & ~held_out(doc_id, folds)).groupBy(doc_id).agg(F.min(F.col(quality)).alias("least"))
    positive = sampled(df, known.filter("least = 1"), text, doc_id, sample)
    if not len(positive):
        return None
    unlabelled = sampled(df, df, text, doc_id, sample)
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled))


def classify(df: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with score (0 to 1, higher: good likelier) and predicted (1 from ``threshold`` on).

    Null and empty texts are scored as texts without words, very long ones whole. Without a model
    every score is 0.5. Repeated rows get equal scores; an empty table stays empty; columns of these
    names are replaced.
    """
    df = df.drop("score", "predicted")
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a in range(0, len(texts), 512):
                part = batch.slice(a, 512)
                x = np.stack([features(t) for t in texts[a : a + 512]])
                # row by row sums: a score doesn't depend on its neighbours
                s = np.round(model.scores(x).astype(np.float64), 6) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return df.mapInArrow(run, schema)
