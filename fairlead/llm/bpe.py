"""BPE encoding and decoding in batched numpy merge rounds.

The words of a batch are encoded together. All symbols lie in one flat array; in each round every
word finds its lowest-rank pair by binary search over the sorted pair keys and merges all its
occurrences from the left. Words that have no pair left drop out. A batch encodes each different
word once; the ids of the texts are then gathered by index.

Spark deals the rows out; a text never leaves its row, so nothing is shuffled. The tokenizer file
is read by each Python worker from ``path``, which must exist on every machine.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fairlead.llm.common import ragged, slices

#: The pieces that the tokenizer file's Split pattern takes from a text.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+")
SPACE = regex.compile("[" + WHITE + "]+")
#: Python's split() also splits at these, which are no white space to the tokenizer.
NOT_SPACE = regex.compile(r"[\x1c-\x1f]")
NO_RANK = np.iinfo(np.int64).max
#: A worker keeps the ids of about so many words, the first that it meets.
KEPT_WORDS = 200_000


def byte_characters() -> list[str]:
    """The printable character for each byte: itself if it is printable Latin-1, else one from
    256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Tokenizer:
    """A tokenizer file of kind BPE with word ends (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        end = model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.first = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        keys, at = np.unique(keys, return_index=True)  # of a repeated pair the first rank counts
        self.keys, self.ranks = keys, at.astype(np.int64)
        self.made = made
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.table = None
        self.known: dict[str, int] = {}
        self.ids = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    # -- words ---------------------------------------------------------------------------------

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and their number for each piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.first[raw]
        symbols[np.cumsum(sizes) - 1] = self.last[raw[np.cumsum(sizes) - 1]]
        word = np.repeat(np.arange(len(pieces)), sizes)
        pair = np.full(len(symbols), NO_RANK)  # rank of each symbol with the next one of its word
        self.rank(pair, symbols, word, np.arange(len(symbols) - 1))
        done_words, done_symbols = [], []
        while len(symbols):
            new_word = np.r_[True, word[1:] != word[:-1]]
            least = np.minimum.reduceat(pair, np.flatnonzero(new_word))[np.cumsum(new_word) - 1]
            over = least == NO_RANK
            if over.any():
                done_words.append(word[over])
                done_symbols.append(symbols[over])
                keep = ~over
                symbols, word, pair, least = symbols[keep], word[keep], pair[keep], least[keep]
                if not len(symbols):
                    break
            take = np.flatnonzero(pair == least)
            run = np.r_[True, np.diff(take) > 1]  # of overlapping occurrences every other one merges
            first = np.maximum.accumulate(np.where(run, np.arange(len(take)), 0))
            take = take[(np.arange(len(take)) - first) % 2 == 0]
            symbols[take] = self.made[pair[take]]
            keep = np.ones(len(symbols), bool)
            keep[take + 1] = False
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            take -= np.arange(len(take))  # where the merged symbols lie now
            pair[take] = NO_RANK
            at = np.r_[take[take > 0] - 1, take[take < len(symbols) - 1]]
            pair[at] = NO_RANK
            self.rank(pair, symbols, word, at)
        word = np.concatenate(done_words) if done_words else np.empty(0, np.int64)
        symbols = np.concatenate(done_symbols) if done_symbols else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(pieces))

    def rank(self, pair: np.ndarray, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> None:
        """Sets the ranks of the pairs that begin at ``at``, where there is one."""
        at = at[word[at] == word[at + 1]]
        key = symbols[at] << 32 | symbols[at + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[found] == key
        pair[at[hit]] = self.ranks[found[hit]]

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of white-space-free lower-case words, one after the other, and their number for each."""
        pieces, owner = [], []
        for i, w in enumerate(words):
            if w.isascii() and w.isalpha():
                pieces.append(w.encode())
                owner.append(i)
            else:
                found = PIECES.findall(w)
                pieces += [p.encode("utf-8", "replace") for p in found]
                owner += [i] * len(found)
        ids, counts = self.merge(pieces)
        return ids, np.bincount(np.array(owner, np.int64), weights=counts, minlength=len(words)).astype(np.int64)

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            text = text.replace("Σ", "σ")  # lower-casing is by character here: no final sigma
        elif NOT_SPACE.search(text) is None:
            return text.lower().split()
        return [w for w in SPACE.split(text.lower()) if w] if NOT_SPACE.search(text) else text.lower().split()

    # -- texts ---------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number for each text."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(words)
            if "<|" in text and self.split_special is not None:
                for part in self.split_special.split(text):
                    words += [part] if part in self.special else self.words(part)
            else:
                words += self.words(text)
            counts[i] = len(words) - before
        codes, unique = pd.factorize(np.array(words, dtype=object)) if words else (np.empty(0, np.int64), np.empty(0, object))
        unique = list(unique)
        row = np.fromiter((self.known.get(w, -1) for w in unique), np.int64, len(unique))
        ids, starts, lengths = self.ids, self.starts, self.lengths
        if (row < 0).any():
            new = [unique[i] for i in np.flatnonzero(row < 0)]
            own = np.array([w in self.special for w in new])
            got, sizes = self.spell(["" if w in self.special else w for w in new])
            if own.any():  # a special token is an id of its own
                got = np.insert(got, (np.cumsum(sizes) - sizes)[own], [self.special[w] for w in new if w in self.special])
                sizes = sizes + own
            row[row < 0] = len(starts) + np.arange(len(new))
            starts = np.r_[starts, len(ids) + np.cumsum(sizes) - sizes]
            lengths, ids = np.r_[lengths, sizes], np.r_[ids, got]
            if len(self.known) < KEPT_WORDS:  # beyond, words that are not kept are spelled in each batch
                self.known.update(zip(new, range(len(self.starts), len(starts))))
                self.ids, self.starts, self.lengths = ids, starts, lengths
        each = row[codes]
        sizes = lengths[each]
        out = ids[ragged(starts[each], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)]
        return out.astype(np.uint32), np.diff(np.r_[0, ends])

    def decode(self, ids: np.ndarray) -> str:
        """As the library does for a file without a decoder: tokens joined by single spaces; ids
        outside the vocabulary are left out."""
        if self.table is None:
            self.table = np.full(max(self.tokens) + 2, None, dtype=object)  # the last stands for unknown ids
            for i, token in self.tokens.items():
                self.table[i] = token
        tokens = self.table[np.where((ids >= 0) & (ids < len(self.table)), ids, -1)].tolist()
        return " ".join(tokens) if None not in tokens else " ".join(t for t in tokens if t is not None)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


#: What ``encode`` can return for a text.
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType(), False),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode(df: DataFrame, path: str, text: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``df`` with OUTPUTS of its text column: the token ids (array<int>), their number, the
    SHA-256 of the ids as little-endian unsigned 32-bit integers, the ids decoded again and the
    SHA-256 of that.

    A null text counts as empty and gives an empty array; very long texts are encoded whole.
    Repeated rows give repeated results; an empty table stays empty. Columns that are already
    named like an output are replaced.
    """
    df = df.drop(*(o for o in outputs if o != text))
    schema = T.StructType([*df.schema.fields, *(T.StructField(o, OUTPUTS[o]) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for a, b in slices(texts):
                ids, counts = t.encode(texts[a:b])
                ends = np.cumsum(counts)
                each = [ids[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())]
                columns = []
                for o in outputs:
                    if o == "ids":
                        columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32))))
                    elif o == "n_tokens":
                        columns.append(pa.array(counts, pa.int64()))
                    elif o == "ids_sha256":
                        columns.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()))
                    elif o == "decoded":
                        columns.append(pa.array([t.decode(x) for x in each], pa.string()))
                    else:
                        columns.append(pa.array([hashlib.sha256(t.decode(x).encode()).hexdigest() for x in each], pa.string()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a column ``out``: the text of the ids in column ``ids`` (null ids: empty text).

    Ids outside the vocabulary are left out. A column that is already named ``out`` is replaced.
    """
    df = df.drop(out) if out in df.columns else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            values = [t.decode(x) for x in id_arrays(batch.column(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def id_arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row; none for null."""
    values, offsets = np.asarray(column.values), np.asarray(column.offsets)
    for i in range(len(column)):
        yield values[offsets[i] : offsets[i + 1]] if column[i].is_valid else values[:0]
