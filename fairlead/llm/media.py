"""Texts as PNG images in a binary column, and low-frequency cosine-transform hashes of images.

The writer stores bytes as 8-bit grey samples; the reader checks the signature, the checksum of
every chunk, the header and the length of the inflated data, undoes all five row filters in numpy
and takes the hash of the samples. Rows are handled on their own: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fairlead.llm.common import slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A payload is padded to a multiple of this, one row of an image.
WIDTH = 576
SIDE, LOW = 32, 8
COSINE = np.cos(np.pi / SIDE * np.outer(np.arange(LOW), np.arange(SIDE) + 0.5))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(samples: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey image (rows x columns) as PNG. Of the filters none and up the one with the
    smaller sum of absolute differences is taken for the whole image."""
    height, width = samples.shape
    up = samples.copy()
    up[1:] -= samples[:-1]
    cost = lambda x: int(np.minimum(x, 256 - x.astype(np.uint16)).sum())
    use_up = height > 1 and cost(up) < cost(samples)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = 2 if use_up else 0
    rows[:, 1:] = up if use_up else samples
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes PNG row filters; runs of rows with the same simple filter are undone together."""
    height, width = rows.shape
    out = np.empty_like(rows)
    before = np.zeros(width, np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), height]):
        kind, part = int(kinds[a]), rows[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part.reshape(b - a, width // bpp, bpp), axis=1, dtype=np.uint8).reshape(b - a, width)
        elif kind == 2:
            out[a:b] = np.cumsum(part, axis=0, dtype=np.uint8) + before
        elif kind in (3, 4):  # each sample needs the one to its left: by pixel
            for y in range(a, b):
                above = (before if y == a else out[y - 1]).astype(int).reshape(-1, bpp)
                line, got = part[y - a].astype(int).reshape(-1, bpp), np.zeros((width // bpp + 1, bpp), int)
                for x in range(len(line)):
                    left, up = got[x], above[x]
                    if kind == 3:
                        guess = (left + up) >> 1
                    else:
                        corner = above[x - 1] if x else np.zeros(bpp, int)
                        p = left + up - corner
                        da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
                        guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
                    got[x + 1] = (line[x] + guess) & 255
                out[y] = got[1:].reshape(-1)
        else:
            raise ValueError(f"PNG: filter {kind}")
        before = out[b - 1]
    return out


def samples(data: bytes) -> np.ndarray:
    """The samples of a PNG with 8 bits a channel, not interlaced and without a palette: rows x
    (columns x channels). A damaged image raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: no signature")
    at, header, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG: cut off")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + size]
        if len(content) < size or at + 12 + size > len(data):
            raise ValueError("PNG: cut off")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(content, zlib.crc32(kind)):
            raise ValueError(f"PNG: checksum of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("PNG: no header or end")
    width, height, depth, color, _, _, interlaced = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("PNG: only 8 bits a channel, not interlaced, without a palette")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (width * channels + 1):
        raise ValueError("PNG: length of the image data")
    rows = raw.reshape(height, width * channels + 1)
    return unfilter(rows[:, 0], rows[:, 1:], channels)


def shrunk(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Means of side x side areas; areas of a smaller image repeat its samples."""
    x = image.astype(np.float64)
    for axis in (0, 1):
        edges = np.arange(side) * x.shape[axis] // side
        ends = np.maximum(np.r_[edges[1:], x.shape[axis]], edges + 1)
        total = np.concatenate([np.zeros_like(x.take([0], axis)), np.cumsum(x, axis)], axis)
        shape = [1, 1]
        shape[axis] = -1
        x = (total.take(ends, axis) - total.take(edges, axis)) / (ends - edges).reshape(shape)
    return x


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest frequencies lie above their median (the first,
    the mean of the image, counts as 0)."""
    x = np.round(COSINE @ shrunk(image) @ COSINE.T, 6)
    x[0, 0] = 0
    return np.packbits(x > np.median(x)).tobytes().hex()


def to_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with ``media`` (binary: its text as a PNG) and n_bytes in place of the text column.

    The text's UTF-8 bytes, followed by bytes 255 up to a positive multiple of WIDTH, are the
    samples of an image WIDTH wide. Null and empty texts are one row of 255s. Long texts give high
    images. Repeated rows give equal images; an empty table stays empty. Columns of these names are
    replaced.
    """
    rest = [c for c in df.columns if c not in (text, media, "n_bytes")]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(len(rest)).to_pylist()]
            for a, b in slices(texts):
                lengths, images = [], []
                for value in texts[a:b]:
                    raw = value.encode()
                    size = max(1, -(-len(raw) // WIDTH)) * WIDTH
                    lengths.append(len(raw))
                    images.append(png(np.frombuffer(raw.ljust(size, b"\xff"), np.uint8).reshape(-1, WIDTH)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(lengths, pa.int64()), pa.array(images, pa.binary())], names=schema.names)

    return df.select(*rest, text).mapInArrow(run, schema)


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` without the media column, with what its images hold: payload_bytes, payload_sha256,
    tail_crc32 (the last 32 samples), media_bytes, media_sha256 and feature (the cosine hash).

    Of a null or damaged image only media_bytes and media_sha256 are known (null: neither). Repeated
    rows give equal results; an empty table stays empty; columns of these names are replaced.
    """
    own = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    rest = [c for c in df.columns if c != media and c not in dict(own)]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(n, t) for n, t in own)])

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            image = samples(data)
        except (ValueError, zlib.error):
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), None
        payload = image.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(features, batch.column(len(rest)).to_pylist()))) or [[]] * 6
            arrays = [pa.array(c, pa.int64() if isinstance(t, T.LongType) else pa.string()) for c, (_, t) in zip(columns, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *arrays], names=schema.names)

    return df.select(*rest, media).mapInArrow(run, schema)
