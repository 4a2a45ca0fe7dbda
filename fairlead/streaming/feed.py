"""A live source of messages: a streaming data source over a provider that keeps its messages by offset.

A provider is a class with ``latest()``, the offset behind its newest message, ``cut(start, end, parts)``, ranges that
tasks read on their own, and ``read(start, end, box)``, which yields the messages of a range, only those within
a box if one is asked for: the box goes to the provider, as it does with a subscription. Offsets are in the
stream's checkpoint, so a stream that starts again goes on where it stopped, and a batch that failed is
read again as it was.

``LineLog`` is the provider of a growing file of JSON lines on a shared path; another one is named by its class.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

Box = tuple[float, float, float, float]
NAME = "message_feed"


class LineLog:
    """Messages of a file that is only appended to; an offset is a place in it, a message belongs to the range in which
    it starts. A last line without its end is not there yet."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def latest(self) -> int:
        if not os.path.exists(self.path):
            return 0
        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            while size:
                start = max(0, size - 65536)
                f.seek(start)
                if (end := f.read(size - start).rfind(b"\n")) >= 0:
                    return start + end + 1
                size = start
        return 0

    def cut(self, start: int, end: int, parts: int) -> list[tuple[int, int]]:
        step = max(1, -(-(end - start) // max(1, parts)))
        return [(a, min(a + step, end)) for a in range(start, end, step)]

    def read(self, start: int, end: int, box: Box | None) -> Iterator[str]:
        with open(self.path, "rb") as f:
            f.seek(max(0, start - 1))
            if start and f.read(1) != b"\n":
                f.readline()  # belongs to the range before
            while f.tell() < end:
                line = f.readline().decode("utf-8", "replace").rstrip("\r\n")
                if line and (box is None or within(line, box)):
                    yield line


def within(line: str, box: Box) -> bool:
    """Whether a message's place is in the box (south, west, north, east); messages without one are let through."""
    try:
        meta = json.loads(line)["MetaData"]
        lat, lon = float(meta["latitude"]), float(meta["longitude"])
    except (ValueError, KeyError, TypeError):
        return True
    return box[0] <= lat <= box[2] and box[1] <= lon <= box[3]


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        module, _, name = options.get("provider", "fairlead.streaming.feed:LineLog").partition(":")
        self.provider = getattr(importlib.import_module(module), name)(dict(options))
        self.parts = int(options.get("parts", "8"))
        self.box = tuple(float(x) for x in options["box"].split(",")) if options.get("box") else None

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        return {"offset": self.provider.latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Range(a, b) for a, b in self.provider.cut(start["offset"], end["offset"], self.parts)]

    def read(self, partition: Range) -> Iterator[tuple[str]]:
        for line in self.provider.read(partition.start, partition.end, self.box):
            yield (line,)


class Feed(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def feed_stream(spark: SparkSession, box: Box | None = None, **options: str) -> DataFrame:
    """The messages (value) of a provider as a stream; ``box`` (south, west, north, east) is asked of the provider."""
    spark.dataSource.register(Feed)
    reader = spark.readStream.format(NAME).options(**options)
    return (reader.option("box", ",".join(map(str, box))) if box else reader).load()
