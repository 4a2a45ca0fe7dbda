"""A table of contents with one writer at a time for each version.

Every version is a small JSON file, named by its number. A writer puts the file of the next version only if it is
not there yet; of two writers with the same number one fails, looks at what the other wrote and
tries again. Readers see whole versions only.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

SCHEMA = "version long, run_id string, source string, region string, written_at string, parts map<string, string>, rows map<string, long>, compacted string, upto long"


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def _file(self, name: str):
        return self.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[dict]:
        """All versions in order: a row for each run or compaction."""
        folder = self._file("")
        if not folder.getFileSystem(self.conf).exists(folder):
            return []
        rows = self.spark.read.schema(SCHEMA).json(f"{self.path}/[0-9]*.json").orderBy("version").collect()
        return [r.asDict() for r in rows]

    def put(self, version: int, entry: dict) -> bool:
        """Writes ``entry`` as ``version`` unless that is there already; whether it was written. The file is written
        aside and renamed, which must not replace another: it is as atomic as the store's rename."""
        aside, final = self._file(f".{uuid.uuid4().hex}"), self._file(f"{version:012d}.json")
        fs = aside.getFileSystem(self.conf)
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": version} | entry).encode()))
        out.close()
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self.fs, "Options$Rename"), 0)
        try:
            self.fs.FileContext.getFileContext(aside.toUri(), self.conf).rename(aside, final, no_options)
            return True
        except Py4JJavaError as error:
            fs.delete(aside, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
