"""Analyzed graphs kept by the content of their dump.

An entry is a folder named by the digest of the dump's bytes and the version of the tables; it holds nodes, edges, the dominator tree and
loaders as Parquet, and, written last, a manifest with their row counts. An entry without a manifest, or of which a table has
other counts, is no entry. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import HeapAnalysis
from .sources import hprof

VERSION = 1
TABLES = ("nodes", "edges", "tree", "loaders")


def digest(spark: SparkSession, path: str) -> str:
    """Of one dump's bytes, read as a stream by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("path").to_pylist():
                found = hashlib.sha256()
                with hprof._open(file) as f:
                    while data := f.read(hprof.PIECE):
                        found.update(data)
                yield pa.RecordBatch.from_pydict({"path": [file], "digest": [found.hexdigest()]})

    rows = spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "path string, digest string").collect()
    if len(rows) != 1:
        raise hprof.HprofError("a digest is of one dump")
    return rows[0].digest


class Cache:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, key: str, name: str) -> str:
        return f"{self.folder}/{key}-v{VERSION}/{name}"

    def get(self, key: str) -> HeapAnalysis | None:
        try:
            told = json.loads("".join(r.value for r in self.spark.read.text(self._at(key, "manifest")).collect()))
            tables = {n: self.spark.read.parquet(self._at(key, n)) for n in TABLES}
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        if any(told.get(n) != tables[n].count() for n in TABLES):
            return None
        return HeapAnalysis.of_tables(**tables)

    def put(self, key: str, heap: HeapAnalysis) -> HeapAnalysis:
        counts = {}
        for name in TABLES:
            table: DataFrame = getattr(heap, name)
            table.write.mode("overwrite").parquet(self._at(key, name))
            counts[name] = self.spark.read.parquet(self._at(key, name)).count()
        self.spark.range(1).select(F.lit(json.dumps(counts)).alias("value")).coalesce(1).write.mode("overwrite").text(self._at(key, "manifest"))
        found = self.get(key)
        if found is None:
            raise OSError("the entry is damaged")
        return found

    def analyze(self, path: str) -> HeapAnalysis:
        """The dump's analysis: kept tables, or new ones that are then kept."""
        key = digest(self.spark, path)
        found = self.get(key)
        if found is None:
            found = self.put(key, HeapAnalysis.of_dump(hprof.read(self.spark, path)))
        return found
