"""A narrow set of calls for programs that look into dumps: only dumps named at the start, no free queries."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .analysis import HeapAnalysis
from .plans.dialect import QueryError
from .sources import hprof


class Tools:
    def __init__(self, spark: SparkSession, allowed: list[str]) -> None:
        self.spark = spark
        self._paths = {str(n): p for n, p in enumerate(allowed, 1)}
        self._open: dict[str, HeapAnalysis] = {}

    def list_dumps(self) -> list[dict[str, object]]:
        return [{"dump": n, "name": os.path.basename(p), "open": n in self._open} for n, p in self._paths.items()]

    def analyze_heap(self, dump: str) -> dict[str, object]:
        if dump not in self._paths:
            raise QueryError("no such dump")
        if dump not in self._open:
            self._open[dump] = HeapAnalysis.of_dump(hprof.read(self.spark, self._paths[dump]))
        return self.get_summary(dump)

    def _heap(self, dump: str) -> HeapAnalysis:
        if dump not in self._open:
            raise QueryError("the dump is not open")
        return self._open[dump]

    def get_summary(self, dump: str) -> dict[str, object]:
        return dict(self._heap(dump).totals)

    def get_evidence(self, dump: str, rows: int = 10) -> dict[str, object]:
        """Suspects with where their memory piles up, and the classes that retain most."""
        heap = self._heap(dump)
        plain = lambda df: [{k: str(v) if k.endswith("_id") and v is not None else v for k, v in r.asDict().items()} for r in df.limit(rows).collect()]
        return {"suspects": plain(heap.accumulated()), "classes": plain(heap.histogram)}

    def investigate_heap(self, dump: str, operation: str, object_id: str) -> list[dict[str, object]]:
        return [{k: str(v) if k == "object_id" else v for k, v in r.asDict().items()} for r in self._heap(dump).investigate(operation, object_id).collect()]

    def close_dump(self, dump: str) -> None:
        self._open.pop(dump, None)
