"""Compact JSON snapshots for comparison, and text sinks of its results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diff

SUMMARY = ("total_heap_size", "reachable_heap_size", "total_instances", "total_classes", "total_arrays", "total_gc_roots")
WASTE = ("duplicate_strings_bytes", "empty_collections_bytes", "oversized_collections_bytes", "boxed_numbers_bytes", "total_wasted_bytes", "wasted_percentage")
SCHEMA = (
    "summary struct<" + ",".join(f"{c}:decimal(38,0)" for c in SUMMARY) + ">, "
    "class_histogram array<struct<class_name:string,instance_count:decimal(38,0),shallow_size:decimal(38,0),retained_size:decimal(38,0)>>, "
    "leak_suspects array<struct<class_name:string,object_id:decimal(20,0),retained_size:decimal(38,0),retained_percentage:double,description:string>>, "
    "waste_analysis struct<" + ",".join(f"{c}:double" for c in WASTE) + ">"
)
MOST_CLASSES, MOST_SUSPECTS, MOST_BYTES = 200_000, 10_000, 8 * 1024 * 1024


class SnapshotError(ValueError):
    pass


class Snapshot:
    """histogram, suspects (with position), summary and waste (or None) of one JSON document."""

    def __init__(self, histogram: DataFrame, suspects: DataFrame, summary: DataFrame, waste: DataFrame | None) -> None:
        self.histogram, self.suspects, self.summary, self.waste = histogram, suspects, summary, waste

    def compare(self, current: "Snapshot") -> dict[str, DataFrame | None]:
        return {"histogram": diff.histogram_delta(self.histogram, current.histogram), "suspects": diff.suspect_changes(self.suspects, current.suspects), "summary": diff.summary_delta(self.summary, current.summary), "waste": diff.waste_delta(self.waste, current.waste)}


def _longs(df: DataFrame) -> DataFrame:
    """Decimals as longs; a number that fits none is an error, ids excepted."""
    names = [n for n, kind in df.dtypes if kind == "decimal(38,0)"]
    if names and diff.fits_long(df).count() != df.count():
        raise SnapshotError("a number doesn't fit a signed 64-bit integer")
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def read(spark: SparkSession, document: str) -> Snapshot:
    one = spark.createDataFrame([(document,)], "value string").select(F.from_json("value", SCHEMA).alias("s")).select("s.*")
    sizes = one.select(F.col("summary").isNotNull(), F.size("class_histogram"), F.size("leak_suspects"), F.col("waste_analysis").isNotNull()).first()
    if not sizes[0] or sizes[1] is None or sizes[1] < 0:
        raise SnapshotError("not a snapshot")
    if sizes[1] > MOST_CLASSES or (sizes[2] or 0) > MOST_SUSPECTS:
        raise SnapshotError("the snapshot has too many rows")
    suspects = one.select(F.posexplode("leak_suspects").alias("position", "x")).select("x.*", "position")
    return Snapshot(_longs(one.select(F.inline("class_histogram"))), _longs(suspects), _longs(one.select("summary.*")), one.select("waste_analysis.*") if sizes[3] else None)


def timeline(spark: SparkSession, paths: list[str], n: int = 10, most: int = 64) -> DataFrame:
    """The n classes that retain most in each snapshot file, by the files' times; missing files are skipped. At most `most` are taken."""
    if len(paths) > most:
        raise SnapshotError(f"at most {most} snapshots")
    parts = []
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                taken = os.stat(path).st_mtime_ns
                parts.append(read(spark, f.read()).histogram.select(F.lit(path).alias("snapshot"), F.lit(taken).cast("long").alias("taken"), "*"))
    if not parts:
        raise SnapshotError("no snapshot")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return diff.timeline(out, n)


def compare_report(baseline: Snapshot, current: Snapshot, rows: int = 50, models: tuple[str, str] = ("", "")) -> dict[str, object]:
    """The comparison as a document: largest changes first, at most `rows` (1 to 10000) of each kind. models: the names of the two size
    models; sizes of different ones can't be compared, which size_models_differ says."""
    if not 1 <= rows <= 10_000:
        raise ValueError("rows must be from 1 to 10000")
    found, out = baseline.compare(current), {"size_models_differ": models[0] != models[1]}
    order = {"histogram": (F.abs("retained_size_delta").desc(), "class_name"), "suspects": (F.abs("retained_size_delta").desc(), "class_name")}
    for name, keys in order.items():
        some = [r.asDict() for r in found[name].orderBy(*keys).limit(rows + 1).collect()]
        out[name], out[f"{name}_truncated"] = some[:rows], len(some) > rows
    for name in ("summary", "waste"):
        out[name] = found[name].first().asDict() if found[name] is not None else None
    return out


def _text(path: str, lines: list[str]) -> None:
    body = "\n".join(lines) + "\n"
    if len(body.encode()) > MOST_BYTES:
        raise SnapshotError("the text is too large")
    with open(path, "x", encoding="utf-8") as f:
        f.write(body)


def write_csv(df: DataFrame, path: str) -> None:
    """A table as Spark's CSV files, every cell quoted and safe for spreadsheets."""
    line = text.csv_line(*(F.col(c) for c in df.columns)).alias("value")
    df.select(line).write.text(path)


def write_csv_file(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """A new local file of at most `rows` rows and 8 MiB; an existing file is an error."""
    if os.path.exists(path):
        raise FileExistsError(path)
    cells = df.limit(rows).select(text.csv_line(*(F.col(c) for c in df.columns)).alias("line")).collect()
    _text(path, [",".join(f'"{c}"' for c in df.columns), *(r.line for r in cells)])


def write_markdown(df: DataFrame, path: str, rows: int = 100) -> None:
    escape = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    _text(path, ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(escape, r)) + " |" for r in df.limit(rows).collect())])
