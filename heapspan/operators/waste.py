"""Wasted memory: duplicate strings, empty and oversized collections, boxed numbers.

strings: object_id, backing_id, shallow_size, position; backings: object_id, content binary, shallow_size, is_chars.
collections: class_name, shallow_size, size, capacity (length of the backing array, or null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Collection classes and the widths of boxed numbers.
COLLECTIONS = ("java.util.HashMap", "java.util.LinkedHashMap", "java.util.ArrayList")
BOXES = {"java.lang.Boolean": 1, "java.lang.Byte": 1, "java.lang.Character": 2, "java.lang.Short": 2, "java.lang.Integer": 4, "java.lang.Float": 4, "java.lang.Long": 8, "java.lang.Double": 8}
PREVIEW = 120


def duplicate_strings(strings: DataFrame, backings: DataFrame, most: int = 50) -> DataFrame:
    """Groups of strings of equal content: preview, count, wasted_bytes, total_bytes; the `most` most wasteful.

    A backing array that several strings share is hashed once. Wasted is what all but the first of a group take, at the first's size.
    """
    content = backings.select(F.col("object_id").alias("backing_id"), F.sha2("content", 256).alias("digest"), F.col("shallow_size").alias("array_size"), F.expr(f"IF(is_chars, decode(left(content, {2 * PREVIEW}), 'UTF-16BE'), make_valid_utf8(cast(left(content, {PREVIEW}) as string)))").alias("preview"))
    met = strings.join(content, "backing_id").withColumn("each", F.col("shallow_size") + F.col("array_size"))
    groups = met.groupBy("digest").agg(F.count("*").alias("count"), F.min_by("each", "position").alias("each"), F.min_by("preview", "position").alias("preview")).where("count > 1")
    return groups.select("preview", "count", ((F.col("count") - 1) * F.col("each")).alias("wasted_bytes"), (F.col("count") * F.col("each")).alias("total_bytes")).orderBy(F.desc("wasted_bytes"), "preview", F.desc("count"), F.desc("total_bytes")).limit(most)


def empty_collections(collections: DataFrame) -> DataFrame:
    empty = collections.where(F.col("class_name").isin(*COLLECTIONS) & (F.col("size") == 0))
    return empty.groupBy("class_name").agg(F.count("*").alias("count"), F.sum("shallow_size").alias("wasted_bytes")).orderBy(F.desc("wasted_bytes"), "class_name")


def oversized_collections(collections: DataFrame, reference: int = 4) -> DataFrame:
    """Collections that aren't empty and of which the array has over 16 places and over four times the size: count, wasted_bytes, avg_fill_percent."""
    wide = collections.where((F.col("size") > 0) & (F.col("capacity") > 16) & (F.col("capacity") > 4 * F.col("size")))
    return wide.groupBy("class_name").agg(F.count("*").alias("count"), F.sum((F.col("capacity") - F.col("size")) * reference).alias("wasted_bytes"), (F.avg(F.col("size") / F.col("capacity")) * 100).alias("avg_fill_percent")).orderBy(F.desc("wasted_bytes"), "class_name")


def boxed_numbers(nodes: DataFrame, boxes: dict[str, int] | None = None) -> DataFrame:
    """Boxed numbers: count and the bytes beyond the bare numbers."""
    widths = boxes or BOXES
    width = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])
    found = nodes.where(F.col("class_name").isin(*widths)).groupBy("class_name").agg(F.count("*").alias("count"), F.sum("shallow_size").alias("s"))
    return found.select("class_name", "count", F.greatest(F.col("s") - F.col("count") * width[F.col("class_name")], F.lit(0)).cast("long").alias("wasted_bytes")).orderBy(F.desc("wasted_bytes"), "class_name")


def totals(duplicates: DataFrame, empty: DataFrame, oversized: DataFrame, boxed: DataFrame, heap: int) -> DataFrame:
    """One row: bytes of each kind (of duplicates those listed), all of them, and their percentage of the whole heap."""
    names = ("duplicate_strings", "empty_collections", "oversized_collections", "boxed_numbers")
    parts = [df.agg(F.coalesce(F.sum("wasted_bytes"), F.lit(0)).cast("long").alias(f"{n}_bytes")) for n, df in zip(names, (duplicates, empty, oversized, boxed))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    total = sum((F.col(f"{n}_bytes") for n in names[1:]), F.col(f"{names[0]}_bytes"))
    return out.withColumn("total_wasted_bytes", total).withColumn("wasted_percentage", F.col("total_wasted_bytes") * 100.0 / F.lit(float(heap)) if heap else F.lit(0.0))


def shown(groups: DataFrame, by: str = "wasted_bytes", descending: bool = True, like: str = "") -> DataFrame:
    """Groups of one kind whose preview or class name holds `like` (any case), by a column; equal ones by name."""
    name = "preview" if "preview" in groups.columns else "class_name"
    if by not in groups.columns:
        raise ValueError(f"no column {by}")
    found = groups.where(F.contains(F.lower(name), F.lit(like.lower()))) if like else groups
    return found.orderBy(F.desc(by) if descending else F.asc(by), name)
