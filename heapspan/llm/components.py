"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, root) of every node of edges(a, b), both long: root is the smallest node of its component.

    A large star links each larger neighbour of a node to its smallest one, a small star each smaller neighbour; edges
    never outnumber the input's, a hub's neighbours are only ever reduced by min(), and the rounds are logarithmic. Each
    round is a table in the shared folder; only its count and checksum reach the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        met = both.join(least, "v")
        if large:
            out = met.where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = store.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star0")
    seen, n = summary(now), 0
    while seen[0]:
        n += 1
        now = store.put(star(star(now, True), False), f"star{n}")
        store.drop(f"star{n - 1}")
        last, seen = seen, summary(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
