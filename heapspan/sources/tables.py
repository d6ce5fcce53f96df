"""Ordinary tables as an object graph, so that every operator runs on Parquet.

super root -> region -> nation -> customer -> order -> line -> lot. A line is the first record of its (order, line number) in
a total order of the columns; the other records only repeat its edge. A lot, (part, quantity), is shared by lines. Suppliers have
no incoming edge: they are unreachable. Ids are kind * 10^12 + key + 1; sizes are integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..store import parts_of

KIND = 10**12
# Number of each kind.
KINDS = {"region": 1, "nation": 2, "customer": 3, "order": 4, "line": 5, "lot": 6, "supplier": 7}
GC_ROOT, FIELD, ELEMENT = 0, 1, 2


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key) -> F.Column:
    return (F.lit(KINDS[kind] * KIND) + key + 1).cast("long")


def _line_key() -> F.Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def _lot_key() -> F.Column:
    return F.col("l_partkey") * 64 + F.col("l_quantity").cast("long")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each (l_orderkey, l_linenumber)."""
    records = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate", "l_extendedprice")
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag"))
    # few records are repeated, so combining them before the shuffle would sort each file part for nothing
    records = records.repartition(parts_of(spark, records.count()), "l_orderkey", "l_linenumber")
    return records.groupBy("l_orderkey", "l_linenumber").agg(first.alias("r")).select("l_orderkey", "l_linenumber", "r.*")


def nodes(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """line: a table of lines(), if there is one."""
    t = lambda name: load(spark, sf_dir, name)

    def of(df: DataFrame, kind: str, key, name, size, node_type: str = graph.INSTANCE) -> DataFrame:
        return df.select(_id(kind, key).alias("nid"), F.lit(node_type).alias("node_type"), name.alias("class_name"), size.cast("long").alias("shallow_size"))

    line = lines(spark, sf_dir) if line is None else line
    lot = line.select(_lot_key().alias("lot"), "l_partkey").distinct()
    parts = [
        spark.createDataFrame([(0, graph.SUPER, "", 0)], "nid long, node_type string, class_name string, shallow_size long"),
        of(t("region"), "region", F.col("r_regionkey"), F.lit("shop.Region"), F.lit(24)),
        of(t("nation"), "nation", F.col("n_nationkey"), F.lit("shop.Nation"), F.lit(32)),
        of(t("customer"), "customer", F.col("c_custkey"), F.concat(F.lit("shop.Customer."), F.initcap("c_mktsegment")), F.lit(40)),
        of(t("orders"), "order", F.col("o_orderkey"), F.concat(F.lit("shop.Order."), "o_orderstatus"), F.lit(48)),
        of(line, "line", _line_key(), F.concat(F.lit("shop.Line."), "l_returnflag"), 16 + F.col("l_quantity").cast("long")),
        of(lot, "lot", F.col("lot"), F.lit("byte[]"), 16 + 8 * (F.col("l_partkey") % 50), graph.ARRAY),
        of(t("supplier"), "supplier", F.col("s_suppkey"), F.lit("shop.Supplier"), F.lit(56)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("object_id", F.col("nid").cast("decimal(20,0)"))


def edges(spark: SparkSession, sf_dir: str, cycles: bool = False, line: DataFrame | None = None) -> DataFrame:
    """With cycles also line -> supplier -> nation. A repeated record adds no edge: its line has its order and number."""
    t = lambda name: load(spark, sf_dir, name)
    link = lambda df, a, b, label: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"), F.lit(label).alias("label"))
    line = lines(spark, sf_dir) if line is None else line
    parts = [
        link(t("region"), F.lit(0), _id("region", F.col("r_regionkey")), GC_ROOT),
        link(t("nation"), _id("region", F.col("n_regionkey")), _id("nation", F.col("n_nationkey")), FIELD),
        link(t("customer"), _id("nation", F.col("c_nationkey")), _id("customer", F.col("c_custkey")), FIELD),
        link(t("orders"), _id("customer", F.col("o_custkey")), _id("order", F.col("o_orderkey")), FIELD),
        link(line, _id("order", F.col("l_orderkey")), _id("line", _line_key()), ELEMENT),
        link(line, _id("line", _line_key()), _id("lot", _lot_key()), FIELD),
    ]
    if cycles:
        parts += [link(line, _id("line", _line_key()), _id("supplier", F.col("l_suppkey")), FIELD), link(t("supplier"), _id("supplier", F.col("s_suppkey")), _id("nation", F.col("s_nationkey")), FIELD)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def strings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as strings and their backing arrays."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    s = docs.select(F.col("doc_id").alias("object_id"), F.col("doc_id").alias("backing_id"), F.lit(24).cast("long").alias("shallow_size"), F.col("doc_id").alias("position"))
    b = docs.select(F.col("doc_id").alias("object_id"), F.encode("text", "UTF-8").alias("content"), (F.octet_length("text") + 16).cast("long").alias("shallow_size"), F.lit(False).alias("is_chars"))
    return s, b


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as collections of their lines; the priority decides class and capacity."""
    o, n = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"))
    kind = F.when(F.col("o_orderpriority") < "2", "java.util.HashMap").when(F.col("o_orderpriority") < "4", "java.util.ArrayList").otherwise("java.util.LinkedHashMap")
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select(kind.alias("class_name"), F.lit(48).cast("long").alias("shallow_size"), F.coalesce("size", F.lit(0)).alias("size"), (8 + F.col("o_custkey") % 57).alias("capacity"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram a year, of orders by status and priority: snapshot, taken, class_name, instance_count, shallow_size, retained_size."""
    o = load(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("taken"), F.concat(F.lit("shop."), "o_orderstatus", F.lit("."), F.substring("o_orderpriority", 1, 1)).alias("class_name"), F.floor("o_totalprice").cast("long").alias("size"))
    return o.groupBy("taken", "class_name").agg(F.count("*").alias("instance_count"), (F.count("*") * 48).alias("shallow_size"), F.sum("size").alias("retained_size")).select(F.concat(F.lit("y"), "taken").alias("snapshot"), "taken", "class_name", "instance_count", "shallow_size", "retained_size")
