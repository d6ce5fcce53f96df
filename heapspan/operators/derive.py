"""Tables derived from the dominator tree: histograms, top objects, leak suspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

MB = 1024 * 1024


def shallow_histogram(nodes: DataFrame) -> DataFrame:
    """instance_count and shallow_size of each class, of instances and arrays; largest first."""
    return nodes.where(F.col("node_type").isin(graph.INSTANCE, graph.ARRAY)).groupBy("class_name").agg(F.count("*").alias("instance_count"), F.sum("shallow_size").alias("shallow_size")).orderBy(F.desc("shallow_size"), "class_name")


def topmost(tree: DataFrame) -> DataFrame:
    """Reachable nodes without a node of their own class above them in the dominator tree."""
    return tree.where("reachable and not inner")


def retained_histogram(tree: DataFrame, total: int | None = None) -> DataFrame:
    """Count and shallow size of all objects of a class (unreachable ones too), retained size of its topmost ones; class nodes count
    from 1 % of the heap. Largest retained size first."""
    total = total if total is not None else tree.agg(F.sum("shallow_size")).first()[0] or 0
    counted = F.col("node_type").isin(graph.INSTANCE, graph.ARRAY) | (F.col("node_type") == graph.CLASS) & (F.col("retained_size") * 100 >= total)
    all_ = tree.where(counted).groupBy("class_name").agg(F.count("*").alias("instance_count"), F.sum("shallow_size").alias("shallow_size"))
    kept = topmost(tree.where(F.col("node_type") != graph.ROOT)).where(counted).groupBy("class_name").agg(F.sum("retained_size").alias("retained_size"))
    return all_.join(kept, "class_name", "left").select("class_name", "instance_count", "shallow_size", F.coalesce("retained_size", F.lit(0).cast("long")).alias("retained_size")).orderBy(F.desc("retained_size"), "class_name")


def top_objects(tree: DataFrame, n: int = 50, total: int | None = None) -> DataFrame:
    """The n objects that retain most; class nodes from 1 % of the heap."""
    total = total if total is not None else tree.agg(F.sum("shallow_size")).first()[0] or 0
    shown = F.col("node_type").isin(graph.INSTANCE, graph.ARRAY) | (F.col("node_type") == graph.CLASS) & (F.col("retained_size") * 100 >= total)
    return tree.where(shown & (F.col("retained_size") > 0)).select(*graph.REPORT).orderBy(*graph.by_retained()).limit(n)


def percentage(part: Column | str, whole: int) -> Column:
    return (F.col(part) if isinstance(part, str) else part) * F.lit(100.0) / F.lit(float(whole)) if whole else F.lit(0.0)


SUSPECT = "class_name string, object_id decimal(20,0), retained_size long, retained_percentage double, description string"


def loader_suspects(tree: DataFrame, loaders: DataFrame, reachable: int, n: int = 5) -> DataFrame:
    """Class loaders (loaders: nid) that retain 5 % of the reachable heap or more; the n largest."""
    floor = reachable * 5 // 100
    found = tree.join(loaders.select("nid").distinct(), "nid", "left_semi").where((F.col("retained_size") >= floor) & (F.col("class_name") != "") & (F.col("retained_size") > 0))
    return found.orderBy(*graph.by_retained()).limit(n).select("nid", "class_name", "object_id", "retained_size", percentage("retained_size", reachable).alias("retained_percentage"), F.format_string("Class loader %s retains %.1f%% of the heap (%.2f MB)", "class_name", percentage("retained_size", reachable), F.col("retained_size") / F.lit(float(MB))).alias("description"))


def class_suspects(histogram: DataFrame, reachable: int, percent: float = 10) -> DataFrame:
    """Classes of several objects that together retain over 10 %."""
    share = percentage("retained_size", reachable)
    return histogram.where((share > percent) & (F.col("instance_count") > 1)).select("class_name", F.lit(0).cast("decimal(20,0)").alias("object_id"), "retained_size", F.least(share, F.lit(99.9)).alias("retained_percentage"), F.format_string("%d instances of %s retain %.1f%% of the heap (%.2f MB)", "instance_count", "class_name", F.least(share, F.lit(99.9)), F.col("retained_size") / F.lit(float(MB))).alias("description"))


def object_candidates(tree: DataFrame, reachable: int, n: int = 10) -> DataFrame:
    """The n objects that retain 10 % or more; of equal ones the later."""
    return tree.where(F.col("node_type").isin(graph.INSTANCE, graph.ARRAY) & (F.col("retained_size") >= reachable * 10 // 100) & (F.col("retained_size") > 0)).orderBy(F.desc("retained_size"), F.desc("nid")).limit(n)


def _uncovered(tree: DataFrame, candidates: DataFrame, loaders: list[int]) -> DataFrame:
    """candidates (a handful) that are neither one of the loaders nor below one."""
    gone = graph.covered(tree, loaders, [r.nid for r in candidates.select("nid").collect()]) if loaders else set()
    return candidates.where(~F.col("nid").isin(sorted(gone))) if gone else candidates


def _object_description(reachable: int) -> Column:
    return F.format_string("Object of %s retains %.1f%% of the heap (%.2f MB)", "class_name", percentage("retained_size", reachable), F.col("retained_size") / F.lit(float(MB)))


def leak_suspects(tree: DataFrame, histogram: DataFrame, loaders: DataFrame, reachable: int, most: int = 10) -> DataFrame:
    """Loaders, then classes, then single objects that no suspect loader covers and whose class isn't listed yet, until there are
    `most`; by percentage, largest first. The fold over at most 10 candidates is on the driver."""
    spark = tree.sparkSession
    lead, kinds = loader_suspects(tree, loaders, reachable), class_suspects(histogram, reachable)
    rows = [(*r[1:], 0) for r in lead.collect()] + [(*r, 1) for r in kinds.orderBy(F.desc("retained_size"), "class_name").collect()]
    covering = [r.nid for r in lead.collect()]
    listed = {r[0] for r in rows}
    singles = _uncovered(tree, object_candidates(tree, reachable), covering).select("class_name", "object_id", "retained_size", percentage("retained_size", reachable).alias("p"), _object_description(reachable).alias("d"), "nid").orderBy(F.desc("retained_size"), F.desc("nid"))
    for r in singles.collect():
        if len(rows) >= most:
            break
        if r.class_name not in listed:
            listed.add(r.class_name)
            rows.append((*r[:5], 2))
    order = sorted(range(len(rows)), key=lambda i: -rows[i][3])
    return spark.createDataFrame([(*rows[i][:5], n) for n, i in enumerate(order)], SUSPECT + ", position int")


def object_suspects(tree: DataFrame, loaders: DataFrame, reachable: int) -> DataFrame:
    """All uncovered candidates and the suspect loaders; a candidate whose immediate dominator is listed too goes."""
    lead = loader_suspects(tree, loaders, reachable).select("nid")
    covering = [r.nid for r in lead.collect()]
    single = _uncovered(tree, object_candidates(tree, reachable), covering).select("nid", "idom")
    listed = single.select("nid").unionByName(lead).distinct()
    alone = single.join(listed.withColumnRenamed("nid", "idom"), "idom", "left_anti").select("nid")
    shown = tree.join(alone.unionByName(lead).distinct(), "nid", "left_semi")
    return shown.select("class_name", "object_id", "retained_size", percentage("retained_size", reachable).alias("retained_percentage"), _object_description(reachable).alias("description")).orderBy(F.desc("retained_percentage"), "object_id")


def legacy_object_suspects(tree: DataFrame, reachable: int, most: int = 10) -> DataFrame:
    """The older policy: objects from 5 %, without those of which one child candidate keeps over 9/10; the first `most`."""
    found = tree.where(F.col("node_type").isin(graph.INSTANCE, graph.ARRAY) & (F.col("retained_size") * 100 >= reachable * 5) & (F.col("retained_size") > 0))
    heavy = found.select(F.col("idom").alias("nid"), F.col("retained_size").alias("child"))
    passed = found.join(heavy, "nid").where(F.col("child") * 10 > F.col("retained_size") * 9).select("nid").distinct()
    return found.join(passed, "nid", "left_anti").orderBy(*graph.by_retained()).limit(most).select("class_name", "object_id", "retained_size", percentage("retained_size", reachable).alias("retained_percentage"), _object_description(reachable).alias("description"))


def legacy_suspects(tree: DataFrame, histogram: DataFrame, reachable: int, most: int = 10) -> DataFrame:
    """The older policy in whole: its objects, then the classes that class_suspects finds and no object has named."""
    objects = legacy_object_suspects(tree, reachable, most)
    classes = class_suspects(histogram, reachable).join(objects.select("class_name").distinct(), "class_name", "left_anti")
    return objects.withColumn("kind", F.lit("object")).unionByName(classes.select(*objects.columns).withColumn("kind", F.lit("class"))).orderBy(F.desc("kind"), F.desc("retained_size"), "class_name", "object_id")


def accumulations(tree: DataFrame, suspects: DataFrame, share: float = 0.7) -> DataFrame:
    """suspects (a handful, with object_id) with accumulation_class, accumulation_id and accumulation_size: where the memory that a
    suspect retains piles up, if that is another object. Loaders and objects have one, classes (id 0) have none."""
    spark, own = tree.sparkSession, F.col("object_id")
    starts = tree.join(F.broadcast(suspects.where(own != 0).select("object_id").distinct()), "object_id").select("object_id", "nid").collect()
    ends = graph.accumulation_points(tree, [r.nid for r in starts], share) if starts else {}
    named = spark.createDataFrame([(r.object_id, ends[r.nid]) for r in starts if ends[r.nid] != r.nid], "object_id decimal(20,0), nid long")
    at = tree.join(F.broadcast(named.withColumnRenamed("object_id", "from")), "nid").select(F.col("from").alias("object_id"), F.col("class_name").alias("accumulation_class"), F.col("object_id").alias("accumulation_id"), F.col("retained_size").alias("accumulation_size"))
    return suspects.join(at, "object_id", "left").select(*suspects.columns, "accumulation_class", "accumulation_id", "accumulation_size")


def class_drill(tree: DataFrame, class_name: str, n: int = 200) -> DataFrame:
    """The n objects of a class that retain most."""
    return tree.where((F.col("class_name") == class_name) & F.col("node_type").isin(graph.INSTANCE, graph.ARRAY) & (F.col("retained_size") > 0)).select(*graph.REPORT).orderBy(*graph.by_retained()).limit(n)


def unlinked_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The query language's tables before there are edges: nothing retains anything yet, and nothing has children."""
    own = nodes.where(F.col("node_type").isin(graph.INSTANCE, graph.ARRAY) & (F.col("shallow_size") > 0)).select("object_id", "node_type", "class_name", "shallow_size", F.lit(0).cast("long").alias("retained_size"), "nid")
    histogram = shallow_histogram(nodes).withColumn("retained_size", F.lit(0).cast("long"))
    return {"instances": own, "class_histogram": histogram, "leak_suspects": nodes.sparkSession.createDataFrame([], SUSPECT), "dominator_tree": own.limit(0)}


def above(suspects: DataFrame, percent: float) -> DataFrame:
    return suspects.where(F.col("retained_percentage") >= percent)
