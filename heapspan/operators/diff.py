"""Comparison of snapshots, timelines, alerts, diagnosis.

A snapshot is a histogram (class_name, instance_count, shallow_size, retained_size), suspects and a one-row summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1024 * 1024


def histogram_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Per class the three deltas and change_type, which the retained size alone decides; largest change first."""
    b = baseline.select("class_name", *(F.col(c).alias(f"b_{c}") for c in ("instance_count", "shallow_size", "retained_size")), F.lit(1).alias("b"))
    c = current.select("class_name", "instance_count", "shallow_size", "retained_size", F.lit(1).alias("c"))
    met = c.join(b, "class_name", "full_outer")
    delta = {n: (F.coalesce(F.col(n), F.lit(0)) - F.coalesce(F.col(f"b_{n}"), F.lit(0))).alias(f"{n}_delta") for n in ("instance_count", "shallow_size", "retained_size")}
    kept = F.coalesce("retained_size", F.lit(0)) - F.coalesce("b_retained_size", F.lit(0))
    kind = F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "removed").when(kept > 0, "grew").when(kept < 0, "shrank").otherwise("unchanged")
    return met.select("class_name", *delta.values(), F.coalesce("b_retained_size", F.lit(0)).cast("long").alias("baseline_retained_size"), F.coalesce("retained_size", F.lit(0)).cast("long").alias("current_retained_size"), F.coalesce("instance_count", F.lit(0)).cast("long").alias("current_instance_count"), kind.alias("change_type")).orderBy(F.abs("retained_size_delta").desc(), "class_name")


def largest_changes(delta: DataFrame, n: int = 10) -> DataFrame:
    return delta.where("retained_size_delta <> 0").orderBy(F.abs("retained_size_delta").desc(), "class_name").limit(n)


def suspect_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """persisted, new or resolved by class name, and the place in the list that the row is from. Both need `position`; of equal names the
    baseline's last counts, every current row is shown."""
    last = baseline.groupBy("class_name").agg(*(F.max_by(c, "position").alias(f"b_{c}") for c in ("retained_size", "retained_percentage", "description")), F.max("position").alias("b_position"), F.lit(1).alias("b"))
    met = current.join(last, "class_name", "left")
    live = met.select("class_name", F.when(F.col("b").isNull(), "new").otherwise("persisted").alias("status"), "description", "retained_size", (F.col("retained_size") - F.coalesce("b_retained_size", F.lit(0))).alias("retained_size_delta"), "position")
    gone = last.join(current.select("class_name").distinct(), "class_name", "left_anti").select("class_name", F.lit("resolved").alias("status"), F.concat(F.lit("Previously: "), "b_description").alias("description"), F.lit(0).cast("long").alias("retained_size"), (-F.col("b_retained_size")).alias("retained_size_delta"), F.col("b_position").alias("position"))
    return live.unionByName(gone)


def summary_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """current - baseline of each number, in one row."""
    b = baseline.select(*(F.col(c).alias(f"b_{c}") for c in baseline.columns))
    return current.crossJoin(F.broadcast(b)).select(*((F.col(c) - F.col(f"b_{c}")).alias(f"{c}_delta") for c in current.columns))


def waste_delta(baseline: DataFrame | None, current: DataFrame | None) -> DataFrame | None:
    return summary_delta(baseline, current) if baseline is not None and current is not None else None


def timeline(histograms: DataFrame, n: int = 10) -> DataFrame:
    """The n classes that retain most in each snapshot. histograms: snapshot, taken (time), and the histogram's columns."""
    rank = F.row_number().over(Window.partitionBy("snapshot").orderBy(F.desc("retained_size"), "class_name"))
    return histograms.withColumn("rank", rank).where(F.col("rank") <= n).orderBy("taken", "snapshot", "rank")


def _dense(histograms: DataFrame) -> DataFrame:
    """A row for every class and snapshot; missing ones retain 0. One row a snapshot is broadcast (a timeline has at most 64)."""
    shots = histograms.select("snapshot", "taken").distinct()
    ordered = F.broadcast(shots.withColumn("step", F.row_number().over(Window.orderBy("taken", "snapshot"))))
    grid = histograms.select("class_name").distinct().crossJoin(ordered)
    return grid.join(histograms.select("class_name", "snapshot", "retained_size"), ["class_name", "snapshot"], "left").select("class_name", "step", F.coalesce("retained_size", F.lit(0).cast("long")).alias("retained_size"))


def growth(histograms: DataFrame, jump: float = 0.5, run: int = 2) -> DataFrame:
    """Per class the first and last size, growth_percent (100 if it is new) and anomaly: the last `run` or more steps each grew by over
    `jump`, in three snapshots or more."""
    w = Window.partitionBy("class_name").orderBy("step")
    steps = _dense(histograms).withColumn("before", F.lag("retained_size").over(w))
    jumped = F.when(F.col("before").isNull(), None).when(F.col("before") > 0, (F.col("retained_size") - F.col("before")) > jump * F.col("before")).otherwise(F.lit(False))
    series = steps.withColumn("jumped", jumped).groupBy("class_name").agg(F.array_sort(F.collect_list(F.struct("step", "retained_size", "jumped"))).alias("s"))
    first, last = F.col("s")[0]["retained_size"], F.element_at("s", -1)["retained_size"]
    calm = F.expr("array_max(transform(s, x -> IF(x.jumped, 0, x.step)))")
    trailing = F.size("s") - F.coalesce(calm, F.lit(1))
    percent = F.when(first > 0, (last - first) * 100.0 / first).when(last > 0, 100.0).otherwise(0.0)
    return series.select("class_name", first.alias("first_size"), last.alias("last_size"), (last - first).alias("growth"), percent.alias("growth_percent"), ((F.size("s") >= 3) & (trailing >= run)).alias("anomaly")).orderBy(F.desc("growth"), "class_name")


def class_lines(histograms: DataFrame, n: int = 10) -> DataFrame:
    """Sizes by snapshot of the n classes that changed most between the first and the last."""
    top = growth(histograms).orderBy(F.abs("growth").desc(), "class_name").limit(n).select("class_name")
    return _dense(histograms).join(F.broadcast(top), "class_name").orderBy("class_name", "step")


def alerts(delta: DataFrame, suspects: DataFrame, baseline_total: int, current_total: int, percent: float = 25.0) -> DataFrame:
    """id, severity and message of each rule that fires: the heap grew by over `percent`; suspects are new; a class has at least as many
    new instances as it had before, none included, and retains over a MiB (the one whose retained size changed most); suspects are
    resolved. Of suspects the first three are named."""
    spark, grown = delta.sparkSession, current_total - baseline_total
    heap = spark.createDataFrame([("heap-growth", "warning", f"Heap grew by {grown * 100.0 / baseline_total:.0f}% (+{grown / MIB:.1f} MB)")] if baseline_total and grown * 100.0 / baseline_total > percent else [], "id string, severity string, message string")

    def listed(status: str, id_: str, severity: str, text: str) -> DataFrame:
        found = suspects.where(F.col("status") == status).select("class_name", F.struct("position", "class_name").alias("at"))
        first = found.orderBy("at").limit(3).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list("at")), lambda x: x["class_name"])).alias("names"))
        many = found.agg(F.count("*").alias("n")).where("n > 0").crossJoin(F.broadcast(first))  # a row each
        return many.select(F.lit(id_).alias("id"), F.lit(severity).alias("severity"), F.concat(F.col("n").cast("string"), F.lit(text), "names", F.when(F.col("n") > 3, F.format_string(" and %d more", F.col("n") - 3)).otherwise("")).alias("message"))

    burst = delta.where((F.col("instance_count_delta") > 0) & (F.col("current_instance_count") > 0) & (F.col("instance_count_delta") >= F.col("current_instance_count") - F.col("instance_count_delta")) & (F.col("current_retained_size") > MIB))
    most = burst.orderBy(F.abs("retained_size_delta").desc(), "class_name").limit(1).select(F.lit("class-explosion").alias("id"), F.lit("warning").alias("severity"), F.format_string("%s has %d more instances, twice as many or more, and retains %.1f MB", "class_name", "instance_count_delta", F.col("current_retained_size") / F.lit(float(MIB))).alias("message"))
    return heap.unionByName(listed("new", "new-leak-suspects", "warning", " new leak suspect(s): ")).unionByName(most).unionByName(listed("resolved", "resolved-leaks", "info", " leak suspect(s) resolved: "))


# Parts of class names in the order they are looked for, and the kind of advice they call for; the first that fits counts.
ADVICE = (("cach", "cache"), ("pool", "connections"), ("connection", "connections"), ("datasource", "connections"), ("session", "session"), ("queue", "backpressure"), ("buffer", "backpressure"), ("blocking", "backpressure"), ("thread", "threads"))
# Parts of class names that make a large class a finding.
PATTERNS = ("cache", "pool", "connection", "session", "queue", "buffer")
SAYS = {
    "cache": "Bound it, or let old entries expire.",
    "cache, critical": "It holds too much: see what evicts from it, and bound it.",
    "connections": "See that connections are closed, and how large the pool may grow.",
    "session": "See when sessions expire and what they hold.",
    "backpressure": "Its consumers may be too slow, or its capacity unbounded.",
    "threads": "See thread-locals and how many threads are kept.",
    "arrays": "See that streams are closed and buffers are no larger than needed.",
    "arrays, critical": "Look for unclosed streams, whole bodies in memory or much building of strings.",
    "other": "See whether so many objects of this size are expected.",
    "other, critical": "See what keeps these objects from being collected.",
    "count": "See whether these objects pile up.",
}


def advice(name: Column, severity: Column) -> Column:
    """The kind of advice for a class; SAYS has its words."""
    critical = F.when(severity == "critical", ", critical").otherwise("")
    out = F.when(name.isin("byte[]", "char[]"), F.concat(F.lit("arrays"), critical)).otherwise(F.concat(F.lit("other"), critical))
    for word, kind in reversed(ADVICE):
        out = F.when(F.lower(name).contains(word), F.concat(F.lit(kind), critical) if kind == "cache" else F.lit(kind)).otherwise(out)
    return out


def diagnosis(histogram: DataFrame, suspects: DataFrame, reachable: int) -> DataFrame:
    """Findings: severity, confidence, title, advice; critical ones first, then as found.

    Suspects above 20 % (50 %: critical) come first, then, by retained size, large arrays, large classes of a telling name and classes of
    many instances. One whose class name is in the title of an earlier one is left out; that is a window over the few classes that
    meet a rule at all, which takes 3 % of the heap.
    """
    share = F.col("retained_size") * 100.0 / F.lit(float(max(1, reachable)))
    s = suspects.select("class_name", F.col("retained_percentage").alias("share"), F.when(F.col("retained_percentage") > 50, "critical").otherwise("warning").alias("severity"), F.lit("high").alias("confidence"), F.format_string("%s retains %.1f%% of heap", "class_name", "retained_percentage").alias("title"), F.lit(0).alias("part"), F.col("position").cast("double").alias("place"), F.lit(0).alias("rule")).where("share > 20")
    h = histogram.select("class_name", "instance_count", share.alias("share")).where("share > 3")
    level = F.when(F.col("share") > 30, "critical").otherwise("warning")
    row = lambda df, severity, confidence, title, rule: df.select("class_name", "share", severity.alias("severity"), F.lit(confidence).alias("confidence"), title.alias("title"), F.lit(1).alias("part"), (-F.col("share")).alias("place"), F.lit(rule).alias("rule"))
    arrays = row(h.where(F.col("class_name").isin("byte[]", "char[]") & (F.col("share") > 20)), F.lit("warning"), "medium", F.format_string("%s occupies %.1f%% of heap", "class_name", "share"), 0)
    names = row(h.where(F.lower("class_name").rlike("|".join(PATTERNS)) & (F.col("share") > 10)), level, "medium", F.format_string("%s pattern detected (%.1f%% heap)", "class_name", "share"), 1)
    many = row(h.where("instance_count > 100000"), F.lit("info"), "low", F.format_string("%s instances of %s (%.1f%% heap)", F.format_number("instance_count", 0), "class_name", "share"), 2)
    order = Window.orderBy("part", "place", "class_name", "rule")
    found = s.unionByName(arrays).unionByName(names).unionByName(many).withColumn("at", F.row_number().over(order)).withColumn("before", F.collect_list("title").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    kept = found.where((F.col("part") == 0) | ~F.exists("before", lambda t: F.contains(t, F.col("class_name"))))
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    told = F.when((F.col("part") == 1) & (F.col("rule") == 2), "count").otherwise(advice(F.col("class_name"), F.col("severity")))
    return kept.select("severity", "confidence", "title", told.alias("advice"), rank.alias("rank"), "at").orderBy("rank", "at").drop("rank", "at")


def fits_long(df: DataFrame, except_for: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """Rows of which every decimal but ids fits a signed 64-bit integer."""
    wide = [f.name for f in df.schema if f.dataType.simpleString().startswith("decimal") and f.name not in except_for]
    out = df
    for c in wide:
        out = out.where(F.col(c).between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)")))
    return out
