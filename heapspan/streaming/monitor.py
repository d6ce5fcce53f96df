"""Live metrics: parsing, derived values, the bounded tail of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Rounds

METRICS = (
    "timestamp long, heapUsed long, heapMax long, heapCommitted long, nonHeapUsed long, nonHeapCommitted long, threadCount int, daemonThreadCount int, uptime long, "
    "gcCollectors array<struct<name:string,collectionCount:long,collectionTimeMs:long>>, memoryPools array<struct<name:string,type:string,used:long,max:long,committed:long>>"
)
POINTS = 300


def parse_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines (batch or stream) as metrics; a line that is no metric has no timestamp and goes."""
    return lines.select(F.from_json(column, METRICS).alias("m")).select("m.*").where("timestamp is not null")


def heap_percent() -> Column:
    """Used heap in percent of the maximum, or null without one."""
    return F.when(F.col("heapMax") > 0, F.col("heapUsed") * 100.0 / F.col("heapMax")).cast("double")


def uptime_parts(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.struct(F.floor(s / 86400).alias("days"), F.floor(s % 86400 / 3600).alias("hours"), F.floor(s % 3600 / 60).alias("minutes"), (s % 60).alias("seconds"))


def derived(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("taken", F.timestamp_millis("timestamp")).withColumn("heap_percent", heap_percent()).withColumn("gc_time_ms", F.expr("aggregate(transform(gcCollectors, c -> c.collectionTimeMs), 0L, (a, x) -> a + x)")).withColumn("up", uptime_parts(F.col("uptime")))


def latest(points: DataFrame, key: str, order: tuple[str, ...], n: int = POINTS) -> DataFrame:
    """The last n points of each key. A sample of n of each of many salts is taken before they meet, so a hot key is no hot group."""
    from pyspark.sql import Window

    by = [F.col(c).desc() for c in order]
    salted = points.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    some = salted.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*by))).where(F.col("__n") <= n)
    return some.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("__n") <= n).drop("__n", "__salt")


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """The agent's metrics as a stream."""
    return derived(parse_metrics(spark.readStream.format("socket").option("host", host).option("port", port).load()))


def keep_tail(stream: DataFrame, path: str, checkpoint: str, n: int = POINTS):
    """A streaming query that keeps the last n points in a Parquet table; each batch reads at most n old points."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.orderBy(F.desc("timestamp")).limit(n)
        try:
            old = spark.read.schema(batch.schema).parquet(f"{path}/{epoch - 1}")
            new = new.unionByName(old).orderBy(F.desc("timestamp")).limit(n)
        except Exception as e:
            if epoch and "PATH_NOT_FOUND" not in str(e):
                raise
        new.coalesce(1).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_LINE = r"^\s*\d+:\s+(\d+)\s+(\d+)\s+(\S+)"


def parse_histogram(lines: DataFrame, column: str = "value") -> DataFrame:
    """class_name, instances, bytes of the lines of a live class histogram; header and total go."""
    rows = lines.where(F.col(column).rlike(_LINE))
    return rows.select(F.regexp_extract(column, _LINE, 3).alias("class_name"), F.regexp_extract(column, _LINE, 1).cast("long").alias("instances"), F.regexp_extract(column, _LINE, 2).cast("long").alias("bytes"))


def live_top(histogram: DataFrame, n: int = 50) -> DataFrame:
    return histogram.orderBy(F.desc("bytes"), "class_name").limit(n)


def windowed_counts(spark: SparkSession, path: str, every: str = "1 day", late: str = "30 days") -> DataFrame:
    """An extension: events counted in event-time windows by a streaming query that reads the table to its end."""
    events = spark.read.parquet(path)
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(events.schema)
    one_file = events.inputFiles()[0].rstrip("/").endswith(f"/{name}")
    stream = source.option("pathGlobFilter", name).parquet(folder) if one_file else source.parquet(path)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rounds = Rounds(spark)
    out = f"{rounds.base}/counts"

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{epoch}")

    done = counts.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", f"{rounds.base}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    last = done.lastProgress["batchId"] if done.lastProgress else 0
    rows = spark.read.parquet(f"{out}/{last}")
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
