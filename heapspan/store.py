"""Tables written between the rounds of an iterative algorithm."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: differences of neighbouring ids instead of ids
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}


def parts_of(spark: SparkSession, rows: int = 0) -> int:
    """Buckets for a table of so many rows: 100,000 rows each, and half a million where these were over 48. Not fewer than a shuffle has,
    as Spark would shuffle such a table again."""
    least = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions")
    return max(int(least), min(rows // 100_000, max(48, rows // 500_000)))


class Rounds:
    """Cuts lineage by tables in the folder that driver and executors share (spark.checkpoint.dir), so that a lost executor costs a
    reread. A temporary folder stands in for it where it is unset, in local mode only: on a cluster that is an error."""

    def __init__(self, spark: SparkSession) -> None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            if not _LOCAL:
                _LOCAL.append("file://" + tempfile.mkdtemp(prefix="heapspan-rounds-"))
            path = _LOCAL[0]
        self.spark, self.base, self.n = spark, f"{path.rstrip('/')}/rounds-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.options(**PACKED).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dealt(self, df: DataFrame, by: str, parts: int) -> DataFrame:
        """As cut, in `parts` buckets of `by` in its order: joins and groups on it that ask for as many parts don't move this table.
        Tables that are dealt alike meet without a shuffle."""
        self.n += 1
        name = f"rounds_{uuid.uuid4().hex}"
        df.repartition(parts, by).sortWithinPartitions(by).write.bucketBy(parts, by).sortBy(by).options(path=f"{self.base}/{self.n}", **PACKED).format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def last(self, df: DataFrame) -> DataFrame:
        """df as a table, the only one left of these rounds."""
        out = self.cut(df)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in range(1, self.n):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}")
            path.getFileSystem(conf).delete(path, True)
        return out
