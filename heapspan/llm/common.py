"""Helpers shared by the operators: tables in the shared folder, parallelism, UTF-8 columns."""

from __future__ import annotations

import contextlib
import ctypes
import io
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="heapspan-"))
        path = _LOCAL[0]
    return path.rstrip("/")


class Store:
    """Tables written to the shared folder under a name of their own, so that a lost executor costs a reread and no recomputation."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names.discard(name)

    def clear(self) -> None:
        """Delete all tables, when nothing reads any of them any more."""
        for name in sorted(self.names):
            self.drop(name)

    def only(self, df: DataFrame) -> DataFrame:
        """df as a table, the only one left of this store."""
        out = self.put(df, "result")
        for name in sorted(self.names - {"result"}):
            self.drop(name)
        return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hash_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    m = np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * m
    h = h ^ (h >> np.uint64(32))
    h = h * m
    return h ^ (h >> np.uint64(32))


def pack(columns: dict) -> bytes:
    """Columns of one row, compressed."""
    out, batch = io.BytesIO(), pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def trim() -> None:
    """Give freed memory back, as a Python worker stays for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
