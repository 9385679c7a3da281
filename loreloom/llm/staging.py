"""Shared-storage helpers: where operators put intermediate tables, and how tasks cut batches.

Everything that one task writes and another reads goes below the session's
``spark.checkpoint.dir`` (shared by the driver and all executors).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``.

    Where a local session names no such folder a temporary one is made and set; on a
    cluster that is an error, as executors couldn't share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name storage that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to shared storage and read it back; returns frame and path."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that no remaining plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tasks(spark: SparkSession) -> int:
    """Partitions to deal rows to: the session's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def lowest(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """At most ``n`` rows, those with the least values of a 64-bit hash, ties in any order.

    A bound on the hash that four times as many rows are expected to pass goes first, so
    that the sort gets a bounded number of rows however many partitions there are.
    """
    share = min(1.0, 4 * n / max(1, rows.count()))
    few = rows.withColumn("_hash", key)
    if share < 1:
        few = few.where(F.col("_hash") < int(-(2**63) + share * 2**64))
    return few.orderBy("_hash").limit(n).drop("_hash")


def chunks(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column``, one row at least."""
    size, begin = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > begin and size + n > limit:
            yield batch.slice(begin, i - begin)
            size, begin = 0, i
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
