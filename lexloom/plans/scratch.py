"""Intermediate tables in the folder that all executors share.

The cluster names that folder in `spark.checkpoint.dir`.  Where the setting is
absent a fresh local folder is used in local mode (tests, notebooks); on a cluster that is an error, as
executors would write where others can't read.

Rows here are whole documents, so a session with Spark's own number of rows an Arrow batch (10,000) gets a
smaller one: buffers on both sides of a Python worker grow with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches to 1000 documents, unless the session sets a number of its own.

    The setting stays: plans that are made here run when their result is asked for, which may be at any time.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


def shared_dir(spark: SparkSession) -> str:
    small_batches(spark)
    base = spark.conf.get(_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_KEY, base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "zstd", free: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends at files that outlive executors.

    With `free` the write's own shuffles are deleted as soon as it is done, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    if free:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if free:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it."""
    at, system = _located(spark, path)
    system.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under one that a write has completed."""
    at, system = _located(spark, path)
    if not system.exists(at):
        return []
    done = lambda p: system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return [s.getPath().getName() for s in system.listStatus(at) if s.isDirectory() and done(s.getPath())]


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file, fewer if it is shorter."""
    at, system = _located(spark, path)
    stream = system.open(at)
    try:
        found = [stream.read() for _ in range(n)]
    finally:
        stream.close()
    return bytes(b for b in found if b >= 0)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared one."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not a scratch folder")
    delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that no plan still to run reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores where the input has fewer partitions than that (one small file); otherwise unchanged."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows that cost much each over all cores, however their files are cut: a row group is one task whatever its size, and the other splits of its file have no rows.

    They are dealt by their places, so nothing is sorted and copies don't meet in one task.
    """
    if df.isStreaming:
        return df
    n = max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartitionById(n, (F.monotonically_increasing_id() % n).cast("int"))
