"""Files and tables in the folder that driver and executors share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path, shared_folder


#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def kept(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and go on from its files.

    Cuts the lineage; a lost executor costs a re-read, not a re-run. Shuffle
    files of the write are removed when it ends, where Spark can do that.
    """
    spark = df.sparkSession
    shared_folder(spark)
    path = scratch_path(spark, name)
    with short_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_shuffles(spark: SparkSession):
    """Within it, an action's shuffle files go when the action ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB for the session's tasks, unless it has its own setting.

    Texts are long: batches by row count alone would hold tens of MB on both sides of
    every Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "64MB", "67108864", "67108864b", str(2**31 - 1), f"{2**31 - 1}b"):
        spark.conf.set(key, str(BATCH_BYTES))


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a ``kept`` table that no later result reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Tasks for rows that stand for much more work than their bytes show."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def file_system(uri: str):
    """(file system, path) of a shared place: file, hdfs, s3, gs …"""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class Appender:
    """A new file below ``folder``; every attempt of a task has its own name, and
    only files named in a committed manifest count."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        system, path = file_system(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size = system.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset of the first byte."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length, offset)


def worker_state(name: str, make: Callable):
    """A value that lives as long as the Python worker, across its tasks."""
    home = sys.modules.setdefault("millrace_worker_state", types.ModuleType("millrace_worker_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
