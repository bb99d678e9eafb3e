"""A table of rows by key on plain files, changed by copy on write.

Rows lie in ``buckets`` by a hash of their key, each bucket in one folder. A manifest
names the folders in force; a change writes new folders for the buckets that hold
changed keys only, and then a manifest of the next version. So a change costs what its buckets hold,
readers see the state before or after it, and a failure before the manifest
appears leaves the table as it was. A manifest that exists is never replaced: of two
writers at once the second one fails and can try again.

The folder may be any that Hadoop reaches. Putting a manifest in place is one rename,
which must fail if the target exists (HDFS, local disks; on object stores let one writer
at a time change a table).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.keys import join_by_key
from ..session import settle
from .sinks import LoadError

BUCKETS = 64


class Conflict(LoadError):
    """Another writer was faster."""


class KeyedTable:
    """``KeyedTable.create(spark, path, schema, key)``, later ``KeyedTable(spark, path)``.

    Null keys are keys like any other. ``buckets`` is fixed at creation: take so many
    that one of them is a task's work.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int = BUCKETS) -> KeyedTable:
        missing = [k for k in key if k not in schema.names]
        if missing or not key:
            raise LoadError(f"key columns are missing: {missing}")
        table = cls(spark, path)
        table._commit({"version": 0, "key": key, "buckets": buckets, "schema": schema.json(), "batches": {}, "folders": {}})
        return table

    # Manifests

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/{version:020d}.json"

    def state(self) -> dict:
        """The manifest in force."""
        folder = self._paths(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            raise LoadError(f"no table at {self.path}")
        stream = self._fs.open(self._paths(self._manifest(max(versions))))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw)

    def _commit(self, state: dict) -> None:
        target = self._paths(self._manifest(state["version"]))
        draft = self._paths(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {state['version']} of {self.path} was written by another")

    # Rows

    def _rows(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        folders = [f"{self.path}/{f}" for b, f in state["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The rows in force now, whatever is written later (until ``vacuum``)."""
        return self._rows(self.state())

    def upsert(self, updates: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> int:
        """Update or insert by key; of several updates of a key the last by ``order`` wins.

        ``batch`` is (writer, number): a number that this writer has reached already changes
        nothing. Returns the number of buckets written.
        """
        state = self.state()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return 0
        schema = StructType.fromJson(json.loads(state["schema"]))
        # The rank is part of what is combined map-side, so no key is gathered.
        row, place = F.struct(*[F.col(c).cast(schema[c].dataType).alias(c) for c in schema.names]), F.struct(*order)
        newest = updates.groupBy(*state["key"]).agg(F.max_by(row, place).alias("_row")).select("_row.*")
        # Bytes of the types of the schema, so that a key falls in one bucket whoever writes it.
        bucket = F.pmod(F.xxhash64(*state["key"]), F.lit(state["buckets"])).cast("string")
        last = settle(newest.withColumn("_bucket", bucket))
        touched = sorted(r[0] for r in last.select("_bucket").distinct().collect())
        if touched:
            old = self._rows(state, touched).withColumn("_bucket", bucket)
            keys = last.select(*state["key"]).withColumn("_new", F.lit(True))
            left = join_by_key(old, keys, state["key"], "left").filter("_new IS NULL").drop("_new")
            folder = f"data/{uuid.uuid4().hex}"
            both = left.unionByName(last).repartition(len(touched), "_bucket")
            both.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            state["folders"].update({b: f"{folder}/_bucket={b}" for b in touched})
        if batch:
            state["batches"][batch[0]] = batch[1]
        state["version"] += 1
        self._commit(state)
        return len(touched)

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders and manifests that none of the last ``keep`` versions names; returns the folders deleted."""
        last = self.state()["version"]
        used = set()
        for v in range(max(0, last - keep + 1), last + 1):
            path = self._paths(self._manifest(v))
            if self._fs.exists(path):
                stream = self._fs.open(path)
                try:
                    used |= set(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"].values())
                finally:
                    stream.close()
        gone = 0
        for v in range(max(0, last - keep + 1)):
            self._fs.delete(self._paths(self._manifest(v)), False)
        data = self._paths(f"{self.path}/data")
        for change in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for folder in self._fs.listStatus(change.getPath()):
                name = f"data/{change.getPath().getName()}/{folder.getPath().getName()}"
                if folder.isDirectory() and name not in used:
                    gone += bool(self._fs.delete(folder.getPath(), True))
        return gone
