"""Streams in and out: sources, envelope, routing, sinks, metrics."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..session import scratch_path
from ..sources.keyed import KeyedTable
from ..sources.sinks import upsert_table

log = logging.getLogger(__name__)


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", format: str = "parquet",
                max_files: int = 100) -> DataFrame:
    """New files of a folder. ``max_files`` per batch holds the source back instead of dropping rows."""
    return (spark.readStream.schema(schema).format(format).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files).load(folder))


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000, **options: str) -> DataFrame:
    """Topic rows (key, value, topic, partition, offset, timestamp); needs the kafka package on the class path."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("maxOffsetsPerTrigger", max_offsets).options(**options).load())


def envelope(df: DataFrame, source: str) -> DataFrame:
    """data (JSON), timestamp, source and message id.

    The id is source and microseconds; all rows of a batch share a time, so a
    hash of the data tells them apart.
    """
    now = F.current_timestamp()
    data = F.to_json(F.struct(*df.columns))
    return df.select(
        data.alias("data"), now.alias("timestamp"), F.lit(source).alias("source"),
        F.concat_ws("_", F.lit(source), F.unix_micros(now), F.hex(F.xxhash64(data))).alias("message_id"))


def write(df: DataFrame, path: str, checkpoint: str, format: str = "parquet", mode: str = "append",
          every: str | None = None) -> StreamingQuery:
    """File sink. Without ``every`` all available rows are processed and the query ends."""
    writer = df.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def drain(df: DataFrame, name: str = "stream") -> DataFrame:
    """Process everything there is into files of the shared folder, then read them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write(df, path, scratch_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """``fn(batch, batch_id)`` per micro-batch; a batch may come twice after a failure."""
    writer = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def route(processors: dict[str, Callable[[DataFrame, int], None]], source: str = "source") -> Callable[[DataFrame, int], None]:
    """One branch per source; rows of an unknown source are counted in a warning."""

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name, fn in processors.items():
                fn(kept.filter(F.col(source) == name), batch_id)
            unknown = kept.filter(~F.col(source).isin(list(processors)) | F.col(source).isNull()).count()
            if unknown:
                log.warning("batch %s: %s rows of unknown sources", batch_id, unknown)
        finally:
            kept.unpersist()

    return run


def to_files(folder: str, format: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A processor writing each batch to its own folder, so a repeated batch replaces itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.format(format).mode("overwrite").save(f"{folder}/batch={batch_id}")

    return run


def upsert_into(table: str | KeyedTable, key: list[str], order: list[str], writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A processor that upserts each batch into a table; repeating a batch changes nothing.

    A ``KeyedTable`` rewrites the buckets with changed keys only and remembers the last
    batch of ``writer``; a plain table is written anew with every batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if isinstance(table, KeyedTable):
            table.upsert(batch, order, (writer, batch_id))
        else:
            upsert_table(batch.sparkSession, table, batch, key, order)

    return run


def buffered_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """A function over Arrow batches of a stream."""
    return df.mapInPandas(fn, schema)


class Counter(StreamingQueryListener):
    """Batches, rows, rows dropped for being late, and errors of every query of a session.

    Spark keeps only the last progress reports of a query; this adds up all of them,
    from when the counter is made.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.seen, self.failed = spark, {}, {}
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        self.seen[str(event.id)] = {}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        # A batch that is tried again replaces its first report.
        self.seen.setdefault(str(p.id), {})[p.batchId] = (p.numInputRows, late)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed[str(event.id)] = self.failed.get(str(event.id), 0) + 1

    def of(self, query: StreamingQuery) -> dict:
        """Waits for the reports on their way, then gives the sums."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        batches = self.seen.get(str(query.id), {})
        return {
            "batches": sum(1 for n, _ in batches.values() if n), "processed": sum(n for n, _ in batches.values()),
            "dropped": sum(n for _, n in batches.values()), "errors": self.failed.get(str(query.id), 0)}

    def stop(self) -> None:
        self.spark.streams.removeListener(self)
