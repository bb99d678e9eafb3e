"""Writing files, tables and payload batches."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException, UnsupportedOperationException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.ranged import row_index

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,63}$")
MAX_VALUE = 10_000


class LoadError(RuntimeError):
    """A load that must not go on."""


def check_identifier(name: str) -> str:
    """A plain name of at most 64 characters."""
    if not _NAME.match(name):
        raise LoadError(f"not a valid name: {name!r}")
    return name


def value_guard(df: DataFrame, limit: int = MAX_VALUE) -> DataFrame:
    """Values longer than ``limit`` per column; column names are checked at once."""
    for c in df.columns:
        check_identifier(c)
    rows = [F.struct(F.lit(c).alias("column"), F.count_if(F.length(F.col(c).cast("string")) > limit).alias("too_long")) for c in df.columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def write_file(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", **options) -> int:
    """Write csv (with header), json, parquet, orc or text; the row count is observed on the way."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(format)
    if format == "csv":
        options = {"header": True, **options}
    writer.options(**options).save(path)
    return seen.get["rows"]


def format_of(path: str) -> str:
    """Writer by suffix, json without one."""
    low = path.lower().rstrip("/")
    for ending, format in ((".csv", "csv"), (".parquet", "parquet"), (".orc", "orc"), (".txt", "text")):
        if low.endswith(ending):
            return format
    return "json"


def write_json(df: DataFrame, path: str) -> dict:
    return {"destination": path, "records_loaded": write_file(df, path, "json")}


def write_object_store(df: DataFrame, bucket: str, key: str, format: str = "json", scheme: str = "s3a") -> int:
    root = bucket if "://" in bucket or bucket.startswith("/") else f"{scheme}://{bucket}"
    return write_file(df, f"{root.rstrip('/')}/{key}", format)


def append(df: DataFrame, table: str, create_table: bool = False) -> None:
    """Insert; the table must exist unless ``create_table``."""
    check_identifier(table)
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        if not create_table:
            raise LoadError(f"table {table} does not exist")
        df.write.format("parquet").saveAsTable(table)
    else:
        df.select(*spark.table(table).columns).write.insertInto(table)


def replace(df: DataFrame, table: str) -> None:
    check_identifier(table)
    df.write.format("parquet").mode("overwrite").saveAsTable(table)


def jdbc_append(df: DataFrame, url: str, table: str, batch_size: int = 1000, **options) -> None:
    df.write.format("jdbc").mode("append").option("url", url).option("dbtable", table).option("batchsize", batch_size).options(**options).save()


def upsert(target: DataFrame, updates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Update or insert by key; of several updates of a key the last by ``order`` wins."""
    for k in key:
        if k not in target.columns or k not in updates.columns:
            raise LoadError(f"key column {k} is missing")
    newest = W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    last = updates.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").select(*target.columns)
    return target.join(last.select(*key), key, "left_anti").select(*target.columns).unionByName(last)


def upsert_table(spark: SparkSession, table: str, updates: DataFrame, key: list[str], order: list[str]) -> None:
    """Upsert into a plain table: the new state is written beside the old one, and then the
    catalog is pointed to it. A failure before that leaves the table as it was.

    The whole table is written once. Tables that change often should be a
    ``keyed.KeyedTable``; formats with MERGE have ``merge_table``.
    """
    check_identifier(table)
    before = _location(spark, table)
    beside = f"{before.rstrip('/')}-{uuid.uuid4().hex}"
    upsert(spark.table(table), updates, key, order).write.parquet(beside)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{beside}'")
    spark.catalog.refreshTable(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(before)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _location(spark: SparkSession, table: str) -> str:
    """Folder of a plain table."""
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def merge_table(spark: SparkSession, table: str, updates: DataFrame, key: list[str], order: list[str]) -> str:
    """Upsert by the table format's own MERGE, which touches only files with changed keys;
    a format without one gets ``upsert_table``. Tells which it was: merge or rewrite.
    """
    check_identifier(table)
    newest = W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    last = updates.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").select(*spark.table(table).columns)
    same = reduce(lambda a, b: a & b, [F.expr(f"{table}.`{k}` <=> _new.`{k}`") for k in key])
    try:
        last.alias("_new").mergeInto(table, same).whenMatched().updateAll().whenNotMatched().insertAll().merge()
    except (AnalysisException, UnsupportedOperationException) as e:
        if "MERGE" not in str(e).upper():
            raise
        upsert_table(spark, table, updates, key, order)
        return "rewrite"
    return "merge"


def api_batches(df: DataFrame, order: list[str], batch_size: int = 100) -> DataFrame:
    """Rows packed into numbered JSON payloads of ``batch_size`` rows; nothing is sent."""
    rows = row_index(df, [], order).withColumn("batch", F.floor((F.col("idx") - 1) / batch_size))
    packed = F.array_sort(F.collect_list(F.struct("idx", F.struct(*df.columns).alias("row"))))
    return rows.groupBy("batch").agg(
        F.count("*").alias("records"), F.to_json(F.transform(packed, lambda x: x["row"])).alias("payload"))


def fan_out(df: DataFrame, destinations: list[tuple[str, str]]) -> DataFrame:
    """The same rows to many (path, format) targets: computed once, written several times; status per target."""
    kept = df.persist()
    out = []
    try:
        for path, format in destinations:
            try:
                out.append((path, format, "completed", write_file(kept, path, format), None))
            except Exception as e:  # noqa: BLE001 - one failed target must not stop the others
                out.append((path, format, "failed", 0, str(e).splitlines()[0]))
    finally:
        kept.unpersist()
    return df.sparkSession.createDataFrame(out, "path string, format string, status string, records long, error string")


def load_stats(runs: DataFrame, status: str, records: str, seconds: str) -> DataFrame:
    """Loads, successes, failures, records, time and throughput."""
    ok = F.col(status) == "completed"
    return runs.agg(
        F.count("*").alias("total_loads"), F.count_if(ok).alias("successful_loads"), F.count_if(~ok).alias("failed_loads"),
        F.sum(records).alias("total_records"), F.sum(seconds).alias("total_seconds"),
        F.coalesce(F.try_divide(F.sum(records).cast("double"), F.sum(seconds)), F.lit(0.0)).alias("throughput"))


