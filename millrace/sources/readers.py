"""Reading files, tables and queries; describing what is there."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P

DELIMITERS = [",", ";", "\t", "|"]


class SourceError(RuntimeError):
    """A source that cannot be read."""


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The candidate that occurs most often in the first line."""
    first = spark.read.option("encoding", encoding).text(path).head()
    if first is None:
        raise SourceError(f"{path} is empty")
    return max(DELIMITERS, key=first[0].count)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Header row gives the names, every value stays text; a comma is checked against the first line."""
    sep = sniff_delimiter(spark, path, encoding) if delimiter == "," else delimiter
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One array of objects or one object per file; anything else fails."""
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object per line, blank lines skipped, a bad line fails the read. Splittable."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.format("avro").load(path)
    except Exception as e:
        raise SourceError("avro needs the spark-avro package on the class path") from e


_BY_SUFFIX = [
    ((".csv", ".tsv"), read_csv), ((".jsonl", ".ndjson"), read_jsonl), ((".json",), read_json),
    ((".parquet", ".pq"), read_parquet), ((".txt", ".log"), read_text), ((".orc",), read_orc), ((".avro",), read_avro)]


def read_auto(spark: SparkSession, path: str, fallback=None, row_tag: str = "row") -> DataFrame:
    """Reader by suffix (a folder may carry one); ``row_tag`` is the element of a row in XML."""
    low = path.lower().rstrip("/")
    if low.endswith(".xml"):
        return read_xml(spark, path, row_tag)
    for endings, reader in _BY_SUFFIX:
        if low.endswith(endings):
            return reader(spark, path)
    if fallback:
        return fallback(spark, path)
    raise SourceError(f"no reader for {path}")


def object_store_source(spark: SparkSession, bucket: str, key: str, scheme: str = "s3a") -> DataFrame:
    """Format by key suffix, csv when unknown."""
    root = bucket if "://" in bucket or bucket.startswith("/") else f"{scheme}://{bucket}"
    return read_auto(spark, f"{root.rstrip('/')}/{key}", fallback=read_csv)


def inline_source(spark: SparkSession, records: list[dict] | str) -> DataFrame:
    """A small list of records, or csv text, given by the caller."""
    if isinstance(records, str):
        records = list(csv.DictReader(records.strip().splitlines()))
    names = list(dict.fromkeys(k for r in records for k in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], names)


def sql_source(spark: SparkSession, query: str, parameters: dict | None = None) -> DataFrame:
    """A query over registered views with named parameters."""
    return spark.sql(query, args=parameters or {})


def jdbc_source(spark: SparkSession, url: str, query: str, partition_column: str | None = None, lower=None, upper=None,
                partitions: int = 32, fetch_size: int = 10_000, **options: str) -> DataFrame:
    """A database query, read in parallel ranges of ``partition_column`` when given."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size).options(**options)
    if partition_column:
        return (reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
                .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load())
    return reader.option("query", query).load()


def batch_plan(df: DataFrame, batch_size: int) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("total_records"), F.ceil(n / F.lit(batch_size)).alias("batches"))


def column_sample(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def detect_format(name: str | Column) -> Column:
    x = F.lower(F.col(name) if isinstance(name, str) else name)
    chain = None
    for kind, pattern in P.FORMAT_SUFFIXES.items():
        chain = F.when(x.rlike(pattern), kind) if chain is None else chain.when(x.rlike(pattern), kind)
    return chain.otherwise("unknown")


def list_files(spark: SparkSession, prefix: str) -> DataFrame:
    """(path, length) of every file below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix).select("path", "length")


def file_inventory(files: DataFrame) -> DataFrame:
    """Files and bytes per format."""
    return files.groupBy(detect_format("path").alias("format")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))


def sample_keys(files: DataFrame, n: int = 10) -> DataFrame:
    return files.orderBy("path").limit(n)


def detect_partitions(files: DataFrame, path: str = "path") -> DataFrame:
    """``key=value`` folder names, and year/month/day folders."""
    names = F.regexp_extract_all(F.col(path), F.lit(r"(\w+)=([^/]+)"), F.lit(1))
    dated = F.when(F.col(path).rlike(r"\d{4}/\d{2}/\d{2}"), F.array(F.lit("year/month/day"))).otherwise(F.array().cast("array<string>"))
    return files.select(F.explode(F.concat(names, dated)).alias("partition")).distinct()


def _coarse(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text"


def parquet_stats(df: DataFrame) -> DataFrame:
    """Columns with coarse types and the row count, from file footers only."""
    rows = [(f.name, _coarse(f.dataType)) for f in df.schema.fields]
    table = df.sparkSession.createDataFrame(rows, "column string, kind string")
    return table.withColumn("row_count", df.agg(F.count("*").alias("n")).scalar())


def _any(x: Column, words: list[str], test) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | test(x, F.lit(w))
    return out


def classify_source(uri: str | Column) -> Column:
    """api, file, s3, database, streaming, message_queue or unknown by prefix, path and suffix."""
    raw = F.col(uri) if isinstance(uri, str) else uri
    low = F.lower(F.trim(raw))
    path = F.coalesce(F.try_parse_url(raw, F.lit("PATH")), F.lit(""))
    web = low.startswith("http://") | low.startswith("https://")
    return (
        F.when(web & _any(F.lower(path), P.API_PATHS, F.contains), "api")
        .when(web & _any(path, [".json", ".xml", ".csv"], F.endswith), "file")
        .when(web, "api")
        .when(low.startswith("s3://"), "s3")
        .when(_any(low, P.DATABASE_PREFIXES, F.contains), "database")
        .when(_any(low, P.FILE_ENDINGS, F.endswith) | F.contains(low, F.lit("/")) | F.contains(low, F.lit("\\")), "file")
        .when(_any(low, P.STREAM_WORDS, F.contains), "streaming")
        .when(_any(low, P.QUEUE_WORDS, F.contains), "message_queue")
        .otherwise("unknown"))


def schema_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(n, f.name, f.dataType.simpleString()) for n, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, column string, type string")


def data_patterns(columns: DataFrame) -> DataFrame:
    """Flags per table from column names and types, and the width class."""
    name, kind = F.lower(F.col("column")), F.col("type")
    numeric = kind.rlike("int|double|float|decimal|long")
    out = columns.groupBy("table").agg(
        F.bool_or(name.rlike("|".join(P.TIMESTAMP_NAMES))).alias("has_timestamps"),
        F.bool_or(name.rlike("|".join(P.INCREMENTAL_NAMES))).alias("has_incremental_keys"),
        F.bool_or(name.rlike("|".join(P.GEO_NAMES))).alias("has_geospatial"),
        F.bool_or(numeric & ~kind.rlike("^(array|struct|map)")).alias("has_numeric"),
        F.bool_or(kind == "string").alias("has_categorical"),
        F.bool_or(kind.rlike("^(array|struct|map)")).alias("has_nested"), F.count("*").alias("_n"))
    width = F.when(F.col("_n") <= 10, "simple").when(F.col("_n") <= 50, "moderate").otherwise("complex")
    rate = F.when(F.col("has_timestamps") & F.col("has_incremental_keys"), "real_time").when(
        F.col("has_timestamps"), "batch").otherwise("unknown")
    return out.select("*", width.alias("schema_complexity"), rate.alias("update_frequency")).drop("_n")


def estimate_volume(inventory: DataFrame) -> DataFrame:
    """Records guessed per file by format (100 per file at least) and the volume class."""
    per = inventory.sparkSession.createDataFrame(P.RECORDS_PER_FILE, "format string, _per long")
    # Six fixed rows; other formats count as unknown.
    joined = inventory.join(F.broadcast(per), "format", "left")
    guess = F.greatest(F.sum(F.col("files") * F.coalesce("_per", F.lit(100))), F.sum("files") * 100)
    rows = joined.agg(guess.alias("estimated_records"))
    chain = None
    for name, below in P.VOLUME_CLASSES:
        test = F.col("estimated_records") < below
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return rows.withColumn("volume", chain.otherwise("xlarge"))
