"""Sampling. Every sample is a top-k of a key or a share of rows, never a driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranged import first_rows, row_index


def hash_order(key: str | list[str], seed: int = 0) -> Column:
    """A repeatable random order of rows by their key."""
    parts = [key] if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in parts]))


def random_rows(df: DataFrame, key: str | list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement; the same rows for the same seed."""
    return df.orderBy(hash_order(key, seed)).limit(n)


def systematic(df: DataFrame, order: list[str], n: int, sql_form: bool = False) -> DataFrame:
    """Every (total // n)-th row in key order, the first ``n``.

    The SQL form counts from 1 and takes rn % step = 0; the other takes rows
    0, step, 2·step, ...
    """
    rows = row_index(df, [], order, "_idx", total="_total")
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / n))
    at = F.col("_idx") if sql_form else F.col("_idx") - 1
    hit = (at % step == 0) & ((F.col("_idx") if sql_form else F.col("_idx") + step - 1) <= step * n)
    return rows.filter(hit).drop("_idx", "_total")


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0, parts: int = 3) -> DataFrame:
    """``n // parts`` random rows per stratum, then ``n`` in all."""
    few = first_rows(df.withColumn("_h", hash_order(key, seed)), [stratum], ["_h", key], max(1, n // parts), "_rn")
    return few.orderBy("_rn", stratum).limit(n).drop("_h", "_rn")


def reservoir(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Uniform ``n`` rows in one pass: each task keeps its ``n`` smallest random keys."""
    return df.orderBy(F.rand(seed)).limit(n)


def head(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def line_sample(spark, path: str, n: int, seed: int = 0) -> DataFrame:
    """Random lines of a text file."""
    return reservoir(spark.read.text(path).filter(F.length("value") > 0), n, seed)


def multi_file(df: DataFrame, n: int, files: int, seed: int = 0) -> DataFrame:
    """``n // files`` rows of each file (``files`` from the file listing), ``n`` in all."""
    named = df.withColumn("file_path", F.col("_metadata.file_path")).withColumn("_h", F.rand(seed))
    few = first_rows(named, ["file_path"], ["_h"], max(1, n // max(files, 1)), "_rn")
    return few.limit(n).drop("_h", "_rn")


def percentage(df: DataFrame, pct: float = 10.0, seed: int = 0) -> DataFrame:
    return df.sample(fraction=pct / 100.0, seed=seed)


def sample_report(df: DataFrame, sample: DataFrame, strategy: str) -> DataFrame:
    """Total rows, sample rows and strategy as one row."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return sample.agg(F.count("*").alias("sample_size")).select(
        total.alias("total_records"), "sample_size", F.lit(strategy).alias("strategy"))
