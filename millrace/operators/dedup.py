"""Deduplication. The first row per key is found by rank 1, which Spark limits
to one row per key and map task before the shuffle, so copies do not pile up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import strip


def exact_key(fields: list[str]) -> Column:
    return F.struct(*fields)


def fuzzy_text(c: str | Column) -> Column:
    """Lower case, stripped, inner white space collapsed."""
    x = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(strip(F.lower(x.cast("string"))), r"\s+", " ")


def numeric_step(c: str, threshold: float) -> Column:
    """Number of the step a value rounds to, half to even."""
    return F.rint(F.col(c) / F.lit(float(threshold)))


def _key_part(rule: dict) -> list[Column]:
    kind = rule.get("type", "exact")
    if kind == "fuzzy":
        return [fuzzy_text(f).alias(f) for f in rule["fields"]]
    if kind == "numeric":
        return [numeric_step(f, rule.get("threshold", 0.01)).alias(f) for f in rule["fields"]]
    return [F.col(f) for f in rule["fields"]]


def dedup(df: DataFrame, rules: list[dict], order: list[str]) -> DataFrame:
    """First row, by ``order``, of each composite key (a struct, so parts never run together)."""
    parts = [p for r in rules for p in _key_part(r)]
    keyed = df.withColumn("_dk", F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))
    first = W.partitionBy("_dk").orderBy(*order)
    return keyed.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn", "_dk")


def dedup_exact(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    return dedup(df, [{"type": "exact", "fields": fields}], order)


def dedup_fuzzy(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    return dedup(df, [{"type": "fuzzy", "fields": fields}], order)


def dedup_numeric(df: DataFrame, fields: list[str], threshold: float, order: list[str]) -> DataFrame:
    return dedup(df, [{"type": "numeric", "fields": fields, "threshold": threshold}], order)


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_stats(df: DataFrame, fields: list[str]) -> DataFrame:
    """Original, kept and removed rows; null parts count as a value.

    Rows are first combined per key on the map side, so copies are counted
    where they are read.
    """
    per_key = df.groupBy(F.struct(*fields).alias("_k")).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("original"),
        F.count("*").alias("kept"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("removed"),
    )


def duplicate_share(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy over all rows."""
    stats = dedup_stats(df, df.columns)
    return stats.select((F.col("removed") / F.greatest(F.col("original"), F.lit(1))).alias("duplicate_share"))
