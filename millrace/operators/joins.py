"""Joins on keys, the tolerance join and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.ranged import first_rows

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def join(left: DataFrame, right: DataFrame, on: list[str], kind: str = "inner") -> DataFrame:
    """Equi-join; AQE picks broadcast or sort-merge and splits skewed partitions.

    There is no keyless kind: a product of two large tables cannot be paid for.
    """
    if kind not in KINDS or not on:
        raise ValueError(f"kind must be one of {KINDS} with at least one key")
    return left.join(right, on, kind)


def denormalize(df: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Chain of left joins: (dimension, left key, right key)."""
    for dim, lk, rk in steps:
        df = df.join(dim, df[lk] == dim[rk], "left").drop(dim[rk])
    return df


def recent_with(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, ts: str, now, hours: int = 24) -> DataFrame:
    """Rows of the last hours with their dimension, newest first."""
    recent = facts.filter((F.col(ts) >= F.expr(f"{now} - interval {hours} hours")) & (F.col(ts) <= F.expr(now)))
    return recent.join(dim, recent[key] == dim[dim_key], "left").orderBy(F.col(ts).desc(), key)


def key_intersection(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys held by every group."""
    held = df.select(key, group).distinct().groupBy(key).agg(F.count("*").alias("_held"))
    groups = df.agg(F.count_distinct(group).alias("g"))
    return held.filter(F.col("_held") == groups.scalar()).select(key)


def referential_errors(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """How many child rows point to no parent (null keys point nowhere by choice)."""
    known = parent.select(F.col(parent_key).alias(key))
    lost = child.filter(F.col(key).isNotNull()).join(known, key, "left_anti")
    return lost.agg(F.count("*").alias("errors"))


def last_points(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key, ``rn`` = 1 for the newest."""
    return first_rows(df, keys, order, n, newest=True)


def tolerance_join(
    a: DataFrame, b: DataFrame, ts: str, row_id: str, value: str, seconds: float = 1.0, last: int = 100
) -> DataFrame:
    """For each of the last points of ``a``, the first point of ``b`` within ``seconds``.

    Both sides meet on a time bucket and its two neighbours. ``a`` holds at most
    ``last`` rows, so it is the broadcast side; of ``b`` only the first match
    per point survives the map side.
    """
    width = int(seconds * 1_000_000)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    points = (
        a.orderBy(F.col(ts).desc(), F.col(row_id).desc())
        .limit(last)
        .select(F.col(row_id).alias("a_id"), micros.alias("a_at"), F.col(value).alias("a_value"))
        .withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                                    lambda d: F.floor(F.col("a_at") / width) + d)))
    )
    other = b.select(
        F.col(row_id).alias("b_id"), micros.alias("b_at"), F.col(value).alias("b_value"),
        F.floor(micros / width).alias("bucket"),
    )
    near = other.join(F.broadcast(points), "bucket").filter(F.abs(F.col("a_at") - F.col("b_at")) <= width)
    first = near.groupBy("a_id", "a_at", "a_value").agg(
        F.min(F.struct("b_at", "b_id", "b_value")).alias("b")
    )
    return first.select("a_id", F.col("b.b_id").alias("b_id"), "a_value", F.col("b.b_value").alias("b_value"))


def resolve_conflicts(sources: list[tuple[str, DataFrame]], key: str, updated: str) -> DataFrame:
    """One row per key: the latest record wins, ties go to the earlier source."""
    parts = [
        df.withColumn("source", F.lit(name)).withColumn("_priority", F.lit(i))
        for i, (name, df) in enumerate(sources)
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    best = W.partitionBy(key).orderBy(F.col(updated).desc(), "_priority")
    return merged.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn", "_priority")
