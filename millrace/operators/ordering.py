"""Row numbers, trailing windows, pages, set operations, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranged import first_rows, ranked_values, row_index, running, trailing_sums, windowed_rows
from .joins import last_points


def number_rows(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Global row number without a single-task window."""
    return row_index(df, [], order, name)


def keep_last(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key."""
    return last_points(df, keys, order, n).drop("rn")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return first_rows(df, keys, order, n, "_rn").drop("_rn")


def reversals(df: DataFrame, keys: list[str], order: list[str], direction: str, seconds: int = 1800) -> DataFrame:
    """Rows whose next row of the key differs in direction within ``seconds``."""
    ts = order[0]
    rows = windowed_rows(
        df, keys, order,
        lambda w: {"next_direction": F.lead(direction).over(w), "next_ts": F.lead(ts).over(w)},
        after=1,
    )
    gap = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.filter((F.col(direction) != F.col("next_direction")) & (gap < seconds * 1_000_000))


def trailing_points(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Mean and count over the last ``n`` points up to each row."""

    def made(w):
        frame = w.rowsBetween(-(n - 1), 0)
        return {"trail_avg": F.avg(value).over(frame), "trail_n": F.count(value).over(frame)}

    return windowed_rows(df, keys, order, made, before=n - 1)


def trailing_seconds(df: DataFrame, keys: list[str], ts: str, row_id: str, value: str, seconds: float) -> DataFrame:
    """Mean and count over ``[ts - seconds, ts]`` of the same key, per row."""
    one = F.when(F.col(value).isNotNull(), F.lit(1)).otherwise(F.lit(0))
    out = trailing_sums(df, keys, ts, row_id, seconds, {"_s": F.coalesce(F.col(value), F.lit(0.0)), "_n": one})
    return (
        out.withColumn("trail_avg", F.try_divide(F.col("_s"), F.col("_n")))
        .withColumn("trail_n", F.col("_n").cast("long"))
        .drop("_s", "_n")
    )


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Each distinct value with its count and tie-averaged rank."""
    ranked = ranked_values(df, [], value)
    return ranked.select(value, "n", (F.col("upto") - (F.col("n") - 1) / 2).alias("avg_rank"))


def list_all(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def list_filtered(df: DataFrame, conditions: dict, newest: str, tie: str, limit: int) -> DataFrame:
    for field, value in conditions.items():
        if value is not None:
            df = df.filter(F.col(field) == F.lit(value))
    return df.orderBy(F.col(newest).desc(), tie).limit(limit)


def get_by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def count_all(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def active_since(df: DataFrame, key: str, ts: str, cutoff) -> DataFrame:
    seen = df.groupBy(key).agg(F.max(ts).alias("last_seen"))
    return seen.filter(F.col("last_seen") >= cutoff).orderBy(F.col("last_seen").desc(), key)


def pivot(df: DataFrame, keys: list[str], column: str, values: list, agg: Column) -> DataFrame:
    """Values are named by the caller, so no extra pass looks them up."""
    return df.groupBy(*keys).pivot(column, values).agg(agg)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def union(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def union_sources(*dfs: DataFrame) -> DataFrame:
    return union(*dfs).dropDuplicates()


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return running(df, keys, order, {name: F.col(value)})
