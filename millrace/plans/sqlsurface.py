"""Ad-hoc SQL on registered views: guard, limit, plan, log."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P


class RefusedQuery(ValueError):
    """A query the guard does not let through."""


def violation(sql: str, level: str = "standard") -> str | None:
    """The first forbidden pattern of a query text, or None."""
    low = sql.lower().strip()
    for p in [*P.FORBIDDEN_SQL, *(P.STRICT_SQL if level == "strict" else [])]:
        if re.search(p, low):
            return p
    if level == "strict" and not low.startswith("select"):
        return "must start with select"
    return None


def is_safe(sql: str | Column, level: str = "standard") -> Column:
    """The same guard over a column of query texts."""
    low = F.lower(F.trim(F.col(sql) if isinstance(sql, str) else sql))
    safe = F.lit(True)
    for p in [*P.FORBIDDEN_SQL, *(P.STRICT_SQL if level == "strict" else [])]:
        safe = safe & ~low.rlike(p)
    return safe & low.startswith("select") if level == "strict" else safe


class Result(NamedTuple):
    """Rows of a query, and a frame with one row that tells what the limit did to them."""

    rows: DataFrame
    truncated: DataFrame


_OWN_LIMIT = re.compile(r"\blimit\s+(\d+|:\w+|all)\s*(offset\s+\S+\s*)?;?\s*$", re.I)


def query(spark: SparkSession, sql: str, limit: int = 1000, parameters: dict | None = None, level: str = "standard") -> Result:
    """Guarded query; the limit is put on the result, and only if the text ends with none of its own."""
    found = violation(sql, level)
    if found:
        raise RefusedQuery(f"refused: {found}")
    rows = spark.sql(sql, args=parameters or {})
    if _OWN_LIMIT.search(sql):
        return Result(rows, rows.agg(F.count("*").alias("row_count")).select(
            "row_count", F.lit(len(rows.columns)).alias("column_count"), F.lit(False).alias("truncated")))
    return Result(add_limit(rows, limit), truncated(rows, limit))


def add_limit(df: DataFrame, limit: int) -> DataFrame:
    return df.limit(limit)


def truncated(rows: DataFrame, limit: int) -> DataFrame:
    """Rows given out, columns and whether ``limit`` leaves rows of the unlimited frame out."""
    return rows.limit(limit + 1).agg(F.count("*").alias("n")).select(
        F.least("n", F.lit(limit)).alias("row_count"), F.lit(len(rows.columns)).alias("column_count"), (F.col("n") > limit).alias("truncated"))


def plan(spark: SparkSession, sql: str) -> DataFrame:
    """The formatted plan as one text row."""
    return spark.sql(f"EXPLAIN FORMATTED {sql}")


def to_csv(df: DataFrame, header: bool = True) -> DataFrame:
    """One csv line per row; the header line comes first."""
    lines = df.select(F.to_csv(F.struct(*df.columns)).alias("line"))
    if not header:
        return lines
    return df.sparkSession.createDataFrame([(",".join(df.columns),)], "line string").unionByName(lines)


def log_entry(spark: SparkSession, sql: str, user: str, rows: int, seconds: float, at) -> DataFrame:
    """One row for the query log."""
    return spark.createDataFrame(
        [(user, sql, rows, float(seconds), at, violation(sql) is None)],
        "user_id string, sql string, row_count long, seconds double, at timestamp, safe boolean")


def history(log: DataFrame, ts: str, tie: str, n: int = 100) -> DataFrame:
    return log.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
