"""Normalization: one statistics row as a scalar subquery, then one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_float
from ..plans.ranged import quantiles, row_index, value_counts
from .measures import long_form, numeric_columns, per_column


def _number(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("double") if c in numeric_columns(df) else to_float(c)


def _stats(x: Column) -> Column:
    return F.struct(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"), F.sqrt(F.sum(x * x)).alias("magnitude"), F.max(F.abs(x)).alias("max_abs"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean, std and magnitude of the castable values, one row per column."""
    return per_column(df, columns, {
        "count": lambda c: F.count(_number(df, c)), "min": lambda c: F.min(_number(df, c)),
        "max": lambda c: F.max(_number(df, c)), "mean": lambda c: F.avg(_number(df, c)),
        "std": lambda c: F.stddev_samp(_number(df, c)),
        "magnitude": lambda c: F.sqrt(F.sum(_number(df, c) * _number(df, c)))})


def _scaled(x: Column, s: Column, method: str) -> Column:
    if method == "min_max":
        span = s["max"] - s["min"]
        return F.when(x.isNull(), None).when(span == 0, 0.0).otherwise(F.try_divide(x - s["min"], span))
    if method == "z_score":
        std = F.when(s["n"] == 1, 1.0).otherwise(s["std"])
        return F.when(x.isNull(), None).when(std == 0, 0.0).otherwise(F.try_divide(x - s["mean"], std))
    if method == "decimal_scaling":
        digits = F.length(F.floor(s["max_abs"]).cast("string"))
        return x / F.pow(F.lit(10.0), digits)
    if method == "unit_vector":
        return F.when(x.isNull(), None).when(s["magnitude"] == 0, 0.0).otherwise(F.try_divide(x, s["magnitude"]))
    raise ValueError(f"unknown method {method!r}")


def normalize(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules ``{field, method, target}`` (``type`` may name the method); one aggregation gives all statistics."""
    fields = list(dict.fromkeys(r["field"] for r in rules))
    stats = df.agg(F.struct(*[_stats(_number(df, c)).alias(c) for c in fields]).alias("s")).scalar()
    out = [F.col(c) for c in df.columns if c not in {r.get("target", r["field"]) for r in rules}]
    for r in rules:
        made = _scaled(_number(df, r["field"]), stats[r["field"]], r.get("method") or r["type"])
        out.append(made.alias(r.get("target", r["field"])))
    return df.select(*out)


def robust_scale_params(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles and their distance (at least 1e-8) per column."""
    q = quantiles(long_form(df, columns, "double"), ["column"], "value", {"q25": 0.25, "q75": 0.75})
    return q.withColumn("iqr", F.greatest(F.col("q75") - F.col("q25"), F.lit(1e-8)))


def robust_scale(df: DataFrame, column: str, target: str) -> DataFrame:
    """(x − q25) / iqr."""
    p = robust_scale_params(df, [column]).select(F.struct("q25", "iqr").alias("p")).scalar()
    return df.withColumn(target, (F.col(column) - p["q25"]) / p["iqr"])


def label_encode(df: DataFrame, column: str, target: str) -> DataFrame:
    """Most frequent label 0, next 1, ... (ties by name); null takes the next free number.

    Labels are numbered on the cluster, so their count is not bound by the driver.
    """
    counts = value_counts(df, [], column).withColumn("_rank", -F.col("n"))
    labels = row_index(counts, [], ["_rank", column], "_label").select(
        F.col(column).alias("_value"), (F.col("_label") - 1).cast("double").alias("_label"))
    spare = labels.agg(F.count("*").cast("double").alias("n")).scalar()
    joined = df.join(labels, df[column] == labels["_value"], "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce("_label", spare).alias(target))


def one_hot_encode(df: DataFrame, column: str, target: str) -> DataFrame:
    from pyspark.ml.feature import OneHotEncoder

    indexed = label_encode(df, column, f"_{target}")
    return OneHotEncoder(inputCol=f"_{target}", outputCol=target).fit(indexed).transform(indexed).drop(f"_{target}")


def tfidf(df: DataFrame, row_id: str, column: str, target: str) -> DataFrame:
    """(row_id, term, target): count of the term in the text times ln((rows + 1) / (rows with it + 1)).

    Terms are the words of the lower-cased text, exactly: one row per text and term.
    """
    terms = df.select(row_id, F.explode(F.split(F.lower(F.trim(F.col(column))), r"\s+")).alias("term")).filter("term <> ''")
    counts = terms.groupBy(row_id, "term").agg(F.count("*").alias("_tf"))
    spread = counts.groupBy("term").agg(F.count("*").alias("_df"))
    total = df.agg(F.count("*").alias("n")).scalar()
    weight = F.col("_tf") * F.log((total + 1) / (F.col("_df") + 1))
    return counts.join(spread, "term").select(row_id, "term", weight.alias(target))
