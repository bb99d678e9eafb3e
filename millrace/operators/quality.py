"""Quality rules, issues, scores, trends and risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scalars import starts_matching, to_float
from ..plans.ranged import quantiles, row_index
from .dedup import duplicate_share
from .joins import last_points, referential_errors
from .measures import blank, long_form, numeric_columns, per_column, text_columns

# Weights, levels, model weights and issue thresholds.
SEVERITY_WEIGHTS = {"critical": 10, "error": 5, "warning": 2}
LEVELS = [(95, "excellent"), (85, "good"), (70, "acceptable"), (50, "poor")]
RISKS = [(0.5, "critical"), (0.7, "high"), (0.85, "medium")]
MODEL_WEIGHTS = {"trend": 0.4, "anomaly": 0.3, "current": 0.3}
ISSUE_THRESHOLDS = [
    ("missing_values", 6, 0.1),
    ("duplicate_records", 7, 0.05),
    ("outliers", 8, 0.1),
    ("schema_drift", 9, 0.01),
    ("format_violations", 10, 0.01),
    ("freshness_decay", 12, 0.5),
]

BUILTIN_RULES = [
    {"name": "completeness_check", "type": "completeness", "severity": "warning", "min": 0.9},
    {"name": "uniqueness_check", "type": "uniqueness", "severity": "error", "fields": ["id", "email", "ssn"]},
    {"name": "email_format", "type": "format", "severity": "error", "field": "email", "pattern": P.EMAIL},
    {"name": "phone_format", "type": "format", "severity": "warning", "field": "phone", "pattern": P.PHONE},
    {"name": "age_range", "type": "range", "severity": "error", "field": "age", "min": 0, "max": 150},
    {"name": "data_type_consistency", "type": "consistency", "severity": "warning"},
    {"name": "statistical_outliers", "type": "outlier", "severity": "warning", "threshold": 3.0, "min_samples": 10},
]


def _number(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("double") if c in numeric_columns(df) else to_float(c)


def _text_kinds(df: DataFrame, c: str) -> tuple[Column, Column]:
    """(number of classes, non-null values); numeric text is a class of its own."""
    numeric = to_float(c).isNotNull()
    kinds = F.when(F.count_if(numeric) > 0, 1).otherwise(0) + F.when(
        F.count_if(F.col(c).isNotNull() & ~numeric) > 0, 1).otherwise(0)
    return kinds, F.count(c)


def issues(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Issue rows ``(rule_name, field_name, issue_type, severity, record_count)``.

    Every rule becomes a measure of one aggregation over the data; the moments
    that outlier rules need are one earlier aggregation.
    """
    outlier_fields = [c for c in numeric_columns(df) if any(r["type"] == "outlier" for r in rules)]
    moments = None
    if outlier_fields:
        moments = df.agg(F.struct(*[
            F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c)
            for c in outlier_fields]).alias("v")).scalar()
    made: list[Column] = []

    def add(rule: dict, field: str, count: Column, when: Column | None = None) -> None:
        shown = count if when is None else F.when(when, count)
        made.append(F.struct(
            F.lit(rule["name"]).alias("rule_name"), F.lit(field).alias("field_name"), F.lit(rule["type"]).alias("issue_type"),
            F.lit(rule["severity"]).alias("severity"), F.coalesce(shown, F.lit(0)).cast("long").alias("record_count")))

    for r in rules:
        kind = r["type"]
        if kind == "completeness":
            for c in r.get("fields", df.columns):
                share = F.avg(F.when(blank(c), 0.0).otherwise(1.0))
                add(r, c, F.count_if(blank(c)), share < r.get("min", 0.9))
        elif kind == "uniqueness":
            for c in r["fields"]:
                if c in df.columns:
                    add(r, c, F.count(c) - F.count_distinct(c))
        elif kind == "format":
            if r["field"] in df.columns:
                add(r, r["field"], F.count_if(F.col(r["field"]).isNotNull() & ~starts_matching(r["field"], r["pattern"])))
        elif kind == "range":
            if r["field"] in df.columns:
                x = _number(df, r["field"])
                out = F.lit(False)
                if r.get("min") is not None:
                    out = out | (x < r["min"])
                if r.get("max") is not None:
                    out = out | (x > r["max"])
                add(r, r["field"], F.count_if(out))
        elif kind == "consistency":
            for c in r.get("fields", text_columns(df)):
                kinds, n = _text_kinds(df, c)
                add(r, c, n, kinds > 1)
        elif kind == "outlier":
            for c in outlier_fields:
                m = moments.getField(c)
                z = F.try_divide(F.abs(F.col(c) - m.getField("m")), m.getField("s"))
                add(r, c, F.count_if(z > r.get("threshold", 3.0)), F.count_distinct(c) >= r.get("min_samples", 10))
        elif kind == "correlation":
            a, b = r["fields"]
            test = F.expr(r["condition"]) if isinstance(r["condition"], str) else r["condition"]
            add(r, f"{a},{b}", F.count_if(test))
        else:
            raise ValueError(f"unknown quality rule {kind!r}")
    return df.agg(F.array(*made).alias("i")).select(F.inline("i")).filter("record_count > 0")


def score(issue_rows: DataFrame, total: Column) -> DataFrame:
    """max(0, 100 − 10·Σ share·weight), two decimals, with its level."""
    weight = F.lit(1)
    for name, w in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    penalty = F.coalesce(F.sum(F.col("record_count") * weight), F.lit(0))
    s = F.round(F.greatest(F.lit(0.0), 100 - penalty / total * 10), 2)
    return issue_rows.agg(s.alias("score")).withColumn("level", level(F.col("score")))


def level(s: Column) -> Column:
    chain = None
    for least, name in LEVELS:
        chain = F.when(s >= least, name) if chain is None else chain.when(s >= least, name)
    return chain.otherwise("critical")


def suggestions(issue_rows: DataFrame, profiles: DataFrame, limit: int = 10) -> DataFrame:
    """One line per issue, sparse field and constant field; at most ``limit``."""
    a = issue_rows.select(F.col("field_name").alias("field"), F.concat(F.lit("fix_"), "issue_type").alias("suggestion"))
    b = profiles.filter(F.col("completeness") < 0.8).select("field", F.lit("improve_collection").alias("suggestion"))
    c = profiles.filter((F.col("unique_count") == 1) & (F.col("total_count") > 1)).select(
        "field", F.lit("review_constant").alias("suggestion"))
    return a.unionByName(b).unionByName(c).distinct().orderBy("field", "suggestion").limit(limit)


def field_profile(df: DataFrame) -> DataFrame:
    """Totals, blanks and distinct values per field."""
    rows = per_column(df, df.columns, {
        "total_count": lambda c: F.count(F.lit(1)),
        "null_count": lambda c: F.count_if(blank(c)),
        "unique_count": lambda c: F.count_distinct(F.when(~blank(c), F.col(c))),
    }).withColumnRenamed("column", "field")
    return rows.withColumn("completeness", 1 - F.col("null_count") / F.col("total_count"))


def trend(history: DataFrame, key: str, ts: str, value: str, since=None, tie: str | None = None) -> DataFrame:
    """Average, first, last and direction of the scores per dataset.

    Rows of one time are ordered by ``tie`` (by the value itself if none is given).
    """
    at = F.struct(ts, tie or value)
    rows = history if since is None else history.filter(F.col(ts) >= since)
    out = rows.groupBy(key).agg(
        F.count("*").alias("measurements"), F.avg(value).alias("average"),
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    return out.withColumn(
        "direction", F.when(F.col("last") > F.col("first"), "improving").when(
            F.col("last") < F.col("first"), "declining").otherwise("stable"))


def feature_row(df: DataFrame, now: Column, ts: str | None = None, expected: dict[str, str] | None = None,
                dates: Sequence[str] = (), emails: Sequence[str] = (), parents: Sequence[tuple[DataFrame, str, str]] = ()) -> DataFrame:
    """The metrics of one dataset at one time, as one row; ``feature_vector`` reads it.

    Counts come from one aggregation; outliers, duplicates and entropies each
    need one more because they group by value. ``parents`` lists
    (table, key here, key there) to count rows that point nowhere. The data
    volume is eight bytes per cell.
    """
    texts, numbers, width = text_columns(df), numeric_columns(df), len(df.columns)
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    rows = F.count(F.lit(1))
    unique = [F.count_distinct(c) / F.greatest(rows, F.lit(1)) for c in texts]
    bad = [F.count_if(unparsable_date(F.col(c))) for c in dates]
    bad += [F.count_if(~F.coalesce(F.col(c).rlike(P.EMAIL), F.lit(False))) for c in emails]
    age = (
        (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max(ts).cast("timestamp"))) / 3_600_000_000
        if ts else F.lit(0.0)
    )
    drift = schema_drift_count(df, expected or {})
    one = df.agg(
        rows.alias("row_count"),
        (F.sum(nulls) / (rows * width)).alias("null_percentage"),
        ((sum(unique, F.lit(0.0)) / len(texts)) if texts else F.lit(1.0)).alias("uniqueness"),
        sum(bad, F.lit(0)).cast("long").alias("format_errors"),
        age.alias("freshness_hours"),
    )
    out = one.select(
        "row_count", F.lit(width).alias("column_count"), "null_percentage", "uniqueness", "format_errors",
        "freshness_hours", F.lit(drift).alias("schema_violations"))
    if numbers:
        out = out.withColumn("outlier_percentage", outlier_share(df, numbers).scalar())
    else:
        out = out.withColumn("outlier_percentage", F.lit(0.0))
    if texts:
        out = out.withColumn("mean_column_entropy", column_entropy(df, texts).agg(F.avg("entropy").alias("e")).scalar())
    else:
        out = out.withColumn("mean_column_entropy", F.lit(0.0))
    lost = F.lit(0).cast("long")
    for parent, key, parent_key in parents:
        lost = lost + referential_errors(df, parent, key, parent_key).scalar()
    out = out.select(
        "*", duplicate_share(df).scalar().alias("duplicate_percentage"), lost.alias("referential_integrity_errors"),
        (F.col("row_count") * F.col("column_count") * 8 / float(1 << 30)).alias("data_volume_gb"), now.alias("measured_at"))
    return derived_scores(out)


def derived_scores(rows: DataFrame) -> DataFrame:
    """Completeness, accuracy, consistency, validity, timeliness and their mean with uniqueness."""
    cells = F.greatest(F.col("row_count") * F.col("column_count"), F.lit(1))
    accuracy = 1 - F.col("format_errors") / cells
    rows = rows.select(
        "*", (1 - F.col("null_percentage")).alias("completeness"), accuracy.alias("accuracy"),
        (1 - F.col("schema_violations") / F.greatest("column_count", F.lit(1))).alias("consistency"),
        accuracy.alias("validity"),
        F.greatest(F.lit(0.0), 1 - F.col("freshness_hours") / 168.0).alias("timeliness"))
    six = ["completeness", "accuracy", "consistency", "validity", "uniqueness", "timeliness"]
    return rows.withColumn("overall_score", sum((F.col(c) for c in six), F.lit(0.0)) / 6)


def unparsable_date(x: Column) -> Column:
    return x.try_cast("timestamp").isNull()


def outlier_share(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Values outside the quartile fences over rows times columns."""
    from .profile import fences, fenced_counts

    counted = fenced_counts(df, columns, fences(df, columns, k))
    total = counted.agg((F.sum("outliers") / F.greatest(F.max("rows") * len(columns), F.lit(1))).alias("share"))
    return total


def schema_drift(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Columns whose type differs from the expected one (schema only, no scan)."""
    have = dict(df.dtypes)
    rows = [(c, t, have[c]) for c, t in expected.items() if c in have and have[c] != t]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string")


def schema_drift_count(df: DataFrame, expected: dict[str, str]) -> int:
    have = dict(df.dtypes)
    return sum(1 for c, t in expected.items() if c in have and have[c] != t)


def column_entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """−Σ p·log2 p per column, over value counts that combine map-side."""
    counts = long_form(df, columns, "string").filter("value is not null").groupBy("column", "value").agg(
        F.count("*").alias("n"))
    # Σ p·log2 p = Σ n·log2 n / N − log2 N, so one more aggregation is enough.
    n = F.sum("n")
    return counts.groupBy("column").agg(
        (F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias("entropy"))


def freshness(df: DataFrame, ts: str, now: Column) -> DataFrame:
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max(ts).cast("timestamp"))) / 3_600_000_000
    return df.agg(hours.alias("freshness_hours")).withColumn(
        "timeliness", F.greatest(F.lit(0.0), 1 - F.col("freshness_hours") / 168.0))


def feature_vector() -> Column:
    """Seventeen scaled numbers of a metrics row."""
    c = F.col
    cap = lambda x: F.least(x, F.lit(1.0))
    return F.array(
        c("completeness"), c("accuracy"), c("consistency"), c("validity"), c("uniqueness"), c("timeliness"),
        c("null_percentage"), c("duplicate_percentage"), c("outlier_percentage"),
        cap(c("schema_violations") / 100.0), cap(c("format_errors") / 1000.0),
        cap(c("referential_integrity_errors") / 100.0), cap(c("freshness_hours") / 24.0),
        F.log10(F.greatest(c("row_count"), F.lit(1))) / 8.0, c("column_count") / 100.0,
        c("mean_column_entropy"), cap(c("data_volume_gb") / 1000.0),
    )


def score_trend(history: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Slope per step, direction, population volatility, last value and change over 24 points."""
    rows = row_index(history.select(key, ts, value), [key], [ts], "_i", total="_n")
    back = F.max(F.when(F.col("_i") == F.greatest(F.lit(1), F.col("_n") - 23), F.col(value)))
    out = rows.groupBy(key).agg(
        F.regr_slope(value, F.col("_i").cast("double")).alias("slope"), F.stddev_pop(value).alias("volatility"),
        F.max_by(value, "_i").alias("recent"), back.alias("_back"), F.max("_n").alias("points"))
    direction = F.when(F.col("slope") > 0.01, "improving").when(F.col("slope") < -0.01, "degrading").otherwise("stable")
    return out.filter("points >= 3").select(
        key, "points", "slope", direction.alias("direction"), "volatility", "recent",
        (F.col("recent") - F.col("_back")).alias("change"))


def daily_pattern(df: DataFrame, ts: str, value: str, spread: float = 0.1) -> DataFrame:
    """Peak and trough hour of day by mean value."""
    hours = df.groupBy(F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean"))
    return hours.agg(
        (F.max("mean") - F.min("mean") > spread).alias("has_pattern"),
        F.max(F.struct("mean", (-F.col("hour")).alias("h")))["h"].alias("_p"),
        F.min(F.struct("mean", "hour"))["hour"].alias("trough_hour"),
        F.max("mean").alias("peak_score"), F.min("mean").alias("trough_score"),
    ).select("has_pattern", (-F.col("_p")).alias("peak_hour"), "trough_hour", "peak_score", "trough_score")


def anomaly_score(metrics: DataFrame, key: list[str], vector: str) -> DataFrame:
    """Largest |z| over the vector positions, halved and capped at 1, per metrics row."""
    long = metrics.select(*key, F.posexplode(vector).alias("pos", "x"))
    moments = long.groupBy("pos").agg(F.avg("x").alias("m"), (F.stddev_pop("x") + 1e-8).alias("s"))
    # One row per vector position: seventeen rows.
    joined = long.join(F.broadcast(moments), "pos")
    z = F.max(F.abs(F.col("x") - F.col("m")) / F.col("s"))
    return joined.groupBy(*key).agg(F.least(F.lit(1.0), z / 2.0).alias("anomaly_score"))


def predicted_issues(vector: str | Column) -> Column:
    """Names of the issues whose feature passes its threshold."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.array_compact(F.array(*[F.when(v[i] > t, F.lit(n)) for n, i, t in ISSUE_THRESHOLDS]))


def risk_level(s: Column) -> Column:
    chain = None
    for below, name in RISKS:
        chain = F.when(s < below, name) if chain is None else chain.when(s < below, name)
    return chain.otherwise("low")


def predicted_score(slope: Column, hours: float, anomaly: Column, current: Column) -> Column:
    ahead = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.8 + slope * hours))
    w = MODEL_WEIGHTS
    return ahead * w["trend"] + (1 - anomaly) * w["anomaly"] + current * w["current"]


def key_issue_flags(metrics: DataFrame, key: str, ts: str) -> DataFrame:
    """Issue flags of the newest metrics row per dataset."""
    newest = last_points(metrics, [key], [ts], 1)
    return newest.select(
        key, F.col("overall_score").alias("current_score"),
        (F.col("null_percentage") > 0.1).alias("high_null_percentage"),
        (F.col("duplicate_percentage") > 0.05).alias("high_duplicate_percentage"),
        (F.col("outlier_percentage") > 0.1).alias("high_outlier_percentage"),
        (F.col("schema_violations") > 0).alias("schema_violations"),
        (F.col("freshness_hours") > 24).alias("freshness_issues"))


def gate_trend(history: DataFrame, key: str, ts: str, value: str, last: int = 10) -> DataFrame:
    """Direction, mean and spread of the last results per gate."""
    out = last_points(history, [key], [ts], last).groupBy(key).agg(
        F.count("*").alias("n"), F.max_by(value, ts).alias("last"), F.min_by(value, ts).alias("first"),
        F.avg(value).alias("recent_average"), (F.max(value) - F.min(value)).alias("volatility"))
    return out.filter("n >= 2").withColumn(
        "direction", F.when(F.col("last") > F.col("first"), "improving").otherwise("declining"))


def adapted_threshold(passed: Column, direction: Column, value: Column, current: Column, base: Column) -> Column:
    """Raise by 2 (98 at most) after a clear pass, lower by 1 (90 % of base at least) after a failure."""
    floor = base * 0.9
    return (
        F.when(passed & (direction == "improving") & (value > current + 10), F.least(current + 2.0, F.lit(98.0)))
        .when(~passed & (direction == "declining") & (current > floor), F.greatest(current - 1.0, floor))
        .otherwise(current)
    )


def robust_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles per column, by rank over distinct values."""
    return quantiles(long_form(df, columns, "double"), ["column"], "value", {"q25": 0.25, "q75": 0.75})
