"""Metric series: trends, alerts, baselines, anomalies and forecasts.

A series is ``(key, ts, id, value)``. A key may hold a third of all points, so
whole-series steps use the range-partition helpers, and "the last n points" is
a rank limit that Spark applies before the shuffle. ``now`` is always given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patterns as P
from ..plans.keys import join_by_key
from ..plans.ranged import affine_scans, quantiles, row_index, running
from .joins import last_points, tolerance_join

# Fixed values of the models.
TREND_WEIGHTS = [0.4, 0.3, 0.2, 0.1]
BLEND = {"time": 0.2, "day": 0.1, "trend": 0.3, "current": 0.25, "queue": 0.15}
EMA = 0.1


def micros(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(x.cast("timestamp"))


def seconds(c: str | Column) -> Column:
    return micros(c) / 1e6


def history(df: DataFrame, key: str, name: str, ts: str, since, row_id: str) -> DataFrame:
    return df.filter((F.col(key) == name) & (F.col(ts) >= since)).orderBy(F.col(ts).desc(), F.col(row_id).desc())


def _band(x: Column, at: float, up: str = "increasing", down: str = "decreasing") -> Column:
    return F.when(x > at, up).when(x < -at, down).otherwise("stable")


def slope_trend(df: DataFrame, key: str, order: list[str], value: str, at: float = 0.1) -> DataFrame:
    """Least-squares slope of the value on its position."""
    rows = row_index(df.select(key, *order, value), [key], order)
    out = rows.groupBy(key).agg(F.regr_slope(F.col(value), F.col("idx").cast("double")).alias("slope"))
    return out.withColumn("direction", _band(F.col("slope"), at))


def corr_trend(df: DataFrame, key: str, order: list[str], value: str, at: float = 0.3) -> DataFrame:
    """Correlation of the value with its position."""
    rows = row_index(df.select(key, *order, value), [key], order)
    out = rows.groupBy(key).agg(F.corr(F.col(value), F.col("idx").cast("double")).alias("r"))
    return out.select(key, _band(F.col("r"), at).alias("direction"), F.abs("r").alias("strength"))


def half_split_trend(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(mean of the second half − mean of the first) / max(0.01, |first|)."""
    rows = row_index(df.select(key, *order, value), [key], order, total="n")
    early = F.col("idx") <= F.floor(F.col("n") / 2)
    out = rows.groupBy(key).agg(
        F.avg(F.when(early, F.col(value))).alias("a"), F.avg(F.when(~early, F.col(value))).alias("b"))
    return out.select(key, ((F.col("b") - F.col("a")) / F.greatest(F.lit(0.01), F.abs("a"))).alias("trend"))


def volatility(df: DataFrame, key: str, value: str) -> DataFrame:
    mean = F.avg(value)
    return df.groupBy(key).agg(
        F.when(mean > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)) / mean).otherwise(0.0).alias("volatility"))


def breaks(value: Column, operator: Column, threshold: Column, tolerance: float = 0.001) -> Column:
    """Whether a value breaks a rule: gt, lt, eq or ne."""
    close = F.abs(value - threshold) < tolerance
    return (
        F.when(operator == "gt", value > threshold).when(operator == "lt", value < threshold)
        .when(operator == "eq", close).when(operator == "ne", ~close).otherwise(False))


def rule_table(spark, rules: list[dict]) -> DataFrame:
    """Alert rules as a small table: one row per rule given by the caller."""
    rows = [(r.get("rule", f"rule{i}"), r["metric"], r["operator"], float(r["threshold"]), r.get("severity", "warning"))
            for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule string, metric string, operator string, threshold double, severity string")


def threshold_alerts(df: DataFrame, key: str, value: str, rules: list[dict]) -> DataFrame:
    """One row per point and broken rule. The rule list is broadcast: its size is the caller's list."""
    table = F.broadcast(rule_table(df.sparkSession, rules))
    joined = df.join(table, df[key] == table["metric"])
    return joined.filter(breaks(F.col(value), F.col("operator"), F.col("threshold"))).drop("metric")


def window_averages(df: DataFrame, key: str, ts: str, value: str, width: str = "5 minutes") -> DataFrame:
    out = df.groupBy(key, F.window(ts, width).alias("w")).agg(F.avg(value).alias("avg_value"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "avg_value", "n")


def window_avg_alerts(df: DataFrame, key: str, ts: str, value: str, rules: list[dict], width: str = "5 minutes") -> DataFrame:
    return threshold_alerts(window_averages(df, key, ts, value, width), key, "avg_value", rules)


def duration_alerts(df: DataFrame, key: str, ts: str, value: str, rules: list[dict], duration: float) -> DataFrame:
    """The latest point breaks and so did every point of the last ``duration`` seconds.

    That holds exactly when the last unbroken point is older than the window,
    so one aggregation per rule decides it.
    """
    table = F.broadcast(rule_table(df.sparkSession, rules))
    at = micros(ts)
    bad = breaks(F.col(value), F.col("operator"), F.col("threshold"), 0.01)
    seen = df.join(table, df[key] == table["metric"]).groupBy("rule", key).agg(
        F.max(at).alias("last_at"), F.max(F.when(~bad, at)).alias("last_ok"),
        F.max(F.struct(at, F.col(value).alias("v")))["v"].alias("latest"))
    quiet = F.col("last_ok").isNull() | (F.col("last_at") - F.col("last_ok") > int(duration * 1e6))
    return seen.select("rule", key, "latest", quiet.alias("fires"))


def alert_episodes(df: DataFrame, key: str, order: list[str], breach: Column) -> DataFrame:
    """Runs of consecutive breaches: opened, last seen, repeats, closed by the first good point.

    The number of good points so far names a run, so one running sum is enough.
    """
    rows = df.select(key, *order, F.coalesce(breach, F.lit(False)).alias("_bad"))
    run = running(rows, [key], order, {"_good": F.when(F.col("_bad"), 0).otherwise(1).cast("long")})
    # The good point that ends run g is the (g+1)-th good point.
    named = run.withColumn("episode", F.when(F.col("_bad"), F.col("_good")).otherwise(F.col("_good") - 1))
    ts = order[0]
    out = named.groupBy(key, "episode").agg(
        F.min(F.when(F.col("_bad"), F.col(ts))).alias("opened_at"),
        F.max(F.when(F.col("_bad"), F.col(ts))).alias("last_triggered"),
        F.count_if("_bad").alias("trigger_count"),
        F.min(F.when(~F.col("_bad"), F.col(ts))).alias("resolved_at"))
    return out.filter("trigger_count > 0").drop("episode")


def severity(z: Column) -> Column:
    return F.when(z > 4, "critical").when(z > 3, "error").when(z > 2, "warning").otherwise("info")


def zscore_last_incl(df: DataFrame, key: str, order: list[str], value: str, since, threshold: float = 3.0) -> DataFrame:
    """The latest point against the mean and population deviation of all points since."""
    out = df.filter(F.col(order[0]) >= since).groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.max(F.struct(*order, F.col(value).alias("v")))["v"].alias("latest"))
    z = F.abs(F.col("latest") - F.col("mean")) / F.col("std")
    return out.filter((F.col("n") >= 10) & (F.col("std") > 0)).select(
        key, "latest", z.alias("z_score"), (z > threshold).alias("anomaly"))


def zscore_last_excl(df: DataFrame, key: str, order: list[str], value: str, sensitivity: float = 0.5) -> DataFrame:
    """The latest point against the 99 before it."""
    last = last_points(df.select(key, *order, value), [key], order, 100)
    older = F.when(F.col("rn") > 1, F.col(value))
    out = last.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(older).alias("mean"), F.stddev_pop(older).alias("std"),
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("latest"))
    z = F.abs(F.col("latest") - F.col("mean")) / F.col("std")
    return out.filter((F.col("n") >= 30) & (F.col("std") > 0)).select(
        key, "latest", "mean", z.alias("z_score"), (z > 3.0 - 2.0 * sensitivity).alias("anomaly"),
        F.when(F.col("latest") > F.col("mean"), "spike").otherwise("drop").alias("anomaly_type"),
        F.least(F.lit(0.99), z / 5.0).alias("confidence"), severity(z).alias("severity"))


def trend_change(df: DataFrame, key: str, order: list[str], value: str, at: float = 0.1) -> DataFrame:
    """Slopes of the two halves of the last 100 points; a change above 10 % of the mean counts."""
    last = last_points(df.select(key, *order, value), [key], order, 100)
    sized = join_by_key(last, last.groupBy(key).agg(F.count("*").alias("n")), key)
    pos = (F.col("n") - F.col("rn")).cast("double")
    early = pos < F.floor(F.col("n") / 2)
    out = sized.groupBy(key).agg(
        F.max("n").alias("n"), F.avg(value).alias("mean"),
        F.regr_slope(F.when(early, F.col(value)), F.when(early, pos)).alias("slope_1"),
        F.regr_slope(F.when(~early, F.col(value)), F.when(~early, pos)).alias("slope_2"))
    change = F.abs(F.col("slope_2") - F.col("slope_1")) / F.col("mean")
    return out.filter((F.col("n") >= 20) & (F.col("mean") > 0)).select(
        key, "slope_1", "slope_2", change.alias("relative_change"), (change > at).alias("changed"),
        F.least(F.lit(0.9), change * 5).alias("confidence"))


def metric_correlation(a: DataFrame, b: DataFrame, ts: str, row_id: str, value: str, within: float = 1.0) -> DataFrame:
    """Pearson over the points of two series that lie close in time; needs 10 pairs."""
    pairs = tolerance_join(a, b, ts, row_id, value, within)
    return pairs.agg(F.count("*").alias("pairs"), F.corr("a_value", "b_value").alias("r")).select(
        "pairs", F.when(F.col("pairs") >= 10, F.col("r")).alias("correlation"),
        F.coalesce((F.col("pairs") >= 10) & (F.abs("r") > 0.5), F.lit(False)).alias("shown"))


def sli(df: DataFrame, ts: str, since, error: Column, value: Column | None = None) -> DataFrame:
    """(1 − errors / requests)·100 in the window; 99 without any point."""
    weight = F.lit(1.0) if value is None else value
    ratio = F.try_divide(F.sum(F.when(error, weight).otherwise(0.0)), F.sum(weight))
    return df.filter(F.col(ts) >= since).agg(F.coalesce((1 - ratio) * 100, F.lit(99.0)).alias("sli"))


def slo_breach(slis: DataFrame, target: float) -> DataFrame:
    return slis.select("sli", F.lit(target).alias("target"), (F.col("sli") < target).alias("breach"),
                       (F.lit(target) - F.col("sli")).alias("error_budget"))


def baseline(df: DataFrame, key: str, value: str, least: int = 100) -> DataFrame:
    """Moments and quantiles per series with at least ``least`` points."""
    moments = df.groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df.select(key, value), [key], value, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return join_by_key(moments.filter(F.col("n") >= least), q, key)


def health_score(critical: Column, errors: Column, breaches: Column) -> Column:
    """100 − 20·critical − min(30, 2·errors) above 10 errors − 15·breaches, between 0 and 100."""
    raw = 100 - critical * 20 - F.when(errors > 10, F.least(F.lit(30), errors * 2)).otherwise(0) - breaches * 15
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


def health_status(score: Column) -> Column:
    return F.when(score >= 95, "excellent").when(score >= 80, "good").when(score >= 60, "degraded").otherwise("critical")


def lower_is_better(name: str) -> bool:
    n = name.lower()
    if "time" in n or "duration" in n:
        return True
    if any(w in n for w in ("availability", "accuracy", "success")):
        return False
    return "error" in n or "failure" in n


def meets(name: str, actual: Column, target: float) -> Column:
    return actual <= target if lower_is_better(name) else actual >= target


def sla_per_execution(df: DataFrame, name: str, key: str, value: str, target: float) -> DataFrame:
    ok = F.count_if(meets(name, F.col(value), target))
    pct = ok / F.count("*") * 100
    return df.groupBy(key).agg(
        F.count("*").alias("total"), ok.alias("compliant_runs"), pct.alias("actual_pct"), (pct >= 95.0).alias("compliant"))


def sla_average(df: DataFrame, name: str, key: str, ts: str, value: str, target: float, period: str = "1 hour") -> DataFrame:
    out = df.groupBy(key, F.window(ts, period).alias("w")).agg(F.avg(value).alias("actual"), F.count("*").alias("points"))
    return out.select(key, F.col("w.start").alias("period_start"), "points", "actual",
                      meets(name, F.col("actual"), target).alias("compliant"))


def ema_baseline(df: DataFrame, key: str, order: list[str], duration: str, success: Column, alpha: float = EMA) -> DataFrame:
    """Running means of duration and success after each run; degraded above 1.5 times the mean.

    Runs without a duration are left out, so they neither count nor change a mean.
    """
    rows = df.filter(F.col(duration).isNotNull()).select(key, *order, F.col(duration).cast("double").alias(duration), F.when(success, 100.0).otherwise(0.0).alias("_ok"))
    rows = rows.select("*", F.lit(1 - alpha).alias("_keep"), (F.col(duration) * alpha).alias("_add"),
                       (F.col("_ok") * alpha).alias("_add_ok"))
    rows = rows.withColumn("_one", F.lit(1.0))
    rows = affine_scans(rows, [key], order, {
        "avg_duration": ("_keep", "_add", duration), "success_rate": ("_keep", "_add_ok", "_ok"),
        "sample_count": ("_one", "_one", "_one")})
    rows = rows.withColumn("sample_count", F.col("sample_count").cast("long"))
    # The first run only sets the baseline; it is not compared with itself.
    slow = (F.col("sample_count") > 1) & (F.col(duration) > F.col("avg_duration") * 1.5)
    return rows.select(key, *order, duration, "avg_duration", "success_rate", "sample_count", slow.alias("degraded"))


def ema_anomaly(df: DataFrame, key: str, order: list[str], value: str, alpha: float = EMA) -> DataFrame:
    """Running mean and variance per point; |v − mean| / sd > 3 after ten points, > 4 is high.

    Points without a value are left out.
    """
    rows = df.filter(F.col(value).isNotNull()).select(key, *order, F.col(value).cast("double").alias(value))
    rows = rows.select("*", F.lit(1 - alpha).alias("_keep"), (F.col(value) * alpha).alias("_add"), F.lit(0.0).alias("_zero"),
                       F.lit(1.0).alias("_one"))
    rows = affine_scans(rows, [key], order, {"mean": ("_keep", "_add", value), "count": ("_one", "_one", "_one")})
    # The step from the old mean, read back from the new one.
    gap = (F.col(value) - F.col("mean")) / (1 - alpha)
    rows = affine_scans(
        rows.withColumn("_add_var", gap * gap * alpha), [key], order, {"variance": ("_keep", "_add_var", "_zero")})
    rows = rows.withColumn("count", F.col("count").cast("long"))
    z = F.when((F.col("count") >= 10) & (F.col("variance") > 0), F.abs(F.col(value) - F.col("mean")) / F.sqrt("variance"))
    return rows.select(key, *order, value, "mean", "variance", "count", z.alias("z_score"),
                       F.when(z > 4, "high").when(z > 3, "medium").alias("severity"))


def series_model(df: DataFrame, key: str, value: str, least: int = 30) -> DataFrame:
    """Mean, deviation, median, index quartiles and extremes per series."""
    m = df.groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    slim = df.select(key, value)
    out = join_by_key(m.filter(F.col("n") >= least), quantiles(slim, [key], value, {"median": 0.5}), key)
    return join_by_key(out, quantiles(slim, [key], value, {"p25": 0.25, "p75": 0.75}, "index"), key).withColumn(
        "iqr", F.col("p75") - F.col("p25"))


def trend_model(df: DataFrame, key: str, order: list[str], value: str, last: int = 50, least: int = 10) -> DataFrame:
    """Slope on time over the last points and strength min(1, |slope|·n / sqrt(SST))."""
    rows = last_points(df.select(key, *order, value), [key], order, last)
    # Seconds before a fixed date keep the sums small; the slope does not change.
    at = seconds(order[0]) - 1_700_000_000.0
    out = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.coalesce(F.regr_slope(F.col(value), at), F.lit(0.0)).alias("slope"),
        (F.var_pop(value) * F.count("*")).alias("sst"))
    strength = F.when(F.col("sst") > 0, F.least(F.lit(1.0), F.abs("slope") * F.col("n") / F.sqrt("sst"))).otherwise(0.0)
    return out.filter(F.col("n") >= least).select(
        key, "n", "slope", strength.alias("strength"),
        F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable").alias("direction"))


def hour_means(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return df.groupBy(key, F.hour(ts).alias("hour")).agg(F.count("*").alias("points"), F.avg(value).alias("hour_mean"))


def seasonal_model(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Hour means (more than 2 points) where more than 12 hours have one, with their strength."""
    hours = hour_means(df, key, ts, value)
    totals = hours.groupBy(key).agg(
        F.sum("points").alias("n"), F.count_if(F.col("points") > 2).alias("hours"),
        F.avg(F.when(F.col("points") > 2, F.col("hour_mean"))).alias("m"),
        F.stddev_samp(F.when(F.col("points") > 2, F.col("hour_mean"))).alias("s"))
    good = totals.filter((F.col("n") >= 100) & (F.col("hours") > 12)).select(
        key, F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) / F.greatest(F.lit(0.01), F.abs("m"))).alias("strength"))
    return join_by_key(hours.filter("points > 2"), good, key).select(key, "hour", "hour_mean", "strength")


def latest(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.struct(*order, F.col(value).alias("v"))).alias("l")).select(
        key, F.col(f"l.{order[0]}").alias("latest_ts"), F.col("l.v").alias("latest"))


def detect_zscore(df: DataFrame, key: str, order: list[str], value: str, sensitivity: float = 0.8) -> DataFrame:
    """The latest value against the series model."""
    limit = 2.0 + (1.0 - sensitivity)
    rows = join_by_key(latest(df, key, order, value), series_model(df, key, value).filter("std > 0"), key)
    z = F.abs(F.col("latest") - F.col("mean")) / F.col("std")
    return rows.select(
        key, "latest", z.alias("z_score"), (z > limit).alias("anomaly"),
        F.least(F.lit(1.0), (z - limit) / limit).alias("confidence"), F.least(F.lit(1.0), z / 4.0).alias("severity"))


def detect_trend(df: DataFrame, key: str, order: list[str], value: str, sensitivity: float = 0.8) -> DataFrame:
    """The latest value against the line through the point before it; "now" is the latest time."""
    two = last_points(df.select(key, *order, value), [key], order, 2).groupBy(key).agg(
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("latest"),
        F.max(F.when(F.col("rn") == 2, F.col(value))).alias("before"),
        (F.max(F.when(F.col("rn") == 1, micros(order[0]))) - F.max(F.when(F.col("rn") == 2, micros(order[0])))).alias("gap"))
    rows = join_by_key(two, trend_model(df, key, order, value).filter("strength >= 0.3"), key)
    expected = F.col("before") + F.col("slope") * F.col("gap") / 1e6
    off = F.abs(F.col("latest") - expected) / F.greatest(F.lit(0.01), F.abs(expected))
    return rows.select(key, "latest", expected.alias("expected"), off.alias("deviation"), (off > sensitivity).alias("anomaly"))


def detect_seasonal(df: DataFrame, key: str, order: list[str], value: str, sensitivity: float = 0.8) -> DataFrame:
    """The latest value against the mean of its hour, where the pattern is strong enough."""
    rows = latest(df, key, order, value).withColumn("hour", F.hour("latest_ts"))
    rows = join_by_key(rows, seasonal_model(df, key, order[0], value).filter("strength >= 0.2"), [key, "hour"])
    off = F.abs(F.col("latest") - F.col("hour_mean")) / F.greatest(F.lit(0.01), F.abs("hour_mean"))
    return rows.select(key, "hour", "latest", "hour_mean", off.alias("deviation"), (off > sensitivity * 1.5).alias("anomaly"))


def detect_recent(df: DataFrame, key: str, order: list[str], value: str, sensitivity: float = 0.8) -> DataFrame:
    """The latest value against the last twenty points."""
    rows = last_points(df.select(key, *order, value), [key], order, 20).groupBy(key).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("latest"))
    off = F.abs(F.col("latest") - F.col("mean")) / F.col("std")
    return rows.filter((F.col("n") >= 10) & (F.col("std") > 0)).select(
        key, "latest", off.alias("deviation"), (off > sensitivity * 2.5).alias("anomaly"))


def forecast_linear(df: DataFrame, key: str, order: list[str], value: str, horizon: float = 3600.0, steps: int = 5,
                    sensitivity: float = 0.8) -> DataFrame:
    """Last value plus slope per step over the last twenty points, flagged against the series model."""
    line = trend_model(df, key, order, value, last=20, least=10).select(key, "slope")
    rows = join_by_key(join_by_key(latest(df, key, order, value), line, key), series_model(df, key, value).select(key, "mean", "std"), key)
    step = horizon / steps
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    guess = F.col("latest") + F.col("slope") * F.col("step") * step
    off = F.abs(guess - F.col("mean")) / F.greatest(F.lit(0.01), F.col("std"))
    return rows.select(key, "step", guess.alias("predicted"), off.alias("deviation"), (off > sensitivity * 2).alias("anomalous"))


def _last_line(df: DataFrame, key: str, order: list[str], value: str, last: int) -> DataFrame:
    """Regression of the last points on their position, oldest 0, with their moments."""
    rows = last_points(df.select(key, *order, value), [key], order, last)
    x = (-F.col("rn")).cast("double")
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.stddev_pop(value).alias("std_pop"),
        F.coalesce(F.regr_slope(F.col(value), x), F.lit(0.0)).alias("slope"),
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("latest"))


def forecast_blend(df: DataFrame, key: str, order: list[str], value: str, now: Column, minutes: float, queue: Column) -> DataFrame:
    """Blend of time of day, weekday, trend, current value and queue, between 0 and 1."""
    rows = _last_line(df, key, order, value, 10)
    epoch = micros(now) / 1e6
    angle = (epoch % 86400) / 86400 * (2 * F.pi()) - F.pi() / 3
    day = F.floor(epoch / 86400) % 7
    x = F.col("n") + minutes / 5
    line = F.when(F.col("n") >= 3, F.col("mean") + F.col("slope") * (x - (F.col("n") - 1) / 2)).otherwise(F.col("mean"))
    blend = (
        (0.5 + 0.3 * F.sin(angle)) * BLEND["time"] + F.when((day < 1) | (day >= 6), 0.7).otherwise(1.0) * BLEND["day"]
        + line * BLEND["trend"] + F.col("latest") * BLEND["current"] + F.least(F.lit(0.3), queue / 1000) * BLEND["queue"])
    return rows.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)).alias("prediction"))


def forecast_step(df: DataFrame, key: str, order: list[str], value: str, horizon: float = 300.0, cap: float | None = None) -> DataFrame:
    """Last value plus the projected slope of the last ten, with a confidence from spread and trend."""
    rows = _last_line(df, key, order, value, 10)
    trend = F.col("slope") * (horizon / 300)
    guess = F.greatest(F.lit(0.0), F.col("latest") + trend)
    if cap is not None:
        guess = F.least(F.lit(float(cap)), guess)
    cv = F.try_divide(F.coalesce("std", F.lit(0.0)), F.col("mean"))
    sure = (F.greatest(F.lit(0.1), 1 - cv) + 0.5 + F.least(F.lit(1.0), F.abs(trend) * 10) * 0.4) / 2
    confidence = F.when((F.col("n") < 3) | (F.col("mean") == 0), 0.5).otherwise(F.least(F.lit(0.95), sure))
    return rows.filter("n >= 10").select(key, guess.alias("predicted"), trend.alias("trend"), confidence.alias("confidence"))


def seasonal_step_up(df: DataFrame, key: str, ts: str, value: str, factor: float = 1.3, least: float = 0.0) -> DataFrame:
    """Hours whose next hour of day is usually above ``factor`` times this one."""
    hours = hour_means(df, key, ts, value).select(key, "hour", "hour_mean")
    after = hours.select(key, ((F.col("hour") + 23) % 24).cast("int").alias("hour"), F.col("hour_mean").alias("next_mean"))
    rows = join_by_key(hours, after, [key, "hour"])
    hit = (F.col("next_mean") > F.col("hour_mean") * factor) & (F.col("next_mean") > least)
    return rows.select(key, "hour", "hour_mean", "next_mean", hit.alias("step_up"), (F.col("next_mean") * 0.8).alias("target"))


def hourly(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return df.groupBy(key, F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour")).agg(F.avg(value).alias("v"))


def autocorrelation(df: DataFrame, key: str, ts: str, value: str, lag: int) -> DataFrame:
    """Autocorrelation of the hourly means; a series has one row per hour, so its window is short."""
    rows = hourly(df, key, ts, value)
    whole, ordered = W.partitionBy(key), W.partitionBy(key).orderBy("hour")
    rows = rows.withColumn("d", F.col("v") - F.avg("v").over(whole)).withColumn("n", F.count("*").over(whole))
    rows = rows.withColumn("ahead", F.lead("d", lag).over(ordered))
    out = rows.groupBy(key).agg(F.try_divide(F.sum(F.col("d") * F.col("ahead")), F.sum(F.col("d") * F.col("d"))).alias("acf"), F.max("n").alias("n"))
    return out.filter(F.col("n") > lag).select(key, F.lit(lag).alias("lag"), "acf", (F.col("acf") > 0.3).alias("seasonal"))


def forecast_interval(rows: DataFrame, key: str, predicted: str) -> DataFrame:
    """± value·(population deviation of the forecasts + 0.1), at least 0.01 below."""
    spread = rows.groupBy(key).agg((F.coalesce(F.stddev_pop(predicted), F.lit(0.0)) + 0.1).alias("_f"))
    p = F.col(predicted)
    return join_by_key(rows, spread, key).select(
        *rows.columns, F.greatest(F.lit(0.01), p - p * F.col("_f")).alias("lower"), (p + p * F.col("_f")).alias("upper"))


def forecast_anomaly(df: DataFrame, key: str, order: list[str], value: str, forecasts: DataFrame, predicted: str) -> DataFrame:
    """|mean forecast − mean of the last twenty| in population deviations, a third, capped at 1."""
    rows = _last_line(df, key, order, value, 20).filter("n >= 10")
    means = forecasts.groupBy(key).agg(F.avg(predicted).alias("f"))
    z = F.abs(F.col("f") - F.col("mean")) / F.col("std_pop")
    return join_by_key(rows, means, key).select(
        key, F.when(F.col("std_pop") == 0, 0.0).otherwise(F.least(F.lit(1.0), z / 3.0)).alias("anomaly_score"))


def forecast_fallback(df: DataFrame, key: str, order: list[str], value: str, horizon: int = 5) -> DataFrame:
    """Mean of the last ten, five percent more per step, ± 10 %."""
    rows = _last_line(df, key, order, value, 10).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    p = F.col("mean") * (1 + 0.05 * F.col("step"))
    return rows.select(key, "step", p.alias("predicted"), (p * 0.9).alias("lower"), (p * 1.1).alias("upper"))


def phase_bottlenecks(df: DataFrame, key: list[str], phases: list[str], factor: float = 1.5) -> DataFrame:
    """Phases above ``factor`` times the mean phase of their row; twice the mean is high."""
    total = sum((F.col(p).cast("double") for p in phases), F.lit(0.0))
    rows = df.select(*key, total.alias("_total"), *[F.col(p).cast("double").alias(p) for p in phases])
    long = rows.unpivot([*key, "_total"], phases, "phase", "spent")
    mean = F.col("_total") / len(phases)
    return long.filter(F.col("spent") > mean * factor).select(
        *key, "phase", "spent", F.coalesce(F.try_divide(F.col("spent"), F.col("_total")) * 100, F.lit(0.0)).alias("pct_of_total"),
        F.when(F.col("spent") > mean * 2, "high").otherwise("medium").alias("severity"))


# Limit, and the limit above which it is high (none: always medium).
RESOURCE_LIMITS = {"cpu": (80, 90), "memory": (85, 95), "io": (75, None)}


def resource_bottlenecks(df: DataFrame, key: list[str], columns: dict[str, str], quality: str | None = None) -> DataFrame:
    """Resources over their limit and a quality score under 0.8, one row each."""
    made = []
    for name, column in columns.items():
        limit, high = RESOURCE_LIMITS[name]
        level = F.when(F.col(column) > high, "high").otherwise("medium") if high else F.lit("medium")
        made.append(F.when(F.col(column) > limit, F.struct(
            F.lit(name).alias("resource"), F.col(column).cast("double").alias("value"), level.alias("severity"))))
    if quality:
        made.append(F.when(F.col(quality) < 0.8, F.struct(
            F.lit("quality").alias("resource"), F.col(quality).cast("double").alias("value"),
            F.when(F.col(quality) < 0.6, "high").otherwise("medium").alias("severity"))))
    return df.select(*key, F.inline(F.array_compact(F.array(*made))))


def history_patterns(df: DataFrame, duration: str, quality: str) -> DataFrame:
    """Mean, median and deviation of run time and quality, as rows."""
    rows = df.select(F.col(duration).cast("double").alias("time"), F.col(quality).cast("double").alias("quality")).unpivot(
        [], ["time", "quality"], "measure", "value")
    m = rows.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))
    return m.join(quantiles(rows, ["measure"], "value", {"median": 0.5}), "measure")


def retain(df: DataFrame, ts: str, now: Column, days: float, resolved: Column | None = None) -> DataFrame:
    """Drop old points; with ``resolved`` only the resolved ones go."""
    old = micros(ts) < micros(now) - int(days * 86_400_000_000)
    return df.filter(~old if resolved is None else ~(old & resolved))


def dashboard(df: DataFrame, key: str, order: list[str], value: str, now: Column, breach: Column, error: Column,
              target: float, recent_days: float = 1.0) -> DataFrame:
    """Current value and breaches per series with the service level of the whole, as rows."""
    recent = micros(order[0]) >= micros(now) - int(recent_days * 86_400_000_000)
    rows = df.groupBy(key).agg(
        F.max(F.struct(*order, F.col(value).alias("v")))["v"].alias("current_value"),
        F.max(F.struct(*order, F.coalesce(breach, F.lit(False)).alias("b")))["b"].alias("alert_active"),
        F.count_if(breach & recent).alias("recent_alerts"), F.count("*").alias("points"))
    level = df.agg(((1 - F.count_if(error) / F.count("*")) * 100).alias("s")).scalar()
    return rows.withColumn("sli", level).withColumn("slo_breach", F.col("sli") < target)


def weighted_average(df: DataFrame, key: str, order: list[str], value: str, n: int = 10, weights: list[float] = TREND_WEIGHTS) -> DataFrame:
    """Mean of the last points, newer points weighing more; the last weight goes on for older ones."""
    rows = last_points(df.select(key, *order, value), [key], order, n)
    table = F.array(*[F.lit(w) for w in weights])
    w = F.element_at(table, F.least(F.col("rn"), F.lit(len(weights))).cast("int"))
    return rows.groupBy(key).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("weighted_avg"))


def ma_crossover(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Mean of five against mean of ten: ± 5 % moves the next value by ± 2 %."""
    rows = last_points(df.select(key, *order, value), [key], order, 20).groupBy(key).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("rn") <= 5, F.col(value))).alias("short_ma"),
        F.avg(F.when(F.col("rn") <= 10, F.col(value))).alias("long_ma"),
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("last"))
    factor = F.when(F.col("short_ma") > F.col("long_ma") * 1.05, 1.02).when(
        F.col("short_ma") < F.col("long_ma") * 0.95, 0.98).otherwise(1.0)
    return rows.filter("n >= 20").select(key, "short_ma", "long_ma", (F.col("last") * factor).alias("predicted"))


def short_trend(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(last − third last) / 3 beyond ± 0.001, and the spread of the last twenty over their mean."""
    rows = last_points(df.select(key, *order, value), [key], order, 20).groupBy(key).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("a"), F.max(F.when(F.col("rn") == 3, F.col(value))).alias("c"))
    slope = (F.col("a") - F.col("c")) / 3
    return rows.filter("n >= 10").select(
        key, _band(slope, 0.001, "rising", "falling").alias("trend"),
        F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0).alias("volatility"))


def operation_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, extremes, sum and index percentiles per operation."""
    m = df.groupBy(key).agg(
        F.count(value).alias("count"), F.avg(value).alias("avg_time"), F.min(value).alias("min_time"),
        F.max(value).alias("max_time"), F.sum(value).alias("total_time"))
    return join_by_key(m, quantiles(df.select(key, value), [key], value, {"p50": 0.5, "p90": 0.9, "p95": 0.95}, "index"), key)


def slow_operations(df: DataFrame, key: str, order: list[str], value: str, error: Column, last: int = 100,
                    slow: float = 1000.0, errors: float = 0.1) -> DataFrame:
    """Among the last points of all operations: slow on average or failing too often (3 points at least)."""
    rows = df.withColumn("_err", F.when(error, 1.0).otherwise(0.0)).orderBy(*[F.col(c).desc() for c in order]).limit(last)
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"), F.avg("_err").alias("error_rate"))
    return out.filter((F.col("n") >= 3) & ((F.col("avg_value") > slow) | (F.col("error_rate") > errors)))


def peak_hour(df: DataFrame, key: str, order: list[str], last: int = 100) -> DataFrame:
    """Most frequent hour of the last accesses, the earlier hour on a tie."""
    hours = last_points(df.select(key, *order), [key], order, last).groupBy(key, F.hour(order[0]).alias("hour")).agg(
        F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("hour")).alias("h")))
    return hours.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.h")).alias("peak_hour"), F.col("b.n").alias("accesses"))


def error_statistics(df: DataFrame, operation: str, kind: str, ts: str) -> DataFrame:
    """Per operation the total and last time (kind null), and the count of each kind, in one pass."""
    sets = df.groupingSets([[F.col(operation)], [F.col(operation), F.col(kind)]], operation, kind)
    return sets.agg(F.grouping(kind).alias("is_total"), F.count("*").alias("n"), F.max(ts).alias("last_error"))


def classify_failure(text: Column, context: Column | None = None) -> Column:
    """First fragment found names the class, then the context, then transient."""
    low = F.lower(text)
    chain = None
    for word, kind in P.FAILURE_WORDS:
        hit = F.contains(low, F.lit(word))
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    if context is not None:
        for word, kind in (("network", "network"), ("resource", "resource"), ("data", "data_quality")):
            chain = chain.when(F.contains(context, F.lit(word)), kind)
    return chain.otherwise("transient")


def behaviour_scores(df: DataFrame, user: str, ts: str, permission: str, duration: str, violation: Column, cutoff) -> DataFrame:
    """Events since ``cutoff`` scored against the user's earlier behaviour.

    .3 for an hour not seen before, .4 for a new permission, .2 above twice the
    mean duration, .5 for users with more than two violations since; 1 at most.
    A user's hours are at most 24; permissions are joined, not collected.
    """
    old, new = df.filter(F.col(ts) < cutoff), df.filter(F.col(ts) >= cutoff)
    usual = old.groupBy(user).agg(F.collect_set(F.hour(ts)).alias("_hours"), F.avg(duration).alias("_mean"))
    allowed = old.select(user, permission).distinct().withColumn("_known", F.lit(True))
    bad = new.groupBy(user).agg(F.count_if(violation).alias("_bad"))
    rows = join_by_key(join_by_key(join_by_key(new, usual, user, "left"), allowed, [user, permission], "left"), bad, user)
    score = (
        F.when(F.coalesce(F.array_contains("_hours", F.hour(ts)), F.lit(False)), 0.0).otherwise(0.3)
        + F.when(F.col("_known"), 0.0).otherwise(0.4)
        + F.when(F.col(duration) > F.col("_mean") * 2, 0.2).otherwise(0.0)
        + F.when(F.col("_bad") > 2, 0.5).otherwise(0.0))
    return rows.select(*df.columns, F.least(F.lit(1.0), score).alias("anomaly_score"))


def attempt_success_rate(df: DataFrame, key: str, order: list[str], attempt: str, success: Column, last: int = 20) -> DataFrame:
    """Success share per attempt number among the last outcomes: below 10 % stop, below 30 % escalate."""
    rows = last_points(df.select(key, *order, attempt, F.when(success, 1.0).otherwise(0.0).alias("_ok")), [key], order, last)
    out = rows.groupBy(key, attempt).agg(F.count("*").alias("n"), F.avg("_ok").alias("success_rate"))
    return out.filter("n >= 3").withColumn(
        "decision", F.when(F.col("success_rate") < 0.1, "stop").when(F.col("success_rate") < 0.3, "escalate").otherwise("retry"))
