"""Time windows: the same functions serve batch frames and streams.

A stream needs a watermark first (``late``); rows older than it are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.timeseries import threshold_alerts, window_averages
from ..plans.ranged import quantiles


def late(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp (a stream cannot watermark a zone-free one) with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, key: str, ts: str, value: str, width: str = "5 minutes") -> DataFrame:
    """Count, sum and mean per window."""
    out = df.groupBy(key, F.window(ts, width).alias("w")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total", "mean")


def sliding_sketch(df: DataFrame, key: str, ts: str, value: str, width: str = "15 minutes", slide: str = "1 minute",
                   points: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = 800) -> DataFrame:
    """Percentiles per sliding window from one sketch per slide; bounded state, fit for a stream.

    Each row goes into the sketch of its pane, one ``slide`` long. When the watermark has passed a pane, its
    sketch is merged into those of the windows it belongs to. ``k`` is the size of the KLL
    sketches: ranks are off by less than 0.5 % of the window at 800, and exact for small windows.
    Null values are counted in ``n`` alone.
    """
    panes = df.groupBy(key, F.window(ts, slide).alias("pane")).agg(
        F.count("*").alias("n"), F.count(value).alias("m"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))
    out = panes.groupBy(key, F.window("pane", width, slide).alias("w")).agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    found = [F.when(F.col("m") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(f"p{round(p * 100)}") for p in points]
    return out.select(key, F.col("w.start").alias("window_start"), "n", *found)


def sliding_exact(df: DataFrame, key: str, ts: str, value: str, width: int = 900, slide: int = 60,
                  points: dict[str, float] | None = None) -> DataFrame:
    """Exact percentiles per sliding window of a batch frame.

    Values are counted per slide first; only those counts are copied to the
    ``width / slide`` windows they fall into.
    """
    points = points or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (slide * 1_000_000))
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, slot.alias("_slot"), value).agg(F.count("*").alias("_n"))
    spread = counts.withColumn("_start", F.explode(F.sequence(F.col("_slot") - (width // slide - 1), F.col("_slot"))))
    out = quantiles(spread, [key, "_start"], value, points, weight="_n")
    return out.select(key, F.timestamp_micros(F.col("_start") * (slide * 1_000_000)).cast("timestamp_ntz").alias("window_start"), *points)


def sessions(df: DataFrame, user: str, ts: str, gap: int = 1800) -> DataFrame:
    """Sessions of a batch frame: start, end (last event plus gap), events, duration.

    Events of one user in the same gap-long slot always share a session, so rows
    are combined per slot before any ordering: a user is then at most one row
    per slot of the time range.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = gap * 1_000_000
    slots = df.groupBy(user, F.floor(micros / width).alias("_slot")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count("*").alias("_n"))
    w = W.partitionBy(user).orderBy("_slot")
    new = F.when(F.col("_first") - F.lag("_last").over(w) <= width, 0).otherwise(1)
    marked = slots.withColumn("_new", new).withColumn("_session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = marked.groupBy(user, "_session").agg(F.min("_first").alias("a"), F.max("_last").alias("b"), F.sum("_n").alias("events"))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select(
        user, at(F.col("a")).alias("session_start"), at(F.col("b") + width).alias("session_end"), "events",
        ((F.col("b") - F.col("a")) / 1e6).alias("duration_seconds"))


def session_windows(df: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """The same sessions with Spark's own session window, for streams."""
    out = df.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def session_summary(rows: DataFrame, user: str) -> DataFrame:
    """Sessions, users and durations over a set of sessions."""
    return rows.agg(
        F.count("*").alias("sessions"), F.count_distinct(user).alias("unique_users"),
        F.avg("duration_seconds").alias("avg_duration"), F.max("duration_seconds").alias("longest"))


def window_alerts(df: DataFrame, key: str, ts: str, value: str, rules: list[dict], width: str = "5 minutes") -> DataFrame:
    """Window means that break a rule."""
    return threshold_alerts(window_averages(df, key, ts, value, width), key, "avg_value", rules)
