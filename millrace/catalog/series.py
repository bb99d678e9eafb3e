"""Metric time series (TSA) and view-style monitors."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions import patterns as PT
from ..operators import timeseries as T
from .profiling import rounded
from .relational import runs
from .registry import query

NOW = dt.datetime(2024, 1, 31)
ORDER = ["ts", "event_id"]
ORD = "ORDER BY ts, event_id"


def ev(t):
    return t.events.select("event_id", "ts", "user_id", "event_type", "value")


def last(n, cols="event_type, ts, event_id, value", key="event_type"):
    """SQL for the last n points per key, rn = 1 newest."""
    return f"""(SELECT {cols}, row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, event_id DESC) AS rn FROM events
 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, event_id DESC) <= {n})"""


IDX = f"(SELECT *, row_number() OVER (PARTITION BY event_type {ORD}) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query("tsa01_history", """
SELECT event_id, ts, value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-30' ORDER BY ts DESC""")
def _(t):
    return T.history(ev(t), "event_type", "click", "ts", dt.datetime(2024, 1, 30), "event_id").select("event_id", "ts", "value")


@query("tsa02_slope_trend", f"""
SELECT event_type, round(s, 8) AS slope, CASE WHEN s > 0.1 THEN 'increasing' WHEN s < -0.1 THEN 'decreasing' ELSE 'stable' END AS direction
FROM (SELECT event_type, regr_slope(value, i) AS s FROM {IDX} GROUP BY event_type)""")
def _(t):
    return rounded(T.slope_trend(ev(t), "event_type", ORDER, "value"), "slope", digits=8)


@query("tsa03_corr_trend", f"""
SELECT event_type, CASE WHEN r > 0.3 THEN 'increasing' WHEN r < -0.3 THEN 'decreasing' ELSE 'stable' END AS direction, round(abs(r), 6) AS strength
FROM (SELECT event_type, corr(value, i) AS r FROM {IDX} GROUP BY event_type)""")
def _(t):
    return rounded(T.corr_trend(ev(t), "event_type", ORDER, "value"), "strength")


@query("tsa04_half_split_trend", f"""
SELECT event_type, round((b - a) / greatest(0.01, abs(a)), 6) AS trend FROM (SELECT event_type,
 avg(value) FILTER (i <= n // 2) AS a, avg(value) FILTER (i > n // 2) AS b FROM {IDX} GROUP BY event_type)""")
def _(t):
    return rounded(T.half_split_trend(ev(t), "event_type", ORDER, "value"), "trend")


@query("tsa05_volatility", "SELECT event_type, round(stddev_samp(value) / avg(value), 6) AS volatility FROM events GROUP BY event_type")
def _(t):
    return rounded(T.volatility(ev(t), "event_type", "value"), "volatility")


RULES = [
    {"rule": "high_click", "metric": "click", "operator": "gt", "threshold": 30, "severity": "critical"},
    {"rule": "low_view", "metric": "view", "operator": "lt", "threshold": 0.5},
    {"rule": "flat_error", "metric": "error", "operator": "eq", "threshold": 6.55},
]
_BREAK = """(event_type = 'click' AND {v} > 30) OR (event_type = 'view' AND {v} < 0.5) OR (event_type = 'error' AND abs({v} - 6.55) < {e})"""
_RULE = "CASE event_type WHEN 'click' THEN 'high_click' WHEN 'view' THEN 'low_view' ELSE 'flat_error' END"


@query("tsa06_threshold_alerts", f"SELECT event_id, {_RULE} AS rule, value FROM events WHERE {_BREAK.format(v='value', e=0.001)}")
def _(t):
    return T.threshold_alerts(ev(t), "event_type", "value", RULES).select("event_id", "rule", "value")


AVG_RULES = [
    {"rule": "busy", "metric": "click", "operator": "gt", "threshold": 20},
    {"rule": "idle", "metric": "view", "operator": "lt", "threshold": 2},
    {"rule": "off", "metric": "error", "operator": "ne", "threshold": 10},
]
WINDOWED = """(SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS w, avg(value) AS a, count(*) AS n FROM events GROUP BY 1, 2)"""


@query("tsa07_window_avg_alerts", f"""
SELECT event_type, w AS window_start, round(a + 1e-9, 6) AS avg_value, CASE event_type WHEN 'click' THEN 'busy' WHEN 'view' THEN 'idle' ELSE 'off' END AS rule
FROM {WINDOWED} WHERE (event_type = 'click' AND a > 20) OR (event_type = 'view' AND a < 2) OR (event_type = 'error' AND abs(a - 10) >= 0.001)""")
def _(t):
    out = T.window_avg_alerts(ev(t), "event_type", "ts", "value", AVG_RULES)
    return rounded(out, "avg_value", nudge=1e-9).select("event_type", "window_start", "avg_value", "rule")


@query("tsa08_duration_alerts", """
WITH r AS (SELECT * FROM (VALUES ('up','click','gt',0.1), ('deep','view','gt',60.0), ('low','error','lt',1000.0)) v(rule, metric, op, th)),
x AS (SELECT rule, event_type, ts, event_id, value, CASE op WHEN 'gt' THEN value > th ELSE value < th END AS bad FROM events JOIN r ON event_type = metric)
SELECT rule, event_type, arg_max(value, ts) AS latest,
 bool_and(bad) FILTER (epoch_us(ts) >= m - 3600000000) AS fires
FROM (SELECT *, epoch_us(max(ts) OVER (PARTITION BY rule)) AS m FROM x) GROUP BY rule, event_type""")
def _(t):
    rules = [{"rule": "up", "metric": "click", "operator": "gt", "threshold": 0.1},
             {"rule": "deep", "metric": "view", "operator": "gt", "threshold": 60.0},
             {"rule": "low", "metric": "error", "operator": "lt", "threshold": 1000.0}]
    return T.duration_alerts(ev(t), "event_type", "ts", "value", rules, 3600)


EPISODES = f"""
WITH x AS (SELECT *, value > 15 AS bad FROM events),
g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY event_type {ORD} ROWS UNBOUNDED PRECEDING) AS good FROM x),
h AS (SELECT *, CASE WHEN bad THEN good ELSE good - 1 END AS ep FROM g)
SELECT event_type, min(ts) FILTER (bad) AS opened_at, max(ts) FILTER (bad) AS last_triggered, count(*) FILTER (bad) AS trigger_count,
 min(ts) FILTER (NOT bad) AS resolved_at FROM h GROUP BY event_type, ep HAVING count(*) FILTER (bad) > 0"""


@query("tsa09_alert_episodes", EPISODES)
def _(t):
    return T.alert_episodes(ev(t), "event_type", ORDER, F.col("value") > 15)


@query("tsa10_zscore_last_incl", """
SELECT event_type, l AS latest, round(abs(l - m) / s, 6) AS z_score, abs(l - m) / s > 3 AS anomaly FROM (
 SELECT event_type, arg_max(value, ts) AS l, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events
 WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY event_type) WHERE n >= 10""")
def _(t):
    return rounded(T.zscore_last_incl(ev(t), "event_type", ORDER, "value", dt.datetime(2024, 1, 25)), "z_score")


@query("tsa11_zscore_last_excl", f"""
SELECT event_type, l AS latest, round(m, 6) AS mean, round(z, 6) AS z_score, z > 2 AS anomaly, CASE WHEN l > m THEN 'spike' ELSE 'drop' END AS anomaly_type,
 round(least(0.99, z / 5), 6) AS confidence FROM (SELECT *, abs(l - m) / s AS z FROM (
 SELECT event_type, max(value) FILTER (rn = 1) AS l, avg(value) FILTER (rn > 1) AS m, stddev_pop(value) FILTER (rn > 1) AS s FROM {last(100)} GROUP BY event_type))""")
def _(t):
    return rounded(T.zscore_last_excl(ev(t), "event_type", ORDER, "value"), "mean", "z_score", "confidence").drop("severity")


@query("tsa12_severity", """
SELECT event_id, CASE WHEN z > 4 THEN 'critical' WHEN z > 3 THEN 'error' WHEN z > 2 THEN 'warning' ELSE 'info' END AS severity FROM (
 SELECT event_id, abs(value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) AS z FROM events)""")
def _(t):
    e = ev(t)
    m = e.agg(F.struct(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).alias("v")).scalar()
    return e.select("event_id", T.severity(F.abs(F.col("value") - m["m"]) / m["s"]).alias("severity"))


@query("tsa13_trend_change", f"""
WITH x AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM {last(100)}), y AS (SELECT *, n - rn AS p FROM x),
z AS (SELECT event_type, avg(value) AS m, regr_slope(value, p) FILTER (p < n // 2) AS s1, regr_slope(value, p) FILTER (p >= n // 2) AS s2 FROM y GROUP BY event_type)
SELECT event_type, round(s1, 6) AS slope_1, round(s2, 6) AS slope_2, round(abs(s2 - s1) / m, 6) AS relative_change, abs(s2 - s1) / m > 0.1 AS changed,
 round(least(0.9, abs(s2 - s1) / m * 5), 6) AS confidence FROM z""")
def _(t):
    return rounded(T.trend_change(ev(t), "event_type", ORDER, "value"), "slope_1", "slope_2", "relative_change", "confidence")


from .relational import TOLERANCE  # noqa: E402


@query("tsa14_metric_correlation", f"""
SELECT count(*) AS pairs, CASE WHEN count(*) >= 10 THEN round(corr(a_value, b_value), 6) END AS correlation,
 coalesce(count(*) >= 10 AND abs(corr(a_value, b_value)) > 0.5, false) AS shown FROM {TOLERANCE}""")
def _(t):
    e = ev(t)
    out = T.metric_correlation(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "ts", "event_id", "value", 300)
    return rounded(out, "correlation")


@query("tsa15_slo_breach", """
WITH s AS (SELECT (1 - count(*) FILTER (event_type = 'error')::DOUBLE / count(*)) * 100 AS v FROM events WHERE ts >= TIMESTAMP '2024-01-24')
SELECT round(v, 6) AS sli, 99.5::DOUBLE AS target, v < 99.5 AS breach, round(99.5 - v, 6) AS error_budget FROM s""")
def _(t):
    s = T.sli(ev(t), "ts", dt.datetime(2024, 1, 24), F.col("event_type") == "error")
    return rounded(T.slo_breach(s, 99.5), "sli", "error_budget")


@query("tsa16_baseline", """
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
 round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY event_type HAVING count(*) >= 100""")
def _(t):
    return rounded(T.baseline(ev(t), "event_type", "value"), "mean", "std", "median", "p95", "p99")


@query("tsa16_baseline_null_series", """
SELECT nullif(event_type, 'view') AS event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median
FROM events GROUP BY 1 HAVING count(*) >= 100""")
def _(t):
    out = T.baseline(ev(t).withColumn("event_type", F.nullif("event_type", F.lit("view"))), "event_type", "value")
    return rounded(out, "mean", "median").select("event_type", "n", "mean", "median")


@query("tsa17_health_score", """
WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 35) AS c, count(*) FILTER (event_type = 'error') AS e,
 count(*) FILTER (value > 45) AS b FROM events GROUP BY user_id),
s AS (SELECT user_id, greatest(0, least(100, 100 - c * 20 - CASE WHEN e > 10 THEN least(30, e * 2) ELSE 0 END - b * 15)) AS s FROM u)
SELECT user_id, s AS score, CASE WHEN s >= 95 THEN 'excellent' WHEN s >= 80 THEN 'good' WHEN s >= 60 THEN 'degraded' ELSE 'critical' END AS status FROM s""")
def _(t):
    e = F.col("event_type") == "error"
    u = ev(t).groupBy("user_id").agg(F.count_if(e & (F.col("value") > 35)).alias("c"), F.count_if(e).alias("e"),
                                     F.count_if(F.col("value") > 45).alias("b"))
    s = u.withColumn("score", T.health_score(F.col("c"), F.col("e"), F.col("b")))
    return s.select("user_id", "score", T.health_status(F.col("score")).alias("status"))


@query("tsa18_sla_per_execution", """
SELECT o_custkey, count(*) AS total, count(*) FILTER (o_totalprice <= 400000) AS compliant_runs,
 round(100.0 * count(*) FILTER (o_totalprice <= 400000) / count(*), 6)::DOUBLE AS actual_pct,
 100.0 * count(*) FILTER (o_totalprice <= 400000) / count(*) >= 95 AS compliant FROM orders GROUP BY o_custkey""")
def _(t):
    return rounded(T.sla_per_execution(runs(t), "completion_time", "o_custkey", "duration", 400000.0), "actual_pct")


@query("tsa19_sla_average", """
SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS period_start, count(*) AS points, round(avg(value) + 1e-9, 6) AS actual, avg(value) >= 12 AS compliant
FROM events GROUP BY 1, 2""")
def _(t):
    return rounded(T.sla_average(ev(t), "availability", "event_type", "ts", "value", 12.0, "1 day"), "actual", nudge=1e-9)


EMA_SQL = f"""(SELECT user_id, event_id, ts, value, event_type, row_number() OVER w AS c,
 list_reduce(list(value) OVER w, lambda a, x: 0.9 * a + 0.1 * x) AS m,
 list_reduce(list(CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END) OVER w, lambda a, x: 0.9 * a + 0.1 * x) AS s
 FROM events WINDOW w AS (PARTITION BY user_id {ORD} ROWS UNBOUNDED PRECEDING))"""


@query("tsa20_ema_baseline", f"""
SELECT event_id, round(m + 1e-9, 6) AS avg_duration, round(s + 1e-9, 6) AS success_rate, c AS sample_count, c > 1 AND value > m * 1.5 AS degraded FROM {EMA_SQL}""")
def _(t):
    out = T.ema_baseline(ev(t), "user_id", ORDER, "value", F.col("event_type") != "error")
    return rounded(out, "avg_duration", "success_rate", nudge=1e-9).select("event_id", "avg_duration", "success_rate", "sample_count", "degraded")


@query("tsa20_ema_null_values", f"""
SELECT event_id, round(m + 1e-9, 6) AS avg_duration, c AS sample_count FROM {EMA_SQL.replace("FROM events", "FROM (SELECT * FROM events WHERE event_id % 5 <> 0) events")}""")
def _(t):
    """Every fifth value is null; those points are left out."""
    df = ev(t).withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    out = T.ema_baseline(df, "user_id", ORDER, "value", F.col("event_type") != "error")
    return rounded(out, "avg_duration", nudge=1e-9).select("event_id", "avg_duration", "sample_count")


@query("tsa21_ema_anomaly", f"""
WITH a AS (SELECT *, CASE WHEN c = 1 THEN 0.0 ELSE 0.1 * ((value - m) / 0.9) * ((value - m) / 0.9) END AS d FROM {EMA_SQL}),
v AS (SELECT *, list_reduce(list(d) OVER (PARTITION BY user_id {ORD} ROWS UNBOUNDED PRECEDING), lambda x, y: 0.9 * x + y) AS var FROM a),
z AS (SELECT *, CASE WHEN c >= 10 AND var > 0 THEN abs(value - m) / sqrt(var) END AS z FROM v)
SELECT event_id, round(m + 1e-9, 6) AS mean, round(var + 1e-9, 6) AS variance, round(z + 1e-9, 6) AS z_score, CASE WHEN z > 4 THEN 'high' WHEN z > 3 THEN 'medium' END AS severity FROM z""")
def _(t):
    out = T.ema_anomaly(ev(t), "user_id", ORDER, "value")
    return rounded(out, "mean", "variance", "z_score", nudge=1e-9).select("event_id", "mean", "variance", "z_score", "severity")


MODEL = f"""(SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median,
 max(value) FILTER (j = n // 4) AS p25, max(value) FILTER (j = 3 * n // 4) AS p75 FROM (
 SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS j, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type HAVING count(*) >= 30)"""


@query("tsa22_series_model", f"""
SELECT event_type, n, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(median, 6) AS median, p25, p75, round(p75 - p25, 6) AS iqr FROM {MODEL}""")
def _(t):
    return rounded(T.series_model(ev(t), "event_type", "value"), "mean", "std", "median", "iqr")


def _line(n):
    return f"""(SELECT event_type, count(*) AS n, regr_slope(value, epoch_us(ts) / 1e6 - 1.7e9) AS slope, var_pop(value) * count(*) AS sst,
 max(value) FILTER (rn = 1) AS latest, max(value) FILTER (rn = 2) AS before, max(epoch_us(ts)) FILTER (rn = 1) - max(epoch_us(ts)) FILTER (rn = 2) AS gap
 FROM {last(n)} GROUP BY event_type)"""


@query("tsa23_trend_model", f"""
SELECT event_type, n, round(slope, 10) AS slope, round(CASE WHEN sst > 0 THEN least(1.0, abs(slope) * n / sqrt(sst)) ELSE 0 END, 8) AS strength,
 CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM {_line(50)} WHERE n >= 10""")
def _(t):
    out = T.trend_model(ev(t), "event_type", ORDER, "value")
    return rounded(rounded(out, "slope", digits=10), "strength", digits=8)


def season(v):
    return f"""(SELECT h.event_type, hour, hm, strength FROM (SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS c, avg({v}) AS hm FROM events GROUP BY 1, 2) h
 JOIN (SELECT event_type, least(1.0, stddev_samp(hm) / greatest(0.01, abs(avg(hm)))) AS strength FROM
  (SELECT event_type, hour(ts) AS hour, count(*) AS c, avg({v}) AS hm FROM events GROUP BY 1, 2) WHERE c > 2 GROUP BY event_type
  HAVING count(*) > 12 AND sum(c) >= 100) s USING (event_type) WHERE c > 2)"""


SEASON = season("value")


@query("tsa24_seasonal_model", f"SELECT event_type, hour, round(hm + 1e-9, 6) AS hour_mean, round(strength, 6) AS strength FROM {SEASON}")
def _(t):
    return rounded(rounded(T.seasonal_model(ev(t), "event_type", "ts", "value"), "strength"), "hour_mean", nudge=1e-9)


_LATEST = "(SELECT event_type, arg_max(value, ts) AS l, max(ts) AS lts FROM events GROUP BY event_type)"


@query("tsa25_detect_zscore", f"""
SELECT event_type, l AS latest, round(z, 6) AS z_score, z > 2.2 AS anomaly, round(least(1.0, (z - 2.2) / 2.2), 6) AS confidence, round(least(1.0, z / 4), 6) AS severity
FROM (SELECT event_type, l, abs(l - mean) / std AS z FROM {_LATEST} JOIN {MODEL} USING (event_type))""")
def _(t):
    return rounded(T.detect_zscore(ev(t), "event_type", ORDER, "value"), "z_score", "confidence", "severity")


# Points packed a thousand times denser, climbing with time: the trend is then strong.
_BASE = 1_704_067_200_000_000
CLIMB = f"""(SELECT event_id, event_type, {_BASE} + (epoch_us(ts) - {_BASE}) // 1000 AS tm, (epoch_us(ts) - {_BASE}) / 1e9 + value / 100 AS climb FROM events)"""


@query("tsa26_detect_trend", f"""
WITH p AS (SELECT event_type, climb, tm, row_number() OVER (PARTITION BY event_type ORDER BY tm DESC, event_id DESC) AS rn FROM {CLIMB}),
m AS (SELECT event_type, regr_slope(climb, (tm - {_BASE}) / 1e6) AS s, var_pop(climb) * count(*) AS sst, count(*) AS n,
 max(climb) FILTER (rn = 1) AS l, max(climb) FILTER (rn = 2) AS b, max(tm) FILTER (rn = 1) - max(tm) FILTER (rn = 2) AS gap FROM p WHERE rn <= 50 GROUP BY event_type),
e AS (SELECT *, b + s * gap / 1e6 AS x FROM m)
SELECT event_type, round(l, 4) AS latest, round(x, 4) AS expected, round(abs(l - x) / greatest(0.01, abs(x)), 5) AS deviation, abs(l - x) / greatest(0.01, abs(x)) > 0.00001 AS anomaly FROM e
WHERE least(1.0, abs(s) * n / sqrt(sst)) >= 0.3""")
def _(t):
    past = T.micros("ts") - F.lit(_BASE)
    e = t.events.select("event_id", "event_type", F.timestamp_micros(F.lit(_BASE) + F.floor(past / 1000)).alias("ts"),
                        (past / 1e9 + F.col("value") / 100).alias("climb"))
    out = T.detect_trend(e, "event_type", ORDER, "climb", 0.00001)
    return rounded(rounded(out, "latest", "expected", digits=4), "deviation", digits=5)


# A value that follows the hour of day, so that the pattern is strong.
_DAILY = "value * (1 + hour(ts))"


@query("tsa27_detect_seasonal", f"""
WITH x AS (SELECT event_type, CAST(hour(max(ts)) AS INTEGER) AS hour, arg_max({_DAILY}, ts) AS l FROM events GROUP BY event_type)
SELECT event_type, hour, round(l, 6) AS latest, round(hm, 6) AS hour_mean, round(abs(l - hm) / greatest(0.01, abs(hm)), 6) AS deviation,
 abs(l - hm) / greatest(0.01, abs(hm)) > 1.2 AS anomaly FROM x JOIN {season(_DAILY)} USING (event_type, hour) WHERE strength >= 0.2""")
def _(t):
    e = ev(t).withColumn("value", F.col("value") * (1 + F.hour("ts")))
    return rounded(T.detect_seasonal(e, "event_type", ORDER, "value"), "latest", "hour_mean", "deviation")


@query("tsa28_detect_recent", f"""
SELECT event_type, l AS latest, round(abs(l - m) / s, 6) AS deviation, abs(l - m) / s > 2.0 AS anomaly FROM (
 SELECT event_type, avg(value) AS m, stddev_samp(value) AS s, max(value) FILTER (rn = 1) AS l, count(*) AS n FROM {last(20)} GROUP BY event_type) WHERE n >= 10""")
def _(t):
    return rounded(T.detect_recent(ev(t), "event_type", ORDER, "value"), "deviation")


@query("tsa29_forecast_linear", f"""
WITH f AS (SELECT event_type, CAST(step AS INTEGER) AS step, latest + slope * step * 720 AS p, mean, std FROM {_line(20)} JOIN (SELECT event_type, mean, std FROM {MODEL}) USING (event_type),
 unnest([1, 2, 3, 4, 5]) u(step))
SELECT event_type, step, round(p, 5) AS predicted, round(abs(p - mean) / greatest(0.01, std), 5) AS deviation, abs(p - mean) / greatest(0.01, std) > 1.6 AS anomalous FROM f""")
def _(t):
    return rounded(T.forecast_linear(ev(t), "event_type", ORDER, "value"), "predicted", "deviation", digits=5)


def _ten(n, value="value"):
    return f"""(SELECT event_type, count(*) AS n, avg({value}) AS m, stddev_samp({value}) AS sd, stddev_pop({value}) AS sp, regr_slope({value}, -rn) AS s,
 max({value}) FILTER (rn = 1) AS l FROM {last(n)} GROUP BY event_type)"""


@query("tsa30_forecast_blend", f"""
WITH t AS (SELECT epoch(TIMESTAMP '2024-01-31 15:30:00') AS e)
SELECT event_type, round(greatest(0, least(1.0, (0.5 + 0.3 * sin((e % 86400) / 86400 * 2 * pi() - pi() / 3)) * 0.2
 + CASE WHEN floor(e / 86400)::BIGINT % 7 < 1 OR floor(e / 86400)::BIGINT % 7 >= 6 THEN 0.7 ELSE 1.0 END * 0.1
 + (m + s * (n + 6.0 - (n - 1) / 2.0)) * 0.3 + l * 0.25 + least(0.3, 120 / 1000.0) * 0.15)), 6) AS prediction FROM {_ten(10, 'value / 100')}, t""")
def _(t):
    e = ev(t).withColumn("value", F.col("value") / 100)
    out = T.forecast_blend(e, "event_type", ORDER, "value", F.lit(dt.datetime(2024, 1, 31, 15, 30)), 30, F.lit(120.0))
    return rounded(out, "prediction")


@query("tsa31_forecast_step", f"""
SELECT event_type, round(greatest(0, l + s * 2), 6) AS predicted, round(s * 2, 6) AS trend,
 round(least(0.95, (greatest(0.1, 1 - sd / m) + 0.5 + least(1.0, abs(s * 2) * 10) * 0.4) / 2), 6) AS confidence FROM {_ten(10)} WHERE n >= 10""")
def _(t):
    return rounded(T.forecast_step(ev(t), "event_type", ORDER, "value", 600.0), "predicted", "trend", "confidence")


@query("tsa32_seasonal_step_up", """
WITH h AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT a.event_type, a.hour, round(a.m + 1e-9, 6) AS hour_mean, round(b.m + 1e-9, 6) AS next_mean, b.m > a.m * 1.3 AS step_up, round(b.m * 0.8 + 1e-9, 6) AS target
FROM h a JOIN h b ON a.event_type = b.event_type AND b.hour = (a.hour + 1) % 24""")
def _(t):
    return rounded(T.seasonal_step_up(ev(t), "event_type", "ts", "value"), "hour_mean", "next_mean", "target", nudge=1e-9)


@query("tsa33_autocorrelation", """
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1, 2),
d AS (SELECT *, v - avg(v) OVER (PARTITION BY event_type) AS d, count(*) OVER (PARTITION BY event_type) AS n FROM h),
l AS (SELECT *, lead(d, 24) OVER (PARTITION BY event_type ORDER BY hour) AS a FROM d)
SELECT event_type, 24 AS lag, round(sum(d * a) / sum(d * d), 6) AS acf, sum(d * a) / sum(d * d) > 0.3 AS seasonal FROM l GROUP BY event_type HAVING max(n) > 24""")
def _(t):
    return rounded(T.autocorrelation(ev(t), "event_type", "ts", "value", 24), "acf")


FALLBACK = f"(SELECT event_type, CAST(step AS INTEGER) AS step, m * (1 + 0.05 * step) AS p FROM {_ten(10)}, unnest([0, 1, 2, 3, 4]) u(step))"


@query("tsa34_forecast_interval", f"""
WITH f AS (SELECT *, stddev_pop(p) OVER (PARTITION BY event_type) + 0.1 AS k FROM {FALLBACK})
SELECT event_type, step, round(p, 6) AS predicted, round(greatest(0.01, p - p * k), 6) AS lower, round(p + p * k, 6) AS upper FROM f""")
def _(t):
    f = T.forecast_fallback(ev(t), "event_type", ORDER, "value").select("event_type", "step", "predicted")
    return rounded(T.forecast_interval(f, "event_type", "predicted"), "predicted", "lower", "upper")


@query("tsa35_forecast_anomaly", f"""
SELECT event_type, round(CASE WHEN sp = 0 THEN 0 ELSE least(1.0, abs(f - m) / sp / 3) END, 6) AS anomaly_score FROM {_ten(20)}
JOIN (SELECT event_type, avg(p) AS f FROM {FALLBACK} GROUP BY event_type) USING (event_type)""")
def _(t):
    e = ev(t)
    f = T.forecast_fallback(e, "event_type", ORDER, "value")
    return rounded(T.forecast_anomaly(e, "event_type", ORDER, "value", f, "predicted"), "anomaly_score")


@query("tsa36_forecast_fallback", f"""
SELECT event_type, step, round(p, 6) AS predicted, round(p * 0.9, 6) AS lower, round(p * 1.1, 6) AS upper FROM {FALLBACK}""")
def _(t):
    return rounded(T.forecast_fallback(ev(t), "event_type", ORDER, "value"), "predicted", "lower", "upper")


_PH = ["l_quantity", "price", "discount", "tax"]


@query("tsa37_phase_bottlenecks", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / 2000 AS price, l_discount * 400 AS discount, l_tax * 400 AS tax FROM lineitem),
s AS (SELECT *, l_quantity + price + discount + tax AS total FROM x),
u AS (SELECT l_orderkey, l_linenumber, total, 'l_quantity' AS phase, l_quantity AS spent FROM s UNION ALL SELECT l_orderkey, l_linenumber, total, 'price', price FROM s
 UNION ALL SELECT l_orderkey, l_linenumber, total, 'discount', discount FROM s UNION ALL SELECT l_orderkey, l_linenumber, total, 'tax', tax FROM s)
SELECT l_orderkey, l_linenumber, phase, round(spent, 6) AS spent, round(spent / total * 100, 4) AS pct_of_total FROM u WHERE spent > total / 4 * 1.5""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 2000).alias("price"),
                           (F.col("l_discount") * 400).alias("discount"), (F.col("l_tax") * 400).alias("tax"))
    out = T.phase_bottlenecks(df, ["l_orderkey", "l_linenumber"], _PH).drop("severity")
    return rounded(rounded(out, "spent"), "pct_of_total", digits=4)


@query("tsa37_resource_bottlenecks", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS cpu, l_discount * 1000 AS memory, l_tax * 1000 AS io, 1 - l_tax * 10 AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, 'cpu' AS resource, round(cpu, 6) AS value, CASE WHEN cpu > 90 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE cpu > 80
UNION ALL SELECT l_orderkey, l_linenumber, 'memory', round(memory, 6), CASE WHEN memory > 95 THEN 'high' ELSE 'medium' END FROM x WHERE memory > 85
UNION ALL SELECT l_orderkey, l_linenumber, 'io', round(io, 6), 'medium' FROM x WHERE io > 75
UNION ALL SELECT l_orderkey, l_linenumber, 'quality', round(q, 6), CASE WHEN q < 0.6 THEN 'high' ELSE 'medium' END FROM x WHERE q < 0.8""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("cpu"), (F.col("l_discount") * 1000).alias("memory"),
                           (F.col("l_tax") * 1000).alias("io"), (1 - F.col("l_tax") * 10).alias("q"))
    out = T.resource_bottlenecks(df, ["l_orderkey", "l_linenumber"], {"cpu": "cpu", "memory": "memory", "io": "io"}, "q")
    return rounded(out, "value")


@query("tsa38_history_patterns", """
SELECT 'time' AS measure, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, count(*) AS n, round(median(o_totalprice), 4) AS median FROM orders
UNION ALL SELECT 'quality', round(avg(q), 4), round(stddev_samp(q), 4), count(*), round(median(q), 4) FROM (SELECT CAST(o_orderkey % 100 AS DOUBLE) AS q FROM orders)""")
def _(t):
    df = runs(t).withColumn("quality", F.col("o_orderkey") % 100)
    return rounded(T.history_patterns(df, "duration", "quality"), "mean", "std", "median", digits=4)


@query("tsa39_retain", "SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND event_type <> 'error')")
def _(t):
    return T.retain(ev(t), "ts", F.lit(NOW), 7, F.col("event_type") != "error").select("event_id")


@query("tsa40_dashboard", """
WITH s AS (SELECT (1 - count(*) FILTER (event_type = 'error')::DOUBLE / count(*)) * 100 AS v FROM events)
SELECT event_type, arg_max(value, ts) AS current_value, arg_max(value > 30, ts) AS alert_active,
 count(*) FILTER (value > 30 AND ts >= TIMESTAMP '2024-01-30') AS recent_alerts, count(*) AS points, round(max(v), 6) AS sli, max(v) < 99 AS slo_breach
FROM events, s GROUP BY event_type""")
def _(t):
    out = T.dashboard(ev(t), "event_type", ORDER, "value", F.lit(NOW), F.col("value") > 30, F.col("event_type") == "error", 99.0)
    return rounded(out, "sli")


@query("tsa41_weighted_average", f"""
SELECT event_type, round(sum(value * w) / sum(w), 6) AS weighted_avg FROM (SELECT *, [0.4, 0.3, 0.2, 0.1][least(rn, 4)]::DOUBLE AS w FROM {last(10)}) GROUP BY event_type""")
def _(t):
    return rounded(T.weighted_average(ev(t), "event_type", ORDER, "value"), "weighted_avg")


@query("tsa42_ma_crossover", f"""
SELECT event_type, round(a, 6) AS short_ma, round(b, 6) AS long_ma, round(l * CASE WHEN a > b * 1.05 THEN 1.02 WHEN a < b * 0.95 THEN 0.98 ELSE 1 END, 6) AS predicted FROM (
 SELECT event_type, avg(value) FILTER (rn <= 5) AS a, avg(value) FILTER (rn <= 10) AS b, max(value) FILTER (rn = 1) AS l, count(*) AS n FROM {last(20)} GROUP BY event_type) WHERE n >= 20""")
def _(t):
    return rounded(T.ma_crossover(ev(t), "event_type", ORDER, "value"), "short_ma", "long_ma", "predicted")


@query("tsa43_short_trend", f"""
SELECT event_type, CASE WHEN (a - c) / 3 > 0.001 THEN 'rising' WHEN (a - c) / 3 < -0.001 THEN 'falling' ELSE 'stable' END AS trend, round(s / m, 6) AS volatility FROM (
 SELECT event_type, max(value) FILTER (rn = 1) AS a, max(value) FILTER (rn = 3) AS c, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM {last(20)} GROUP BY event_type) WHERE n >= 10""")
def _(t):
    return rounded(T.short_trend(ev(t), "event_type", ORDER, "value"), "volatility")


@query("tsa44_operation_stats", """
SELECT event_type, count(*) AS count, round(avg(value), 6) AS avg_time, min(value) AS min_time, max(value) AS max_time, round(sum(value), 4) AS total_time,
 max(value) FILTER (j = floor(n * 0.5)) AS p50, max(value) FILTER (j = floor(n * 0.9 + 1e-9)) AS p90, max(value) FILTER (j = floor(n * 0.95 + 1e-9)) AS p95
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS j, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def _(t):
    out = T.operation_stats(ev(t), "event_type", "value")
    return rounded(rounded(out, "avg_time"), "total_time", digits=4)


@query("tsa45_slow_operations", """
SELECT user_id, count(*) AS n, round(avg(value), 6) AS avg_value, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6)::DOUBLE AS error_rate FROM
 (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) GROUP BY user_id HAVING count(*) >= 3 AND (avg(value) > 20 OR avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.1)""")
def _(t):
    out = T.slow_operations(ev(t), "user_id", ORDER, "value", F.col("event_type") == "error", slow=20.0)
    return rounded(out, "avg_value", "error_rate")


@query("tsa46_peak_hour", f"""
SELECT user_id, hour AS peak_hour, n AS accesses FROM (SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM {last(100, 'user_id, ts', 'user_id')} GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) = 1""")
def _(t):
    return T.peak_hour(ev(t), "user_id", ORDER)


@query("tsa47_error_statistics", """
SELECT user_id, NULL AS event_type, 1::TINYINT AS is_total, count(*) AS n, max(ts) AS last_error FROM events GROUP BY user_id
UNION ALL SELECT user_id, event_type, 0, count(*), max(ts) FROM events GROUP BY user_id, event_type""")
def _(t):
    return T.error_statistics(ev(t), "user_id", "event_type", "ts")


@query("tsa48_classify_failure", "SELECT doc_id, CASE " + " ".join(
    f"WHEN contains(lower(text), '{w}') THEN '{k}'" for w, k in PT.FAILURE_WORDS) + " ELSE 'transient' END AS failure FROM documents")
def _(t):
    return t.documents.select("doc_id", T.classify_failure(F.col("text")).alias("failure"))


@query("tsa49_behaviour_score", """
WITH o AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20'), w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20'),
h AS (SELECT DISTINCT user_id, hour(ts) AS hour FROM o), p AS (SELECT DISTINCT user_id, event_type FROM o), m AS (SELECT user_id, avg(value) AS m FROM o GROUP BY user_id),
b AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS b FROM w GROUP BY user_id)
SELECT event_id, round(least(1.0, CASE WHEN h.hour IS NULL THEN 0.3 ELSE 0 END + CASE WHEN p.user_id IS NULL THEN 0.4 ELSE 0 END
 + CASE WHEN value > m * 2 THEN 0.2 ELSE 0 END + CASE WHEN b > 2 THEN 0.5 ELSE 0 END), 4)::DOUBLE AS anomaly_score
FROM w LEFT JOIN h ON w.user_id = h.user_id AND hour(w.ts) = h.hour LEFT JOIN p ON w.user_id = p.user_id AND w.event_type = p.event_type
LEFT JOIN m ON w.user_id = m.user_id JOIN b ON w.user_id = b.user_id""")
def _(t):
    out = T.behaviour_scores(ev(t), "user_id", "ts", "event_type", "value", F.col("event_type") == "error", dt.datetime(2024, 1, 20))
    return out.select("event_id", F.round("anomaly_score", 4).alias("anomaly_score"))


@query("tsa50_attempt_success_rate", f"""
SELECT user_id, attempt, n, round(s, 6)::DOUBLE AS success_rate, CASE WHEN s < 0.1 THEN 'stop' WHEN s < 0.3 THEN 'escalate' ELSE 'retry' END AS decision FROM (
 SELECT user_id, event_id % 3 AS attempt, count(*) AS n, avg(CASE WHEN value > 15 THEN 1.0 ELSE 0.0 END) AS s FROM {last(20, 'user_id, event_id, value', 'user_id')} GROUP BY 1, 2) WHERE n >= 3""")
def _(t):
    e = ev(t).withColumn("attempt", F.col("event_id") % 3)
    return rounded(T.attempt_success_rate(e, "user_id", ORDER, "attempt", F.col("value") > 15), "success_rate")
