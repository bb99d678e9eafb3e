"""Streaming (STR): each query drains the events as a stream; windows also as batch."""

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.keyed import KeyedTable
from ..streaming import flow, stateful, windows
from .profiling import rounded
from .registry import query
from .series import AVG_RULES, EMA_SQL, EPISODES, ORD, WINDOWED


def stream(t):
    return flow.file_stream(t.spark, t.folder, t.events.schema, "events.parquet")


def shuffled(t):
    """The events in files of random rows, several files to a batch, and at last one row
    (event -1, no user, no type) past the end, which lets out what still waits."""
    folder = scratch_path(t.spark, "shuffled")
    t.events.repartition(6).write.parquet(folder)
    end = t.events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
    last = end.select(*[F.col("ts") if f.name == "ts" else F.lit(-1 if f.name == "event_id" else None).cast(f.dataType).alias(f.name) for f in t.events.schema])
    last.coalesce(1).write.mode("append").parquet(folder)
    return flow.file_stream(t.spark, folder, t.events.schema, max_files=2)


#: Random order spreads a batch over the whole table; rows may be this late.
SPAN = "200 days"


@query("str01_envelope", "SELECT event_id, 'clicks' AS source, true AS named FROM events")
def _(t):
    out = flow.drain(flow.envelope(stream(t).select("event_id", "value"), "clicks"))
    return out.select(F.get_json_object("data", "$.event_id").cast("long").alias("event_id"), "source",
                      F.col("message_id").startswith("clicks_").alias("named"))


@query("str02_micro_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    folder = scratch_path(t.spark, "split")
    t.events.repartition(6, "event_id").write.parquet(folder)
    out = scratch_path(t.spark, "batches")
    q = flow.each_batch(flow.file_stream(t.spark, folder, t.events.schema, max_files=2), flow.to_files(out), scratch_path(t.spark, "c"))
    q.awaitTermination()
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("str03_route", "SELECT event_type AS source, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def _(t):
    out = {s: scratch_path(t.spark, s) for s in ("click", "view")}
    router = flow.route({s: flow.to_files(p) for s, p in out.items()}, "event_type")
    flow.each_batch(stream(t), router, scratch_path(t.spark, "c")).awaitTermination()
    rows = [t.spark.read.parquet(p).select(F.lit(s).alias("source")) for s, p in out.items()]
    return rows[0].unionByName(rows[1]).groupBy("source").agg(F.count("*").alias("n"))


@query("str04_backpressure", "SELECT count(*) AS processed, 0::BIGINT AS dropped, 0::BIGINT AS errors FROM events")
def _(t):
    counter = flow.Counter(t.spark)
    q = flow.write(stream(t), scratch_path(t.spark, "out"), scratch_path(t.spark, "c"))
    q.awaitTermination()
    m = counter.of(q)
    counter.stop()
    return t.spark.createDataFrame([(m["processed"], m["dropped"], m["errors"])], "processed long, dropped long, errors long")


@query("str05_drain", "SELECT event_id, value FROM events")
def _(t):
    return flow.drain(stream(t).select("event_id", "value"))


@query("str06_stream_metrics", """
SELECT unnest(['batches', 'processed', 'dropped', 'errors']) AS metric, unnest([6, count(*), 0, 0])::BIGINT AS value FROM events""")
def _(t):
    """Six batches, more than the two reports that the session keeps meanwhile."""
    key = "spark.sql.streaming.numRecentProgressUpdates"
    before = t.spark.conf.get(key)
    t.spark.conf.set(key, "2")
    counter = flow.Counter(t.spark)
    try:
        folder = scratch_path(t.spark, "split")
        t.events.repartition(6).write.parquet(folder)
        q = flow.write(flow.file_stream(t.spark, folder, t.events.schema, max_files=1), scratch_path(t.spark, "out"), scratch_path(t.spark, "c"))
        q.awaitTermination()
        m = counter.of(q)
    finally:
        counter.stop()
        t.spark.conf.set(key, before)
    return t.spark.createDataFrame([(k, int(v)) for k, v in m.items()], "metric string, value long")


# Accepted requests of a user in order: each is looked up from the state that the one before left,
# the times of the last two accepted ones (at most two lie in a window).
RATE_SQL = f"""
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id {ORD}) AS k FROM events),
s AS (SELECT user_id, event_id, k, true AS accepted, us AS newer, CAST(NULL AS BIGINT) AS older FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.event_id, o.k, o.us - coalesce(s.older, -9000000000000000) >= 7200000000 AS ok,
  CASE WHEN o.us - coalesce(s.older, -9000000000000000) >= 7200000000 THEN o.us ELSE s.newer END,
  CASE WHEN o.us - coalesce(s.older, -9000000000000000) >= 7200000000 THEN s.newer ELSE s.older END
 FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id, event_id, accepted FROM s"""


@query("str07_rate_limit", RATE_SQL)
def _(t):
    return flow.drain(stateful.rate_limit(shuffled(t), "user_id", "ts", "event_id", 2, 7200, SPAN))


@query("str08_stream_alerts", f"""
WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events)
SELECT event_type, w.w AS window_start, round(a + 1e-9, 6) AS avg_value, CASE event_type WHEN 'click' THEN 'busy' WHEN 'view' THEN 'idle' ELSE 'off' END AS rule
FROM {WINDOWED} w, m WHERE ((event_type = 'click' AND a > 20) OR (event_type = 'view' AND a < 2) OR (event_type = 'error' AND abs(a - 10) >= 0.001)) AND w.w + INTERVAL 5 MINUTE <= m.w""")
def _(t):
    out = flow.drain(windows.window_alerts(windows.late(stream(t)), "event_type", "ts", "value", AVG_RULES))
    return rounded(out, "avg_value", nudge=1e-9).select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "avg_value", "rule")


@query("str09_stream_ema", f"""
WITH a AS (SELECT *, CASE WHEN c = 1 THEN 0.0 ELSE 0.1 * ((value - m) / 0.9) * ((value - m) / 0.9) END AS d FROM {EMA_SQL}),
v AS (SELECT *, list_reduce(list(d) OVER (PARTITION BY user_id {ORD} ROWS UNBOUNDED PRECEDING), lambda x, y: 0.9 * x + y) AS var FROM a)
SELECT event_id, round(m + 1e-9, 6) AS mean, round(var + 1e-9, 6) AS variance, c AS count, c > 1 AND value > m * 1.5 AS degraded FROM v""")
def _(t):
    out = flow.drain(stateful.ema(shuffled(t), "user_id", "ts", "event_id", "value", delay=SPAN))
    return rounded(out, "mean", "variance", nudge=1e-9).select("event_id", "mean", "variance", "count", "degraded")


@query("str10_stream_episodes", f"SELECT * FROM ({EPISODES}) WHERE resolved_at IS NOT NULL")
def _(t):
    out = flow.drain(stateful.episodes(shuffled(t), "event_type", "ts", "event_id", "value", 15, delay=SPAN))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select("event_type", at(F.col("opened_us")).alias("opened_at"), at(F.col("last_us")).alias("last_triggered"),
                      "trigger_count", at(F.col("resolved_us")).alias("resolved_at"))


@query("str11_file_sink", "SELECT event_id, event_type FROM events WHERE value > 10")
def _(t):
    return flow.drain(stream(t).filter("value > 10").select("event_id", "event_type"))


@query("str11_keyed_sink", """
SELECT user_id, event_id, event_type, value FROM events WHERE user_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    """The last event of each user, kept up to date by micro-batches that come in any order."""
    rows = shuffled(t).filter("user_id IS NOT NULL").select("user_id", "event_id", "event_type", "value", "ts")
    table = KeyedTable.create(t.spark, scratch_path(t.spark, "last-events"), rows.schema, ["user_id"], 16)

    def newest(batch, batch_id):
        # Batches are not in time order: the row in force takes part.
        both = batch.unionByName(table.read().join(batch.select("user_id").distinct(), "user_id", "left_semi"))
        flow.upsert_into(table, ["user_id"], ["ts", "event_id"])(both, batch_id)

    flow.each_batch(rows, newest, scratch_path(t.spark, "last-events-checkpoint")).awaitTermination()
    return table.read().drop("ts")


@query("str13_buffered_map", "SELECT event_id, round(value * 2, 2) AS doubled FROM events")
def _(t):
    def twice(batches):
        for pdf in batches:
            yield pdf[["event_id"]].assign(doubled=(pdf["value"] * 2).round(2))

    return flow.drain(flow.buffered_map(stream(t).select("event_id", "value"), twice, "event_id long, doubled double"))


TUMBLE = """(SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total, round(avg(value) + 1e-9, 6) AS mean FROM events GROUP BY 1, 2)"""


@query("str14_tumbling", f"SELECT * FROM {TUMBLE}")
def _(t):
    out = windows.tumbling(t.events, "event_type", "ts", "value").drop("window_end")
    return rounded(rounded(out, "mean", nudge=1e-9), "total", digits=4)


@query("str14_tumbling_stream", f"SELECT * FROM {TUMBLE} WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def _(t):
    out = flow.drain(windows.tumbling(windows.late(stream(t)), "event_type", "ts", "value")).drop("window_end")
    out = out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return rounded(rounded(out, "mean", nudge=1e-9), "total", digits=4)


@query("str15_sliding", """
SELECT event_type, window_start, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM (
 SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 14 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS window_start FROM events)
GROUP BY 1, 2""")
def _(t):
    return rounded(windows.sliding_exact(t.events, "event_type", "ts", "value"), "p50", "p95", "p99")


@query("str15_sliding_stream")
def _(t):
    return flow.drain(windows.sliding_sketch(windows.late(stream(t)), "event_type", "ts", "value"))


@query("str15_sliding_stream_error", """
SELECT event_type, window_start, count(*) AS n, true AS p50_near, true AS p95_near, true AS p99_near FROM (
 SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 14 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS window_start FROM events)
WHERE window_start + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def _(t):
    """All closed windows of the stream, and whether their percentiles lie within 2 % of the asked ranks."""
    out = flow.drain(windows.sliding_sketch(windows.late(stream(t)), "event_type", "ts", "value"))
    found = out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    minute = F.date_trunc("minute", F.col("ts"))
    every = t.events.select("event_type", "value", F.explode(F.sequence(minute - F.expr("INTERVAL 14 MINUTES"), minute, F.expr("INTERVAL 1 MINUTE"))).alias("window_start"))
    both = every.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).join(found, ["event_type", "window_start"])
    near = []
    for p in (0.5, 0.95, 0.99):
        q = F.col(f"p{round(p * 100)}")
        below, upto = F.count_if(F.col("value") < q) / F.count("value"), F.count_if(F.col("value") <= q) / F.count("value")
        near.append(((below <= p + 0.02) & (upto >= p - 0.02)).alias(f"p{round(p * 100)}_near"))
    return both.groupBy("event_type", "window_start").agg(F.first("n").alias("n"), *near)


SESSIONS = """(SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, CAST(count(*) AS BIGINT) AS events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds
 FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events))
 GROUP BY user_id, s)"""


@query("str16_sessions", f"SELECT user_id, session_start, session_end, events, round(duration_seconds, 6)::DOUBLE AS duration_seconds FROM {SESSIONS}")
def _(t):
    return rounded(windows.sessions(t.events, "user_id", "ts"), "duration_seconds")


@query("str16_session_summary", f"""
SELECT count(*) AS sessions, count(DISTINCT user_id) AS unique_users, round(avg(duration_seconds), 6)::DOUBLE AS avg_duration, round(max(duration_seconds), 6)::DOUBLE AS longest FROM {SESSIONS}""")
def _(t):
    return rounded(windows.session_summary(windows.sessions(t.events, "user_id", "ts"), "user_id"), "avg_duration", "longest")


@query("str16_sessions_stream", f"""
SELECT user_id, session_start, session_end, events FROM {SESSIONS} WHERE session_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def _(t):
    out = flow.drain(windows.session_windows(windows.late(stream(t)), "user_id", "ts"))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                      F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events")


@query("udf04_stream_processor", "SELECT event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY event_type")
def _(t):
    out = scratch_path(t.spark, "mine")

    def mine(batch, batch_id):
        batch.filter("value > 20").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    flow.each_batch(stream(t), mine, scratch_path(t.spark, "c")).awaitTermination()
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))
