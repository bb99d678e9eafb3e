"""Series operators and streams against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import privacy, stats
from millrace.operators import timeseries as T
from millrace.session import scratch_path
from millrace.streaming import flow, stateful, windows


def ordered(hot):
    rows = {}
    for r in sorted(hot.filter("key is not null").collect(), key=lambda r: (r["ts"], r["id"])):
        rows.setdefault(r["key"], []).append(r)
    return rows


def split_stream(spark, hot, parts=4):
    """The series as files in time order, one file per micro-batch."""
    folder = scratch_path(spark, "stream")
    rows = hot.filter("key is not null").withColumn("sec", F.unix_seconds("ts") - 1700000000)
    for i in range(parts):
        part = rows.filter((F.col("sec") >= i * 4001 // parts) & (F.col("sec") < (i + 1) * 4001 // parts)).drop("sec")
        part.coalesce(1).write.mode("append").parquet(folder)
    return flow.file_stream(spark, folder, hot.schema, max_files=1)


def shuffled_stream(spark, hot, parts=5):
    """The series dealt to files by id, two files per micro-batch, and one row at the end
    that lets out what waits; the null key is one of the keys."""
    folder = scratch_path(spark, "shuffled")
    for i in range(parts):
        hot.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(folder)
    last = spark.createDataFrame([("~end", -1, 1700000000 + 10 ** 8, None)], "key string, id long, sec long, value double")
    last.selectExpr("key", "id", "timestamp_seconds(sec) AS ts", "value").coalesce(1).write.mode("append").parquet(folder)
    return flow.file_stream(spark, folder, hot.schema, max_files=2)


def by_key(hot):
    rows = {}
    for r in sorted(hot.collect(), key=lambda r: (r["ts"], r["id"])):
        rows.setdefault(r["key"], []).append(r)
    return rows


def test_duration_alert(spark, hot):
    rules = [{"rule": "r", "metric": k, "operator": "gt", "threshold": 0.0} for k in ("hot", "a", "b", "c")]
    got = {r["key"]: r["fires"] for r in T.duration_alerts(hot, "key", "ts", "value", rules, 60).collect()}
    for key, rows in ordered(hot).items():
        end = rows[-1]["ts"].timestamp()
        assert got[key] == all(r["value"] > 0 for r in rows if r["ts"].timestamp() >= end - 60)


def test_episodes_batch_and_stream(spark, hot):
    want = set()
    for key, rows in by_key(hot).items():
        count = 0
        for r in rows:
            if r["value"] > 30:
                start = start if count else r["ts"]  # noqa: F821
                count, last = count + 1, r["ts"]
            elif count:
                want.add((key, start, last, count, r["ts"]))
                count = 0
    batch = T.alert_episodes(hot, "key", ["ts", "id"], F.col("value") > 30).filter("resolved_at is not null")
    assert {tuple(r) for r in batch.select("key", "opened_at", "last_triggered", "trigger_count", "resolved_at").collect()} == want
    out = flow.drain(stateful.episodes(shuffled_stream(spark, hot), "key", "ts", "id", "value", 30, "2 hours"))
    at = lambda c: F.timestamp_micros(c)
    got = out.select("key", at("opened_us"), at("last_us"), "trigger_count", at("resolved_us")).collect()
    assert {tuple(r) for r in got} == want


def test_ema_batch_and_stream(spark, hot):
    want = {}
    for rows in by_key(hot).values():
        mean = var = None
        for n, r in enumerate(rows, 1):
            v = r["value"]
            if n == 1:
                mean, var = v, 0.0
            else:
                var = 0.9 * var + 0.1 * (v - mean) ** 2
                mean = 0.9 * mean + 0.1 * v
            want[r["id"]] = (mean, var, n)
    batch = T.ema_anomaly(hot, "key", ["ts", "id"], "value").collect()
    stream = flow.drain(stateful.ema(shuffled_stream(spark, hot), "key", "ts", "id", "value", delay="2 hours")).collect()
    for rows in (batch, stream):
        assert len(rows) == len(want)
        for r in rows:
            mean, var, n = want[r["id"]]
            assert abs(r["mean"] - mean) < 1e-9 and abs(r["variance"] - var) < 1e-7 and r["count"] == n


def test_rate_limit_stream(spark, hot):
    want = {}
    for rows in by_key(hot).values():
        accepted = []
        for r in rows:
            t = r["ts"].timestamp()
            accepted = [a for a in accepted if t - a < 60]
            want[r["id"]] = len(accepted) < 3
            if want[r["id"]]:
                accepted.append(t)
    out = flow.drain(stateful.rate_limit(shuffled_stream(spark, hot), "key", "ts", "id", 3, 60, "2 hours"))
    assert {r["id"]: r["accepted"] for r in out.collect()} == want


def test_rate_flags(hot):
    got = {r["id"]: r["requests"] for r in privacy.rate_flags(hot.filter("key is not null"), "key", "ts", "id", 3, 60).collect()}
    for rows in ordered(hot).values():
        t = [r["ts"].timestamp() for r in rows]
        for i, r in enumerate(rows):
            assert got[r["id"]] == sum(t[i] - 60 <= x <= t[i] for x in t)


def test_sessions_match_session_window(hot):
    clean = hot.filter("key is not null")
    a = windows.sessions(clean, "key", "ts", 20).select("key", F.col("session_start").cast("timestamp"), F.col("session_end").cast("timestamp"), "events")
    b = windows.session_windows(clean, "key", "ts", "20 seconds")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_sliding_exact_matches_percentile(hot):
    clean = hot.filter("key is not null")
    a = windows.sliding_exact(clean, "key", "ts", "value", 300, 60, {"p50": 0.5, "p90": 0.9})
    w = clean.groupBy("key", F.window("ts", "5 minutes", "1 minute").alias("w")).agg(
        F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.9).alias("p90"))
    want = {(r["key"], r["s"]): (r["p50"], r["p90"]) for r in w.select("key", F.col("w.start").alias("s"), "p50", "p90").collect()}
    got = a.select("key", F.col("window_start").cast("timestamp").alias("s"), "p50", "p90").collect()
    assert len(got) == len(want)
    for r in got:
        assert r["p50"] == pytest.approx(want[(r["key"], r["s"])][0]) and r["p90"] == pytest.approx(want[(r["key"], r["s"])][1])


def test_router_counts_every_source(spark, hot):
    out = {k: scratch_path(spark, k) for k in ("hot", "a")}
    counter = flow.Counter(spark)
    q = flow.each_batch(split_stream(spark, hot), flow.route({k: flow.to_files(p) for k, p in out.items()}, "key"), scratch_path(spark, "c"))
    q.awaitTermination()
    for k, p in out.items():
        assert spark.read.parquet(p).count() == hot.filter(F.col("key") == k).count()
    m = counter.of(q)
    counter.stop()
    assert m["processed"] == hot.filter("key is not null").count() and m["batches"] == 4 and m["dropped"] == 0


def test_stream_table_sink_upserts(spark, hot):
    import uuid

    spark.sql(f"CREATE DATABASE IF NOT EXISTS str_db LOCATION '{scratch_path(spark, 'db')}'")
    spark.catalog.setCurrentDatabase("str_db")
    try:
        table = f"t_{uuid.uuid4().hex[:8]}"
        hot.filter("id < 0").write.saveAsTable(table)
        flow.each_batch(split_stream(spark, hot), flow.upsert_into(table, ["key"], ["ts", "id"]), scratch_path(spark, "c")).awaitTermination()
        got = {r["key"]: r["id"] for r in spark.table(table).collect()}
        assert got == {k: rows[-1]["id"] for k, rows in ordered(hot).items()}
    finally:
        spark.catalog.setCurrentDatabase("default")


def test_t_distribution():
    # Known two-sided 5 % points of Student's t.
    for df, t in [(1, 12.7062047), (5, 2.5705818), (30, 2.0422725), (1000, 1.9623390)]:
        assert abs(stats._t_tail(t, df) - 0.05) < 1e-6


def test_rank_tests_with_ties(spark):
    a, b = [1.0, 2.0, 2.0, 3.0], [2.0, 3.0, 4.0, 5.0, 5.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    row = stats.mann_whitney(df, "g", "v", "a", "b").head()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert row["u1"] == u and row["u2"] == len(a) * len(b) - u
    assert 0 < row["p_value"] < 1
    assert math.isclose(stats.welch_interval(df, "g", "v", "a", "b").head()["difference"], 2.0 - 3.8)
