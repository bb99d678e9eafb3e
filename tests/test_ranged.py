"""Ordered helpers against plain pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.plans import ranged as R

ORDER = ["ts", "id"]


def frame(df):
    return df.toPandas().sort_values(ORDER).reset_index(drop=True)


def test_no_range_partition_takes_the_whole_hot_key(hot):
    rows = R.ranged(hot, ["key"], ORDER)
    largest = rows.groupBy("_part").count().agg(F.max("count")).head()[0]
    assert rows.select("_part").distinct().count() > 1
    assert largest < 0.6 * hot.count()


def test_row_index_and_total(hot):
    got = frame(R.row_index(hot, ["key"], ORDER, total="n"))
    want = frame(hot)
    assert (got["idx"] == want.groupby("key", dropna=False).cumcount() + 1).all()
    assert (got["n"] == want.groupby("key", dropna=False)["id"].transform("size")).all()


def test_global_row_index(hot):
    got = frame(R.row_index(hot, [], ORDER))
    assert got["idx"].tolist() == list(range(1, len(got) + 1))


def test_running_sum_keeps_nulls_apart(hot):
    got = frame(R.running(hot, ["key"], ORDER, {"s": F.col("value")}))
    want = frame(hot).groupby("key", dropna=False)["value"].cumsum()
    assert np.allclose(got["s"], want)


@pytest.mark.parametrize("rows", [7, 50, 100_000])
def test_windowed_rows_across_blocks(hot, rows):
    def made(w):
        return {"before": F.lag("value", 2).over(w), "after": F.lead("value").over(w),
                "mean": F.avg("value").over(w.rowsBetween(-4, 0))}

    got = frame(R.windowed_rows(hot, ["key"], ORDER, made, before=4, after=1, rows=rows))
    g = frame(hot).groupby("key", dropna=False)["value"]
    assert len(got) == hot.count()
    pd.testing.assert_series_equal(got["before"], g.shift(2), check_names=False)
    pd.testing.assert_series_equal(got["after"], g.shift(-1), check_names=False)
    want = g.rolling(5, min_periods=1).mean().reset_index(level=0, drop=True).sort_index()
    assert np.allclose(got["mean"], want)


def test_halo_longer_than_block(hot):
    def made(w):
        return {"mean": F.avg("value").over(w.rowsBetween(-9, 0))}

    got = frame(R.windowed_rows(hot, ["key"], ORDER, made, before=9, rows=5))
    want = frame(hot).groupby("key", dropna=False)["value"].rolling(10, min_periods=1).mean().reset_index(level=0, drop=True).sort_index()
    assert len(got) == hot.count() and np.allclose(got["mean"], want)


@pytest.mark.parametrize("n", [3, 1500])
def test_first_rows_both_ways(hot, n):
    got = R.first_rows(hot, ["key"], ORDER, n, newest=True).toPandas()
    want = frame(hot).groupby("key", dropna=False).tail(n)
    assert sorted(got["id"]) == sorted(want["id"])
    assert got.groupby("key", dropna=False)["rn"].max().max() == min(n, got.groupby("key", dropna=False).size().max())


def test_quantiles(hot):
    points = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = R.quantiles(hot, ["key"], "value", points).toPandas().set_index("key")
    for key, part in hot.toPandas().groupby("key", dropna=False):
        row = got.loc[key] if isinstance(key, str) else got[got.index.isna()].iloc[0]
        assert np.allclose(row[list(points)].astype(float), np.quantile(part["value"], list(points.values())))


@pytest.mark.parametrize("method, many", [("linear", 1), ("linear", 50_000), ("index", 50_000)])
def test_quantiles_by_several_rounds_of_brackets(spark, monkeypatch, method, many):
    """Skewed, tied and negative values, one key with most rows, brackets of a few values."""
    for name, v in {"INSIDE": 20, "GRID": 20, "ACCURACY": 400, "MANY_KEYS": many}.items():
        monkeypatch.setattr(R, name, v)
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.lognormal(3, 3, 5000), 2)] + [("hot", 7.0)] * 3000
    rows += [("ties", float(v)) for v in rng.integers(-2, 2, 700)] + [(None, float(v)) for v in rng.normal(size=300)]
    rows += [("one", -1.5), ("hot", None), ("nothing", None), ("two", 1.0), ("two", 2.0)]
    points = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.99}
    got = {r["k"]: [r[p] for p in points] for r in R.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", points, method).collect()}
    assert set(got) == {"hot", "ties", None, "one", "two"}
    for k in got:
        s = np.sort([v for x, v in rows if x == k and v is not None])
        n = len(s)
        want = {"linear": lambda p: np.quantile(s, p), "lower": lambda p: s[int(p * (n - 1))], "index": lambda p: s[min(int(p * n), n - 1)]}[method]
        assert np.allclose(got[k], [want(p) for p in points.values()], rtol=1e-12), (k, method)


def test_quantiles_of_whole_numbers_and_nothing(spark):
    big = [2**60 + i for i in range(50)]
    df = spark.createDataFrame([(v,) for v in big], "v long")
    assert R.quantiles(df, [], "v", {"a": 0.5}, "lower").head()["a"] == big[24]
    none = df.filter("v < 0")
    assert R.quantiles(none, [], "v", {"a": 0.5}).collect()[0]["a"] is None
    assert R.quantiles(none.selectExpr("v AS k", "v"), ["k"], "v", {"a": 0.5}).collect() == []


def test_quantiles_move_only_what_is_inside(spark):
    """The plan neither sorts values over ranges nor reads a checkpoint, and few values are shuffled."""
    df = spark.range(200_000).selectExpr("id % 2 AS k", "hash(id) AS v")
    made = R.quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9})
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "RDDScan" not in plan and "ExistingRDD" not in plan.replace("Scan ExistingRDD", "", 1)
    stage = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "SortMergeJoin" not in stage


@pytest.mark.parametrize("method", ["lower", "index"])
def test_picked_quantiles(spark, method):
    values = [5.0, 1.0, 1.0, 9.0, 3.0, 7.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = R.quantiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.9}, method).head()
    s, n = sorted(values), len(values)
    pick = (lambda p: s[int(p * (n - 1))]) if method == "lower" else (lambda p: s[min(int(p * n), n - 1)])
    assert [got["a"], got["b"], got["c"]] == [pick(0.25), pick(0.5), pick(0.9)]


def test_trailing_sums_with_bursts(hot):
    got = R.trailing_sums(hot, ["key"], "ts", "id", 30, {"s": F.col("value"), "n": F.lit(1)}).toPandas().set_index("id")
    rows = hot.toPandas()
    for _, part in rows.groupby("key", dropna=False):
        if part["key"].isna().all():
            continue
        t = part["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        for i, rid in enumerate(part["id"]):
            inside = (t >= t[i] - 30) & (t <= t[i])
            assert got.loc[rid, "n"] == inside.sum()
            assert abs(got.loc[rid, "s"] - part["value"].to_numpy()[inside].sum()) < 1e-6


@pytest.mark.parametrize("dense", [3, 40, 200_000])
@pytest.mark.parametrize("seconds", [0, 0.000003, 7])
def test_trailing_sums_of_any_scale(spark, monkeypatch, dense, seconds):
    """Bursts, equal times, times before 1970, null keys, and values of 24 orders of magnitude in one block."""
    monkeypatch.setattr(R, "DENSE", dense)
    rng = np.random.default_rng(5)
    rows = [("a", i, int(t), float(10.0 ** rng.integers(-9, 15))) for i, t in enumerate(np.sort(rng.integers(-4_000_000, 30_000_000, 300)))]
    rows += [(None, 1000 + i, int(t), 1.0) for i, t in enumerate(rng.integers(0, 20, 60))] + [("b", 2000, 5, None)]
    df = spark.createDataFrame(rows, "key string, id long, us long, v double").withColumn("ts", F.timestamp_micros("us"))
    got = {r["id"]: (r["s"], r["n"]) for r in R.trailing_sums(df, ["key"], "ts", "id", seconds, {"s": F.col("v"), "n": F.lit(1)}).collect()}
    assert len(got) == len(rows)
    span = int(seconds * 1_000_000)
    for key, i, t, _ in rows:
        inside = [v or 0.0 for k, _, u, v in rows if k == key and t - span <= u <= t]
        assert got[i][1] == len(inside) and got[i][0] == pytest.approx(sum(inside), rel=1e-12)


def test_affine_scans(hot):
    rows = hot.withColumn("k", F.lit(0.9)).withColumn("a", F.col("value") * 0.1).withColumn("one", F.lit(1.0))
    got = frame(R.affine_scans(rows, ["key"], ORDER, {"m": ("k", "a", "value"), "c": ("one", "one", "one")}))
    state: dict = {}
    for key, value, m, c in zip(got["key"], got["value"], got["m"], got["c"]):
        last = state.get(key)
        state[key] = (value, 1) if last is None else (last[0] * 0.9 + value * 0.1, last[1] + 1)
        assert abs(state[key][0] - m) < 1e-9 and state[key][1] == c


@pytest.mark.parametrize("block", [2, 8])
def test_affine_scans_over_thousands_of_blocks(spark, monkeypatch, block):
    """Levels of blocks, with steps that forget all and null inputs of another key."""
    monkeypatch.setattr(R, "BLOCK", block)
    n = 40_000 if block == 8 else 60  # 5,000 blocks of one key
    rows = spark.range(n).selectExpr("'a' AS key", "id", "CASE WHEN id % 97 = 5 THEN 0.0 ELSE 0.5 + (id % 7) / 8 END AS k", "(id * 37 % 101) - 50.0 AS a", "3.0D AS f")
    more = spark.sql("SELECT CAST(NULL AS STRING) AS key, id, 0.5D AS k, CAST(NULL AS DOUBLE) AS a, 1.0D AS f FROM range(5)")
    got = R.affine_scans(rows.unionByName(more), ["key"], ["id"], {"s": ("k", "a", "f")}).orderBy("id").collect()
    s, seen = None, 0
    for r in got:
        if r["key"] is None:
            assert (r["s"] == 1.0) if r["id"] == 0 else r["s"] is None
            continue
        s = r["f"] if s is None else s * float(r["k"]) + float(r["a"])
        assert abs(r["s"] - s) < 1e-9 * max(1, abs(s))
        seen += 1
    assert seen == n


def test_affine_scans_run_in_the_jvm(hot):
    rows = hot.withColumn("k", F.lit(0.9)).withColumn("a", F.col("value") * 0.1)
    plan = R.affine_scans(rows, ["key"], ORDER, {"m": ("k", "a", "value")})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
