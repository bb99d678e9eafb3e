"""Descriptive statistics, rank and t tests, effect sizes.

Group moments come from one aggregation; ranks come from counts of distinct
values in range partitions. Test formulas then run on a handful of rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.keys import join_by_key
from ..plans.ranged import quantiles, running


def describe_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, median, deviation, extremes, quartiles, skewness and excess kurtosis (population forms)."""
    m = df.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    q = quantiles(df.select(group, value), [group], value, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return join_by_key(m, q, group).withColumn("iqr", F.col("q75") - F.col("q25"))


def ranked_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Distinct (value, group) counts with the tie-averaged rank of the value over all groups.

    Values are combined map-side first, so a value shared by a third of the rows
    is one row per map task and group.
    """
    per_group = df.filter(F.col(value).isNotNull()).groupBy(value, group).agg(F.count("*").alias("m"))
    counts = per_group.groupBy(value).agg(F.sum("m").alias("n"))
    ranks = running(counts, [], [value], {"upto": F.col("n")}, {"total": "upto"})
    ranks = ranks.select(value, "n", "total", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    return per_group.join(ranks, value)


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: size and rank sum; plus the tie term Σ(t³ − t) of the whole."""
    rows = ranked_groups(df, group, value)
    sums = rows.groupBy(group).agg(
        F.sum("m").alias("n"), F.sum(F.col("rank") * F.col("m")).alias("rank_sum"), F.max("total").alias("total"))
    t = F.col("n").cast("double")
    ties = rows.select(value, "n").distinct().agg(F.sum(t * t * t - t).alias("ties")).scalar()
    return sums.withColumn("ties", ties)


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal probability of ``z`` for a few result rows."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))

    return tail(z)


def mann_whitney(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """U of both groups, two-sided p by the normal law with tie correction, rank-biserial effect."""
    sums = rank_sums(df.filter(F.col(group).isin(a, b)), group, value)
    pick = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    one = sums.agg(
        pick(a, "n").cast("double").alias("n1"), pick(b, "n").cast("double").alias("n2"),
        pick(a, "rank_sum").alias("r1"), F.max("ties").alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    out = one.select("n1", "n2", u1.alias("u1"), (n1 * n2 - u1).alias("u2"), sd.alias("_sd"))
    z = (F.greatest("u1", "u2") - n1 * n2 / 2 - 0.5) / F.col("_sd")
    return out.select(
        "u1", "u2", (1 - F.least("u1", "u2") * 2 / (n1 * n2)).alias("rank_biserial"), normal_two_sided(z).alias("p_value"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank statistic of pairs (zero differences dropped) and effect |z| / sqrt(n)."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).filter("d <> 0")
    rows = ranked_groups(d.select(F.abs("d").alias("v"), (F.col("d") > 0).alias("up")), "up", "v")
    one = rows.agg(
        F.coalesce(F.sum(F.when(F.col("up"), F.col("rank") * F.col("m"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(~F.col("up"), F.col("rank") * F.col("m"))), F.lit(0.0)).alias("w_minus"),
        F.sum("m").cast("double").alias("n"))
    n = F.col("n")
    w = F.least("w_plus", "w_minus")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return one.select("n", "w_plus", "w_minus", w.alias("statistic"), z.alias("z"), (F.abs(z) / F.sqrt(n)).alias("effect"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H over all groups, corrected for ties."""
    sums = rank_sums(df, group, value)
    one = sums.agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.max("total").cast("double").alias("t"),
        F.count("*").alias("groups"), F.max("ties").alias("ties"))
    t = F.col("t")
    h = F.col("s") * 12 / (t * (t + 1)) - (t + 1) * 3
    return one.select((h / (1 - F.col("ties") / (t * t * t - t))).alias("h"), (F.col("groups") - 1).alias("df"))


def two_moments(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """n, mean and variance of two groups as one row."""
    def of(g, fn):
        return fn(F.when(F.col(group) == g, F.col(value)))

    return df.agg(
        of(a, F.count).cast("double").alias("n1"), of(a, F.avg).alias("m1"), of(a, F.var_samp).alias("v1"),
        of(b, F.count).cast("double").alias("n2"), of(b, F.avg).alias("m2"), of(b, F.var_samp).alias("v2"))


def _pooled() -> Column:
    n1, n2 = F.col("n1"), F.col("n2")
    return ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2)


def _welch_df() -> Column:
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))


def t_test(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Equal variances."""
    t = (F.col("m1") - F.col("m2")) / F.sqrt(_pooled() * (1 / F.col("n1") + 1 / F.col("n2")))
    rows = two_moments(df, group, value, a, b).select(t.alias("t"), (F.col("n1") + F.col("n2") - 2).alias("df"))
    return rows.withColumn("p_value", t_two_sided(F.col("t"), F.col("df")))


def welch_t(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Unequal variances."""
    t = (F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    rows = two_moments(df, group, value, a, b).select(t.alias("t"), _welch_df().alias("df"))
    return rows.withColumn("p_value", t_two_sided(F.col("t"), F.col("df")))


def cohens_d(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    d = (F.col("m1") - F.col("m2")) / F.sqrt(_pooled())
    return two_moments(df, group, value, a, b).select(d.alias("cohens_d"), effect_band(d).alias("band"))


def effect_band(d: Column) -> Column:
    x = F.abs(d)
    return F.when(x < 0.2, "negligible").when(x < 0.5, "small").when(x < 0.8, "medium").otherwise("large")


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between-group over total sum of squares, from group moments."""
    g = df.filter(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("within"))
    total = g.agg(F.struct((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"), F.sum("within").alias("w")).alias("v")).scalar()
    gap = F.col("m") - total["m"]
    between = F.sum(F.col("n") * gap * gap)
    return g.agg(F.coalesce(F.try_divide(between, between + F.max(total["w"])), F.lit(0.0)).alias("eta_squared"))


def welch_interval(df: DataFrame, group: str, value: str, a, b, confidence: float = 0.95) -> DataFrame:
    """Mean difference ± t·se with Welch's degrees of freedom."""
    se = F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    rows = two_moments(df, group, value, a, b).select(
        (F.col("m1") - F.col("m2")).alias("difference"), se.alias("se"), _welch_df().alias("df"))
    q = t_quantile(F.col("df"), 0.5 + confidence / 2)
    return rows.withColumn("_q", q).select(
        "difference", "se", "df", (F.col("difference") - F.col("_q") * F.col("se")).alias("lower"),
        (F.col("difference") + F.col("_q") * F.col("se")).alias("upper"))


def _t_tail(t: float, df: float) -> float:
    """P(|T| > t): the regularized incomplete beta at df/(df+t²), by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                        -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1.0 - front * fraction(1 - x, b, a) / b


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided probability of Student's t for a few result rows."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(i) or pd.isna(j) else _t_tail(abs(i), j) for i, j in zip(x, d)], dtype="float64")

    return tail(t, df)


def t_quantile(df: Column, p: float) -> Column:
    """Quantile of Student's t above one half, by bisection on the tail."""

    @F.pandas_udf("double")
    def find(d: pd.Series) -> pd.Series:
        out = []
        for v in d:
            if pd.isna(v):
                out.append(None)
                continue
            low, high = 0.0, 1e6
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if _t_tail(mid, v) > 2 * (1 - p) else (low, mid)
            out.append((low + high) / 2)
        return pd.Series(out, dtype="float64")

    return find(df)


def bonferroni(tests: DataFrame, p: str) -> DataFrame:
    """min(1, p·m) over the m tests of the table."""
    m = tests.agg(F.count("*").alias("m")).scalar()
    return tests.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * m))


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    return quantiles(df.select(group, value), [group], value, {"median": 0.5})


def rank_by_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups ordered by their median, smallest first."""
    ordered = running(medians(df, group, value), [], ["median", group], {"position": F.lit(1).cast("long")})
    return ordered.select(group, "median", "position")


def ratio_to(df: DataFrame, group: str, value: str, base) -> DataFrame:
    """Every group's median over the median of the group ``base``."""
    m = medians(df, group, value)
    whole = m.filter(F.col(group).eqNullSafe(F.lit(base))).select(F.max("median")).scalar()
    return m.select(group, "median", F.try_divide(F.col("median"), whole).alias("ratio"))


def ratio_matrix(df: DataFrame, group: str, value: str, groups: list) -> DataFrame:
    """median_i / median_j for every two of the ``groups`` the caller names."""
    named = df.filter(F.col(group).isin([g for g in groups if g is not None]) | (F.col(group).isNull() & F.lit(None in groups)))
    m = medians(named, group, value)
    table = m.agg(F.array_sort(F.collect_list(F.struct(group, "median"))).alias("t")).scalar()
    rows = m.withColumn("_o", F.explode(table))
    return rows.select(
        F.col(group).alias("group_a"), F.col(f"_o.{group}").alias("group_b"),
        F.try_divide(F.col("median"), F.col("_o.median")).alias("ratio"))
