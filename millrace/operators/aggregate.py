"""Grouped aggregation by rules, rollups, top-k and latest values.

Everything here combines map-side, so a hot key costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import to_float
from ..plans.ranged import quantiles, row_index


def _num(df: DataFrame, field: str) -> Column:
    return F.col(field) if isinstance(df.schema[field].dataType, T.NumericType) else to_float(field)


FUNCTIONS = {
    "count": lambda d, f, r: F.count(f),
    "sum": lambda d, f, r: F.sum(_num(d, f)),
    "avg": lambda d, f, r: F.avg(_num(d, f)),
    "mean": lambda d, f, r: F.avg(_num(d, f)),
    "min": lambda d, f, r: F.min(f),
    "max": lambda d, f, r: F.max(f),
    "std": lambda d, f, r: F.stddev_samp(_num(d, f)),
    "stddev": lambda d, f, r: F.stddev_samp(_num(d, f)),
    "distinct_count": lambda d, f, r: F.approx_count_distinct(f) if r.get("approx") else F.count_distinct(f),
}


def aggregate(df: DataFrame, group_by: list[str], rules: list[dict]) -> DataFrame:
    """Rules ``{field, function, alias, approx, order_by}``; no group gives one row.

    ``median`` is exact and taken by rank over range partitions, then joined to
    the other aggregates on the group; ``approx=True`` takes a sketch instead.
    ``concat`` joins texts in the order of ``order_by`` (make it distinct): parts of
    a group are ordered and joined apart, then put together in one cell; where a
    group's text has no bound, keep the parts of ``concat_parts``.
    An unknown function counts.
    """
    # The group may also be a rule of its own.
    group_by = [*group_by, *[f for r in rules if r.get("type") == "group_by" for f in r["fields"]]]
    rules = [r for r in rules if r.get("type") != "group_by"]
    plain, medians, concats = [], [], []
    for rule in rules:
        field, fn = rule["field"], rule["function"]
        alias = rule.get("alias", f"{fn}_{field}")
        if fn == "median" and not rule.get("approx"):
            medians.append((alias, field))
        elif fn == "median":
            plain.append(F.percentile_approx(_num(df, field), 0.5).alias(alias))
        elif fn == "concat":
            concats.append((alias, field, rule["order_by"]))
        else:
            plain.append(FUNCTIONS.get(fn, FUNCTIONS["count"])(df, field, rule).alias(alias))
    out = df.groupBy(*group_by).agg(*plain) if plain else df.select(*group_by).distinct()
    for alias, field in medians:
        part = quantiles(df.select(*group_by, _num(df, field).cast("double").alias("_v")), group_by, "_v", {alias: 0.5})
        out = _attach(out, part, group_by, alias)
    for alias, field, order in concats:
        parts = concat_parts(df, group_by, field, order)
        pieces = F.array_sort(F.collect_list(F.struct("part", F.col(field).alias("v"))))
        part = parts.groupBy(*group_by).agg(F.array_join(F.transform(pieces, lambda x: x["v"]), ", ").alias(alias))
        out = _attach(out, part, group_by, alias)
    names = [r.get("alias", f"{r['function']}_{r['field']}") for r in rules]
    return out.select(*group_by, *names)


def _attach(out: DataFrame, part: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left join of one measure; null keys are a group of their own."""
    if not keys:
        return out.withColumn(value, part.select(value).scalar())
    renamed = part.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], value)
    on = None
    for i, k in enumerate(keys):
        test = out[k].eqNullSafe(renamed[f"_k{i}"])
        on = test if on is None else on & test
    return out.join(renamed, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def concat_parts(
    df: DataFrame, keys: list[str], field: str, order: list[str], rows: int = 10_000, sep: str = ", "
) -> DataFrame:
    """The concatenation in numbered parts of at most ``rows`` values each."""
    indexed = row_index(df.filter(F.col(field).isNotNull()).select(*dict.fromkeys([*keys, field, *order])), keys, order)
    part = F.floor((F.col("idx") - 1) / rows)
    bits = F.array_sort(F.collect_list(F.struct("idx", F.col(field).cast("string").alias("v"))))
    return (
        indexed.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.array_join(F.transform(bits, lambda x: x["v"]), sep).alias(field))
    )


def collect_groups(df: DataFrame, field: str, order: list[str], rows: int = 10_000) -> DataFrame:
    """Rows per key as arrays, key as text; a large key gives several chunks."""
    indexed = row_index(df, [field], order)
    return (
        indexed.withColumn("chunk", F.floor((F.col("idx") - 1) / rows))
        .groupBy(F.col(field).cast("string").alias("group_key"), "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("idx", F.struct(*df.columns).alias("row")))).alias("rows"))
        .withColumn("rows", F.transform("rows", lambda x: x["row"]))
    )


def simple_agg(df: DataFrame, group_by: list[str], operations: list[tuple[str, str]]) -> DataFrame:
    """(operation, field) pairs over castable values, named ``field_op``; count counts rows."""
    made = []
    for op, field in operations:
        x = _num(df, field)
        expr = {"sum": F.sum(x), "avg": F.avg(x), "min": F.min(x), "max": F.max(x), "count": F.count(F.lit(1))}[op]
        made.append(expr.alias(f"{field}_{op}"))
    return df.groupBy(*group_by).agg(*made)


def activity_summary(df: DataFrame, agent: str, status: Column, duration: str, ts: str) -> DataFrame:
    return df.groupBy(agent).agg(
        F.count("*").alias("total_activities"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.avg(duration).alias("avg_duration"),
        F.min(ts).alias("first_activity"),
        F.max(ts).alias("last_activity"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def run_statistics(df: DataFrame, status: str, duration: str, ts: str, since, until) -> DataFrame:
    inside = df.filter((F.col(ts) >= since) & (F.col(ts) <= until))
    total, done = F.count("*"), F.count_if(F.col(status) == "completed")
    return inside.agg(
        total.alias("total"),
        done.alias("completed"),
        F.count_if(F.col(status) == "failed").alias("failed"),
        _share(done, total).alias("success_rate"),
        F.avg(F.when(F.col(status) == "completed", F.col(duration))).alias("avg_duration"),
    )


def task_rollup(df: DataFrame, run: str, status: Column) -> DataFrame:
    total = F.count("*")
    done, failed = F.count_if(status == "completed"), F.count_if(status == "failed")
    return df.groupBy(run).agg(
        total.alias("tasks"),
        done.alias("completed"),
        failed.alias("failed"),
        F.count_if(status == "running").alias("running"),
        _share(done, total).alias("success_pct"),
        _share(failed, total).alias("failure_pct"),
    )


def top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), key).limit(k)


def breakdown(df: DataFrame, columns: list[str], measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Counts per value of each column, one grouping set per column, in one pass."""
    measures = measures or {}
    sets = df.groupingSets([[F.col(c)] for c in columns], *columns)
    level = None
    for c in columns:
        test = F.grouping(c) == 0
        level = F.when(test, c) if level is None else level.when(test, c)
    grouped = sets.agg(
        level.alias("dimension"), F.count("*").alias("n"), *[m.alias(n) for n, m in measures.items()]
    )
    return grouped.select("dimension", F.coalesce(*columns).alias("value"), "n", *measures)


def failure_analysis(df: DataFrame, columns: list[str], duration: str) -> DataFrame:
    """Counts and resolution times per class, with the most common value flagged."""
    parts = breakdown(
        df, columns, {"avg_time": F.avg(duration), "fastest": F.min(duration), "slowest": F.max(duration)}
    )
    best = parts.groupBy("dimension").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("_best"))
    return parts.join(best, "dimension").withColumn("most_common", F.col("value").eqNullSafe(F.col("_best"))).drop("_best")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    newest = F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns])).alias("_last")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_last._{c}").alias(c) for c in columns])


def metric_summary(df: DataFrame, key: str, value: str, order: list[str], since: Column | None = None) -> DataFrame:
    rows = df if since is None else df.filter(F.col(order[0]) >= since)
    return rows.groupBy(key).agg(
        F.count(value).alias("count"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("avg"),
        F.max(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("latest"),
    )


def value_counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def audit_report(df: DataFrame, ts: str, kind: str, since, until, kinds: Mapping[str, list[str]]) -> DataFrame:
    inside = df.filter((F.col(ts) >= since) & (F.col(ts) < until))
    return inside.agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col(kind).isin(v)).alias(n) for n, v in kinds.items()],
    )


def consensus_vote(votes: DataFrame, rule: str, passed: str, threshold: float) -> DataFrame:
    """Per rule: pass share, whether a consensus is reached, and the whole vote."""
    share = F.avg(F.col(passed).cast("int"))
    rules = votes.groupBy(rule).agg(share.alias("pass_share"))
    agreed = (F.col("pass_share") >= threshold) | ((1 - F.col("pass_share")) >= threshold)
    rules = rules.select(
        rule,
        "pass_share",
        agreed.alias("consensus_reached"),
        F.when(F.col("pass_share") >= threshold, "pass").otherwise("fail").alias("result"),
        F.greatest("pass_share", 1 - F.col("pass_share")).alias("confidence"),
    )
    whole = rules.agg((F.count_if("consensus_reached") >= F.count("*") * threshold).alias("ok"))
    return rules.withColumn("overall_consensus", whole.scalar())
