"""Column profiles, type inference, outliers, correlations, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patterns as P
from ..functions.scalars import starts_matching, strip, to_float
from ..plans.ranged import first_rows, quantiles, value_counts
from .measures import (
    blank,
    is_digits,
    long_form,
    majority,
    matches_any,
    numeric_columns,
    per_column,
    text_columns,
    value_class,
)

PERCENTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def dataset_structure(df: DataFrame) -> DataFrame:
    """Rows, columns, columns per kind, memory guess rows·columns·8, any missing value."""
    numbers, texts = len(numeric_columns(df)), len(text_columns(df))
    width = len(df.columns)
    missing = F.lit(False)
    for c in df.columns:
        missing = missing | F.col(c).isNull()
    return df.agg(
        F.count("*").alias("row_count"), F.lit(width).alias("column_count"), F.lit(numbers).alias("numeric_columns"),
        F.lit(texts).alias("text_columns"), (F.count("*") * width * 8).alias("memory_bytes"),
        F.coalesce(F.bool_or(missing), F.lit(False)).alias("has_missing"))


def sparsity(df: DataFrame) -> DataFrame:
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    return df.agg(
        (F.coalesce(F.try_divide(F.sum(nulls), F.count(F.lit(1)) * len(df.columns)), F.lit(0.0)) * 100).alias("sparsity_pct"))


def _texts(df: DataFrame, columns: list[str] | None) -> list[str]:
    return columns or text_columns(df)


def _by_class(df: DataFrame, columns: list[str], classify, decide) -> DataFrame:
    """Classify every value once, then decide per column from the class numbers."""
    classes = df.select(*[classify(c).alias(c) for c in columns])
    return per_column(classes, columns, {"data_type": lambda c: decide(F.col(c))})


def _share(test: Column, of: Column) -> Column:
    return F.avg(F.when(of.isNotNull(), F.when(test, 1.0).otherwise(0.0)))


def infer_schema(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """integer, float, boolean or string when every non-null text fits; unknown without values."""

    def classify(c: str) -> Column:
        x, number = F.col(c), to_float(c)
        whole = number.isNotNull() & (number == F.floor(number)) & ~F.contains(x, F.lit("."))
        word = F.lower(x).isin("true", "false", "1", "0")
        return (
            F.when(whole & word, 0).when(whole, 1).when(number.isNotNull(), 2).when(word, 3).when(x.isNotNull(), 4))

    def decide(k: Column) -> Column:
        return (
            F.when(F.count(k) == 0, "unknown").when(F.max(k) <= 1, "integer").when(F.max(k) <= 2, "float")
            .when(F.count_if(~k.isin(0, 3)) == 0, "boolean").otherwise("string"))

    return _by_class(df, _texts(df, columns), classify, decide)


def infer_type_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """First kind that holds for more than 80 % of the non-null texts."""

    def classify(c: str) -> Column:
        x = F.col(c)
        return (
            F.when(is_digits(x), 0).when(to_float(x).isNotNull(), 1).when(matches_any(x, P.DATE_SHARE), 2)
            .when(x.isNotNull(), 3))

    def decide(k: Column) -> Column:
        return (
            F.when(F.count(k) == 0, "null").when(_share(k == 0, k) > 0.8, "integer")
            .when(_share(k <= 1, k) > 0.8, "float").when(_share(k == 2, k) > 0.8, "date").otherwise("string"))

    return _by_class(df, _texts(df, columns), classify, decide)


def infer_type_majority(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Most common of integer, float, boolean, datetime, string."""
    names = ["integer", "float", "boolean", "datetime", "string"]

    def classify(c: str) -> Column:
        x = strip(c)
        decimal = to_float(x).isNotNull() & (F.contains(x, F.lit(".")) | F.contains(F.lower(x), F.lit("e")))
        word = F.lower(x).isin("true", "false", "1", "0", "yes", "no")
        return (
            F.when(x.rlike(r"^-?[0-9]+$"), 0).when(decimal, 1).when(word, 2)
            .when(matches_any(x, P.DATE_MAJORITY), 3).when(x.isNotNull(), 4))

    return _by_class(df, _texts(df, columns), classify, lambda k: majority(
        {n: F.count_if(k == i) for i, n in enumerate(names)}, "string"))


def infer_type_classes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Most common value class, blanks left out."""
    names = ["integer", "float", "boolean", "date", "string", "unknown"]
    return _by_class(
        df, _texts(df, columns), lambda c: F.when(~blank(c), value_class(df, c)),
        lambda k: majority({n: F.count_if(k == n) for n in names}, "unknown"))


def infer_type_source(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """numeric or date above 80 % of the values that are no null word, else string."""

    def classify(c: str) -> Column:
        x = F.when(~F.col(c).isin(P.SOURCE_NULLS), F.col(c))
        return F.when(to_float(x).isNotNull(), 0).when(matches_any(x, P.DATE_SOURCE), 1).when(x.isNotNull(), 2)

    def decide(k: Column) -> Column:
        return (
            F.when(F.count(F.lit(1)) == 0, "unknown").when(F.count(k) == 0, "null")
            .when(_share(k == 0, k) > 0.8, "numeric").when(_share(k == 1, k) > 0.8, "date").otherwise("string"))

    return _by_class(df, _texts(df, columns), classify, decide)


def infer_type_features(df: DataFrame) -> DataFrame:
    """numeric by column type; text with under 10 % distinct values is categorical."""
    numbers, texts = set(numeric_columns(df)), set(text_columns(df))

    def kind(c: str) -> Column:
        if c in numbers:
            return F.when(F.count(c) > 0, "numeric").otherwise("unknown")
        if c not in texts:
            return F.lit("unknown")
        share = F.try_divide(F.count_distinct(c), F.count(c))
        return F.when(share < 0.1, "categorical").when(share.isNotNull(), "text").otherwise("unknown")

    return per_column(df, df.columns, {
        "feature_type": kind, "missing_share": lambda c: F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0))})


def feature_profile(df: DataFrame) -> DataFrame:
    """Samples, features, mean missing share and the score 1 − that mean."""
    rows = infer_type_features(df)
    samples = df.agg(F.count("*").alias("n")).scalar()
    return rows.agg(
        F.count("*").alias("num_features"), F.count_if(F.col("feature_type") == "numeric").alias("numeric_features"),
        (1 - F.avg("missing_share")).alias("data_quality_score")).withColumn("num_samples", samples)


def select_features(df: DataFrame, max_missing: float = 0.5) -> DataFrame:
    """Features kept and the transforms named for their kind."""
    rows = infer_type_features(df).filter(F.col("missing_share") <= max_missing)
    named = (
        F.when(F.col("feature_type") == "numeric", "normalize,standardize")
        .when(F.col("feature_type") == "categorical", "one_hot_encode,label_encode")
        .when(F.col("feature_type") == "text", "tfidf,word_embeddings"))
    return rows.select("column", "feature_type", named.alias("transformations"))


def null_unique_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approx else F.count_distinct
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    return per_column(df, columns or df.columns, {
        "null_count": lambda c: F.count_if(F.col(c).isNull()),
        "null_percentage": lambda c: F.count_if(F.col(c).isNull()) / total * 100,
        "unique_count": lambda c: distinct(c),
        "unique_percentage": lambda c: distinct(c) / total * 100,
    })


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, median, deviation, variance, extremes per numeric column."""
    cols = columns or numeric_columns(df)
    rows = per_column(df, cols, {
        "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c), "variance": lambda c: F.var_samp(c),
        "min": lambda c: F.min(F.col(c).cast("double")), "max": lambda c: F.max(F.col(c).cast("double"))})
    medians = quantiles(long_form(df, cols, "double"), ["column"], "value", {"median": 0.5})
    return rows.join(medians, "column", "left")


def percentiles(df: DataFrame, columns: list[str], points: dict[str, float] | None = None, method: str = "linear",
                approx: bool = False) -> DataFrame:
    """Percentiles per column; ``approx`` takes Spark's sketch in one pass instead."""
    points = points or PERCENTILES
    if approx:
        return per_column(df, columns, {
            n: (lambda c, p=p: F.percentile_approx(F.col(c).cast("double"), p, 10_000)) for n, p in points.items()})
    return quantiles(long_form(df, columns, "double"), ["column"], "value", points, method)


def modes(df: DataFrame, columns: list[str], cast: str = "string") -> DataFrame:
    """Most common value per column, smallest value on a tie."""
    counts = value_counts(long_form(df, columns, cast), ["column"], "value")
    best = W.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def string_lengths(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return per_column(df, _texts(df, columns), {
        "avg_length": lambda c: F.avg(F.length(c)), "min_length": lambda c: F.min(F.length(c)),
        "max_length": lambda c: F.max(F.length(c))})


def detect_patterns(df: DataFrame, columns: list[str] | None = None, share: float = 0.7) -> DataFrame:
    """Share of values matching each known format, and whether it is above ``share``."""
    cols = _texts(df, columns)
    rows = per_column(df, cols, {
        n: (lambda c, p=p: F.avg(F.when(F.col(c).isNotNull(), F.when(starts_matching(c, p), 1.0).otherwise(0.0))))
        for n, p in P.VALUE_FORMATS.items()})
    long = rows.unpivot(["column"], list(P.VALUE_FORMATS), "pattern", "match_share")
    return long.withColumn("detected", F.coalesce(F.col("match_share") > share, F.lit(False)))


def format_consistency(df: DataFrame, columns: list[str] | None = None, share: float = 0.8) -> DataFrame:
    """Two measures per column: 1.0 without a known format and 0.9 with one; and
    the match share, or 1.0 / 0.8 by equal length where no format is known."""
    cols = _texts(df, columns)
    found = detect_patterns(df, cols, share)
    hits = found.groupBy("column").agg(
        F.count_if("detected").alias("hits"),
        F.sum(F.when(F.col("detected"), F.col("match_share")).otherwise(0.0)).alias("shares"))
    lengths = per_column(df, cols, {"one_length": lambda c: F.min(F.length(c)) == F.max(F.length(c))})
    return hits.join(lengths, "column").select(
        "column", F.when(F.col("hits") > 0, 0.9).otherwise(1.0).alias("flat_consistency"),
        F.when(F.col("hits") > 0, F.least(F.lit(1.0), "shares")).when(F.col("one_length"), 1.0).otherwise(0.8)
        .alias("share_consistency"))


def validity_scores(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """1 − share of null words among the non-null texts; the simple form strips and counts nulls too."""
    return per_column(df, _texts(df, columns), {
        "validity": lambda c: 1 - F.coalesce(F.avg(F.when(F.col(c).isNotNull(), F.when(
            F.lower(c).isin(P.INVALID_WORDS), 1.0).otherwise(0.0))), F.lit(0.0)),
        "validity_simple": lambda c: F.coalesce(F.avg(F.when(
            F.col(c).isNull() | F.lower(strip(c)).isin(P.INVALID_WORDS_SIMPLE), 0.0).otherwise(1.0)), F.lit(1.0))})


def fences(df: DataFrame, columns: list[str], k: float = 1.5, method: str = "linear", keys: list[str] | None = None) -> DataFrame:
    """Lower and upper fence per column; columns with fewer than 4 values have none."""
    keys = keys or []
    q = quantiles(long_form_keys(df, columns, keys), [*keys, "column"], "value", {"q1": 0.25, "q3": 0.75}, method)
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, "column", "q1", "q3", (F.col("q1") - k * iqr).alias("lower"), (F.col("q3") + k * iqr).alias("upper"))


def long_form_keys(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.unpivot(keys, columns, "column", "value") if keys else rows.unpivot([], columns, "column", "value")


def fenced_counts(df: DataFrame, columns: list[str], bounds: DataFrame, min_values: int = 4) -> DataFrame:
    """Outliers per column. The bounds are one row per column, read as one array."""
    table = bounds.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("lower", "upper")))).alias("b")).scalar()

    def out(c: str) -> Column:
        b = F.element_at(table, F.lit(c))
        x = F.col(c).cast("double")
        return F.when(F.count(c) >= min_values, F.count_if((x < b["lower"]) | (x > b["upper"]))).otherwise(0)

    return per_column(df, columns, {
        "rows": lambda c: F.count(F.lit(1)), "values": lambda c: F.count(c), "outliers": out})


def outliers_iqr(df: DataFrame, column: str, k: float = 1.5, method: str = "linear") -> DataFrame:
    """Rows outside the quartile fences."""
    b = fences(df, [column], k, method).select(F.struct("lower", "upper").alias("b")).scalar()
    n = df.agg(F.count(column).alias("n")).scalar()
    x = F.col(column).cast("double")
    return df.filter((n >= 4) & ((x < b["lower"]) | (x > b["upper"])))


def _moments(df: DataFrame, column: str) -> Column:
    return df.agg(F.struct(
        F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.count(column).alias("n")).alias("v")).scalar()


def outliers_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    m = _moments(df, column)
    return df.filter(F.try_divide(F.abs(F.col(column) - m["m"]), m["s"]) > threshold)


def outliers_median(df: DataFrame, column: str, factor: float = 2.5) -> DataFrame:
    """Farther than ``factor`` deviations from the median; needs 10 values."""
    m = _moments(df, column)
    median = quantiles(df.select(F.col(column).cast("double").alias("_v")), [], "_v", {"median": 0.5}).scalar()
    return df.filter((m["n"] >= 10) & (F.abs(F.col(column) - median) > factor * m["s"]))


def outlier_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Total outliers, columns with outliers and the mean share in percent."""
    cols = columns or numeric_columns(df)
    rows = fenced_counts(df, cols, fences(df, cols))
    return rows.agg(
        F.sum("outliers").alias("total_outliers"), F.count_if(F.col("outliers") > 0).alias("columns_with_outliers"),
        F.avg(F.col("outliers") / F.greatest(F.col("values"), F.lit(1)) * 100).alias("avg_outlier_pct"))


def correlations(df: DataFrame, columns: list[str] | None = None, least: float = 0.3, min_rows: int = 10) -> DataFrame:
    """Pearson for every pair of numeric columns in one pass over the rows."""
    cols = columns or numeric_columns(df)
    rows = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            both = F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(
                F.col(a).cast("double"), F.col(b).cast("double")).alias("correlation"), both.alias("n")))
    out = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    r = F.col("correlation")
    return out.filter((F.col("n") > min_rows) & (F.abs(r) > least)).select(
        "a", "b", "correlation", F.when(F.abs(r) > 0.7, "strong").otherwise("moderate").alias("strength"),
        F.when(r > 0, "positive").otherwise("negative").alias("direction"))


def column_profiles(df: DataFrame) -> DataFrame:
    """One row per column with the measures the scores and recommendations use."""
    numbers, texts = set(numeric_columns(df)), set(text_columns(df))
    cols = df.columns

    def validity(c: str) -> Column:
        if c not in texts:
            return F.lit(1.0)
        return 1 - F.coalesce(F.avg(F.when(F.col(c).isNotNull(), F.when(
            F.lower(c).isin(P.INVALID_WORDS), 1.0).otherwise(0.0))), F.lit(0.0))

    def consistency(c: str) -> Column:
        if c not in texts:
            return F.lit(1.0)
        known = F.lit(False)
        for p in P.VALUE_FORMATS.values():
            known = known | (F.avg(F.when(F.col(c).isNotNull(), F.when(starts_matching(c, p), 1.0).otherwise(0.0))) > 0.7)
        return F.when(known, 0.9).otherwise(1.0)

    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    rows = per_column(df, cols, {
        "data_type": lambda c: F.lit("numeric" if c in numbers else "string" if c in texts else "other"),
        "total_count": lambda c: F.count(F.lit(1)),
        "null_percentage": lambda c: F.count_if(F.col(c).isNull()) / total * 100,
        "unique_count": lambda c: F.count_distinct(c),
        "unique_percentage": lambda c: F.count_distinct(c) / total * 100,
        "completeness_score": lambda c: 1 - F.count_if(F.col(c).isNull()) / total,
        "validity_score": validity, "consistency_score": consistency})
    nums = [c for c in cols if c in numbers]
    if not nums:
        return rows.withColumn("outlier_percentage", F.lit(0.0))
    counted = fenced_counts(df, nums, fences(df, nums)).select(
        "column", (F.col("outliers") / F.greatest(F.col("values"), F.lit(1)) * 100).alias("outlier_percentage"))
    return rows.join(counted, "column", "left").fillna(0.0, ["outlier_percentage"])


def overall_quality(profiles: DataFrame) -> DataFrame:
    """0.4 completeness + 0.3 validity + 0.3 consistency, three decimals, with its parts."""
    a, b, c = F.avg("completeness_score"), F.avg("validity_score"), F.avg("consistency_score")
    return profiles.agg(
        a.alias("completeness"), b.alias("validity"), c.alias("consistency"),
        F.avg("outlier_percentage").alias("outlier_impact"),
        F.round(a * 0.4 + b * 0.3 + c * 0.3, 3).alias("overall"))


def recommendations(profiles: DataFrame) -> DataFrame:
    """Flags per column profile."""
    return profiles.select(
        "column", (F.col("null_percentage") > 20).alias("many_nulls"),
        (F.col("outlier_percentage") > 5).alias("many_outliers"),
        ((F.col("unique_percentage") < 10) & (F.col("unique_count") > 1)).alias("categorical"),
        ((F.col("unique_percentage") > 95) & (F.col("data_type") == "string")).alias("high_cardinality"))


def dataset_advice(profiles: DataFrame) -> DataFrame:
    """Score band and column count advice for the whole dataset."""
    rows = overall_quality(profiles).withColumn("columns", profiles.agg(F.count("*").alias("n")).scalar())
    return rows.select(
        "overall", F.when(F.col("overall") < 0.7, "below_threshold").when(
            F.col("overall") < 0.9, "room_for_improvement").otherwise("good").alias("band"),
        (F.col("columns") > 50).alias("many_columns"))


def mask(c: str | Column) -> Column:
    """Digits D, letters A, everything else S."""
    x = F.col(c) if isinstance(c, str) else c
    letters = F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9]", "_"), "[a-zA-Z]", "A")
    return F.replace(F.regexp_replace(letters, "[0-9]", "D"), F.lit("_"), F.lit("S"))


def value_masks(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(mask(column).alias("mask")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "mask").limit(k)


def quality_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blanks, distinct values, shortest and longest text per column."""
    def filled(c: str) -> Column:
        return F.when(~blank(c), F.col(c).cast("string"))

    return per_column(df, columns, {
        "total_count": lambda c: F.count(F.lit(1)), "null_count": lambda c: F.count_if(blank(c)),
        "unique_count": lambda c: F.count_distinct(filled(c)),
        "min_text": lambda c: F.min(F.when(~blank(c), F.struct(F.length(filled(c)), filled(c).alias("v"))))["v"],
        "max_text": lambda c: F.max(F.when(~blank(c), F.struct(F.length(filled(c)), filled(c).alias("v"))))["v"]})


def sample_values(df: DataFrame, key: str, columns: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` non-blank values per column, by key."""
    long = df.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key], columns, "column", "value")
    few = first_rows(long.filter(~blank("value")), ["column"], [key, "value"], n)
    return few.select("column", "rn", "value")


def pii_columns(df: DataFrame, by_name_only: bool = False) -> DataFrame:
    """Columns that are personal by name, or whose values mostly look like mail or phone."""
    def named(c: str) -> Column:
        return F.lit(any(p in c.lower() for p in P.PII_NAMES))

    if by_name_only:
        rows = [(c, any(p in c.lower() for p in P.PII_NAMES)) for c in df.columns]
        return df.sparkSession.createDataFrame(rows, "column string, potential_pii boolean")

    def looks(c: str) -> Column:
        x = F.col(c).cast("string")
        return F.coalesce(F.avg(F.when(x.isNotNull(), F.when(
            x.rlike(P.EMAIL) | x.rlike(P.PHONE), 1.0).otherwise(0.0))), F.lit(0.0)) > 0.5

    return per_column(df, df.columns, {"potential_pii": lambda c: named(c) | looks(c)})


def shape_flags(df: DataFrame) -> DataFrame:
    """Temporal names, nested columns, high cardinality, and the complexity number."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
    temporal = any(any(p in c.lower() for p in P.TEMPORAL_NAMES) for c in df.columns)
    kinds = len({f.dataType.typeName() for f in df.schema.fields})
    complexity = 1 + min(3, len(df.columns) // 5) + 2 * len(nested) + kinds
    flat = [c for c in df.columns if c not in nested]
    values = long_form(df, flat, "string").distinct().groupBy("column").agg(F.count("value").alias("n"))
    return values.agg(
        F.lit(temporal).alias("temporal"), F.lit(bool(nested)).alias("nested"),
        F.coalesce(F.max("n") > 50, F.lit(False)).alias("high_cardinality"), F.lit(complexity).alias("complexity"))


def field_statistics(df: DataFrame) -> DataFrame:
    """Counts for every column, moments for numbers, lengths for texts."""
    numbers, texts = numeric_columns(df), text_columns(df)

    def num(c: str, made) -> Column:
        return made(F.col(c).cast("double")) if c in numbers else F.lit(None).cast("double")

    def text(c: str, made, kind: str) -> Column:
        return made(F.length(c)).cast(kind) if c in texts else F.lit(None).cast(kind)

    total = F.count(F.lit(1))
    rows = per_column(df, df.columns, {
        "count": lambda c: total, "non_null_count": lambda c: F.count(c),
        "null_percentage": lambda c: F.coalesce(F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, total), F.lit(0.0)),
        "unique_count": lambda c: F.count_distinct(c),
        "mean": lambda c: num(c, F.avg), "std": lambda c: num(c, F.stddev_samp),
        "min": lambda c: num(c, F.min), "max": lambda c: num(c, F.max),
        "avg_length": lambda c: text(c, F.avg, "double"), "max_length": lambda c: text(c, F.max, "int"),
        "min_length": lambda c: text(c, F.min, "int")})
    if not numbers:
        return rows.withColumn("median", F.lit(None).cast("double"))
    medians = quantiles(long_form(df, numbers, "double"), ["column"], "value", {"median": 0.5})
    return rows.join(medians, "column", "left")
