"""Validation rules as failure columns, reports in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.scalars import is_filled, starts_matching, to_float
from .measures import blank, is_digits, numeric_columns, per_column, text_columns, value_class


def looks_like(df: DataFrame, field: str, kind: str) -> Column:
    """Whether a non-null value has the declared type."""
    x, text = F.col(field), F.col(field).cast("string")
    have = df.schema[field].dataType
    if kind == "string":
        return F.lit(isinstance(have, T.StringType))
    if kind == "integer":
        return F.lit(True) if isinstance(have, T.IntegralType) else is_digits(text)
    if kind == "float":
        return F.lit(True) if isinstance(have, T.NumericType) else to_float(x).isNotNull()
    if kind == "boolean":
        return F.lit(True) if isinstance(have, T.BooleanType) else F.lower(text).isin("true", "false", "1", "0")
    if kind == "date":
        return text.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.lit(True)


def failure(df: DataFrame, rule: dict) -> Column:
    """True where the rule fails; nulls pass every rule but ``required``."""
    kind, field = rule["type"], rule["field"]
    if field not in df.columns:
        return F.lit(True)
    x = F.col(field)
    if kind == "required":
        return ~is_filled(field)
    if kind == "data_type":
        ok = looks_like(df, field, rule["expected_type"])
    elif kind == "range":
        value = x if field in numeric_columns(df) else to_float(x)
        ok = value.isNotNull()
        low, high = rule.get("min", rule.get("min_value")), rule.get("max", rule.get("max_value"))
        if low is not None:
            ok = ok & (value >= low)
        if high is not None:
            ok = ok & (value <= high)
    elif kind == "pattern":
        ok = starts_matching(x, rule["pattern"])
    elif kind == "enum":
        ok = x.isin(list(rule.get("allowed", rule.get("allowed_values", []))))
    elif kind == "custom":
        ok = rule["check"](x)
        return ~F.coalesce(ok, F.lit(False))
    else:
        ok = F.lit(True)
    return x.isNotNull() & ~F.coalesce(ok, F.lit(False))


def rule_name(rule: dict) -> str:
    return rule.get("name") or f"{rule['type']}:{rule['field']}"


def failed_rules(df: DataFrame, rules: list[dict], with_value: bool = False) -> Column:
    """The failed rules of a row as an array."""
    made = []
    for r in rules:
        known = r["field"] in df.columns
        parts = [
            F.lit(rule_name(r)).alias("rule"),
            F.lit(r["type"] if known else "field_missing").alias("rule_type"),
            F.lit(r["field"]).alias("field"),
            F.lit(r.get("severity", "error")).alias("severity"),
        ]
        if with_value:
            parts.append((F.col(r["field"]).cast("string") if known else F.lit(None).cast("string")).alias("value"))
        made.append(F.when(failure(df, r), F.struct(*parts)))
    return F.array_compact(F.array(*made))


def validate(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows, valid and invalid rows and the failures of each rule: one pass, one row per rule."""
    fails = [failure(df, r) for r in rules]
    bad = fails[0]
    for f in fails[1:]:
        bad = bad | f
    one = df.agg(
        F.count("*").alias("total_records"),
        F.count_if(~bad).alias("valid_records"),
        F.count_if(bad).alias("invalid_records"),
        F.array(*[
            F.struct(F.lit(rule_name(r)).alias("rule"), F.lit(r["type"]).alias("rule_type"), F.count_if(f).alias("errors"))
            for r, f in zip(rules, fails)
        ]).alias("rules"),
    )
    return one.select("total_records", "valid_records", "invalid_records", F.inline("rules"))


def error_rows(df: DataFrame, key: list[str], rules: list[dict]) -> DataFrame:
    """One row per record and failed rule, with the value that failed."""
    found = df.select(*key, F.explode(failed_rules(df, rules, with_value=True)).alias("e"))
    return found.select(*key, "e.rule", "e.rule_type", "e.field", "e.severity", "e.value")


def schema_check(df: DataFrame, fields: list[dict], primary_key: Sequence[str] = ()) -> DataFrame:
    """Declared fields against the data: rows ``(field, check, errors)``.

    Field: ``name``, ``required``, ``nullable``, ``unique``, ``min_length``,
    ``max_length``, ``min_value``, ``max_value``, ``pattern``, ``allowed_values``.
    The columns of ``primary_key`` must be declared.
    """
    known = {f["name"] for f in fields}
    if len(known) != len(fields) or "" in known:
        raise ValueError("field names must be distinct and not empty")
    if not set(primary_key) <= known:
        raise ValueError(f"primary key is not among the fields: {sorted(set(primary_key) - known)}")
    checks: list[tuple[str, str, Column]] = []
    for f in fields:
        n = f["name"]
        if n not in df.columns:
            if f.get("required"):
                checks.append((n, "missing_field", F.count(F.lit(1))))
            continue
        x, text = F.col(n), F.col(n).cast("string")
        if not f.get("nullable", True):
            checks.append((n, "null", F.count_if(x.isNull())))
        if f.get("unique"):
            checks.append((n, "unique", F.count(x) - F.count_distinct(x)))
        if "min_length" in f:
            checks.append((n, "min_length", F.count_if(F.length(text) < f["min_length"])))
        if "max_length" in f:
            checks.append((n, "max_length", F.count_if(F.length(text) > f["max_length"])))
        if "min_value" in f:
            checks.append((n, "min_value", F.count_if(x < f["min_value"])))
        if "max_value" in f:
            checks.append((n, "max_value", F.count_if(x > f["max_value"])))
        if "pattern" in f:
            checks.append((n, "pattern", F.count_if(~starts_matching(x, f["pattern"]))))
        if "allowed_values" in f:
            checks.append((n, "allowed_values", F.count_if(~x.isin(f["allowed_values"]))))
    for c in df.columns:
        if c not in known:
            checks.append((c, "unknown_field", F.count(F.lit(1))))
    rows = [
        F.struct(F.lit(n).alias("field"), F.lit(k).alias("check"), e.cast("long").alias("errors")) for n, k, e in checks
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def required_share(df: DataFrame, fields: list[str], max_null_pct: float = 20.0) -> DataFrame:
    """Missing count and share per required field, and the score 1 − issues / fields."""
    rows = per_column(df, fields, {
        "missing": lambda c: F.count_if(~is_filled(c)),
        "missing_pct": lambda c: F.coalesce(F.try_divide(F.count_if(~is_filled(c)) * 100.0, F.count(F.lit(1))), F.lit(0.0)),
    })
    rows = rows.withColumn("issue", F.col("missing_pct") > max_null_pct)
    score = rows.agg(F.greatest(F.lit(0.0), 1 - F.count_if("issue") / F.lit(max(len(fields), 1))).alias("s"))
    return rows.withColumn("quality_score", score.scalar())


def email_ok(x: Column) -> Column:
    return x.rlike(P.EMAIL_LOOSE)


def phone_ok(x: Column) -> Column:
    return F.regexp_replace(x, r"[\s\-\(\)]", "").rlike(P.PHONE_DIGITS)


def date_ok(x: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in P.DATE_FORMATS]).isNotNull()


def non_empty(x: Column) -> Column:
    return ~blank(x)


def positive_number(x: Column) -> Column:
    return x.try_cast("double") >= 0


NAMED_CHECKS = {
    "email_format": (email_ok, "error"),
    "phone_format": (phone_ok, "error"),
    "date_format": (date_ok, "error"),
    "non_empty": (non_empty, "warning"),
    "positive_number": (positive_number, "error"),
}


def bound_rules(columns: list[str], extra: dict[str, tuple] | None = None) -> list[dict]:
    """Named checks bound to columns by equal or partial name."""
    checks = {**NAMED_CHECKS, **(extra or {})}
    out = []
    for c in columns:
        for name, (check, severity) in checks.items():
            if any(part in c.lower() for part in P.RULE_FIELDS.get(name, [""])):
                out.append({"name": name, "type": "custom", "field": c, "check": check, "severity": severity})
    return out


def dataset_report(df: DataFrame, rules: list[dict]) -> DataFrame:
    """A row is valid when no rule of severity error fails; score in percent."""
    errors = F.lit(False)
    warnings = F.lit(False)
    for r in rules:
        if r.get("severity", "error") == "error":
            errors = errors | failure(df, r)
        else:
            warnings = warnings | failure(df, r)
    total, valid = F.count("*"), F.count_if(~errors)
    return df.agg(
        total.alias("total_records"),
        valid.alias("valid_records"),
        F.count_if(errors).alias("invalid_records"),
        F.count_if(warnings).alias("records_with_warnings"),
        F.coalesce(F.try_divide(valid, total) * 100, F.lit(0.0)).alias("quality_score"),
    )


def report_lines(df: DataFrame, key: list[str], rules: list[dict], errors: int = 10, warnings: int = 5) -> DataFrame:
    """The first errors and warnings of a dataset, by key."""
    rows = error_rows(df, key, rules).drop("value")
    first = rows.filter("severity = 'error'").orderBy(*key, "rule").limit(errors)
    return first.unionByName(rows.filter("severity = 'warning'").orderBy(*key, "rule").limit(warnings))


def completeness_check(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Filled share per field, issue flag, and the mean share as score."""
    rows = per_column(df, df.columns, {
        "completeness": lambda c: F.coalesce(F.avg(F.when(is_filled(c), 1.0).otherwise(0.0)), F.lit(0.0))})
    rows = rows.withColumn("issue", F.col("completeness") < threshold)
    return rows.withColumn("score", rows.agg(F.avg("completeness").alias("s")).scalar())


def uniqueness_check(df: DataFrame, fields: list[str]) -> DataFrame:
    rows = per_column(df, fields, {"duplicates": lambda c: F.count(c) - F.count_distinct(c)})
    score = rows.agg(F.when(F.max("duplicates") > 0, 0.0).otherwise(1.0).alias("s"))
    return rows.withColumn("score", score.scalar())


CLASSES = ["integer", "float", "date", "string", "boolean", "unknown"]


def class_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count of every value class per column; each value is classified once."""
    classes = df.select(*[value_class(df, c).alias(c) for c in columns])
    return per_column(classes, columns, {k: (lambda c, k=k: F.count_if(F.col(c) == k)) for k in CLASSES})


def consistency_check(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A column with more than one value class is an issue; score 0.8 with any issue."""
    rows = class_counts(df, columns or df.columns)
    kinds = sum((F.when(F.col(k) > 0, 1).otherwise(0) for k in CLASSES), F.lit(0))
    rows = rows.select("column", kinds.alias("classes"))
    return rows.withColumn("score", rows.agg(F.when(F.max("classes") > 1, 0.8).otherwise(1.0).alias("s")).scalar())


def type_uniformity(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Largest class share per column, averaged over columns."""
    rows = class_counts(df, columns or df.columns)
    total = sum((F.col(k) for k in CLASSES), F.lit(0))
    share = F.try_divide(F.greatest(*CLASSES).cast("double"), total)
    return rows.agg(F.coalesce(F.avg(share), F.lit(1.0)).alias("consistency"))


def validity_check(df: DataFrame, required: list[str]) -> DataFrame:
    """max(0, 1 − missing required values / (2·rows))."""
    missing = sum((F.when(~is_filled(c), 1).otherwise(0) for c in required), F.lit(0))
    return df.agg(
        F.coalesce(F.sum(missing), F.lit(0)).alias("issues"),
        F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.sum(missing), F.count(F.lit(1)) * 2), F.lit(0.0))).alias("score"),
    )


def core_quality(df: DataFrame, unique: list[str], required: list[str], threshold: float = 0.8) -> DataFrame:
    """Mean of the four rule scores; passed at 0.7 and above without any issue. One pass."""
    texts = text_columns(df)
    classed = df.select("*", *[value_class(df, c).alias(f"_class_{c}") for c in texts])
    filled = [F.coalesce(F.avg(F.when(is_filled(c), 1.0).otherwise(0.0)), F.lit(0.0)) for c in df.columns]
    dups = [F.count(c) - F.count_distinct(c) for c in unique]
    mixed = [
        sum((F.when(F.count_if(F.col(f"_class_{c}") == k) > 0, 1).otherwise(0) for k in CLASSES), F.lit(0)) for c in texts
    ]
    missing = sum((F.when(~is_filled(c), 1).otherwise(0) for c in required), F.lit(0))
    one = classed.agg(
        F.count("*").alias("n"), F.array(*filled).alias("filled"), F.array(*dups).alias("dups"),
        F.array(*mixed).alias("mixed"), F.sum(missing).alias("missing"))
    scores = one.select(
        (F.aggregate("filled", F.lit(0.0), lambda a, x: a + x) / F.size("filled")).alias("completeness"),
        F.exists("filled", lambda x: x < threshold).alias("sparse"),
        F.when(F.exists("dups", lambda x: x > 0), 0.0).otherwise(1.0).alias("uniqueness"),
        F.when(F.exists("mixed", lambda x: x > 1), 0.8).otherwise(1.0).alias("consistency"),
        F.greatest(F.lit(0.0), 1 - F.col("missing") / (F.col("n") * 2)).alias("validity"),
    )
    total = (F.col("completeness") + F.col("uniqueness") + F.col("consistency") + F.col("validity")) / 4
    clean = ~F.col("sparse") & (F.col("uniqueness") == 1) & (F.col("consistency") == 1) & (F.col("validity") == 1)
    return scores.select(
        "completeness", "uniqueness", "consistency", "validity", total.alias("overall"),
        ((total >= 0.7) & clean).alias("passed"))


def cell_completeness(df: DataFrame) -> DataFrame:
    filled = sum((F.when(is_filled(c), 1).otherwise(0) for c in df.columns), F.lit(0))
    return df.agg(
        F.coalesce(F.try_divide(F.sum(filled), F.count(F.lit(1)) * len(df.columns)), F.lit(0.0)).alias("completeness"))


def record_validity(df: DataFrame) -> DataFrame:
    """Share of rows with any value."""
    any_value = F.coalesce(*[F.col(c).cast("string") for c in df.columns]).isNotNull()
    return df.agg(F.coalesce(F.avg(F.when(any_value, 1.0).otherwise(0.0)), F.lit(0.0)).alias("validity"))


def structure_check(df: DataFrame, identifying: list[str]) -> DataFrame:
    """Not empty, and every row has one of the identifying fields."""
    have = [c for c in identifying if c in df.columns]
    named = F.coalesce(*[F.col(c).cast("string") for c in have]).isNotNull() if have else F.lit(False)
    return df.agg((F.count("*") > 0).alias("not_empty"), F.count_if(~named).alias("unnamed_rows"))


DIMENSIONS = {
    "completeness": ("complete_fields", "total_fields"),
    "accuracy": ("accurate_records", "total_records"),
    "consistency": ("consistent_checks", "total_checks"),
    "validity": ("valid_values", "total_values"),
    "uniqueness": ("unique_values", "total_unique_values"),
}


def dimension_scores(metrics: DataFrame) -> DataFrame:
    """Ratio per dimension; 0.5 without data, 0 over nothing."""
    out = []
    for name, (part, whole) in DIMENSIONS.items():
        if part in metrics.columns and whole in metrics.columns:
            ratio = F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
            score = F.when(F.col(part).isNull() & F.col(whole).isNull(), 0.5).otherwise(ratio)
        else:
            score = F.lit(0.5)
        out.append(score.alias(name))
    return metrics.select("*", *out)


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def recent(ts: Column, now: Column, days: int) -> Column:
    """Not older than ``days``."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return micros(now) - micros(ts) <= days * 86_400_000_000


def load_gate(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Error count per rule and whether the load may go on: one aggregation."""
    rows = validate(df, rules)
    blocked = rows.agg((F.sum("errors") > 0).alias("b"))
    return rows.select("rule", "errors").withColumn("load_blocked", blocked.scalar())


