"""Filter rules compiled to one predicate, so that the scan can push it down.

Rule: ``field``, ``operator``, ``value``, ``null_handling`` (exclude | include).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import to_float


def _is_number(df: DataFrame, field: str) -> bool:
    return isinstance(df.schema[field].dataType, T.NumericType)


def _number(df: DataFrame, field: str) -> Column:
    # A numeric column is compared as it is, so the comparison reaches the file scan.
    return F.col(field) if _is_number(df, field) else to_float(field)


def _text(df: DataFrame, field: str) -> Column:
    return F.col(field) if isinstance(df.schema[field].dataType, T.StringType) else F.col(field).cast("string")


OPERATORS = {
    "equals": lambda d, f, v: F.col(f) == F.lit(v),
    "not_equals": lambda d, f, v: F.col(f) != F.lit(v),
    "greater_than": lambda d, f, v: _number(d, f) > float(v),
    "greater_equal": lambda d, f, v: _number(d, f) >= float(v),
    "less_than": lambda d, f, v: _number(d, f) < float(v),
    "less_equal": lambda d, f, v: _number(d, f) <= float(v),
    "in": lambda d, f, v: F.col(f).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.lit(False),
    "not_in": lambda d, f, v: ~F.col(f).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.lit(True),
    "contains": lambda d, f, v: F.contains(_text(d, f), F.lit(str(v))),
    "not_contains": lambda d, f, v: ~F.contains(_text(d, f), F.lit(str(v))),
    "starts_with": lambda d, f, v: _text(d, f).startswith(str(v)),
    "ends_with": lambda d, f, v: _text(d, f).endswith(str(v)),
    "regex": lambda d, f, v: _text(d, f).rlike(str(v)),
    "is_null": lambda d, f, v: F.col(f).isNull(),
    "is_not_null": lambda d, f, v: F.col(f).isNotNull(),
}

# Other spellings of the operator names.
ALIASES = {
    "==": "equals", "eq": "equals",
    "!=": "not_equals", "ne": "not_equals",
    ">": "greater_than", "gt": "greater_than",
    ">=": "greater_equal", "gte": "greater_equal",
    "<": "less_than", "lt": "less_than",
    "<=": "less_equal", "lte": "less_equal",
}


def predicate(df: DataFrame, rule: dict) -> Column:
    """One rule as a boolean column. An unknown operator keeps every row."""
    name = rule.get("operator", "equals")
    name = ALIASES.get(name, name)
    field = rule["field"]
    include = rule.get("null_handling", "exclude") == "include"
    if field not in df.columns:
        return F.lit(include or name == "is_null")
    if name in ("is_null", "is_not_null"):
        return OPERATORS[name](df, field, None)
    if name not in OPERATORS:
        return F.lit(True) if include else F.col(field).isNotNull()
    made = OPERATORS[name](df, field, rule.get("value"))
    if include:
        return F.col(field).isNull() | F.coalesce(made, F.lit(False))
    # A null comparison already drops the row; constants still must not pass nulls.
    return made if name not in ("in", "not_in") else F.col(field).isNotNull() & made


def all_of(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that meet every rule, as a single filter."""
    if not rules:
        return df
    return df.filter(reduce(lambda a, b: a & b, [predicate(df, r) for r in rules]))


def typed_condition(df: DataFrame, field: str, operator: str, value) -> Column:
    """Orders only numeric columns, searches only texts; a missing field is false."""
    if field not in df.columns:
        return F.lit(False)
    numeric = _is_number(df, field)
    texty = isinstance(df.schema[field].dataType, T.StringType)
    name = ALIASES.get(operator, operator)
    if name in ("greater_than", "less_than", "greater_equal", "less_equal") and not numeric:
        return F.lit(False)
    if name == "contains" and not texty:
        return F.lit(False)
    return F.coalesce(OPERATORS[name](df, field, value), F.lit(False)) if name in OPERATORS else F.lit(False)
