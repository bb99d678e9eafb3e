"""Cleaning rules ``{type, fields, ...}``; no fields means every text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

RULES = {
    "trim_whitespace": lambda c, r: S.strip(c),
    "remove_duplicates": lambda c, r: S.distinct_words(c),
    "standardize_case": lambda c, r: S.standardize_case(c, r.get("case", "lower")),
    "remove_special_chars": lambda c, r: F.regexp_replace(c, r.get("pattern", r"[^a-zA-Z0-9\s]"), r.get("replacement", "")),
    "normalize_numbers": lambda c, r: S.to_float(c),
    "fill_nulls": lambda c, r: S.fill_nulls(c, r.get("fill_value", "")),
    "validate_format": lambda c, r: S.validate_format(c, r["pattern"], r.get("default_value")),
}


def clean(df: DataFrame, rules: list[dict]) -> DataFrame:
    """All rules in order, folded per column into one projection.

    An unknown rule changes nothing. ``fill_nulls`` keeps the column type.
    """
    made: dict[str, Column] = {c: F.col(c) for c in df.columns}
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for rule in rules:
        step = RULES.get(rule["type"])
        if step is None:
            continue
        for field in rule.get("fields") or (texts if rule["type"] != "fill_nulls" else df.columns):
            if field in made:
                made[field] = step(made[field], rule)
    return df.select(*[c.alias(n) for n, c in made.items()])
