"""Projection and mapping over whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import (
    apply_transform,
    calculate_concat,
    calculate_multiply,
    calculate_sum,
    is_filled,
    row_completeness,
    strip,
)


def map_fields(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Keep only the target fields.

    Rule: ``target_field``, ``source_field``, ``transformation``, ``parameters``,
    ``default_value``. An absent source column takes the default; a null stays null.
    """
    out = []
    for rule in rules:
        source, target = rule.get("source_field"), rule.get("target_field", rule.get("source_field"))
        if source in df.columns:
            out.append(apply_transform(F.col(source), rule.get("transformation"), rule.get("parameters")).alias(target))
        else:
            out.append(F.lit(rule.get("default_value")).alias(target))
    return df.select(*out)


def add_field(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def rename_field(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def calculate_field(df: DataFrame, name: str, calculation: dict) -> DataFrame:
    """sum, concat or multiply over fields; anything else gives null."""
    kind = calculation.get("type")
    if kind == "sum":
        made = calculate_sum(*[f for f in calculation["fields"] if f in df.columns])
    elif kind == "concat":
        made = calculate_concat(calculation["fields"], calculation.get("separator", " "))
    elif kind == "multiply" and {calculation["field1"], calculation["field2"]} <= set(df.columns):
        made = calculate_multiply(calculation["field1"], calculation["field2"])
    else:
        made = F.lit(None).cast("double")
    return df.withColumn(name, made)


def convert_type(df: DataFrame, field: str, target: str) -> DataFrame:
    """int, float, str or bool; another name or an absent field changes nothing."""
    if field not in df.columns:
        return df
    text = isinstance(df.schema[field].dataType, T.StringType)
    return df.withColumn(field, apply_transform(F.col(field), target, {"text": text}))


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _on_text(df: DataFrame, change) -> DataFrame:
    texts = set(_text_columns(df))
    return df.select(*[change(c).alias(c) if c in texts else F.col(c) for c in df.columns])


def strip_whitespace(df: DataFrame) -> DataFrame:
    return _on_text(df, strip)


def lowercase_keys(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def normalize_keys(df: DataFrame) -> DataFrame:
    """Names stripped, lower case, blanks to ``_``; text values stripped."""
    return strip_whitespace(df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns]))


def default_columns(df: DataFrame, now: Column) -> DataFrame:
    """Adds ``processed_at`` and the share of filled fields, strips texts."""
    seen = df.withColumn("processed_at", now)
    scored = seen.withColumn("data_quality_score", row_completeness(seen.columns))
    return strip_whitespace(scored)


def drop_nulls(df: DataFrame) -> DataFrame:
    """Rows where every field is neither null, '' nor 'NULL'."""
    keep = F.lit(True)
    for c in df.columns:
        keep = keep & is_filled(c) & (F.col(c).cast("string") != "NULL")
    return df.filter(keep)


def standardize_schema(df: DataFrame, target: T.StructType, names: dict[str, str] | None = None) -> DataFrame:
    """Bring a source to one schema; ``names`` maps target to source columns."""
    names = names or {}
    out = []
    for field in target.fields:
        source = names.get(field.name, field.name)
        value = F.col(source) if source in df.columns else F.lit(None)
        out.append(value.try_cast(field.dataType).alias(field.name))
    return df.select(*out)
