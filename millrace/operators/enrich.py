"""Derived columns. Every rule reads the input row, never an earlier rule's result."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_float
from .filters import predicate

_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
}


def calculated(expression: str, fields: list[str]) -> Column:
    """``{field}`` template over numbers and ``+ - * / ( )``.

    Null when a field is null or no number, or on division by zero.
    """

    def column(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](column(node.left), column(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -column(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in fields:
            return to_float(node.id)
        raise ValueError(f"only arithmetic over the listed fields is allowed: {expression!r}")

    return column(ast.parse(re.sub(r"\{(\w+)\}", r"\1", expression), mode="eval").body)


def date_part(field: str, part: str) -> Column:
    when = F.col(field).try_cast("timestamp")
    return {"year": F.year, "month": F.month, "day": F.dayofmonth}[part](when)


def conditional(df: DataFrame, conditions: list[dict], default=None) -> Column:
    """First true condition gives its ``result`` (its ``value`` without one)."""
    chain = None
    for c in conditions:
        test = F.coalesce(predicate(df, c), F.lit(False))
        result = F.lit(c.get("result", c.get("value")))
        chain = F.when(test, result) if chain is None else chain.when(test, result)
    return chain.otherwise(F.lit(default))


def inline_lookup(field: str, table: dict, default=None) -> Column:
    """Lookup in a small dictionary written in the rule; ``lookup`` joins a table instead."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(F.map_contains_key(entries, F.col(field)), F.try_element_at(entries, F.col(field))).otherwise(F.lit(default))


def _rule_column(df: DataFrame, rule: dict) -> Column:
    kind = rule["type"]
    if kind == "constant":
        return F.lit(rule.get("value"))
    if kind == "lookup":
        return inline_lookup(rule["lookup_field"], rule["lookup_table"], rule.get("default_value"))
    if kind in ("calculated", "calculated_field"):
        return calculated(rule["expression"], rule["source_fields"])
    if kind == "concatenation":
        return F.concat_ws(rule.get("separator", " "), *rule["source_fields"])
    if kind == "date_derived":
        source = rule.get("source_field") or rule["source_fields"][0]
        return date_part(source, rule.get("date_part", "year"))
    if kind == "conditional":
        return conditional(df, rule["conditions"], rule.get("default_value"))
    raise ValueError(f"unknown enrichment {kind!r}")


def enrich(df: DataFrame, rules: list[dict]) -> DataFrame:
    """All rules in one projection over the input columns."""
    return df.select("*", *[_rule_column(df, r).alias(r["target_field"]) for r in rules])


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, target: str, default=None) -> DataFrame:
    """Left join to a lookup table with distinct keys; missing keys take the default.

    No hint is set: Spark broadcasts the table while its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles (with skew splitting)
    above it.
    """
    right = table.select(F.col(table_key).alias("_k"), F.col(value).alias(target), F.lit(True).alias("_hit"))
    joined = df.join(right, df[key] == right["_k"], "left")
    made = F.when(F.col("_hit"), F.col(target)).otherwise(F.lit(default))
    return joined.select(*[df[c] for c in df.columns], made.alias(target))
