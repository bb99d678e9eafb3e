"""Measures of many columns in one aggregation, as one row per column."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.scalars import strip, to_float


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def per_column(df: DataFrame, columns: list[str], measures: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """One row per column with every measure, from a single pass.

    A measure must give the same type for every column.
    """
    one = df.agg(
        *[
            F.struct(F.lit(c).alias("column"), *[fn(c).alias(m) for m, fn in measures.items()]).alias(f"_c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.inline(F.array(*[f"_c{i}" for i in range(len(columns))])))


def long_form(df: DataFrame, columns: list[str], cast: str) -> DataFrame:
    """Rows ``(column, value)`` for the given columns."""
    return df.select(*[F.col(c).cast(cast).alias(c) for c in columns]).unpivot([], columns, "column", "value")


def blank(c: str | Column) -> Column:
    """Null, '' or white space only."""
    x = F.col(c) if isinstance(c, str) else c
    return x.isNull() | (strip(x.cast("string")) == "")


def matches_any(x: Column, patterns: list[str]) -> Column:
    return x.rlike("|".join(f"(?:{p})" for p in patterns))


def is_digits(x: Column) -> Column:
    return x.rlike(r"^[0-9]+$")


def value_class(df: DataFrame, c: str) -> Column:
    """Class of one value: the column type, or what a text looks like."""
    kind = df.schema[c].dataType
    x = F.col(c)
    if isinstance(kind, T.StringType):
        made = (
            F.when(to_float(x).isNotNull(), F.when(F.contains(x, F.lit(".")), "float").otherwise("integer"))
            .when(matches_any(x, P.DATE_CLASS), "date")
            .otherwise("string")
        )
    elif isinstance(kind, T.BooleanType):
        made = F.lit("boolean")
    elif isinstance(kind, T.IntegralType):
        made = F.lit("integer")
    elif isinstance(kind, T.NumericType):
        made = F.lit("float")
    else:
        made = F.lit("unknown")
    return F.when(x.isNotNull(), made)


def majority(counts: Mapping[str, Column], fallback: str) -> Column:
    """Name of the largest count; the earlier name wins a tie."""
    best = F.greatest(*counts.values())
    chain = F.when(best == 0, fallback)
    for name, n in counts.items():
        chain = chain.when(n == best, name)
    return chain.otherwise(fallback)
