"""Joins in which a null key is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_key(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; keys that are null on both sides meet."""
    names = [keys] if isinstance(keys, str) else list(keys)
    marks = [f"_right_{i}" for i in range(len(names))]
    renamed = right.withColumnsRenamed(dict(zip(names, marks)))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(m)) for n, m in zip(names, marks)])
    return left.join(renamed, same, how).drop(*marks)
