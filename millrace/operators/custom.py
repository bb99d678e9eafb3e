"""Caller-supplied functions: stages, checks and item maps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, handler: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return df.transform(handler)


def value_check(check: Callable[[object], bool]) -> Callable[[Column], Column]:
    """A Python predicate as a column rule, run on Arrow batches; an error is a failed check."""

    def safe(v) -> bool:
        try:
            return bool(check(v))
        except Exception:  # noqa: BLE001
            return False

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return values.map(safe).astype(bool)

    return run


def item_map(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """``fn`` over every row; rows for which it fails are dropped."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append(fn(row))
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(out) if out else pd.DataFrame(columns=names)

    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    return df.mapInPandas(run, schema)
