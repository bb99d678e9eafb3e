"""Vector search, text extraction and ranking of stored entries."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Importance levels, highest first.
IMPORTANCE = {"critical": 10, "high": 8, "medium": 5, "low": 3, "trivial": 1}


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine to one given vector, in double."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    return F.try_divide(dot(vector, q), F.sqrt(dot(vector, vector)) * F.lit(length))


def knn(df: DataFrame, vector: str, query: list[float], k: int, key: str, threshold: float = 0.7) -> DataFrame:
    """The ``k`` most similar rows at or above ``threshold``; each task keeps its own best ``k``."""
    scored = df.withColumn("score", cosine(F.col(vector), query))
    return scored.filter(F.col("score") >= threshold).orderBy(F.col("score").desc(), key).limit(k)


def text_of(c: str | Column, depth: int = 3) -> Column:
    """All non-blank strings of a JSON text down to ``depth`` levels, joined by a blank."""

    def strings(value, level: int):
        if level >= depth:
            return
        items = value.values() if isinstance(value, dict) else value
        for item in items:
            if isinstance(item, str):
                if item.strip():
                    yield item.strip()
            elif isinstance(item, (dict, list)):
                yield from strings(item, level + 1)

    def one(text):
        if text is None:
            return None
        value = json.loads(text)
        if isinstance(value, str):
            return value.strip()
        return " ".join(strings(value, 0)) if isinstance(value, (dict, list)) else ""

    @F.pandas_udf("string")
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return extract(F.col(c) if isinstance(c, str) else c)


def importance_value(name: Column) -> Column:
    chain = None
    for n, v in IMPORTANCE.items():
        chain = F.when(name == n, v) if chain is None else chain.when(name == n, v)
    return chain


def _hours(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 3_600_000_000


def hybrid_rank(
    df: DataFrame, now: Column, key: str, k: int, types: list[str] | None = None, tags: list[str] | None = None,
    min_importance: int | None = None, max_age_hours: float | None = None, min_confidence: float | None = None,
    position: str | None = None,
) -> DataFrame:
    """Filters, then the best ``k`` by importance, recency and access count.

    Columns: type, tags, importance (number), created_at, last_accessed,
    access_count, confidence, expires_at. With ``position`` (0 for the most
    similar) and its total ``results`` the similarity order joins the score.
    """
    rows = df.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
    if types:
        rows = rows.filter(F.col("type").isin(types))
    for tag in tags or []:
        rows = rows.filter(F.array_contains("tags", tag))
    if min_importance is not None:
        rows = rows.filter(F.col("importance") >= min_importance)
    if max_age_hours is not None:
        rows = rows.filter(_hours(now, F.col("created_at")) <= max_age_hours)
    if min_confidence:
        rows = rows.filter(F.col("confidence") >= min_confidence)
    recency = 1 / (1 + _hours(now, F.col("last_accessed")))
    frequency = F.least(F.col("access_count") / 100.0, F.lit(1.0))
    importance = F.col("importance") / 10.0
    score = importance * 0.5 + recency * 0.3 + frequency * 0.2
    if position:
        similar = 1 - F.col(position) / F.greatest(F.col("results"), F.lit(1))
        score = F.when(F.col(position).isNotNull(), importance * 0.3 + recency * 0.2 + frequency * 0.1 + similar * 0.4).otherwise(score)
    return rows.withColumn("relevance", score).orderBy(F.col("relevance").desc(), key).limit(k)


def substring_search(df: DataFrame, text: str, words: str) -> DataFrame:
    return df.filter(F.contains(F.lower(F.col(text)), F.lit(words.lower())))


def decayed_importance(value: Column, last_accessed: Column, now: Column, factor: float = 0.99) -> Column:
    """value·factor^days, cut to the highest level not above it; below every level it stays."""
    decayed = value * F.pow(F.lit(factor), _hours(now, last_accessed) / 24)
    chain = None
    for level in IMPORTANCE.values():
        chain = F.when(decayed >= level, level) if chain is None else chain.when(decayed >= level, level)
    return chain.otherwise(value).cast("int")


def to_remove(now: Column, trivial: int = IMPORTANCE["trivial"]) -> Column:
    """Expired, or trivial, older than 30 days and used less than twice."""
    old = _hours(now, F.col("created_at")) / 24 > 30
    expired = F.col("expires_at").isNotNull() & (F.col("expires_at") < now)
    return expired | ((F.col("importance") == trivial) & old & (F.col("access_count") < 2))


def cleanup(df: DataFrame, now: Column) -> DataFrame:
    return df.filter(~F.coalesce(to_remove(now), F.lit(False)))
