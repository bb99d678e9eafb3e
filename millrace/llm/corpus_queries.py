"""Registered queries on pairs and groups of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import chunks, decontaminate, minhash
from .registry import query


@query("op1_near_duplicates")
def op1_near_duplicates(t) -> DataFrame:
    """Class of near-duplicates of all documents."""
    return minhash.classes(t.documents)


@query("op4_decontamination")
def op4_decontamination(t) -> DataFrame:
    """Benchmark items found in documents, exact or edited."""
    return decontaminate.matches(t.documents, t.benchmark)


@query("op6_repeated_passages")
def op6_repeated_passages(t) -> DataFrame:
    """Passages of 50 words and more that stand in several documents."""
    return chunks.passages(t.documents)
