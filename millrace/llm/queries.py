"""All registered queries of this subpackage, and the pipeline beside it."""

import corpus_pipeline

from . import corpus_queries, model_queries, native_queries, scan_queries  # noqa: F401
from .registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
