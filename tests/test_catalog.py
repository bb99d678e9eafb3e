"""Registered queries against DuckDB on the smallest tables.

All of them with MILLRACE_ALL=1; otherwise every seventh and the flagship.
"""

import os
import re

import duckdb
import pytest

from millrace.catalog import ORACLES, QUERIES
from tools.compare import kind, rows_of

from .conftest import SF

NAMES = sorted(ORACLES)
if not os.environ.get("MILLRACE_ALL"):
    NAMES = sorted({"agg01_rules_by_group", *NAMES[::7]})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    got, cols = rows_of(df.columns, df.collect())
    want, wcols = rows_of(rel.columns, rel.fetchall())
    assert cols == wcols
    types = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert {c: kind(t) for c, t in df.dtypes} == types
    assert got == want


@pytest.mark.parametrize("name", ["win01_row_number", "win06_average_rank", "agg07_median", "tsa09_alert_episodes", "smp02_systematic", "pro11_percentiles_lower"])
def test_no_window_over_one_partition(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in text
    assert not re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", text)


def test_names():
    assert len(QUERIES) > 300
    assert set(ORACLES) <= set(QUERIES)
