"""Run registered queries on Spark and their SQL in DuckDB and compare the rows.

usage: python tools/compare.py [--sf 0.01] [--merge] [pattern ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import fnmatch
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

from millrace.catalog import ORACLES, QUERIES  # noqa: E402
from millrace.session import get_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (float, np.floating)):
        v = float(v)
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else float(f"{v:.12g}")
    if isinstance(v, (dt.datetime,)):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def kind(t: str) -> str:
    t = t.lower()
    if "[]" in t or t.startswith("array"):
        return "array"
    if t.startswith(("struct", "map")):
        return t[:3]
    if any(x in t for x in ("int", "long")) and "interval" not in t:
        return "int"
    if any(x in t for x in ("double", "float")):
        return "float"
    if "decimal" in t:
        return "decimal"
    if "timestamp" in t:
        return "timestamp"
    if t in ("string", "varchar"):
        return "text"
    return t


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--cpus", default="8")
    ap.add_argument("--merge", action="store_true", help="let AQE merge small partitions (off: helpers see several)")
    ap.add_argument("patterns", nargs="*")
    a = ap.parse_args()
    folder = f"/root/testdata/sf{a.sf}"
    spark = get_session("compare", f"local[{a.cpus}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": str(a.merge).lower(), "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(folder):
        con.sql(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    names = [n for n in QUERIES if not a.patterns or any(fnmatch.fnmatch(n, p) for p in a.patterns)]
    bad, slow = [], []
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, folder)
            got, cols = rows_of(df.columns, df.collect())
            took = time.time() - t0
            slow.append((took, n))
            if n not in ORACLES:
                print(f"rows  {n}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            rel = con.sql(ORACLES[n])
            want, wcols = rows_of(rel.columns, rel.fetchall())
            if cols != wcols:
                raise AssertionError(f"columns {cols} != {wcols}")
            types = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
            off = {c: (kind(t), types[c]) for c, t in df.dtypes if kind(t) != types[c]}
            if off:
                print(f"TYPE  {n}: {off}", flush=True)
                bad.append(n)
            if got != want:
                diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
                raise AssertionError(f"{len(got)} vs {len(want)} rows; first: {diff}")
            print(f"ok    {n}: {len(got)} rows {took:.1f}s" + ("  EMPTY" if not got else ""), flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(n)
            text = str(e) if isinstance(e, AssertionError) else traceback.format_exc(limit=-2)
            print(f"FAIL  {n}: {text[:900]}", flush=True)
    slow.sort(reverse=True)
    print("slowest:", [(n, round(t, 1)) for t, n in slow[:8]])
    print(f"{len(names) - len(set(bad))} of {len(names)} fine; bad: {sorted(set(bad))}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
