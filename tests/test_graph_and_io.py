"""Lineage against brute force; sources, sinks, SQL guard, chains, privacy."""

import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import custom, lineage, privacy, vectors
from millrace.plans import chain, sqlsurface
from millrace.session import scratch_path
from millrace.sources import payloads, readers, sinks

EDGES = [("a", "c"), ("b", "c"), ("c", "d"), ("c", "e"), ("d", "f"), ("e", "f"), ("a", "f"), ("f", "g"), ("x", "y")]


def shortest(edges):
    """(s, t) → all shortest paths."""
    nodes = {n for e in edges for n in e}
    out = {}
    for s in nodes:
        paths, seen = [[s]], {s}
        while paths:
            ahead = [p + [d] for p in paths for a, d in edges if a == p[-1] and d not in seen]
            for p in ahead:
                out.setdefault((s, p[-1]), []).append(p)
            seen |= {p[-1] for p in ahead}
            paths = ahead
    return nodes, out


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES + EDGES[:2], "src string, dst string")


def test_walks(spark, edges):
    _, paths = shortest(EDGES)
    roots = spark.createDataFrame([("f",), ("y",)], "a string")
    up = {(r["root"], r["asset"]): r["depth"] for r in lineage.upstream(edges, roots).collect()}
    assert up == {(t, s): len(p[0]) - 1 for (s, t), p in paths.items() if t in ("f", "y")}
    assert lineage.upstream(edges, roots, depth=1).count() == 4


def test_betweenness(spark, edges):
    nodes, paths = shortest(EDGES)
    got = {r["asset"]: r["betweenness"] for r in lineage.betweenness(edges, spark.createDataFrame([(n,) for n in nodes], "a string")).collect()}
    n = len(nodes)
    for v in nodes:
        b = sum(sum(v in p[1:-1] for p in ps) / len(ps) for ps in paths.values())
        assert got[v] == pytest.approx(b / ((n - 1) * (n - 2)))


def test_cycles(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("z", "a"), ("q", "q")]
    got = sorted(r["cycle"] for r in lineage.find_cycles(spark.createDataFrame(e, "src string, dst string")).collect())
    want = []
    nodes = sorted({n for x in e for n in x})
    for k in range(1, len(nodes) + 1):
        for p in itertools.permutations(nodes, k):
            if p[0] == min(p) and all((p[i], p[(i + 1) % k]) in e for i in range(k)):
                want.append(list(p))
    assert got == sorted(want)


def test_criticality_of_missing_quality(spark, edges):
    row = lineage.criticality(edges, spark.createDataFrame([("a", None)], "asset string, quality_score double")).head()
    assert row["criticality"] == pytest.approx(5 / 10 * 0.4 + 0.5 * 0.2)


def test_criticality_walks_the_edges_once(spark, edges, monkeypatch):
    settled = []
    settle = lineage.settle
    monkeypatch.setattr(lineage, "settle", lambda df: settled.append(df.columns) or settle(df))
    nodes, paths = shortest(EDGES)
    some = ["c", "d", "f", "a"]  # some lie upstream of others
    rows = {r["asset"]: r for r in lineage.criticality(edges, spark.createDataFrame([(v, 0.5) for v in some], "asset string, quality_score double")).collect()}
    # The edges are made distinct and kept once, not for each walk.
    assert sum(len(c) == 2 for c in settled) == 1
    for v in some:
        assert rows[v]["downstream_count"] == sum(s == v for s, _ in paths) and rows[v]["upstream_count"] == sum(t == v for _, t in paths)
        b = sum(sum(v in p[1:-1] for p in ps) / len(ps) for ps in paths.values())
        assert rows[v]["betweenness"] == pytest.approx(b / ((len(nodes) - 1) * (len(nodes) - 2)))


def test_files_round_trip(spark):
    df = spark.createDataFrame([(1, "ä,b", None), (2, "c;d", "x")], "id int, name string, note string")
    for kind, reader in [("csv", readers.read_csv), ("json", readers.read_jsonl), ("parquet", readers.read_parquet), ("orc", readers.read_orc)]:
        path = scratch_path(spark, kind)
        assert sinks.write_file(df, path, kind) == 2
        assert sorted(r["name"] for r in reader(spark, path).collect()) == ["c;d", "ä,b"]


def test_delimiter_is_found(spark):
    path = scratch_path(spark, "semi")
    sinks.write_file(spark.createDataFrame([("id;name",), ("1;x",)], "value string").coalesce(1), path, "text")
    assert readers.read_csv(spark, path).columns == ["id", "name"]


def test_bad_json_fails(spark):
    path = scratch_path(spark, "bad")
    sinks.write_file(spark.createDataFrame([('{"a":1}',), ("{broken",)], "value string"), path, "text")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, path, "a int").collect()


def test_inline_and_unknown_sources(spark):
    assert readers.inline_source(spark, "id,name\n1,x\n2,y").count() == 2
    assert readers.inline_source(spark, [{"a": 1}, {"b": 2}]).columns == ["a", "b"]
    with pytest.raises(readers.SourceError):
        readers.read_auto(spark, "/tmp/x.docx")


def test_tables(spark):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS io_db LOCATION '{scratch_path(spark, 'db')}'")
    spark.catalog.setCurrentDatabase("io_db")
    try:
        df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
        with pytest.raises(sinks.LoadError):
            sinks.append(df, "nope_table")
        with pytest.raises(sinks.LoadError):
            sinks.append(df, "x; drop table y")
        sinks.append(df, "people", create_table=True)
        sinks.append(df, "people")
        assert spark.table("people").count() == 4
        sinks.replace(df, "people")
        sinks.upsert_table(spark, "people", spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id int, v string"), ["id"], ["v"])
        assert sorted(map(tuple, spark.table("people").collect())) == [(1, "a"), (2, "d"), (3, "e")]
        with pytest.raises(sinks.LoadError):
            sinks.upsert(df, df, ["absent"], ["v"])
    finally:
        spark.catalog.setCurrentDatabase("default")


def test_fan_out_reports_failures(spark):
    rows = sinks.fan_out(spark.range(3), [(scratch_path(spark, "ok"), "parquet"), (scratch_path(spark, "bad"), "nosuchformat")]).collect()
    assert [(r["status"], r["records"]) for r in rows] == [("completed", 3), ("failed", 0)]


def test_batches_hold_all_rows(spark):
    rows = sinks.api_batches(spark.range(25), ["id"], 10).orderBy("batch").collect()
    assert [r["records"] for r in rows] == [10, 10, 5]
    assert [x["id"] for r in rows for x in json.loads(r["payload"])] == list(range(25))


def test_envelopes(spark):
    docs = ['[{"a":1},{"a":2}]', '{"data":[{"a":3}],"items":[{"a":9}]}', '{"data":7,"items":[{"a":4}]}', '{"a":5}']
    df = spark.createDataFrame([(d,) for d in docs], "p string")
    got = [json.loads(r["record"])["a"] for r in payloads.unwrap_envelope(df, "p", []).collect()]
    assert got == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("sql,level,ok", [
    ("SELECT * FROM employees WHERE department = 'Engineering'", "standard", True),
    ("DROP TABLE x", "standard", False), ("select 1; delete from x", "standard", False), ("select 1 /* x */", "standard", False),
    ("SELECT a FROM t UNION SELECT b FROM u", "standard", False), ("WITH x AS (SELECT 1) SELECT * FROM x", "standard", True),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "strict", False), ("SELECT sp_who", "strict", False)])
def test_guard(spark, sql, level, ok):
    assert (sqlsurface.violation(sql, level) is None) == ok
    assert spark.range(1).select(sqlsurface.is_safe(F.lit(sql), level)).head()[0] == ok
    if not ok:
        with pytest.raises(sqlsurface.RefusedQuery):
            sqlsurface.query(spark, sql, level=level)


def test_query_limit_and_parameters(spark):
    spark.range(100).createOrReplaceTempView("numbers")
    out = sqlsurface.query(spark, "SELECT id FROM numbers WHERE id >= :least", limit=5, parameters={"least": 50})
    assert out.rows.count() == 5
    assert out.truncated.head()["truncated"]
    own = sqlsurface.query(spark, "SELECT id FROM numbers LIMIT 30", limit=5)
    assert own.rows.count() == 30 and not own.truncated.head()["truncated"]
    assert [r["line"] for r in sqlsurface.to_csv(spark.sql("SELECT 1 AS a, 'x,y' AS b")).collect()] == ["a,b", '1,"x,y"']


def test_chain(spark):
    spec = {"stages": [
        {"name": "read", "type": "extractor", "config": {"input": "rows"}},
        {"name": "shape", "type": "transformer", "config": {"operations": ["strip_whitespace", "nope", "deduplicate"]}},
        {"name": "check", "type": "validator", "config": {"required_fields": ["name"], "max_null_pct": 10}}]}
    rows = spark.createDataFrame([("1", " a"), ("1", "a"), ("2", None)], "id string, name string")
    metrics = {}
    report = chain.run(spark, spec, {"rows": rows}, metrics=metrics).head()
    assert (report["missing"], report["issue"], report["quality_score"]) == (1, True, 0.0)
    assert metrics["read"].get["records"] == 3 and metrics["shape"].get["records"] == 2
    with pytest.raises(ValueError):
        chain.typed(rows, {"type": "nope"})


def test_custom_functions(spark):
    df = spark.range(10)
    out = custom.item_map(df, lambda r: {"id": r["id"], "inv": 10 / r["id"]}, "id long, inv double")
    assert out.count() == 9
    check = custom.value_check(lambda v: 1 / (v - 3) > 0)
    assert df.filter(check(F.col("id"))).count() == 6


def test_privacy(spark):
    df = spark.createDataFrame([("mail a@b.co or 555-123-4567, card 4111-1111-1111-1111, 123-45-6789",)], "t string")
    assert df.select(privacy.redact("t").alias("t")).head()["t"] == (
        "mail [EMAIL_REDACTED] or [PHONE_REDACTED], card [CARD_REDACTED], [SSN_REDACTED]")
    doc = json.dumps({"a": {"user_TOKEN": {"deep": [1]}, "list": ["password: x", "fine"]}, "key": 5})
    got = json.loads(spark.createDataFrame([(doc,)], "d string").select(privacy.redact_json("d").alias("d")).head()["d"])
    assert got == {"a": {"user_TOKEN": "[REDACTED]", "list": ["[REDACTED - SENSITIVE DATA DETECTED]", "fine"]}, "key": "[REDACTED]"}


def test_noise_is_repeatable_and_fades(spark):
    df = spark.range(1000).selectExpr("cast(id AS double) AS v")
    a, b = privacy.dp_aggregates(df, "v", 1.0, 10.0, 3).head(), privacy.dp_aggregates(df, "v", 1.0, 10.0, 3).head()
    assert a == b and a["dp_sum"] != 499500.0
    assert abs(privacy.dp_aggregates(df, "v", 1e12, 1.0).head()["dp_sum"] - 499500.0) < 1e-3
    assert privacy.exponential_pick(df, "v", 7, 1.0).count() == 7


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "id int, e array<float>")
    got = [(r["id"], round(r["score"], 6)) for r in vectors.knn(df, "e", [2.0, 0.0], 5, "id", 0.7).collect()]
    assert got == [(1, 1.0), (2, 0.707107)]
    doc = '{"a":" x ","b":{"c":"y","d":{"e":"deep","f":{"g":"lost"}}},"l":["z",3,["w"]]}'
    assert spark.createDataFrame([(doc,)], "d string").select(vectors.text_of("d").alias("t")).head()["t"] == "x y deep z w"


def test_decay(spark):
    now = dt.datetime(2024, 1, 31)
    df = spark.createDataFrame([(10, now), (10, now - dt.timedelta(days=10)), (1, now - dt.timedelta(days=10))], "v int, at timestamp")
    got = [r[0] for r in df.select(vectors.decayed_importance(F.col("v"), F.col("at"), F.lit(now))).collect()]
    assert got == [10, 8, 1]


def test_yaml_with_roles(spark):
    out = scratch_path(spark, "out") + ".json"
    text = f"""
pipeline:
  name: people
  stages:
    - name: get
      role: extractor
      source: |
        id,name
        1, Ann
        1, Ann
        2,
    - name: shape
      role: transformer
      operations: [normalize, deduplicate, drop_nulls]
    - name: save
      role: loader
      destination: {out}
"""
    chain.run(spark, text)
    assert [r["name"] for r in spark.read.json(out).collect()] == ["Ann"]


def _reached(pairs):
    """Strong components by plain reachability."""
    nodes = {x for e in pairs for x in e}
    after = {x: set() for x in nodes}
    for x in nodes:
        todo = [x]
        while todo:
            for a, b in pairs:
                if a == todo[-1] and b not in after[x]:
                    after[x].add(b)
                    todo.insert(0, b)
            todo.pop()
    return {x: min(y for y in nodes if y in after[x] and x in after[y]) for x in nodes if x in after[x]}


def test_strong_components(spark):
    import random

    rnd = random.Random(8)
    pairs = {(rnd.randrange(14), rnd.randrange(14)) for _ in range(22)}
    pairs |= {(100 + k, 100 + (k + 1) % 9) for k in range(9)} | {(200, 201), (201, 202), (300, 300), (3, 100), (202, 300)}
    df = spark.createDataFrame(sorted(pairs), "src long, dst long")
    got = {r["asset"]: r["component"] for r in lineage.strong_components(df.unionByName(df)).collect()}
    assert got == _reached(pairs)
    assert lineage.strong_components(df.filter("src > 1000")).count() == 0


def test_dense_core_ends_with_its_components(spark):
    """A complete graph of 12 assets has over 10^8 simple cycles; a ring beside it is still listed."""
    dense = [(f"d{a:02d}", f"d{b:02d}") for a in range(12) for b in range(12) if a != b]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r1", "d00")]
    df = spark.createDataFrame(dense + ring, "src string, dst string")
    got = lineage.find_cycles(df).collect()
    assert [r["cycle"] for r in got] == [["r1", "r2", "r3"]] and not got[0]["complete"]
    members = lineage.strong_components(df)
    sizes = {r["component"]: (r["assets"], r["edges"], r["dimension"]) for r in lineage.component_sizes(df, members).collect()}
    assert sizes == {"d00": (12, 132, 121), "r1": (3, 3, 1)}
