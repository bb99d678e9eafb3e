"""Lineage (LIN) and vectors (VEC)."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import lineage as L
from ..operators import vectors as X
from .profiling import rounded
from .registry import query

NOW = dt.datetime(2024, 2, 1)

EDGES = """(SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
WALK = f"""(WITH RECURSIVE e AS (SELECT * FROM {EDGES}), w(root, asset, depth) AS (
 SELECT {{a}}, {{b}}, 1 FROM e WHERE {{cond}} UNION SELECT w.root, e.{{b}}, w.depth + 1 FROM w JOIN e ON w.asset = e.{{a}} WHERE depth < 10)
 SELECT root, asset, min(depth) AS depth FROM w GROUP BY root, asset)"""


def edges(t):
    e = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    c = t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    o = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    return e.unionByName(c).unionByName(o)


def nations(t):
    return t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("asset"))


@query("lin01_upstream", "SELECT * FROM " + WALK.format(a="dst", b="src", cond="dst LIKE 'o%'"))
def _(t):
    return L.upstream(edges(t), t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("a")))


@query("lin02_downstream", "SELECT * FROM " + WALK.format(a="src", b="dst", cond="src LIKE 'r%'"))
def _(t):
    return L.downstream(edges(t), t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("a")))


# In this tree every path is the only one, so a nation lies between its region and all below it.
CRIT = f"""(WITH d AS (SELECT root, count(*) AS down FROM {WALK.format(a="src", b="dst", cond="src LIKE 'n%'")} GROUP BY root),
 v AS (SELECT count(*)::DOUBLE AS n FROM (SELECT src AS a FROM {EDGES} UNION SELECT dst FROM {EDGES}))
 SELECT 'n' || n_nationkey AS asset, 1 AS up, coalesce(down, 0) AS down, n_nationkey / 25.0 AS q, coalesce(down, 0) / ((n - 1) * (n - 2)) AS b,
  least(1.0, least(coalesce(down, 0) / 10.0, 1) * 0.4 + 0.01 + n_nationkey / 25.0 * 0.2 + coalesce(down, 0) / ((n - 1) * (n - 2)) * 0.2) AS c
 FROM v, nation LEFT JOIN d ON root = 'n' || n_nationkey)"""


def critical(t):
    assets = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("asset"), (F.col("n_nationkey") / 25.0).alias("quality_score"))
    return L.criticality(edges(t), assets)


@query("lin03_criticality", f"SELECT asset, up::BIGINT AS upstream_count, down AS downstream_count, round(b, 10)::DOUBLE AS betweenness, round(c, 8)::DOUBLE AS criticality FROM {CRIT}")
def _(t):
    out = critical(t).select("asset", "upstream_count", "downstream_count", "betweenness", "criticality")
    return rounded(rounded(out, "betweenness", digits=10), "criticality", digits=8)


@query("lin04_impact_severity", f"""
WITH x AS (SELECT count(*) AS n, sum(c) AS s FROM {CRIT}), y AS (SELECT n, CASE WHEN n > 10 THEN 0.4 WHEN n > 5 THEN 0.2 ELSE 0 END + s * 0.1 + 0.25 AS s FROM x)
SELECT n AS affected_assets, round(s, 6)::DOUBLE AS score, CASE WHEN s > 0.7 THEN 'critical' WHEN s > 0.5 THEN 'high' WHEN s > 0.3 THEN 'medium' ELSE 'low' END AS severity FROM y""")
def _(t):
    return rounded(L.impact_severity(critical(t), 25), "score").select("affected_assets", "score", "severity")


_CODES = ["select a from b", "try:\n  x()\nexcept:\n  pass", "update t set a = 1", "DELETE from x where y; assert z",
          "a join b join c join d join e", "select distinct a from b order by a", "DROP it\n" + "line\n" * 60]
_CONF = ["0.9", "0.95", "0.9", "0.95", "0.9", "0.9", "0.7"]
_RISK = ["no_error_handling", "", "bulk_update,no_error_handling", "record_deletion,no_error_handling", "many_joins,no_error_handling",
         "distinct_order_by,no_error_handling", "data_deletion,no_error_handling"]


def codes(t):
    return t.customer.select("c_custkey", F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("c_custkey") % 7 + 1).cast("int")).alias("code"))


@query("lin05_confidence", f"""SELECT c_custkey, round(least(1.0, [{', '.join(_CONF)}][c_custkey % 7 + 1] + CASE WHEN c_custkey % 2 = 0 THEN 0.1 ELSE 0 END), 4)::DOUBLE AS confidence FROM customer""")
def _(t):
    kind = F.when(F.col("c_custkey") % 2 == 0, "join").otherwise("etl")
    return rounded(codes(t).select("c_custkey", L.confidence(F.col("code"), kind).alias("confidence")), "confidence", digits=4)


@query("lin06_risk_factors", "SELECT c_custkey, [" + ", ".join(f"'{r}'" for r in _RISK) + "][c_custkey % 7 + 1] AS risks FROM customer")
def _(t):
    return codes(t).select("c_custkey", F.array_join(L.risk_factors(F.col("code")), ",").alias("risks"))


@query("lin07_propagate_quality", """
SELECT 'o' || o_orderkey AS root, round(0.95 * (c_acctbal / 10000 + 0.8 + 0.9) / 3, 8) AS predicted_quality FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    assets = (t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("asset"), (F.col("c_acctbal") / 10000).alias("quality_score"))
              .unionByName(nations(t).withColumn("quality_score", F.lit(0.8)))
              .unionByName(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("asset"), F.lit(0.9).alias("quality_score"))))
    roots = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("a"))
    return rounded(L.propagate_quality(edges(t), assets, roots), "predicted_quality", digits=8)


@query("lin08_find_cycles", """
SELECT 'n' || n_nationkey || '>' || 'r' || n_regionkey AS cycle FROM nation WHERE n_nationkey % 5 = 0""")
def _(t):
    back = t.nation.filter("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return L.find_cycles(edges(t).unionByName(back)).select(F.array_join("cycle", ">").alias("cycle"))


@query("lin08_long_cycle", """
SELECT string_agg(printf('n%02d', n_nationkey), '>' ORDER BY n_nationkey) AS cycle, true AS complete FROM nation WHERE n_nationkey < 14""")
def _(t):
    """A ring of fourteen nations, and the other nations behind each other as a tail of it."""
    name = lambda k: F.format_string("n%02d", k)
    k = F.col("n_nationkey").cast("int")
    ring = t.nation.select(name(k).alias("src"), name(F.when(k == 13, 0).otherwise(k + 1).cast("int")).alias("dst"))
    return L.find_cycles(ring).select(F.array_join("cycle", ">").alias("cycle"), "complete")


@query("lin08_components", """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 40 AS src, (o_custkey * 7 + o_orderkey) % 40 AS dst FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 11 = 0
 UNION SELECT 100 + o_custkey % 60, 100 + (o_custkey % 60 + 1) % 60 FROM orders WHERE o_custkey % 60 <> 30),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT a.src::BIGINT AS asset, least(a.src, min(b.src))::BIGINT AS component FROM (SELECT DISTINCT src FROM r WHERE src = dst) a
JOIN r c ON c.src = a.src JOIN r b ON b.dst = a.src AND b.src = c.dst GROUP BY a.src""")
def _(t):
    """Strong components of a graph drawn from all orders: a dense part and a chain of customers."""
    o, k, n = t.orders, F.col("o_custkey"), F.col("o_orderkey")
    dense = o.filter((k % 3 == 0) & (n % 11 == 0)).select((k % 40).alias("src"), ((k * 7 + n) % 40).alias("dst"))
    chain = o.filter(k % 60 != 30).select((100 + k % 60).alias("src"), (100 + (k % 60 + 1) % 60).alias("dst"))
    return L.strong_components(dense.unionByName(chain))


@query("lin09_opportunities", f"""
SELECT asset, 'caching' AS type, 'high' AS priority FROM {CRIT} WHERE down > 15
UNION ALL SELECT asset, 'quality_improvement', 'critical' FROM {CRIT} WHERE q < 0.7 AND c > 0.6""")
def _(t):
    return L.opportunities(critical(t))


@query("lin10_report", f"""
SELECT asset, up::BIGINT AS upstream_count, down AS downstream_count, round(c, 8)::DOUBLE AS criticality, CASE WHEN down > 0 THEN 'intermediate' ELSE 'sink' END AS graph_position,
 CASE WHEN c > 0.8 THEN 'critical' WHEN c > 0.6 THEN 'high' WHEN c > 0.4 THEN 'medium' ELSE 'low' END AS criticality_level FROM {CRIT}""")
def _(t):
    return rounded(L.lineage_report(critical(t)), "criticality", digits=8)


@query("lin11_register_run", f"""
SELECT 'source_c' || c_custkey AS src, 'target_n' || c_nationkey AS dst, md5([{", ".join("'" + c.replace(chr(10), "' || chr(10) || '") + "'" for c in _CODES)}][c_custkey % 7 + 1]) AS transformation_hash FROM customer""")
def _(t):
    rows = t.customer.join(codes(t), "c_custkey").select(
        F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), "code", F.lit("etl").alias("transformation_type"))
    return L.register_run(rows)[1].select("src", "dst", "transformation_hash")


@query("lin11_register_assets", """
SELECT 'source_c' || c_custkey AS asset FROM customer UNION SELECT 'target_n' || c_nationkey FROM customer""")
def _(t):
    rows = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"),
                             F.lit("select 1").alias("code"), F.lit("etl").alias("transformation_type"))
    return L.register_run(rows)[0]


_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


@query("vec01_knn", f"""
WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_DOT.format(a='embedding', b='qe')} / (sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='qe', b='qe')})) AS s
 FROM embeddings, q) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 25""")
def _(t):
    q = list(t.embeddings.filter("vec_id = 7").head()["embedding"])
    return rounded(X.knn(t.embeddings, "embedding", q, 25, "vec_id", 0.2).select("vec_id", "score"), "score")


@query("vec02_text_of", r"""
SELECT conv_id, turn, md5(role || ' ' || regexp_replace(text, '^\s+|\s+$', '', 'g') || ' deep') AS digest FROM conversations""")
def _(t):
    doc = F.to_json(F.struct("role", "turn", F.struct("text", F.array(F.struct(F.lit("lost").alias("x"))).alias("n"), F.array(F.lit("deep"), F.lit(" ")).alias("l")).alias("body")))
    docs = t.conversations.select("conv_id", "turn", doc.alias("doc"))
    return docs.select("conv_id", "turn", F.md5(X.text_of("doc")).alias("digest"))


# Documents with labels as stored entries.
ENTRIES = """(SELECT doc_id, lang AS type, [source, lang] AS tags, CASE quality WHEN 1 THEN 8 ELSE 3 END AS importance,
 TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 700 AS INTEGER)) AS created_at, TIMESTAMP '2024-01-31' + to_minutes(CAST(doc_id % 1440 AS INTEGER)) AS last_accessed,
 n_chars % 120 AS access_count, (doc_id % 10) / 10.0 AS confidence, CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-01-15' END AS expires_at
 FROM documents JOIN labels USING (doc_id))"""


def entries(t):
    k = F.col("doc_id")
    rows = t.documents.join(t.labels, "doc_id")
    at = lambda day, unit, mod: F.timestamp_micros(F.unix_micros(F.lit(dt.datetime(2024, 1, day)).cast("timestamp")) + (k % mod) * unit)
    return rows.select(
        "doc_id", F.col("lang").alias("type"), F.array("source", "lang").alias("tags"), F.when(F.col("quality") == 1, 8).otherwise(3).alias("importance"),
        at(1, 3_600_000_000, 700).alias("created_at"), at(31, 60_000_000, 1440).alias("last_accessed"),
        (F.col("n_chars") % 120).alias("access_count"), ((k % 10) / 10.0).alias("confidence"),
        F.when(k % 13 == 0, F.lit(dt.datetime(2024, 1, 15)).cast("timestamp")).alias("expires_at"))


_REC = "1 / (1 + (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_accessed)) / 3600000000.0)"


@query("vec03_hybrid_rank", f"""
SELECT doc_id, round(s, 6)::DOUBLE AS relevance FROM (SELECT doc_id, importance / 10.0 * 0.5 + {_REC} * 0.3 + least(access_count / 100.0, 1) * 0.2 AS s FROM {ENTRIES}
 WHERE (expires_at IS NULL OR expires_at >= TIMESTAMP '2024-02-01') AND type = 'en' AND importance >= 3 AND confidence >= 0.2
 AND epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at) <= 700 * 3600000000) ORDER BY s DESC, doc_id LIMIT 40""")
def _(t):
    out = X.hybrid_rank(entries(t), F.lit(NOW).cast("timestamp"), "doc_id", 40, types=["en"], tags=["en"], min_importance=3, max_age_hours=700, min_confidence=0.2)
    return rounded(out.select("doc_id", "relevance"), "relevance")


@query("vec03_hybrid_rank_similar", f"""
SELECT doc_id, round(s, 6)::DOUBLE AS relevance FROM (SELECT doc_id, CASE WHEN doc_id < 50 THEN importance / 10.0 * 0.3 + {_REC} * 0.2 + least(access_count / 100.0, 1) * 0.1 + (1 - doc_id / 50.0) * 0.4
 ELSE importance / 10.0 * 0.5 + {_REC} * 0.3 + least(access_count / 100.0, 1) * 0.2 END AS s FROM {ENTRIES}
 WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2024-02-01') ORDER BY s DESC, doc_id LIMIT 40""")
def _(t):
    rows = entries(t).withColumn("position", F.when(F.col("doc_id") < 50, F.col("doc_id"))).withColumn("results", F.lit(50))
    out = X.hybrid_rank(rows, F.lit(NOW).cast("timestamp"), "doc_id", 40, position="position")
    return rounded(out.select("doc_id", "relevance"), "relevance")


@query("vec04_substring_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def _(t):
    return X.substring_search(t.documents, "text", "The").select("doc_id")


@query("vec05_decay", """
WITH d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 5 WHEN 3 THEN 3 ELSE 1 END AS v, ts FROM events),
x AS (SELECT event_id, v, v * pow(0.99, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3600000000.0 / 24) AS y FROM d)
SELECT event_id, CAST(CASE WHEN y >= 10 THEN 10 WHEN y >= 8 THEN 8 WHEN y >= 5 THEN 5 WHEN y >= 3 THEN 3 WHEN y >= 1 THEN 1 ELSE v END AS INTEGER) AS importance FROM x""")
def _(t):
    v = F.element_at(F.array(*[F.lit(i) for i in (10, 8, 5, 3, 1)]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", X.decayed_importance(v, F.col("ts"), F.lit(NOW)).alias("importance"))


@query("vec06_cleanup", """
SELECT event_id FROM events WHERE NOT (event_id % 10 = 0 AND ts + to_days(20) < TIMESTAMP '2024-02-10' OR event_id % 3 = 0
 AND epoch_us(TIMESTAMP '2024-02-10') - epoch_us(ts) > 30 * 86400000000 AND event_id % 4 < 2)""")
def _(t):
    k = F.col("event_id")
    rows = t.events.select(
        "event_id", F.col("ts").alias("created_at"), F.when(k % 3 == 0, 1).otherwise(5).alias("importance"), (k % 4).alias("access_count"),
        F.when(k % 10 == 0, F.expr("ts + interval 20 days")).alias("expires_at"))
    return X.cleanup(rows, F.lit(dt.datetime(2024, 2, 10)).cast("timestamp_ntz")).select("event_id")
