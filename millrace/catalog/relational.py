"""Enrichment, joins, aggregation, windows, sorts, set operations (ENR, JOI, AGG, WIN, SRT, SET)."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import enrich as E
from ..operators import joins as J
from ..operators import ordering as O
from ..operators.filters import all_of
from .registry import query

DAY = dt.datetime


@query("enr01_calculated", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / nullif(l_tax * 100, 0), 8) AS net FROM lineitem""")
def _(t):
    rule = {"type": "calculated", "target_field": "net", "source_fields": ["l_extendedprice", "l_discount", "l_tax"],
            "expression": "{l_extendedprice}*(1-{l_discount})/({l_tax}*100)"}
    return E.enrich(t.lineitem, [rule]).select("l_orderkey", "l_linenumber", F.round("net", 8).alias("net"))


@query("enr02_lookup", """
SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer
LEFT JOIN (SELECT n_nationkey + 5 AS k, n_name FROM nation) ON c_nationkey = k""")
def _(t):
    # Keys moved on by five: some customers find no row, some rows no customer.
    table = t.nation.select((F.col("n_nationkey") + 5).alias("k"), "n_name")
    return E.lookup(t.customer, table, "c_nationkey", "k", "n_name", "nation", "unknown").select("c_custkey", "nation")


@query("enr02_inline_lookup", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders""")
def _(t):
    rule = {"type": "lookup", "target_field": "state", "lookup_field": "o_orderstatus", "lookup_table": {"F": "done", "O": "open"}, "default_value": "other"}
    return E.enrich(t.orders, [rule]).select("o_orderkey", "state")


@query("enr03_concatenation", """
SELECT p_partkey, concat_ws('/', p_name, CASE WHEN p_size > 25 THEN p_brand END, p_type) AS label FROM part""")
def _(t):
    holed = t.part.withColumn("p_brand", F.when(F.col("p_size") > 25, F.col("p_brand")))
    rule = {"type": "concatenation", "target_field": "label", "separator": "/", "source_fields": ["p_name", "p_brand", "p_type"]}
    return E.enrich(holed, [rule]).select("p_partkey", "label")


@query("enr04_date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
       CAST(day(o_orderdate) AS INTEGER) AS d FROM orders""")
def _(t):
    rules = [{"type": "date_derived", "target_field": n, "source_fields": ["o_orderdate"], "date_part": p}
             for n, p in (("y", "year"), ("m", "month"), ("d", "day"))]
    return E.enrich(t.orders, rules).select("o_orderkey", "y", "m", "d")


@query("enr05_conditional", """
SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS class
FROM orders""")
def _(t):
    rule = {"type": "conditional", "target_field": "class", "default_value": "other", "conditions": [
        {"field": "o_totalprice", "operator": "greater_than", "value": 400000, "result": "big"},
        {"field": "o_orderstatus", "operator": "equals", "value": "F", "result": "done"}]}
    return E.enrich(t.orders, [rule]).select("o_orderkey", "class")


@query("enr06_constant", "SELECT *, 7 AS weight FROM region")
def _(t):
    return E.enrich(t.region, [{"type": "constant", "target_field": "weight", "value": 7}])


@query("enr07_rule_scope", """
SELECT l_orderkey, l_linenumber, round(l_quantity * 2, 4) AS q2, round(l_quantity + 1, 4) AS q1 FROM lineitem""")
def _(t):
    rules = [
        {"type": "calculated", "target_field": "q2", "source_fields": ["l_quantity"], "expression": "{l_quantity}*2"},
        {"type": "calculated", "target_field": "q1", "source_fields": ["l_quantity"], "expression": "{l_quantity}+1"}]
    return E.enrich(t.lineitem, rules).select("l_orderkey", "l_linenumber", F.round("q2", 4).alias("q2"), F.round("q1", 4).alias("q1"))


@query("joi01_recent_executions", """
SELECT o_orderkey, o_orderdate, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 24 HOUR AND o_orderdate <= TIMESTAMP '1998-08-01'""")
def _(t):
    return J.recent_with(t.orders, t.customer, "o_custkey", "c_custkey", "o_orderdate",
                         "timestamp_ntz'1998-08-01 00:00:00'").select("o_orderkey", "o_orderdate", "c_name")


TOLERANCE = """(
 WITH a AS (SELECT event_id AS a_id, epoch_us(ts) AS a_at, value AS a_value FROM events WHERE event_type = 'click'
            ORDER BY ts DESC, event_id DESC LIMIT 100),
 b AS (SELECT event_id AS b_id, epoch_us(ts) AS b_at, value AS b_value FROM events WHERE event_type = 'view')
 SELECT a_id, b_id, a_value, b_value FROM a JOIN b ON abs(a_at - b_at) <= 300000000
 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY b_at, b_id) = 1)"""


def tolerance(t):
    e = t.events
    return J.tolerance_join(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "ts", "event_id", "value", 300)


@query("joi02_tolerance", f"SELECT * FROM {TOLERANCE}")
def _(t):
    return tolerance(t)


@query("joi03_key_intersection", """
SELECT l_suppkey FROM lineitem GROUP BY l_suppkey
HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)""")
def _(t):
    return J.key_intersection(t.lineitem, "l_suppkey", "l_returnflag")


# A third of the keys on either side meet nothing on the other.
_SIDES = """(SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey END AS k, o_orderkey FROM orders) l"""
_OTHER = """(SELECT CASE WHEN c_custkey % 3 = 1 THEN c_custkey + 10000000 ELSE c_custkey END AS k, c_name FROM customer) r"""
for _kind, _sql in {
    "inner": f"SELECT l.k, o_orderkey, c_name FROM {_SIDES} JOIN {_OTHER} ON l.k = r.k",
    "left": f"SELECT l.k, o_orderkey, c_name FROM {_SIDES} LEFT JOIN {_OTHER} ON l.k = r.k",
    "right": f"SELECT r.k, o_orderkey, c_name FROM {_SIDES} RIGHT JOIN {_OTHER} ON l.k = r.k",
    "full": f"SELECT coalesce(l.k, r.k) AS k, o_orderkey, c_name FROM {_SIDES} FULL JOIN {_OTHER} ON l.k = r.k",
    "left_semi": f"SELECT l.k, o_orderkey FROM {_SIDES} SEMI JOIN {_OTHER} ON l.k = r.k",
    "left_anti": f"SELECT l.k, o_orderkey FROM {_SIDES} ANTI JOIN {_OTHER} ON l.k = r.k",
}.items():

    @query(f"joi04_{_kind}", _sql)
    def _(t, kind=_kind):
        left = t.orders.selectExpr("CASE WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey END AS k", "o_orderkey")
        right = t.customer.selectExpr("CASE WHEN c_custkey % 3 = 1 THEN c_custkey + 10000000 ELSE c_custkey END AS k", "c_name")
        return J.join(left, right, ["k"], kind)


@query("joi05_referential_errors", """
SELECT count(*) AS errors FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey % 4 = 0 THEN -c_custkey ELSE c_custkey END FROM customer)""")
def _(t):
    parents = t.customer.withColumn("c_custkey", F.when(F.col("c_custkey") % 4 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")))
    return J.referential_errors(t.orders, parents, "o_custkey", "c_custkey")


@query("joi06_denormalize", """
SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    return J.denormalize(t.customer, (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")
                         ).select("c_custkey", "n_name", "r_name")


@query("src25_resolve_conflicts", """
WITH s AS (SELECT c_custkey AS id, 'crm' AS source, 0 AS p, c_custkey % 3 AS updated, c_acctbal AS v FROM customer
 UNION ALL SELECT c_custkey + 40, 'billing', 1, c_custkey % 2, c_acctbal + 1 FROM customer
 UNION ALL SELECT c_custkey * 2, 'web', 2, 1, c_acctbal + 2 FROM customer)
SELECT id, source, updated, v FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated DESC, p) = 1""")
def _(t):
    c = t.customer
    crm = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("updated"), F.col("c_acctbal").alias("v"))
    # Each source has ids that another one lacks.
    bill = c.select(
        (F.col("c_custkey") + 40).alias("id"), (F.col("c_custkey") % 2).alias("updated"), (F.col("c_acctbal") + 1).alias("v"))
    web = c.select(
        (F.col("c_custkey") * 2).alias("id"), F.lit(1).cast("long").alias("updated"), (F.col("c_acctbal") + 2).alias("v"))
    return J.resolve_conflicts([("crm", crm), ("billing", bill), ("web", web)], "id", "updated")


@query("agg01_rules_by_group", """
SELECT l_returnflag, l_linestatus, count(l_orderkey) AS n, round(sum(l_quantity), 2) AS sum_qty,
 round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax,
 median(l_extendedprice) AS median_price, round(stddev_samp(l_quantity), 6) AS std_qty,
 count(DISTINCT l_suppkey) AS suppliers
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_quantity > 1
GROUP BY l_returnflag, l_linestatus""")
def _(t):
    rows = all_of(t.lineitem, [{"field": "l_quantity", "operator": ">", "value": 1}])
    rows = rows.filter(F.col("l_shipdate") <= DAY(1998, 9, 2))
    out = A.aggregate(rows, ["l_returnflag", "l_linestatus"], [
        {"field": "l_orderkey", "function": "count", "alias": "n"},
        {"field": "l_quantity", "function": "sum", "alias": "sum_qty"},
        {"field": "l_extendedprice", "function": "avg", "alias": "avg_price"},
        {"field": "l_discount", "function": "min", "alias": "min_disc"},
        {"field": "l_tax", "function": "max", "alias": "max_tax"},
        {"field": "l_extendedprice", "function": "median", "alias": "median_price"},
        {"field": "l_quantity", "function": "stddev", "alias": "std_qty"},
        {"field": "l_suppkey", "function": "distinct_count", "alias": "suppliers"},
    ])
    return (out.withColumn("sum_qty", F.round("sum_qty", 2)).withColumn("avg_price", F.round("avg_price", 4))
            .withColumn("std_qty", F.round("std_qty", 6)))


def _one(name, table, group, field, fn, sql_agg, digits=None):
    alias = f"{fn}_{field}"
    shown = f"round({sql_agg}, {digits})" if digits is not None else sql_agg

    @query(name, f"SELECT {group}, {shown} AS {alias} FROM {table} GROUP BY {group}")
    def _(t):
        out = A.aggregate(getattr(t, table), [group], [{"field": field, "function": fn}])
        return out.withColumn(alias, F.round(alias, digits)) if digits is not None else out


_one("agg02_count", "orders", "o_orderstatus", "o_orderkey", "count", "count(o_orderkey)")
_one("agg03_sum", "lineitem", "l_returnflag", "l_extendedprice", "sum", "sum(l_extendedprice)", 2)
_one("agg04_avg", "lineitem", "l_returnflag", "l_extendedprice", "mean", "avg(l_extendedprice)", 4)
_one("agg05_min", "lineitem", "l_returnflag", "l_extendedprice", "min", "min(l_extendedprice)")
_one("agg06_max", "lineitem", "l_returnflag", "l_extendedprice", "max", "max(l_extendedprice)")
_one("agg07_median", "lineitem", "l_suppkey", "l_extendedprice", "median", "median(l_extendedprice)", 4)
_one("agg08_std", "lineitem", "l_returnflag", "l_quantity", "std", "stddev_samp(l_quantity)", 6)
_one("agg09_distinct_count", "lineitem", "l_returnflag", "l_partkey", "distinct_count", "count(DISTINCT l_partkey)")
_one("agg11_unknown_function", "nation", "n_regionkey", "n_name", "resembles", "count(n_name)")


@query("agg10_concat", """
SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey""")
def _(t):
    return A.aggregate(t.nation, ["n_regionkey"], [
        {"field": "n_name", "function": "concat", "alias": "names", "order_by": ["n_nationkey"]}])


@query("agg10_concat_parts", """
SELECT c_nationkey, part, string_agg(c_name, ', ' ORDER BY c_custkey) AS c_name FROM (
 SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 25 AS part FROM customer)
GROUP BY c_nationkey, part""")
def _(t):
    return A.concat_parts(t.customer, ["c_nationkey"], "c_name", ["c_custkey"], rows=25)


@query("agg12_simple_agg", """
SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 4) AS o_totalprice_avg,
 min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, count(*) AS o_orderpriority_count
FROM orders GROUP BY o_orderstatus""")
def _(t):
    out = A.simple_agg(t.orders, ["o_orderstatus"], [
        ("sum", "o_totalprice"), ("avg", "o_totalprice"), ("min", "o_totalprice"), ("max", "o_totalprice"), ("count", "o_orderpriority")])
    return (out.withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2))
            .withColumn("o_totalprice_avg", F.round("o_totalprice_avg", 4)))


@query("agg13_collect_groups", """
SELECT CAST(n_regionkey AS VARCHAR) AS group_key, 0::BIGINT AS chunk, count(*) AS n,
 string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey""")
def _(t):
    out = A.collect_groups(t.nation, "n_regionkey", ["n_nationkey"])
    return out.select("group_key", "chunk", F.size("rows").cast("long").alias("n"),
                      F.array_join(F.transform("rows", lambda r: r["n_name"]), ",").alias("names"))


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END"


def status():
    return F.expr(_STATUS)


@query("agg14_activity_summary", f"""
SELECT user_id, count(*) AS total_activities, count(*) FILTER ({_STATUS} = 'completed') AS completed,
 count(*) FILTER ({_STATUS} = 'failed') AS failed, round(avg(value) + 1e-9, 6) AS avg_duration,
 min(ts) AS first_activity, max(ts) AS last_activity FROM events GROUP BY user_id""")
def _(t):
    out = A.activity_summary(t.events, "user_id", status(), "value", "ts")
    return out.withColumn("avg_duration", F.round(F.col("avg_duration") + 1e-9, 6))


_RUNS = """(SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed'
 ELSE 'running' END AS status, o_totalprice AS duration, o_orderdate AS ts FROM orders)"""


def runs(t):
    """Orders read as runs: F completed, P failed, O running."""
    return t.orders.select("o_orderkey", "o_custkey", F.expr(
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END").alias("status"),
        F.col("o_totalprice").alias("duration"), F.col("o_orderdate").alias("ts"))


@query("agg15_run_statistics", f"""
SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
 round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 6)::DOUBLE AS success_rate,
 round(avg(duration) FILTER (status = 'completed'), 4) AS avg_duration FROM {_RUNS}
WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'""")
def _(t):
    out = A.run_statistics(runs(t), "status", "duration", "ts", DAY(1996, 1, 1), DAY(1998, 12, 31))
    return out.withColumn("success_rate", F.round("success_rate", 6)).withColumn("avg_duration", F.round("avg_duration", 4))


@query("agg16_task_rollup", """
WITH x AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'running' END AS s FROM lineitem)
SELECT l_orderkey, count(*) AS tasks, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed,
 count(*) FILTER (s = 'running') AS running, round(100.0 * count(*) FILTER (s = 'completed') / count(*), 4)::DOUBLE AS success_pct,
 round(100.0 * count(*) FILTER (s = 'failed') / count(*), 4)::DOUBLE AS failure_pct FROM x GROUP BY l_orderkey""")
def _(t):
    s = F.expr("CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'running' END")
    out = A.task_rollup(t.lineitem, "l_orderkey", s)
    return out.withColumn("success_pct", F.round("success_pct", 4)).withColumn("failure_pct", F.round("failure_pct", 4))


@query("agg17_top_k", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def _(t):
    return A.top_k(t.events, "user_id", 10)


@query("agg18_failure_analysis", """
WITH g AS (
 SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n, avg(o_totalprice) AS a, min(o_totalprice) AS f,
  max(o_totalprice) AS s FROM orders GROUP BY o_orderstatus
 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), avg(o_totalprice), min(o_totalprice), max(o_totalprice)
 FROM orders GROUP BY o_orderpriority)
SELECT dimension, value, n, round(a, 4) AS avg_time, f AS fastest, s AS slowest,
 row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) = 1 AS most_common FROM g""")
def _(t):
    return A.failure_analysis(t.orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("avg_time", F.round("avg_time", 4))


@query("agg20_latest_per_key", """
SELECT user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    return A.latest_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("agg21_metric_summary", """
SELECT event_type, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg,
 arg_max(value, ts) AS latest FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type""")
def _(t):
    out = A.metric_summary(t.events, "event_type", "value", ["ts", "event_id"], F.lit(DAY(2024, 1, 20)).cast("timestamp_ntz"))
    return out.withColumn("avg", F.round("avg", 6))


@query("agg22_value_counts", "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def _(t):
    return A.value_counts_by(t.conversations, "role")


@query("agg23_audit_report", """
SELECT count(*) AS events, count(*) FILTER (event_type IN ('signup')) AS consent,
 count(*) FILTER (event_type IN ('click', 'view')) AS processing FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""")
def _(t):
    return A.audit_report(t.events, "ts", "event_type", DAY(2024, 1, 5), DAY(2024, 1, 20),
                          {"consent": ["signup"], "processing": ["click", "view"]})


@query("agg24_consensus_vote", """
WITH v AS (
 SELECT o_orderpriority AS p, 'price' AS rule, avg(o_totalprice) > 250000 AS ok FROM orders GROUP BY 1
 UNION ALL SELECT o_orderpriority, 'status', avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) > 0.33 FROM orders GROUP BY 1
 UNION ALL SELECT o_orderpriority, 'count', count(*) > 10 FROM orders GROUP BY 1),
r AS (SELECT rule, avg(ok::INT) AS share FROM v GROUP BY rule),
q AS (SELECT *, share >= 0.7 OR 1 - share >= 0.7 AS reached FROM r)
SELECT rule, round(share, 6) AS pass_share, reached AS consensus_reached, CASE WHEN share >= 0.7 THEN 'pass' ELSE 'fail' END AS result,
 round(greatest(share, 1 - share), 6) AS confidence, (SELECT count(*) FILTER (reached) >= count(*) * 0.7 FROM q) AS overall_consensus FROM q""")
def _(t):
    per = t.orders.groupBy("o_orderpriority").agg(
        (F.avg("o_totalprice") > 250000).alias("price"),
        (F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)) > 0.33).alias("status"),
        (F.count("*") > 10).alias("count"))
    votes = per.unpivot(["o_orderpriority"], ["price", "status", "count"], "rule", "ok")
    out = A.consensus_vote(votes, "rule", "ok", 0.7)
    return out.withColumn("pass_share", F.round("pass_share", 6)).withColumn("confidence", F.round("confidence", 6))


@query("win01_row_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def _(t):
    return O.number_rows(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "rn")


@query("win02_rank_in_strata", """
SELECT c_custkey, c_mktsegment FROM customer
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR))) <= 20""")
def _(t):
    keyed = t.customer.withColumn("h", F.md5(F.col("c_custkey").cast("string")))
    return O.first_per_key(keyed, ["c_mktsegment"], ["h"], 20).select("c_custkey", "c_mktsegment")


@query("win03_keep_last", """
SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100""")
def _(t):
    return O.keep_last(t.events, ["event_type"], ["ts", "event_id"], 100).select("event_id", "event_type")


@query("win03_keep_last_long", """
SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1500""")
def _(t):
    return O.keep_last(t.events.select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"], 1500).select("event_id", "event_type")


@query("win04_reversals", """
SELECT event_id, user_id, d AS direction, nd AS next_direction FROM (
 SELECT *, lead(d) OVER w AS nd, lead(ts) OVER w AS nts FROM
  (SELECT *, CASE WHEN value > 20 THEN 'up' ELSE 'down' END AS d FROM events)
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE d <> nd AND epoch_us(nts) - epoch_us(ts) < 1800000000""")
def _(t):
    df = t.events.select("event_id", "user_id", "ts", F.when(F.col("value") > 20, "up").otherwise("down").alias("direction"))
    return O.reversals(df, ["user_id"], ["ts", "event_id"], "direction").select("event_id", "user_id", "direction", "next_direction")


@query("win05_trailing_points", """
SELECT event_id, round(avg(value) OVER w + 1e-9, 6) AS trail_avg, count(value) OVER w AS trail_n FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(t):
    df = t.events.select("event_id", "event_type", "ts", "value")
    return O.trailing_points(df, ["event_type"], ["ts", "event_id"], "value", 20).select(
        "event_id", F.round(F.col("trail_avg") + 1e-9, 6).alias("trail_avg"), "trail_n")


@query("win05_trailing_seconds", """
SELECT event_id, round(avg(value) OVER w + 1e-9, 6) AS trail_avg, count(value) OVER w AS trail_n FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)""")
def _(t):
    df = t.events.select("event_id", "event_type", "ts", "value")
    return O.trailing_seconds(df, ["event_type"], "ts", "event_id", "value", 3600).select(
        "event_id", F.round(F.col("trail_avg") + 1e-9, 6).alias("trail_avg"), "trail_n")


@query("win05_trailing_seconds_tiny", """
SELECT event_id, round(avg(value) OVER w + 1e-9, 6) AS trail_avg FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW)""")
def _(t):
    """Values of 1e-8 times the table's; the mean is scaled back for the comparison."""
    df = t.events.select("event_id", "event_type", "ts", (F.col("value") * 1e-8).alias("value"))
    out = O.trailing_seconds(df, ["event_type"], "ts", "event_id", "value", 600)
    return out.select("event_id", F.round(F.col("trail_avg") * 1e8 + 1e-9, 6).alias("trail_avg"))


@query("win05_trailing_seconds_large", """
SELECT event_id, round(avg(value) OVER w + 1e-9, 6) AS trail_avg FROM events
WINDOW w AS (PARTITION BY nullif(event_type, 'view') ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW)""")
def _(t):
    """Values of 1e12 times the table's, and one series without a name."""
    df = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("event_type"), "ts", (F.col("value") * 1e12).alias("value"))
    out = O.trailing_seconds(df, ["event_type"], "ts", "event_id", "value", 600)
    return out.select("event_id", F.round(F.col("trail_avg") / 1e12 + 1e-9, 6).alias("trail_avg"))


@query("win06_average_rank", """
SELECT l_extendedprice, count(*) AS n, avg(rn) AS avg_rank FROM
 (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS rn FROM lineitem) GROUP BY l_extendedprice""")
def _(t):
    return O.average_ranks(t.lineitem, "l_extendedprice")


@query("srt01_list_all", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    return O.list_all(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50, 100)


@query("srt02_list_filtered", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 30 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5""")
def _(t):
    return O.list_filtered(t.orders, {"o_custkey": 30, "o_orderstatus": "F", "o_orderpriority": None}, "o_orderdate", "o_orderkey", 5
                           ).select("o_orderkey", "o_orderdate")


@query("srt03_get_by_id", "SELECT * FROM customer WHERE c_custkey = 77")
def _(t):
    return O.get_by_id(t.customer, "c_custkey", 77)


@query("srt04_count_all", "SELECT count(*) AS n FROM lineitem")
def _(t):
    return O.count_all(t.lineitem)


@query("srt05_active_since", """
SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00'""")
def _(t):
    return O.active_since(t.events, "user_id", "ts", DAY(2024, 1, 30, 12))


@query("srt06_alerts", """
SELECT event_id, ts FROM events WHERE event_type = 'error' AND value > 30 ORDER BY ts DESC, event_id LIMIT 20""")
def _(t):
    open_alerts = t.events.withColumn("resolved", F.col("value") <= 30)
    return O.list_filtered(open_alerts, {"event_type": "error", "resolved": False}, "ts", "event_id", 20).select("event_id", "ts")


@query("srt07_sort_group", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY p_brand")
def _(t):
    return A.value_counts_by(t.part, "p_brand").orderBy("p_brand")


@query("srt08_pivot", """
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def _(t):
    out = O.pivot(t.events, ["user_id"], "event_type", ["click", "view"], F.count("event_id"))
    return out.fillna(0)


@query("srt09_unpivot", """
SELECT l_orderkey, l_linenumber, name, value FROM (
 SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem)""")
def _(t):
    return O.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


_PARTIES = "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier"


def parties(t):
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return a, t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))


@query("set01_union", _PARTIES)
def _(t):
    return O.union(*parties(t))


@query("src21_union_sources", f"SELECT DISTINCT nation, left(name, 8) AS kind FROM ({_PARTIES})")
def _(t):
    a, b = parties(t)
    short = [d.select("nation", F.substring("name", 1, 8).alias("kind")) for d in (a, b)]
    return O.union_sources(*short)


@query("set02_intersect", """
SELECT l_suppkey, l_quantity, l_returnflag FROM lineitem INTERSECT SELECT l_suppkey, l_quantity, CASE l_returnflag WHEN 'A' THEN 'R' ELSE 'A' END FROM lineitem""")
def _(t):
    other = t.lineitem.selectExpr("l_suppkey", "l_quantity", "CASE l_returnflag WHEN 'A' THEN 'R' ELSE 'A' END")
    return t.lineitem.select("l_suppkey", "l_quantity", "l_returnflag").intersect(other)


@query("set03_except", """
SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer""")
def _(t):
    return t.orders.select("o_custkey").exceptAll(t.customer.select("c_custkey"))
