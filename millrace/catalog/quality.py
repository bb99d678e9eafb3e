"""Quality engine (QUA) and issue breakdowns."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions import patterns as PT
from ..operators import aggregate as A
from ..operators import quality as Q
from .mapping import URGENT, urgent
from .profiling import rounded
from .registry import query
from .validation import CONTACTS, TEXTS, contacts, texts

NOW = dt.datetime(2024, 1, 31)
_COLS = ["c_custkey", "c_nationkey", "o_orderkey", "o_totalprice", "o_orderstatus"]


def _issue(name, make, rules, sql):
    @query(name, sql)
    def _(t):
        return Q.issues(make(t), rules)


_HEAD = "SELECT '{r}' AS rule_name, '{f}' AS field_name, '{k}' AS issue_type, '{s}' AS severity, {n} AS record_count FROM {t}"

_issue("qua01_completeness", urgent, [{"name": "complete", "type": "completeness", "severity": "warning", "min": 0.9}],
       "SELECT * FROM (" + " UNION ALL ".join(
           _HEAD.format(r="complete", f=c, k="completeness", s="warning", t=URGENT,
                        n=f"CASE WHEN count(*) FILTER ({c} IS NULL)::DOUBLE / count(*) > 0.1 THEN count(*) FILTER ({c} IS NULL) ELSE 0 END")
           for c in _COLS) + ") WHERE record_count > 0")
_issue("qua02_uniqueness", lambda t: t.orders, [{"name": "unique", "type": "uniqueness", "severity": "error", "fields": ["o_orderkey", "o_custkey"]}],
       _HEAD.format(r="unique", f="o_custkey", k="uniqueness", s="error", t="orders", n="count(o_custkey) - count(DISTINCT o_custkey)"))
_issue("qua03_format", contacts, [{"name": "mail", "type": "format", "severity": "error", "field": "email", "pattern": PT.EMAIL}],
       _HEAD.format(r="mail", f="email", k="format", s="error", t=CONTACTS,
                    n=r"count(*) FILTER (NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$'))"))
_issue("qua04_range", lambda t: t.customer, [{"name": "balance", "type": "range", "severity": "error", "field": "c_acctbal", "min": 0, "max": 9000}],
       _HEAD.format(r="balance", f="c_acctbal", k="range", s="error", t="customer", n="count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000)"))
_issue("qua05_type_consistency", texts, [{"name": "types", "type": "consistency", "severity": "warning"}],
       "SELECT * FROM (" + " UNION ALL ".join(
           _HEAD.format(r="types", f=c, k="consistency", s="warning", t=TEXTS,
                        n=f"CASE WHEN count(DISTINCT TRY_CAST({c} AS DOUBLE) IS NOT NULL) > 1 THEN count({c}) ELSE 0 END")
           for c in ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "note", "flag"]) + ") WHERE record_count > 0")
_issue("qua06_zscore_outliers", lambda t: t.events.select("event_id", "user_id", "value"),
       [{"name": "z", "type": "outlier", "severity": "warning", "threshold": 3.0, "min_samples": 10}],
       _HEAD.format(r="z", f="value", k="outlier", s="warning", n="count(*)",
                    t="events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs(value - m) / s > 3 HAVING count(*) > 0"))
_issue("qua07_cross_field", lambda t: t.part, [{
    "name": "size_price", "type": "correlation", "severity": "warning", "fields": ["p_size", "p_retailprice"],
    "condition": "(p_size < 5 AND p_retailprice > 950) OR (p_size > 45 AND p_retailprice < 910)"}],
       _HEAD.format(r="size_price", f="p_size,p_retailprice", k="correlation", s="warning", t="part",
                    n="count(*) FILTER ((p_size < 5 AND p_retailprice > 950) OR (p_size > 45 AND p_retailprice < 910))"))

# People with the fields that the built-in rules name.
PEOPLE = f"""(SELECT c_custkey AS id, email, phone, CAST(c_custkey % 160 AS DOUBLE) AS age,
 CASE WHEN c_custkey % 4 = 0 THEN '12' WHEN c_custkey % 4 = 1 THEN 'x' ELSE NULL END AS note FROM {CONTACTS})"""


def people(t):
    k = F.col("c_custkey")
    return contacts(t).select(
        k.alias("id"), "email", "phone", (k % 160).cast("double").alias("age"),
        F.when(k % 4 == 0, "12").when(k % 4 == 1, "x").alias("note"))


_PEOPLE_ISSUES = f"""(SELECT * FROM (
 SELECT 'completeness_check' AS rule_name, 'note' AS field_name, 'completeness' AS issue_type, 'warning' AS severity,
  CASE WHEN count(*) FILTER (note IS NULL)::DOUBLE / count(*) > 0.1 THEN count(*) FILTER (note IS NULL) ELSE 0 END AS record_count FROM {PEOPLE}
 UNION ALL SELECT 'uniqueness_check', 'email', 'uniqueness', 'error', count(email) - count(DISTINCT email) FROM {PEOPLE}
 UNION ALL SELECT 'email_format', 'email', 'format', 'error', count(*) FILTER (email = 'broken') FROM {PEOPLE}
 UNION ALL SELECT 'phone_format', 'phone', 'format', 'warning', count(*) FILTER (phone = '12-34') FROM {PEOPLE}
 UNION ALL SELECT 'age_range', 'age', 'range', 'error', count(*) FILTER (age > 150) FROM {PEOPLE}
 UNION ALL SELECT 'data_type_consistency', 'note', 'consistency', 'warning', count(note) FROM {PEOPLE}) WHERE record_count > 0)"""


@query("qua11_builtin_rules", f"SELECT * FROM {_PEOPLE_ISSUES}")
def _(t):
    return Q.issues(people(t), Q.BUILTIN_RULES)


_SCORE = f"""(SELECT round(greatest(0, 100 - coalesce(sum(record_count * CASE severity WHEN 'critical' THEN 10 WHEN 'error' THEN 5 WHEN 'warning' THEN 2 ELSE 1 END), 0)
 / (SELECT count(*)::DOUBLE FROM customer) * 10), 2)::DOUBLE AS score FROM {_PEOPLE_ISSUES})"""
_LEVEL = "CASE WHEN score >= 95 THEN 'excellent' WHEN score >= 85 THEN 'good' WHEN score >= 70 THEN 'acceptable' WHEN score >= 50 THEN 'poor' ELSE 'critical' END"


@query("qua08_score", f"SELECT score, {_LEVEL} AS level FROM {_SCORE}")
def _(t):
    df = people(t)
    return Q.score(Q.issues(df, Q.BUILTIN_RULES), df.agg(F.count("*").alias("n")).scalar())


@query("qua09_level", f"SELECT c_custkey, {_LEVEL.replace('score', 'c_acctbal / 100')} AS level FROM customer")
def _(t):
    return t.customer.select("c_custkey", Q.level(F.col("c_acctbal") / 100).alias("level"))


@query("qua10_suggestions", f"""
SELECT * FROM (SELECT DISTINCT field_name AS field, 'fix_' || issue_type AS suggestion FROM {_PEOPLE_ISSUES}
 UNION SELECT 'note', 'improve_collection' FROM {PEOPLE} HAVING count(note)::DOUBLE / count(*) < 0.8) ORDER BY field, suggestion LIMIT 10""")
def _(t):
    df = people(t)
    return Q.suggestions(Q.issues(df, Q.BUILTIN_RULES), Q.field_profile(df))


@query("agg19_issue_breakdown", f"""
SELECT 'issue_type' AS dimension, issue_type AS value, count(*) AS n FROM {_PEOPLE_ISSUES} GROUP BY issue_type
UNION ALL SELECT 'severity', severity, count(*) FROM {_PEOPLE_ISSUES} GROUP BY severity
UNION ALL SELECT 'field_name', field_name, count(*) FROM {_PEOPLE_ISSUES} GROUP BY field_name""")
def _(t):
    return A.breakdown(Q.issues(people(t), Q.BUILTIN_RULES), ["issue_type", "severity", "field_name"])


# Daily scores per event type: one metrics row per day, from the events themselves.
DAILY = """(SELECT event_type, date_trunc('day', ts) AS day, 1 - avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0 END) AS score,
 count(*) AS n FROM events GROUP BY 1, 2)"""


def daily(t):
    return t.events.groupBy("event_type", F.date_trunc("day", F.col("ts")).alias("day")).agg(
        (1 - F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0))).alias("score"), F.count("*").alias("n"))


@query("qua12_quality_trend", f"""
SELECT event_type, measurements, round(a, 6) AS average, round(f, 6) AS first, round(l, 6) AS last,
 CASE WHEN l > f THEN 'improving' WHEN l < f THEN 'declining' ELSE 'stable' END AS direction FROM (
 SELECT event_type, count(*) AS measurements, avg(score) AS a, arg_min(score, day) AS f, arg_max(score, day) AS l FROM {DAILY}
 WHERE day >= TIMESTAMP '2024-01-10' GROUP BY event_type)""")
def _(t):
    out = Q.trend(daily(t), "event_type", "day", "score", dt.datetime(2024, 1, 10))
    return rounded(out, "average", "first", "last")


@query("qua13_feature_row", f"""
WITH u AS (SELECT * FROM {URGENT}),
m AS (SELECT count(*) AS row_count, 5 AS column_count, count(*) FILTER (o_orderkey IS NULL) * 3.0 / (count(*) * 5) AS np,
 count(DISTINCT o_orderstatus) / count(*)::DOUBLE AS uq FROM u)
SELECT row_count, column_count, round(np, 6)::DOUBLE AS null_percentage, round(1 - np, 6)::DOUBLE AS completeness, round(uq, 6) AS uniqueness,
 0::BIGINT AS format_errors, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS consistency, 1.0::DOUBLE AS timeliness,
 round(((1 - np) + 4 + uq) / 6, 6)::DOUBLE AS overall_score FROM m""")
def _(t):
    out = Q.feature_row(urgent(t), F.lit(NOW))
    cols = ["row_count", "column_count", "null_percentage", "completeness", "uniqueness", "format_errors", "accuracy",
            "consistency", "timeliness", "overall_score"]
    return rounded(out.select(*cols), "null_percentage", "completeness", "uniqueness", "overall_score")


@query("qua13_feature_row_more", """
WITH x AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem)) AS d FROM lineitem)
SELECT round(1 - d / n, 8)::DOUBLE AS duplicate_percentage, (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey + CASE WHEN s_acctbal > 0 THEN 0 ELSE 1000000 END FROM supplier)) AS referential_integrity_errors,
 round(n * 4 * 8 / 1073741824, 10)::DOUBLE AS data_volume_gb FROM x""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
    # Suppliers without a balance have keys that no line refers to.
    parents = t.supplier.withColumn("s_suppkey", F.col("s_suppkey") + F.when(F.col("s_acctbal") > 0, 0).otherwise(1000000))
    out = Q.feature_row(df, F.lit(NOW), parents=[(parents, "l_suppkey", "s_suppkey")])
    out = out.select("duplicate_percentage", "referential_integrity_errors", "data_volume_gb")
    return rounded(rounded(out, "duplicate_percentage", digits=8), "data_volume_gb", digits=10)


@query("qua21_row_to_vector", f"""
SELECT [1.0, 1.0, 1.0, 1.0, round(count(DISTINCT c_mktsegment)::DOUBLE / count(*), 6), 1.0]::DOUBLE[] AS v FROM customer""")
def _(t):
    row = Q.feature_row(t.customer.select("c_custkey", "c_mktsegment"), F.lit(NOW))
    return row.select(F.transform(F.slice(Q.feature_vector(), 1, 6), lambda x: F.round(x, 6)).alias("v"))


@query("qua14_uniqueness_mean", """
SELECT round((count(DISTINCT c_name) + count(DISTINCT c_mktsegment)) / 2.0 / count(*), 6)::DOUBLE AS uniqueness FROM customer""")
def _(t):
    return Q.feature_row(t.customer, F.lit(NOW)).select(F.round("uniqueness", 6).alias("uniqueness"))


_FENCE = """SELECT count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS o, count(*) AS n FROM events,
 (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM events)"""


@query("qua15_outlier_share", "SELECT round(sum(o)::DOUBLE / (max(n) * 2), 8) AS share FROM (" +
       _FENCE.format(c="value") + " UNION ALL " + _FENCE.format(c="user_id") + ")")
def _(t):
    return rounded(Q.outlier_share(t.events, ["value", "user_id"]), "share", digits=8)


@query("qua16_schema_drift", """
SELECT column_name AS "column", 'string' AS expected, 'bigint' AS actual FROM (DESCRIBE SELECT * FROM orders) WHERE column_name = 'o_custkey' AND column_type = 'BIGINT'""")
def _(t):
    return Q.schema_drift(t.orders, {"o_custkey": "string", "o_orderstatus": "string", "absent": "int"})


@query("qua17_format_errors", f"""
SELECT count(*) FILTER (TRY_CAST(note AS TIMESTAMP) IS NULL OR regexp_full_match(note, '[0-9]+')) AS bad_dates, (SELECT count(*) FILTER (email = 'broken') FROM {CONTACTS}) AS bad_emails FROM {TEXTS}""")
def _(t):
    mails = contacts(t).agg(F.count_if(~F.col("email").rlike(PT.EMAIL)).alias("n")).scalar()
    note = F.when(~F.col("note").rlike("^[0-9]+$"), F.col("note"))
    return texts(t).agg(F.count_if(Q.unparsable_date(note)).alias("bad_dates")).withColumn("bad_emails", mails)


@query("qua18_column_entropy", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY {c})"""
    for c in ["o_orderstatus", "o_orderpriority"]))
def _(t):
    return rounded(Q.column_entropy(t.orders, ["o_orderstatus", "o_orderpriority"]), "entropy")


@query("qua19_freshness", """
SELECT round(h, 6)::DOUBLE AS freshness_hours, round(greatest(0, 1 - h / 168), 6)::DOUBLE AS timeliness FROM (
 SELECT (epoch_us(TIMESTAMP '2024-02-02') - epoch_us(max(ts))) / 3600000000.0 AS h FROM events)""")
def _(t):
    return rounded(Q.freshness(t.events, "ts", F.lit(dt.datetime(2024, 2, 2))), "freshness_hours", "timeliness")


@query("qua20_derived_scores", f"""
WITH m AS (SELECT count(*) AS n, count(*) FILTER (email = 'broken') AS e, count(DISTINCT email) AS de, count(DISTINCT phone) AS dp, count(DISTINCT title) AS dti,
 count(DISTINCT c_name) AS dn FROM {CONTACTS}), s AS (SELECT 1 - e / (n * 6.0) AS acc, (de + dp + dti + dn) / 4.0 / n AS uq FROM m)
SELECT round(acc, 6)::DOUBLE AS accuracy, round(1 - 1 / 6.0, 6)::DOUBLE AS consistency, round(acc, 6)::DOUBLE AS validity, round((1 + acc + 1 - 1 / 6.0 + acc + uq + 1) / 6, 6)::DOUBLE AS overall_score FROM s""")
def _(t):
    out = Q.feature_row(contacts(t), F.lit(NOW), expected={"c_custkey": "int", "email": "string"}, emails=["email"])
    return rounded(out.select("accuracy", "consistency", "validity", "overall_score"), "accuracy", "consistency", "validity", "overall_score")


# Metrics rows per supplier, with every column the feature vector reads.
METRICS = """(SELECT l_suppkey, 1 - avg(l_tax) AS completeness, 1 - avg(l_discount) AS accuracy, 1.0::DOUBLE AS consistency, 1 - avg(l_discount) AS validity,
 count(DISTINCT l_partkey)::DOUBLE / count(*) AS uniqueness, 0.9::DOUBLE AS timeliness, avg(l_tax) * 3 AS null_percentage,
 1 - count(DISTINCT l_orderkey)::DOUBLE / count(*) AS duplicate_percentage, avg(l_discount) * 2 AS outlier_percentage,
 count(*) FILTER (l_quantity = 50) AS schema_violations, count(*) FILTER (l_quantity < 3) AS format_errors, count(*) FILTER (l_quantity = 1) AS referential_integrity_errors,
 avg(l_quantity) AS freshness_hours, count(*) AS row_count, 11 AS column_count, 2.5::DOUBLE AS mean_column_entropy, 3.0::DOUBLE AS data_volume_gb,
 1 - avg(l_tax) * 4 AS overall_score, max(l_shipdate) AS ts FROM lineitem GROUP BY l_suppkey)"""


def metrics(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_suppkey").agg(
        (1 - F.avg("l_tax")).alias("completeness"), (1 - F.avg("l_discount")).alias("accuracy"), F.lit(1.0).alias("consistency"),
        (1 - F.avg("l_discount")).alias("validity"), (F.count_distinct("l_partkey") / F.count("*")).alias("uniqueness"),
        F.lit(0.9).alias("timeliness"), (F.avg("l_tax") * 3).alias("null_percentage"),
        (1 - F.count_distinct("l_orderkey") / F.count("*")).alias("duplicate_percentage"),
        (F.avg("l_discount") * 2).alias("outlier_percentage"), F.count_if(q == 50).alias("schema_violations"),
        F.count_if(q < 3).alias("format_errors"), F.count_if(q == 1).alias("referential_integrity_errors"),
        F.avg("l_quantity").alias("freshness_hours"), F.count("*").alias("row_count"), F.lit(11).alias("column_count"),
        F.lit(2.5).alias("mean_column_entropy"), F.lit(3.0).alias("data_volume_gb"),
        (1 - F.avg("l_tax") * 4).alias("overall_score"), F.max("l_shipdate").alias("ts"))


VECTOR = f"""(SELECT l_suppkey, overall_score, [completeness, accuracy, consistency, validity, uniqueness, timeliness, null_percentage, duplicate_percentage, outlier_percentage,
 least(schema_violations / 100.0, 1), least(format_errors / 1000.0, 1), least(referential_integrity_errors / 100.0, 1), least(freshness_hours / 24, 1),
 log10(greatest(row_count, 1)) / 8, column_count / 100.0, mean_column_entropy, least(data_volume_gb / 1000, 1)]::DOUBLE[] AS v FROM {METRICS})"""


@query("qua21_feature_vector", f"SELECT l_suppkey, list_transform(v, lambda x: round(x, 6)) AS v FROM {VECTOR}")
def _(t):
    return metrics(t).select("l_suppkey", F.transform(Q.feature_vector(), lambda x: F.round(x, 6)).alias("v"))


_TREND = f"""(SELECT event_type, count(*) AS points, regr_slope(score, i) AS slope, stddev_pop(score) AS vol, arg_max(score, i) AS recent,
 arg_max(score, i) - max(score) FILTER (i = greatest(1, cnt - 23)) AS ch FROM (
 SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS cnt FROM {DAILY}) GROUP BY event_type)"""


@query("qua22_score_trend", f"""
SELECT event_type, points, round(slope, 8) AS slope, CASE WHEN slope > 0.01 THEN 'improving' WHEN slope < -0.01 THEN 'degrading' ELSE 'stable' END AS direction,
 round(vol, 6) AS volatility, round(recent, 6) AS recent, round(ch, 6) AS change FROM {_TREND} WHERE points >= 3""")
def _(t):
    out = Q.score_trend(daily(t), "event_type", "day", "score")
    return rounded(rounded(out, "slope", digits=8), "volatility", "recent", "change")


@query("qua23_daily_pattern", """
WITH h AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, avg(value) AS m FROM events GROUP BY 1)
SELECT max(m) - min(m) > 0.1 AS has_pattern, arg_max(hour, m) AS peak_hour, arg_min(hour, m) AS trough_hour, round(max(m), 6) AS peak_score, round(min(m), 6) AS trough_score FROM h""")
def _(t):
    return rounded(Q.daily_pattern(t.events, "ts", "value"), "peak_score", "trough_score")


ANOMALY = f"""(SELECT l_suppkey, least(1.0, max(abs(x - m) / s) / 2) AS a FROM (SELECT l_suppkey, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM {VECTOR})
 JOIN (SELECT p, avg(x) AS m, stddev_pop(x) + 1e-8 AS s FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS p FROM {VECTOR}) GROUP BY p) USING (p) GROUP BY l_suppkey)"""


@query("qua24_anomaly_score", f"SELECT l_suppkey, round(a, 5) AS anomaly_score FROM {ANOMALY}")
def _(t):
    m = metrics(t).select("l_suppkey", Q.feature_vector().alias("v"))
    return rounded(Q.anomaly_score(m, ["l_suppkey"], "v"), "anomaly_score", digits=5)


@query("qua25_predict_issues", f"""
SELECT l_suppkey, concat_ws(',', CASE WHEN v[7] > 0.1 THEN 'missing_values' END, CASE WHEN v[8] > 0.05 THEN 'duplicate_records' END, CASE WHEN v[9] > 0.1 THEN 'outliers' END,
 CASE WHEN v[10] > 0.01 THEN 'schema_drift' END, CASE WHEN v[11] > 0.01 THEN 'format_violations' END, CASE WHEN v[13] > 0.5 THEN 'freshness_decay' END) AS issues FROM {VECTOR}""")
def _(t):
    return metrics(t).select("l_suppkey", F.array_join(Q.predicted_issues(Q.feature_vector()), ",").alias("issues"))


@query("qua26_predict_score", f"""
WITH p AS (SELECT l_suppkey, 0.4 * greatest(0, least(1.0, 0.8 + 0.001 * 24)) + 0.3 * (1 - a) + 0.3 * overall_score AS s FROM {VECTOR} JOIN {ANOMALY} USING (l_suppkey))
SELECT l_suppkey, round(s, 5) AS predicted, CASE WHEN s < 0.5 THEN 'critical' WHEN s < 0.7 THEN 'high' WHEN s < 0.85 THEN 'medium' ELSE 'low' END AS risk FROM p""")
def _(t):
    m = metrics(t).select("l_suppkey", "overall_score", Q.feature_vector().alias("v"))
    rows = m.join(Q.anomaly_score(m, ["l_suppkey"], "v"), "l_suppkey")
    s = Q.predicted_score(F.lit(0.001), 24.0, F.col("anomaly_score"), F.col("overall_score"))
    return rows.select("l_suppkey", F.round(s, 5).alias("predicted"), Q.risk_level(s).alias("risk"))


@query("qua27_summary", f"""
SELECT l_suppkey, round(overall_score, 6) AS current_score, null_percentage > 0.1 AS high_null_percentage, duplicate_percentage > 0.05 AS high_duplicate_percentage,
 outlier_percentage > 0.1 AS high_outlier_percentage, schema_violations > 0 AS schema_violations, freshness_hours > 24 AS freshness_issues FROM {METRICS}""")
def _(t):
    return rounded(Q.key_issue_flags(metrics(t), "l_suppkey", "ts"), "current_score")


GATES = f"""(SELECT event_type, count(*) AS n, arg_max(score, day) AS last, arg_min(score, day) AS first, avg(score) AS av, max(score) - min(score) AS vol FROM (
 SELECT * FROM {DAILY} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 10) GROUP BY event_type)"""


@query("qua28_gate_trend", f"""
SELECT event_type, n, round(last, 6) AS last, round(first, 6) AS first, round(av, 6) AS recent_average, round(vol, 6) AS volatility,
 CASE WHEN last > first THEN 'improving' ELSE 'declining' END AS direction FROM {GATES}""")
def _(t):
    return rounded(Q.gate_trend(daily(t), "event_type", "day", "score"), "last", "first", "recent_average", "volatility")


@query("qua28_adapt_threshold", f"""
SELECT event_type, round(CASE WHEN last * 100 >= 70 AND last > first AND last * 100 > 80 THEN least(72.0, 98.0)
 WHEN last * 100 < 70 AND last <= first AND 70.0 > 63.0 THEN greatest(69.0, 63.0) ELSE 70.0 END, 4)::DOUBLE AS threshold FROM {GATES}""")
def _(t):
    g = Q.gate_trend(daily(t), "event_type", "day", "score")
    s = F.col("last") * 100
    made = Q.adapted_threshold(s >= 70, F.col("direction"), s, F.lit(70.0), F.lit(70.0))
    return g.select("event_type", F.round(made, 4).alias("threshold"))
