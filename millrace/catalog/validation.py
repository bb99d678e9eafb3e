"""Validation (VAL) and load checks (SNK-08, SNK-09)."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import validate as V
from .mapping import URGENT, urgent
from .registry import query

# Customers with a mail address and a phone number built from the key; some are broken on purpose.
CONTACTS = """(SELECT c_custkey, c_name, c_acctbal,
 CASE WHEN c_custkey % 7 = 0 THEN 'broken' ELSE 'user' || c_custkey || '@example.com' END AS email,
 CASE WHEN c_custkey % 11 = 0 THEN '12-34' ELSE '+1 (555) ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS phone,
 CASE WHEN c_custkey % 5 = 0 THEN '   ' ELSE c_name END AS title FROM customer)"""


def contacts(t):
    k = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", "c_name", "c_acctbal",
        F.when(k % 7 == 0, "broken").otherwise(F.concat(F.lit("user"), k, F.lit("@example.com"))).alias("email"),
        F.when(k % 11 == 0, "12-34").otherwise(F.concat(F.lit("+1 (555) "), F.lpad(k.cast("string"), 7, "0"))).alias("phone"),
        F.when(k % 5 == 0, "   ").otherwise(F.col("c_name")).alias("title"))


# Orders as text columns, as they come from a csv file; the note column is mixed.
TEXTS = """(SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderstatus,
 strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
 CASE o_orderkey % 3 WHEN 0 THEN 'x' || o_orderkey WHEN 1 THEN CAST(o_orderkey AS VARCHAR) ELSE '2020-01-02' END AS note,
 CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'FALSE' END AS flag FROM orders)"""


def texts(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderstatus",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.when(k % 3 == 0, F.concat(F.lit("x"), k)).when(k % 3 == 1, k.cast("string")).otherwise("2020-01-02").alias("note"),
        F.when(k % 2 == 0, "true").otherwise("FALSE").alias("flag"))


def _rule(name, make, rule, source, where):
    """Errors and valid rows of one rule."""

    @query(name, f"""SELECT count(*) AS total_records, count(*) FILTER (NOT ({where})) AS valid_records,
 count(*) FILTER ({where}) AS errors FROM {source}""")
    def _(t):
        return V.validate(make(t), [rule]).select("total_records", "valid_records", "errors")


_rule("val01_required", urgent, {"type": "required", "field": "o_orderstatus"}, URGENT, "o_orderstatus IS NULL OR o_orderstatus = ''")
for _kind, _col, _where in [
    ("integer", "note", "NOT regexp_full_match(note, '[0-9]+')"),
    ("float", "note", "TRY_CAST(note AS DOUBLE) IS NULL"),
    ("boolean", "flag", "lower(flag) NOT IN ('true','false','1','0')"),
    ("date", "note", r"NOT regexp_matches(note, '^\d{4}-\d{2}-\d{2}')"),
    ("string", "o_orderkey", "false"),
]:
    _rule(f"val02_type_{_kind}", texts, {"type": "data_type", "field": _col, "expected_type": _kind}, TEXTS, _where)
_rule("val03_range", lambda t: t.lineitem, {"type": "range", "field": "l_quantity", "min": 5, "max": 45}, "lineitem",
      "l_quantity < 5 OR l_quantity > 45")
_rule("val03_range_text", texts, {"type": "range", "field": "o_totalprice", "min": 1000, "max": 400000}, TEXTS,
      "CAST(o_totalprice AS DOUBLE) NOT BETWEEN 1000 AND 400000")
_rule("val04_pattern", lambda t: t.customer, {"type": "pattern", "field": "c_name", "pattern": r"Customer#0000000[0-4]"}, "customer",
      "NOT regexp_matches(c_name, '^Customer#0000000[0-4]')")
_rule("val05_enum", lambda t: t.orders, {"type": "enum", "field": "o_orderstatus", "allowed": ["F", "O"]}, "orders",
      "o_orderstatus NOT IN ('F','O')")
_rule("val06_field_missing", lambda t: t.nation, {"type": "range", "field": "absent", "min": 0}, "nation", "true")

_LINE_RULES = [
    {"type": "range", "field": "l_quantity", "min": 5, "max": 45},
    {"type": "enum", "field": "l_returnflag", "allowed": ["A", "N"]},
    {"type": "required", "field": "l_shipdate"},
]


@query("val07_report", """
WITH x AS (SELECT l_quantity < 5 OR l_quantity > 45 AS a, l_returnflag NOT IN ('A','N') AS b, l_shipdate IS NULL AS c FROM lineitem),
s AS (SELECT count(*) AS t, count(*) FILTER (a OR b OR c) AS bad, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b,
 count(*) FILTER (c) AS c FROM x)
SELECT t AS total_records, t - bad AS valid_records, bad AS invalid_records, 'range:l_quantity' AS rule, 'range' AS rule_type, a AS errors FROM s
UNION ALL SELECT t, t - bad, bad, 'enum:l_returnflag', 'enum', b FROM s
UNION ALL SELECT t, t - bad, bad, 'required:l_shipdate', 'required', c FROM s""")
def _(t):
    return V.validate(t.lineitem, _LINE_RULES)


_CUSTOMER_RULES = [
    {"type": "range", "field": "c_acctbal", "min": 0, "name": "balance"},
    {"type": "enum", "field": "c_mktsegment", "allowed": ["MACHINERY", "FURNITURE", "HOUSEHOLD"], "name": "segment"},
]


@query("val08_error_rows", """
SELECT c_custkey, 'balance' AS rule, 'range' AS rule_type, 'c_acctbal' AS field, 'error' AS severity, CAST(c_acctbal AS VARCHAR) AS value
FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'segment', 'enum', 'c_mktsegment', 'error', c_mktsegment FROM customer
WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE', 'HOUSEHOLD')""")
def _(t):
    return V.error_rows(t.customer, ["c_custkey"], _CUSTOMER_RULES)


@query("val09_schema_check", """
SELECT 'c_custkey' AS field, 'unique' AS "check", count(*) - count(DISTINCT c_custkey) AS errors FROM customer
UNION ALL SELECT 'c_custkey', 'null', count(*) FILTER (c_custkey IS NULL) FROM customer
UNION ALL SELECT 'c_name', 'min_length', count(*) FILTER (length(c_name) < 3) FROM customer
UNION ALL SELECT 'c_name', 'max_length', count(*) FILTER (length(c_name) > 17) FROM customer
UNION ALL SELECT 'c_name', 'pattern', count(*) FILTER (NOT regexp_matches(c_name, '^Customer#0000000')) FROM customer
UNION ALL SELECT 'c_acctbal', 'min_value', count(*) FILTER (c_acctbal < 0) FROM customer
UNION ALL SELECT 'c_acctbal', 'max_value', count(*) FILTER (c_acctbal > 9000) FROM customer
UNION ALL SELECT 'c_mktsegment', 'allowed_values', count(*) FILTER (c_mktsegment NOT IN ('MACHINERY')) FROM customer
UNION ALL SELECT 'c_phone', 'missing_field', count(*) FROM customer
UNION ALL SELECT 'c_nationkey', 'unknown_field', count(*) FROM customer""")
def _(t):
    return V.schema_check(t.customer, [
        {"name": "c_custkey", "required": True, "nullable": False, "unique": True},
        {"name": "c_name", "min_length": 3, "max_length": 17, "pattern": "Customer#0000000"},
        {"name": "c_acctbal", "min_value": 0, "max_value": 9000},
        {"name": "c_mktsegment", "allowed_values": ["MACHINERY"]},
        {"name": "c_phone", "required": True}])


@query("val10_required_share", f"""
WITH x AS (SELECT 'c_custkey' AS "column", count(*) FILTER (c_custkey IS NULL) AS missing, count(*) AS n FROM {URGENT}
 UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus IS NULL), count(*) FROM {URGENT}),
y AS (SELECT "column", missing, round(missing * 100.0 / n, 6)::DOUBLE AS missing_pct, missing * 100.0 / n > 20 AS issue FROM x)
SELECT *, round(1 - (SELECT count(*) FILTER (issue) FROM y) / 2.0, 6)::DOUBLE AS quality_score FROM y""")
def _(t):
    out = V.required_share(urgent(t), ["c_custkey", "o_orderstatus"], 20.0)
    return out.withColumn("missing_pct", F.round("missing_pct", 6)).withColumn("quality_score", F.round("quality_score", 6))


@query("val11_name_bound_rules", f"""
SELECT 'email_format' AS rule, 'email' AS field, count(*) AS errors FROM {CONTACTS} WHERE NOT regexp_matches(email, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$')
UNION ALL SELECT 'phone_format', 'phone', count(*) FROM {CONTACTS} WHERE c_custkey % 11 = 0
UNION ALL SELECT 'non_empty', 'title', count(*) FROM {CONTACTS} WHERE trim(title) = ''
UNION ALL SELECT 'non_empty', 'c_name', count(*) FROM {CONTACTS} WHERE trim(c_name) = ''""")
def _(t):
    df = contacts(t)
    rules = V.bound_rules(df.columns)
    named = [{**r, "name": f"{r['name']}|{r['field']}"} for r in rules]
    out = V.validate(df, named)
    parts = F.split("rule", r"\|")
    return out.select(parts[0].alias("rule"), parts[1].alias("field"), "errors")


def _check(name, make, column, check, source, where):
    @query(name, f"SELECT count(*) FILTER ({where}) AS valid, count(*) FILTER (NOT coalesce({where}, false)) AS invalid FROM {source}")
    def _(t):
        ok = F.coalesce(check(F.col(column)), F.lit(False))
        return make(t).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


_check("val12_email_format", contacts, "email", V.email_ok, CONTACTS, r"regexp_matches(email, '^[\w\.-]+@[\w\.-]+\.\w+$')")
_check("val13_phone_format", contacts, "phone", V.phone_ok, CONTACTS,
       r"regexp_matches(regexp_replace(phone, '[\s\-\(\)]', '', 'g'), '^\+?1?\d{9,15}$')")
_check("val15_non_empty", contacts, "title", V.non_empty, CONTACTS, "trim(title) <> ''")
_check("val16_positive_number", lambda t: t.customer, "c_acctbal", V.positive_number, "customer", "c_acctbal >= 0")


@query("val14_date_format", """
SELECT o_orderkey, o_orderkey % 7 <> 6 AS ok FROM orders""")
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    shapes = [F.date_format(d, f) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy",
                                           "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy MMM dd")]
    text = F.element_at(F.array(*shapes), (k % 7 + 1).cast("int"))
    return t.orders.select("o_orderkey", F.coalesce(V.date_ok(text), F.lit(False)).alias("ok"))


@query("val17_dataset_report", f"""
WITH x AS (SELECT NOT regexp_matches(email, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$') OR c_acctbal < 0 AS bad, trim(title) = '' AS warn FROM {CONTACTS})
SELECT count(*) AS total_records, count(*) FILTER (NOT bad) AS valid_records, count(*) FILTER (bad) AS invalid_records,
 count(*) FILTER (warn) AS records_with_warnings, round(100.0 * count(*) FILTER (NOT bad) / count(*), 6)::DOUBLE AS quality_score FROM x""")
def _(t):
    rules = [
        {"type": "custom", "name": "email", "field": "email", "check": V.email_ok},
        {"type": "custom", "name": "balance", "field": "c_acctbal", "check": V.positive_number},
        {"type": "custom", "name": "title", "field": "title", "check": V.non_empty, "severity": "warning"}]
    return V.dataset_report(contacts(t), rules).withColumn("quality_score", F.round("quality_score", 6))


@query("val19_report_text", """
(SELECT c_custkey, 'balance' AS rule, 'range' AS rule_type, 'c_acctbal' AS field, 'error' AS severity FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 10)
UNION ALL (SELECT c_custkey, 'segment', 'enum', 'c_mktsegment', 'warning' FROM customer
WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE', 'HOUSEHOLD') ORDER BY c_custkey LIMIT 5)""")
def _(t):
    rules = [_CUSTOMER_RULES[0], {**_CUSTOMER_RULES[1], "severity": "warning"}]
    return V.report_lines(t.customer, ["c_custkey"], rules)


_FILLED = "avg(CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) = '' THEN 0.0 ELSE 1.0 END)"
_URGENT_COLS = ["c_custkey", "c_nationkey", "o_orderkey", "o_totalprice", "o_orderstatus"]


@query("val20_completeness", "WITH x AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_FILLED.format(c=c)} AS v FROM {URGENT}" for c in _URGENT_COLS) + """)
SELECT "column", round(v, 6) AS completeness, v < 0.8 AS issue, round((SELECT avg(v) FROM x), 6) AS score FROM x""")
def _(t):
    out = V.completeness_check(urgent(t), 0.8)
    return out.withColumn("completeness", F.round("completeness", 6)).withColumn("score", F.round("score", 6))


@query("val21_uniqueness", """
SELECT 'o_orderkey' AS "column", count(o_orderkey) - count(DISTINCT o_orderkey) AS duplicates, 0.0::DOUBLE AS score FROM orders
UNION ALL SELECT 'o_custkey', count(o_custkey) - count(DISTINCT o_custkey), 0.0 FROM orders""")
def _(t):
    return V.uniqueness_check(t.orders, ["o_orderkey", "o_custkey"])


_CLASS = r"""CASE WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN CASE WHEN contains({c}, '.') THEN 'float' ELSE 'integer' END
 WHEN regexp_matches({c}, '^\d{4}-\d{2}-\d{2}$') THEN 'date' ELSE 'string' END"""


@query("val22_consistency", f"WITH x AS (SELECT * FROM {TEXTS}), y AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {_CLASS.replace('{c}', c)}) AS INTEGER) AS classes FROM x"
    for c in ["note", "o_orderkey", "o_orderdate", "o_orderstatus", "flag"]) +
    ") SELECT *, CASE WHEN (SELECT max(classes) FROM y) > 1 THEN 0.8 ELSE 1.0 END::DOUBLE AS score FROM y")
def _(t):
    return V.consistency_check(texts(t), ["note", "o_orderkey", "o_orderdate", "o_orderstatus", "flag"])


@query("val23_validity", f"""
SELECT count(*) FILTER (o_orderstatus IS NULL) AS issues,
 round(greatest(0, 1 - count(*) FILTER (o_orderstatus IS NULL) / (2.0 * count(*))), 6)::DOUBLE AS score FROM {URGENT}""")
def _(t):
    return V.validity_check(urgent(t), ["c_custkey", "o_orderstatus"]).select(
        F.col("issues").cast("long").alias("issues"), F.round("score", 6).alias("score"))


@query("val24_overall", """
SELECT 1.0::DOUBLE AS completeness, 1.0::DOUBLE AS uniqueness, 1.0::DOUBLE AS consistency, 1.0::DOUBLE AS validity,
 1.0::DOUBLE AS overall, true AS passed FROM orders HAVING count(*) = count(DISTINCT o_orderkey)""")
def _(t):
    return V.core_quality(t.orders, ["o_orderkey"], ["o_orderkey", "o_custkey"])


@query("val24_overall_mixed", f"""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus IS NULL) AS m, count(o_orderkey) - count(DISTINCT o_orderkey) AS d,
 avg(CASE WHEN o_orderkey IS NULL THEN 0.0 ELSE 1.0 END) AS f FROM {URGENT}),
s AS (SELECT (2 + 3 * f) / 5 AS completeness, 1.0 AS uniqueness, 1.0 AS consistency, 1 - m / (2.0 * n) AS validity, d FROM c)
SELECT round(completeness, 6) AS completeness, CASE WHEN d > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS uniqueness, 1.0::DOUBLE AS consistency,
 round(validity, 6)::DOUBLE AS validity,
 round((completeness + CASE WHEN d > 0 THEN 0.0 ELSE 1.0 END + 1 + validity) / 4, 6)::DOUBLE AS overall, false AS passed FROM s""")
def _(t):
    out = V.core_quality(urgent(t), ["o_orderkey"], ["o_orderstatus"])
    for c in ("completeness", "validity", "overall"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("val25_cell_completeness", "SELECT round((" + " + ".join(_FILLED.format(c=c) for c in _URGENT_COLS) + f") / 5, 6)::DOUBLE AS completeness FROM {URGENT}")
def _(t):
    return V.cell_completeness(urgent(t)).select(F.round("completeness", 6).alias("completeness"))


@query("val26_type_uniformity", f"""
WITH n AS (SELECT max(c)::DOUBLE / sum(c) AS s FROM (SELECT CASE WHEN TRY_CAST(note AS DOUBLE) IS NOT NULL THEN 'integer'
 WHEN regexp_matches(note, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'date' ELSE 'string' END AS k, count(*) AS c FROM {TEXTS} GROUP BY k))
SELECT round((s + 1 + 1) / 3, 6) AS consistency FROM n""")
def _(t):
    return V.type_uniformity(texts(t), ["note", "o_orderkey", "flag"]).select(F.round("consistency", 6).alias("consistency"))


@query("val27_record_validity", f"SELECT round(avg(CASE WHEN o_orderkey IS NULL THEN 0.0 ELSE 1.0 END), 6) AS validity FROM {URGENT}")
def _(t):
    return V.record_validity(urgent(t).select("o_orderkey", "o_totalprice", "o_orderstatus")).select(F.round("validity", 6).alias("validity"))


@query("val28_structure", "SELECT true AS not_empty, count(*) FILTER (p_size > 25) AS unnamed_rows FROM part")
def _(t):
    df = t.part.select(F.when(F.col("p_size") <= 25, F.col("p_name")).alias("name"))
    return V.structure_check(df, ["id", "name", "value"])


_METRICS = """(SELECT l_suppkey, count(*) FILTER (l_discount > 0) AS complete_fields, count(*) AS total_fields,
 count(*) FILTER (l_tax > 0) AS accurate_records, count(*) AS total_records, NULL::BIGINT AS valid_values, NULL::BIGINT AS total_values
 FROM lineitem GROUP BY l_suppkey)"""


def metrics(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_discount") > 0).alias("complete_fields"), F.count("*").alias("total_fields"),
        F.count_if(F.col("l_tax") > 0).alias("accurate_records"), F.count("*").alias("total_records"),
    ).withColumn("valid_values", F.lit(None).cast("long")).withColumn("total_values", F.lit(None).cast("long"))


@query("val29_dimension_scores", f"""
SELECT l_suppkey, round(complete_fields::DOUBLE / total_fields, 6) AS completeness, round(accurate_records::DOUBLE / total_records, 6) AS accuracy,
 0.5::DOUBLE AS consistency, 0.5::DOUBLE AS validity, 0.5::DOUBLE AS uniqueness FROM {_METRICS}""")
def _(t):
    return V.dimension_scores(metrics(t)).select(
        "l_suppkey", F.round("completeness", 6).alias("completeness"), F.round("accuracy", 6).alias("accuracy"),
        "consistency", "validity", "uniqueness")


@query("val30_grade", f"""
SELECT l_suppkey, CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END AS grade,
 s >= 0.7 AS acceptable FROM (SELECT l_suppkey, accurate_records::DOUBLE / total_records AS s FROM {_METRICS})""")
def _(t):
    s = F.col("accurate_records") / F.col("total_records")
    return metrics(t).select("l_suppkey", V.grade(s).alias("grade"), (s >= 0.7).alias("acceptable"))


@query("val31_recent_timestamp", """
SELECT event_id, ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS recent FROM events""")
def _(t):
    return t.events.select("event_id", V.recent(F.col("ts"), F.lit(dt.datetime(2024, 1, 31)), 7).alias("recent"))


@query("val31_min_score", f"""
WITH c AS (SELECT count(*) FILTER (o_orderstatus IS NULL) AS m, count(*) AS n, count(o_orderkey) - count(DISTINCT o_orderkey) AS d,
 avg(CASE WHEN o_orderkey IS NULL THEN 0.0 ELSE 1.0 END) AS f FROM {URGENT})
SELECT ((2 + 3 * f) / 5 + CASE WHEN d > 0 THEN 0 ELSE 1 END + 1 + 1 - m / (2.0 * n)) / 4 >= 0.85 AS meets FROM c""")
def _(t):
    out = V.core_quality(urgent(t), ["o_orderkey"], ["o_orderstatus"])
    return out.select((F.col("overall") >= 0.85).alias("meets"))


@query("snk08_load_gate", """
WITH x AS (SELECT count(*) FILTER (c_acctbal < 0) AS a, count(*) FILTER (c_name IS NULL) AS b FROM customer)
SELECT 'range:c_acctbal' AS rule, a AS errors, a + b > 0 AS load_blocked FROM x
UNION ALL SELECT 'required:c_name', b, a + b > 0 FROM x""")
def _(t):
    return V.load_gate(t.customer, [{"type": "range", "field": "c_acctbal", "min": 0}, {"type": "required", "field": "c_name"}])
