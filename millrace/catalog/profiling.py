"""Profiling (PRO) and field statistics (VAL-18)."""

from pyspark.sql import functions as F

from ..operators import profile as P
from .mapping import URGENT, urgent
from .registry import query
from .validation import CONTACTS, TEXTS, contacts, texts


def rounded(df, *cols, digits=6, nudge=0.0):
    """Round for comparison; ``nudge`` moves exact halves off the border."""
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c) + nudge if nudge else F.col(c), digits))
    return df


@query("pro01_structure", """
SELECT count(*) AS row_count, 6 AS column_count, 3 AS numeric_columns, 3 AS text_columns, count(*) * 48 AS memory_bytes, false AS has_missing FROM part""")
def _(t):
    return P.dataset_structure(t.part)


@query("pro02_sparsity", f"SELECT round(count(*) FILTER (o_orderkey IS NULL) * 3 * 100.0 / (count(*) * 5), 6)::DOUBLE AS sparsity_pct FROM {URGENT}")
def _(t):
    return rounded(P.sparsity(urgent(t)), "sparsity_pct")


_TEXT_COLS = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "note", "flag"]
_NUM = "TRY_CAST({c} AS DOUBLE) IS NOT NULL"


def _kinds(name, fn, case):
    sql = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {case.replace('{c}', c)} AS data_type FROM x" for c in _TEXT_COLS)

    @query(name, f"WITH x AS (SELECT * FROM {TEXTS}) {sql}")
    def _(t):
        return fn(texts(t))


_kinds("src13_infer_schema", P.infer_schema, f"""CASE WHEN count({{c}}) = 0 THEN 'unknown'
 WHEN bool_and(regexp_full_match({{c}}, '-?[0-9]+')) THEN 'integer' WHEN bool_and({_NUM}) THEN 'float'
 WHEN bool_and(lower({{c}}) IN ('true','false','1','0')) THEN 'boolean' ELSE 'string' END""")
_kinds("pro03_type_share", P.infer_type_share, f"""CASE WHEN count({{c}}) = 0 THEN 'null'
 WHEN avg(regexp_full_match({{c}}, '[0-9]+')::INT) > 0.8 THEN 'integer' WHEN avg(({_NUM})::INT) > 0.8 THEN 'float'
 WHEN avg(regexp_matches({{c}}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$|^\\d{{2}}/\\d{{2}}/\\d{{4}}$')::INT) > 0.8 THEN 'date' ELSE 'string' END""")
_MAJ = """(SELECT k FROM (SELECT CASE {cases} END AS k, min(CASE {order} END) AS p, count(*) AS n FROM x GROUP BY 1) ORDER BY n DESC, p LIMIT 1)"""


def _majority_case(cases):
    return "any_value(" + _MAJ.format(
        cases=" ".join(f"WHEN {w} THEN '{k}'" for w, k in cases) , order=" ".join(f"WHEN {w} THEN {i}" for i, (w, _) in enumerate(cases))) + ")"


_kinds("pro04_type_majority", P.infer_type_majority, _majority_case([
    ("regexp_full_match({c}, '-?[0-9]+')", "integer"), (_NUM, "float"),
    ("lower({c}) IN ('true','false','yes','no')", "boolean"), (r"regexp_matches({c}, '^\d{4}-\d{2}-\d{2}')", "datetime"), ("true", "string")]))
_kinds("pro05_type_classes", P.infer_type_classes, _majority_case([
    (_NUM + " AND NOT contains({c}, '.')", "integer"), (_NUM, "float"),
    (r"regexp_matches({c}, '^\d{4}-\d{2}-\d{2}$')", "date"), ("true", "string")]))
_kinds("pro06_type_source", P.infer_type_source, f"""CASE WHEN avg(({_NUM})::INT) > 0.8 THEN 'numeric'
 WHEN avg(regexp_matches({{c}}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')::INT) > 0.8 THEN 'date' ELSE 'string' END""")


@query("pro07_type_features", """
SELECT 'o_orderkey' AS "column", 'numeric' AS feature_type, 0.0::DOUBLE AS missing_share UNION ALL SELECT 'o_custkey', 'numeric', 0
UNION ALL SELECT 'o_totalprice', 'numeric', 0 UNION ALL SELECT 'o_orderdate', 'unknown', 0
UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) / count(*) < 0.1 THEN 'categorical' ELSE 'text' END, 0 FROM orders
UNION ALL SELECT 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) / count(*) < 0.1 THEN 'categorical' ELSE 'text' END, 0 FROM orders""")
def _(t):
    return P.infer_type_features(t.orders)


def _per(cols, select, table):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {select.format(c=c)} FROM {table}" for c in cols)


@query("pro08_null_unique", _per(
    ["event_id", "user_id", "event_type", "value"],
    "count(*) FILTER ({c} IS NULL) AS null_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6)::DOUBLE AS null_percentage, "
    "count(DISTINCT {c}) AS unique_count, round(100.0 * count(DISTINCT {c}) / count(*), 6)::DOUBLE AS unique_percentage", "events"))
def _(t):
    return rounded(P.null_unique_counts(t.events, ["event_id", "user_id", "event_type", "value"]), "null_percentage", "unique_percentage")


@query("pro09_numeric_stats", _per(
    ["l_quantity", "l_extendedprice", "l_discount"],
    "round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(var_samp({c}), 2) AS variance, min({c}) AS min, max({c}) AS max, "
    "round(median({c}), 6) AS median", "lineitem"))
def _(t):
    out = P.numeric_stats(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(rounded(out, "mean", "std", "median"), "variance", digits=2)


_PCT = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("pro10_percentiles", _per(
    ["l_quantity", "l_extendedprice"], ", ".join(f"round(quantile_cont({{c}}, {p}), 6) AS {n}" for n, p in _PCT.items()), "lineitem"))
def _(t):
    return rounded(P.percentiles(t.lineitem, ["l_quantity", "l_extendedprice"]), *_PCT)


@query("pro10_percentiles_sketch")
def _(t):
    return P.percentiles(t.lineitem, ["l_quantity", "l_extendedprice"], approx=True)


def _lower(c, p):
    return f"max(CASE WHEN i = floor({p} * (n - 1) + 1e-9) THEN {c} END)"


@query("pro11_percentiles_lower", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + ", ".join(f"{_lower(c, p)}::DOUBLE AS {n}" for n, p in _PCT.items()) +
    f" FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM part)" for c in ["p_size", "p_retailprice"]))
def _(t):
    return P.percentiles(t.part, ["p_size", "p_retailprice"], method="lower")


@query("pro12_mode", " UNION ALL ".join(
    f"(SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, count(*) AS n FROM lineitem GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"
    for c in ["l_quantity", "l_discount", "l_suppkey"]))
def _(t):
    return P.modes(t.lineitem, ["l_quantity", "l_discount", "l_suppkey"], "double")


@query("pro13_string_lengths", _per(
    ["text", "lang"], "round(avg(length({c})), 6) AS avg_length, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length", "documents"))
def _(t):
    return rounded(P.string_lengths(t.documents, ["text", "lang"]), "avg_length")


@query("pro14_detect_patterns", r"""
SELECT 'url' AS "column", 'email' AS pattern, round(avg(regexp_matches(url, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')::INT), 6) AS match_share, false AS detected FROM pages
UNION ALL SELECT 'url', 'phone', round(avg(regexp_matches(url, '^\+?[1-9]\d{1,14}$')::INT), 6), false FROM pages
UNION ALL SELECT 'url', 'url', round(avg(regexp_matches(url, '^https?://[^\s]+$')::INT), 6), avg(regexp_matches(url, '^https?://[^\s]+$')::INT) > 0.7 FROM pages
UNION ALL SELECT 'url', 'ipv4', round(avg(regexp_matches(url, '^(?:\d{1,3}\.){3}\d{1,3}$')::INT), 6), false FROM pages""")
def _(t):
    return rounded(P.detect_patterns(t.pages, ["url"]), "match_share")


@query("pro15_format_consistency", r"""
SELECT 'url' AS "column", 0.9::DOUBLE AS flat_consistency, round(avg(regexp_matches(url, '^https?://[^\s]+$')::INT), 6) AS share_consistency FROM pages
UNION ALL SELECT 'html', 1.0, CASE WHEN min(length(html)) = max(length(html)) THEN 1.0 ELSE 0.8 END FROM pages""")
def _(t):
    return rounded(P.format_consistency(t.pages, ["url", "html"]), "share_consistency")


@query("pro16_validity", f"""
SELECT 'o_orderstatus' AS "column", round(1 - avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) FILTER (o_orderstatus IS NOT NULL), 6)::DOUBLE AS validity,
 round(avg(CASE WHEN o_orderstatus IS NULL OR o_orderstatus = 'F' THEN 0.0 ELSE 1 END), 6)::DOUBLE AS validity_simple FROM {URGENT}""")
def _(t):
    df = urgent(t).select(F.when(F.col("o_orderstatus") == "F", "N/A").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return rounded(P.validity_scores(df), "validity", "validity_simple")


@query("pro17_outliers_iqr", """
SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def _(t):
    return P.outliers_iqr(t.events, "value").select("event_id", "value")


@query("pro18_outliers_index", """
WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders),
q AS (SELECT max(CASE WHEN i = n // 4 THEN v END) AS a, max(CASE WHEN i = 3 * n // 4 THEN v END) AS b FROM o)
SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice < a - 0.4 * (b - a) OR o_totalprice > b + 0.4 * (b - a)""")
def _(t):
    return P.outliers_iqr(t.orders, "o_totalprice", k=0.4, method="index").select("o_orderkey", "o_totalprice")


@query("pro19_outliers_zscore", """
SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs(value - m) / s > 2.0""")
def _(t):
    return P.outliers_zscore(t.events, "value", 2.0).select("event_id")


@query("pro20_outliers_median", """
SELECT event_id FROM events, (SELECT median(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs(value - m) > 2.5 * s""")
def _(t):
    return P.outliers_median(t.events, "value").select("event_id")


_FENCED = """SELECT count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS o, count({c}) AS n FROM {t},
 (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t})"""


@query("pro21_outlier_summary", "WITH x AS (" + " UNION ALL ".join(
    _FENCED.format(c=c, t=tb) for c, tb in [("value", "events"), ("user_id", "events")]) + """)
SELECT CAST(sum(o) AS BIGINT) AS total_outliers, count(*) FILTER (o > 0) AS columns_with_outliers, round(avg(o * 100.0 / n), 6)::DOUBLE AS avg_outlier_pct FROM x""")
def _(t):
    return rounded(P.outlier_summary(t.events, ["value", "user_id"]), "avg_outlier_pct")


@query("pro22_correlations", """
WITH p AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem
 UNION ALL SELECT 'l_quantity', 'twice', corr(l_quantity, -2 * l_quantity + l_discount) FROM lineitem
 UNION ALL SELECT 'l_extendedprice', 'twice', corr(l_extendedprice, -2 * l_quantity + l_discount) FROM lineitem)
SELECT a, b, round(r, 6) AS correlation, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
 CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM p WHERE abs(r) > 0.3""")
def _(t):
    df = t.lineitem.select("l_quantity", "l_extendedprice", (F.col("l_quantity") * -2 + F.col("l_discount")).alias("twice"))
    return rounded(P.correlations(df), "correlation")




@query("pro23_overall_quality", """
WITH o AS (SELECT count(*) FILTER (o_orderkey IS NULL) AS m, count(*) AS n FROM """ + URGENT + """)
SELECT round((2 + 3 * (1 - m::DOUBLE / n)) / 5, 6) AS completeness, 1.0::DOUBLE AS validity, 1.0::DOUBLE AS consistency,
 round((2 + 3 * (1 - m::DOUBLE / n)) / 5 * 0.4 + 0.6, 3) AS overall FROM o""")
def _(t):
    out = P.overall_quality(P.column_profiles(urgent(t)))
    return rounded(out, "completeness").drop("outlier_impact")


@query("pro24_recommendations", "WITH u AS (SELECT * FROM " + URGENT + ") " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", 100.0 * count(*) FILTER ({c} IS NULL) / count(*) > 20 AS many_nulls, """
    + (f"(SELECT o * 100.0 / n > 5 FROM ({_FENCED.format(c=c, t='u')}))" if num else "false") +
    f""" AS many_outliers, 100.0 * count(DISTINCT {c}) / count(*) < 10 AND count(DISTINCT {c}) > 1 AS categorical,
 {'false' if num else f"100.0 * count(DISTINCT {c}) / count(*) > 95"} AS high_cardinality FROM u"""
    for c, num in [("c_custkey", 1), ("c_nationkey", 1), ("o_orderkey", 1), ("o_totalprice", 1), ("o_orderstatus", 0)]))
def _(t):
    return P.recommendations(P.column_profiles(urgent(t)))


@query("pro24_dataset_advice", """
WITH o AS (SELECT count(*) FILTER (o_orderkey IS NULL) AS m, count(*) AS n FROM """ + URGENT + """),
s AS (SELECT round((2 + 3 * (1 - m::DOUBLE / n)) / 5 * 0.4 + 0.6, 3) AS overall FROM o)
SELECT overall, CASE WHEN overall < 0.7 THEN 'below_threshold' WHEN overall < 0.9 THEN 'room_for_improvement' ELSE 'good' END AS band, false AS many_columns FROM s""")
def _(t):
    return P.dataset_advice(P.column_profiles(urgent(t)))


@query("pro25_value_masks", """
SELECT replace(regexp_replace(regexp_replace(regexp_replace(phone, '[^a-zA-Z0-9]', '_', 'g'), '[a-zA-Z]', 'A', 'g'), '[0-9]', 'D', 'g'), '_', 'S') AS mask,
 count(*) AS n FROM """ + CONTACTS + " GROUP BY 1 ORDER BY n DESC, mask LIMIT 3")
def _(t):
    return P.value_masks(contacts(t), "phone")


@query("pro26_quality_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS total_count, count(*) FILTER (trim({c}) = '') AS null_count,
 count(DISTINCT {c}) FILTER (trim({c}) <> '') AS unique_count,
 (SELECT {c} FROM {CONTACTS} WHERE trim({c}) <> '' ORDER BY length({c}), {c} LIMIT 1) AS min_text,
 (SELECT {c} FROM {CONTACTS} WHERE trim({c}) <> '' ORDER BY length({c}) DESC, {c} DESC LIMIT 1) AS max_text FROM {CONTACTS}"""
    for c in ["email", "title"]))
def _(t):
    return P.quality_profile(contacts(t), ["email", "title"])


@query("pro26_sample_values", " UNION ALL ".join(
    f"""(SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY c_custkey) AS INTEGER) AS rn, {c} AS value FROM {CONTACTS} WHERE trim({c}) <> '' ORDER BY c_custkey LIMIT 5)"""
    for c in ["email", "title"]))
def _(t):
    return P.sample_values(contacts(t), "c_custkey", ["email", "title"])


@query("pro27_feature_profile", """
SELECT 5::BIGINT AS num_features, 4::BIGINT AS numeric_features,
 round(1 - (3 * count(*) FILTER (o_orderkey IS NULL)::DOUBLE / count(*)) / 5, 6) AS data_quality_score, count(*) AS num_samples FROM """ + URGENT)
def _(t):
    return rounded(P.feature_profile(urgent(t)), "data_quality_score")


@query("pro28_select_features", """
SELECT * FROM (SELECT 'c_custkey' AS "column", 'numeric' AS feature_type, 'normalize,standardize' AS transformations
 UNION ALL SELECT 'c_nationkey', 'numeric', 'normalize,standardize'
 UNION ALL SELECT 'c_mktsegment', 'categorical', 'one_hot_encode,label_encode' UNION ALL SELECT 'c_name', 'text', 'tfidf,word_embeddings')
WHERE (SELECT count(*) FROM customer) > 0""")
def _(t):
    df = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")))
    return P.select_features(df)


@query("pro29_pii_columns", """
SELECT 'c_custkey' AS "column", false AS potential_pii FROM customer HAVING count(*) > 0 UNION ALL SELECT 'c_name', true
UNION ALL SELECT 'c_acctbal', false UNION ALL SELECT 'contact', true UNION ALL SELECT 'other', true""")
def _(t):
    df = contacts(t).select("c_custkey", "c_name", "c_acctbal", F.col("email").alias("contact"), F.col("phone").alias("other"))
    return P.pii_columns(df)


@query("pro30_shape_flags", """
SELECT true AS temporal, false AS nested, count(DISTINCT o_orderkey) > 50 AS high_cardinality, 6 AS complexity FROM orders""")
def _(t):
    return P.shape_flags(t.orders)


@query("val18_field_statistics", "SELECT 'p_size' AS \"column\", count(*) AS count, count(p_size) AS non_null_count, "
       "0.0::DOUBLE AS null_percentage, count(DISTINCT p_size) AS unique_count, round(avg(p_size), 6) AS mean, round(median(p_size), 6) AS median, "
       "round(stddev_samp(p_size), 6) AS std, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, NULL::DOUBLE AS avg_length, NULL::INTEGER AS max_length, "
       "NULL::INTEGER AS min_length FROM part UNION ALL SELECT 'p_name', count(*), count(p_name), 0.0, count(DISTINCT p_name), NULL, NULL, NULL, NULL, NULL, "
       "round(avg(length(p_name)), 6), max(length(p_name))::INTEGER, min(length(p_name))::INTEGER FROM part")
def _(t):
    out = P.field_statistics(t.part.select("p_size", "p_name"))
    return rounded(out, "mean", "median", "std", "avg_length")
