"""Deduplication, cleaning, sampling, normalization (DED, CLN, SMP, NRM)."""

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import dedup as D
from ..operators import normalize as N
from ..operators import sample as P
from ..session import scratch_path
from ..sources import sinks
from .mapping import URGENT, urgent
from .registry import query


@query("ded01_exact", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(t):
    return D.dedup_exact(t.documents.select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@query("ded02_fuzzy", r"""
SELECT min(doc_id) AS doc_id FROM documents
GROUP BY regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')""")
def _(t):
    return D.dedup_fuzzy(t.documents.select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@query("ded03_numeric", "SELECT min(p_partkey) AS p_partkey FROM part GROUP BY round_even(p_retailprice / 7.0, 0)")
def _(t):
    return D.dedup_numeric(t.part, ["p_retailprice"], 7.0, ["p_partkey"]).select("p_partkey")


@query("ded04_composite", """
SELECT l_returnflag, l_suppkey, l_orderkey, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY lower(l_returnflag), l_suppkey, round_even(l_quantity / 10.0, 0)
 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) = 1""")
def _(t):
    rules = [{"type": "fuzzy", "fields": ["l_returnflag"]}, {"type": "exact", "fields": ["l_suppkey"]},
             {"type": "numeric", "fields": ["l_quantity"], "threshold": 10}]
    rows = t.lineitem.select("l_returnflag", "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return D.dedup(rows, rules, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select(
        "l_returnflag", "l_suppkey", "l_orderkey", "l_partkey")


@query("ded05_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def _(t):
    return D.dedup_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_suppkey"))


@query("ded06_stats", """
SELECT count(*) AS original, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS removed FROM documents""")
def _(t):
    return D.dedup_stats(t.documents, ["text"])


@query("ded07_duplicate_share", """
SELECT round(1 - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) / count(*), 8) AS duplicate_share
FROM lineitem""")
def _(t):
    out = D.duplicate_share(t.lineitem.select("l_orderkey", "l_linenumber"))
    return out.select(F.round("duplicate_share", 8).alias("duplicate_share"))


def _clean(name, rule, sql, table="documents", key="doc_id", field="text", digest=True):
    shown = f"md5({sql})" if digest else sql

    @query(name, f"SELECT {key}, {shown} AS v FROM {table}")
    def _(t):
        out = C.clean(getattr(t, table).select(key, field), [{"fields": [field], **rule}])
        return out.select(key, (F.md5(field) if digest else F.col(field)).alias("v"))


_clean("cln01_trim", {"type": "trim_whitespace"}, r"regexp_replace(text, '^\s+|\s+$', '', 'g')")
_clean("cln02_remove_duplicates", {"type": "remove_duplicates"}, r"""(SELECT string_agg(w, ' ' ORDER BY i) FROM
 (SELECT w, min(i) AS i FROM (SELECT unnest(s) AS w, generate_subscripts(s, 1) AS i FROM
  (SELECT regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS s)) GROUP BY w))""")
_clean("cln03_case_upper", {"type": "standardize_case", "case": "upper"}, "upper(p_name)", "part", "p_partkey", "p_name", False)
_clean("cln03_case_lower", {"type": "standardize_case", "case": "lower"}, "lower(p_type)", "part", "p_partkey", "p_type", False)
_clean("cln03_case_title", {"type": "standardize_case", "case": "title"},
       "list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b)",
       "part", "p_partkey", "p_name", False)
_clean("cln04_special_chars", {"type": "remove_special_chars"}, r"regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g')")
_clean("cln05_normalize_numbers", {"type": "normalize_numbers"}, "TRY_CAST(p_brand AS DOUBLE)", "part", "p_partkey", "p_brand", False)
_clean("cln07_validate_format", {"type": "validate_format", "pattern": r"Customer#0000000[0-4]", "default_value": "bad"},
       "CASE WHEN regexp_matches(c_name, '^Customer#0000000[0-4]') THEN c_name ELSE 'bad' END", "customer", "c_custkey", "c_name", False)


@query("cln06_fill_nulls", f"""
SELECT c_custkey, CASE WHEN o_orderstatus IS NULL OR o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus END AS o_orderstatus FROM {URGENT}""")
def _(t):
    worded = urgent(t).select("c_custkey", F.when(F.col("o_orderstatus") == "F", "N/A").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return C.clean(worded, [{"type": "fill_nulls", "fields": ["o_orderstatus"], "fill_value": "none"}])


@query("cln08_field_scope", "SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation")
def _(t):
    padded = t.nation.withColumn("n_name", F.concat(F.lit("  "), "n_name", F.lit("\n")))
    return C.clean(padded, [{"type": "trim_whitespace"}, {"type": "no_such_rule"}, {"type": "standardize_case", "case": "upper"}])


@query("smp01_random", "SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey) LIMIT 500")
def _(t):
    return P.random_rows(t.orders, "o_orderkey", 500, seed=7).select("o_orderkey")


@query("smp02_systematic", """
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS c FROM orders)
WHERE i % (c // 700) = 0 ORDER BY i LIMIT 700""")
def _(t):
    return P.systematic(t.orders.select("o_orderkey"), ["o_orderkey"], 700)


@query("smp02_systematic_sql", """
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS c FROM orders)
WHERE i % (c // 700) = 0 ORDER BY i LIMIT 700""")
def _(t):
    return P.systematic(t.orders.select("o_orderkey"), ["o_orderkey"], 700, sql_form=True)


@query("smp03_stratified", """
SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment,
 row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0:' || c_custkey)) AS rn FROM customer)
WHERE rn <= 60 ORDER BY rn, c_mktsegment LIMIT 180""")
def _(t):
    return P.stratified(t.customer, "c_mktsegment", "c_custkey", 180).select("c_custkey", "c_mktsegment")


@query("smp04_reservoir")
def _(t):
    return P.reservoir(t.orders, 300, seed=3).select("o_orderkey")


@query("smp05_head")
def _(t):
    return P.head(t.orders, 100).select("o_orderkey")


@query("smp06_line_sample")
def _(t):
    path = scratch_path(t.spark, "lines")
    sinks.write_file(t.events.select("event_id", "value"), path, "json")
    return P.line_sample(t.spark, path, 200, seed=2)


@query("smp06_line_sample_check", "SELECT least(200, count(*))::BIGINT AS n, least(200, count(*))::BIGINT AS distinct_lines, least(200, count(*))::BIGINT AS known FROM events")
def _(t):
    """Size of the sample, its different lines, and those that are lines of the file."""
    path = scratch_path(t.spark, "lines")
    sinks.write_file(t.events.select("event_id", "value"), path, "json")
    few = P.line_sample(t.spark, path, 200, seed=2)
    known = few.join(t.spark.read.text(path).distinct(), "value", "left_semi").agg(F.count("*").alias("n")).scalar()
    return few.agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_lines")).withColumn("known", known)


@query("smp07_multi_file", "SELECT 2 AS files, 20 AS least, 20 AS most")
def _(t):
    folder = scratch_path(t.spark, "two")
    for part in (0, 1):
        t.customer.filter(F.col("c_custkey") % 2 == part).coalesce(1).write.mode("append").parquet(folder)
    counts = P.multi_file(t.spark.read.parquet(folder), 40, 2).groupBy("file_path").agg(F.count_distinct("c_custkey").alias("n"))
    return counts.agg(F.count("*").alias("files"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("smp08_percentage")
def _(t):
    return P.percentage(t.orders, 10.0, seed=5).select("o_orderkey")


def _size(name, make, key, n, table):
    """Size and distinctness of a random sample."""

    @query(name, f"SELECT least({n}, count(*)) AS n, least({n}, count(*)) AS distinct_rows FROM {table}")
    def _(t):
        return make(t).agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct_rows"))


_size("smp04_reservoir_size", lambda t: P.reservoir(t.orders, 300, seed=3), "o_orderkey", 300, "orders")
_size("smp05_head_size", lambda t: P.head(t.orders, 100), "o_orderkey", 100, "orders")


@query("smp08_percentage_range", "SELECT true AS in_range FROM orders HAVING count(*) > 0")
def _(t):
    orders = t.orders
    total = orders.agg(F.count("*").alias("n")).scalar()
    share = F.count("*") / F.max("n")
    return P.percentage(orders, 10.0, seed=5).withColumn("n", total).agg(((share > 0.07) & (share < 0.13)).alias("in_range"))


@query("smp09_report", "SELECT count(*) AS total_records, 250::BIGINT AS sample_size, 'random' AS strategy FROM orders")
def _(t):
    orders = t.orders
    return P.sample_report(orders, P.random_rows(orders, "o_orderkey", 250), "random")


def _norm(name, method, sql):
    @query(name, f"""WITH s AS (SELECT min(p_retailprice) AS mn, max(p_retailprice) AS mx, avg(p_retailprice) AS av,
 stddev_samp(p_retailprice) AS sd, sqrt(sum(p_retailprice * p_retailprice)) AS mag FROM part)
SELECT p_partkey, round({sql}, 8) AS scaled FROM part, s""")
    def _(t):
        out = N.normalize(t.part.select("p_partkey", "p_retailprice"), [
            {"field": "p_retailprice", "method": method, "target": "scaled"}])
        return out.select("p_partkey", F.round("scaled", 8).alias("scaled"))


_norm("nrm01_min_max", "min_max", "(p_retailprice - mn) / (mx - mn)")
_norm("nrm02_z_score", "z_score", "(p_retailprice - av) / sd")
_norm("nrm03_decimal_scaling", "decimal_scaling", "p_retailprice / pow(10, length(CAST(floor(mx) AS BIGINT)::VARCHAR))")
_norm("nrm04_unit_vector", "unit_vector", "p_retailprice / mag")


@query("nrm05_column_stats", """
SELECT 'p_size' AS "column", count(p_size) AS count, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, round(avg(p_size), 6) AS mean,
 round(stddev_samp(p_size), 6) AS std, round(sqrt(sum(p_size * p_size)), 6) AS magnitude FROM part
UNION ALL SELECT 'p_retailprice', count(p_retailprice), min(p_retailprice), max(p_retailprice), round(avg(p_retailprice), 6),
 round(stddev_samp(p_retailprice), 6), round(sqrt(sum(p_retailprice * p_retailprice)), 6) FROM part""")
def _(t):
    out = N.column_stats(t.part, ["p_size", "p_retailprice"])
    for c in ("mean", "std", "magnitude"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("nrm06_robust_scale", """
SELECT l_orderkey, l_linenumber, round((l_extendedprice - q1) / greatest(q3 - q1, 1e-8), 6) AS scaled FROM lineitem,
 (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return N.robust_scale(df, "l_extendedprice", "scaled").select("l_orderkey", "l_linenumber", F.round("scaled", 6).alias("scaled"))


@query("nrm07_label_encode", """
SELECT p_partkey, CAST(r AS DOUBLE) AS label FROM part JOIN (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS r
 FROM part GROUP BY p_type) USING (p_type)""")
def _(t):
    return N.label_encode(t.part.select("p_partkey", "p_type"), "p_type", "label").select("p_partkey", "label")


@query("nrm07_one_hot", """
WITH r AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS r, count(*) OVER () AS k FROM part GROUP BY p_type)
SELECT p_partkey, list_transform(range(0, k - 1), lambda i: CASE WHEN i = r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hot FROM part JOIN r USING (p_type)""")
def _(t):
    from pyspark.ml.functions import vector_to_array

    out = N.one_hot_encode(t.part.select("p_partkey", "p_type"), "p_type", "hot")
    return out.select("p_partkey", vector_to_array("hot").alias("hot"))


@query("nrm07_tfidf", r"""
WITH w AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(trim(p_name)), '\s+')) AS term FROM part),
c AS (SELECT p_partkey, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL)
SELECT p_partkey, term, round(tf * ln(((SELECT count(*) FROM part) + 1) / (count(*) OVER (PARTITION BY term) + 1)), 8) AS weight FROM c""")
def _(t):
    out = N.tfidf(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", "weight")
    return out.withColumn("weight", F.round("weight", 8))
