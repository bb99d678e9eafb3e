"""Projection, mapping and filters (MAP, FIL)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import filters, mapping
from .registry import query


@query("map01_fields", """
SELECT o_orderkey AS id, lower(o_orderpriority) AS priority, 'n/a' AS note FROM orders""")
def _(t):
    return mapping.map_fields(t.orders, [
        {"source_field": "o_orderkey", "target_field": "id"},
        {"source_field": "o_orderpriority", "target_field": "priority", "transformation": "lowercase"},
        {"source_field": "absent", "target_field": "note", "default_value": "n/a"},
    ])


@query("map02_uppercase", "SELECT c_custkey, upper(c_mktsegment) AS seg FROM customer")
def _(t):
    return mapping.map_fields(t.customer, [
        {"source_field": "c_custkey"},
        {"source_field": "c_mktsegment", "target_field": "seg", "transformation": "uppercase"}])


@query("map03_lowercase", "SELECT c_custkey, lower(c_mktsegment) AS seg FROM customer")
def _(t):
    return mapping.map_fields(t.customer, [
        {"source_field": "c_custkey"},
        {"source_field": "c_mktsegment", "target_field": "seg", "transformation": "lowercase"}])


@query("map04_trim", r"""
SELECT doc_id, md5(regexp_replace(' ' || text || chr(10), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def _(t):
    padded = t.documents.select("doc_id", F.concat(F.lit(" "), "text", F.lit("\n")).alias("text"))
    return padded.select("doc_id", F.md5(S.strip("text")).alias("digest"))


@query("map05_date_format", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")
def _(t):
    return mapping.map_fields(t.orders, [
        {"source_field": "o_orderkey"},
        {"source_field": "o_orderdate", "target_field": "day", "transformation": "date_format",
         "parameters": {"format": "dd/MM/yyyy"}}])


@query("map06_numeric", """
SELECT p_partkey, TRY_CAST(p_brand AS DOUBLE) AS brand,
       TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no FROM part""")
def _(t):
    df = t.part.withColumn("no", F.regexp_replace("p_brand", "Brand#", ""))
    return mapping.map_fields(df, [
        {"source_field": "p_partkey"},
        {"source_field": "p_brand", "target_field": "brand", "transformation": "numeric"},
        {"source_field": "no", "target_field": "brand_no", "transformation": "numeric"}])


@query("map07_regex_replace", r"""
SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS digest FROM documents""")
def _(t):
    masked = mapping.map_fields(t.documents, [
        {"source_field": "doc_id"},
        {"source_field": "text", "transformation": "regex_replace",
         "parameters": {"pattern": "[0-9]+", "replacement": "#"}}])
    return masked.select("doc_id", F.md5("text").alias("digest"))


@query("map08_unknown_transform", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return mapping.map_fields(t.nation, [
        {"source_field": "n_nationkey"}, {"source_field": "n_name", "transformation": "no_such_thing"}])


@query("map09_add_field", "SELECT *, 'geo' AS domain FROM region")
def _(t):
    return mapping.add_field(t.region, "domain", "geo")


@query("map10_rename_field", "SELECT r_regionkey, r_name AS region FROM region")
def _(t):
    return mapping.rename_field(mapping.rename_field(t.region, "r_name", "region"), "absent", "x")


@query("map11_sum", """
SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice, 4) AS total FROM lineitem""")
def _(t):
    made = S.calculate_sum("l_quantity", "l_extendedprice", "l_returnflag")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(made, 4).alias("total"))


@query("map12_concat", "SELECT n_nationkey, n_name || '-' || n_regionkey AS tag FROM nation")
def _(t):
    return t.nation.select("n_nationkey", S.calculate_concat(["n_name", "n_regionkey"], "-").alias("tag"))


@query("map13_multiply", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS off FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             F.round(S.calculate_multiply("l_extendedprice", "l_discount"), 4).alias("off"))


@query("map14_to_int", "SELECT l_orderkey, CAST(trunc(l_extendedprice) AS BIGINT) AS v FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", S.to_int(S.to_str("l_extendedprice")).alias("v"))


@query("map15_to_float", "SELECT l_orderkey, l_extendedprice AS v FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", S.to_float(S.to_str("l_extendedprice")).alias("v"))


@query("map16_to_str", "SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation")
def _(t):
    return t.nation.select(S.to_str("n_nationkey").alias("k"))


@query("map17_to_bool", "SELECT doc_id, quality <> 0 AS quality, toxic = 1 AS toxic FROM labels")
def _(t):
    return t.labels.select("doc_id", S.to_bool("quality").alias("quality"),
                           S.to_bool(S.to_str("toxic"), text=True).alias("toxic"))


@query("map18_default_columns", """
SELECT c_custkey, c_name, round(CAST(5 + CASE WHEN c_mktsegment = '' THEN 0 ELSE 1 END AS DOUBLE) / 6, 6)
       AS data_quality_score
FROM (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer)""")
def _(t):
    blanked = t.customer.withColumn(
        "c_mktsegment", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")))
    made = mapping.default_columns(blanked, F.current_timestamp())
    return made.select("c_custkey", "c_name", F.round("data_quality_score", 6).alias("data_quality_score"))


@query("map19_normalize_keys", 'SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey FROM nation')
def _(t):
    odd = t.nation.toDF(" Nation Key", "Nation Name ", "N_REGIONKEY")
    return mapping.normalize_keys(odd.withColumn("Nation Name ", F.concat(F.lit("\t"), F.col("Nation Name "))))


@query("map20_lowercase_keys", "SELECT * FROM nation")
def _(t):
    return mapping.lowercase_keys(t.nation.toDF("N_NATIONKEY", "N_Name", "n_regionkey"))


@query("map21_strip_whitespace", r"""
SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest, lang FROM documents""")
def _(t):
    padded = t.documents.select("doc_id", "text", F.concat(F.lit("\t"), "lang", F.lit(" ")).alias("lang"))
    return mapping.strip_whitespace(padded).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("map22_square", "SELECT l_orderkey, l_quantity, l_quantity * l_quantity AS squared FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_quantity", S.square("l_quantity").alias("squared"))


@query("map23_categorize", """
SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 25 THEN 'medium' ELSE 'high' END AS class FROM events""")
def _(t):
    return t.events.select("event_id", S.categorize("value", 10, 25).alias("class"))


@query("map24_row_completeness", """
SELECT c_custkey, round((2 + CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END) / 3.0, 6)::DOUBLE AS filled FROM customer""")
def _(t):
    holes = t.customer.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return holes.select("c_custkey", F.round(S.row_completeness(["c_custkey", "c_name", "c_acctbal"]), 6).alias("filled"))


@query("map25_sanitize_sql", r"""
SELECT doc_id, md5(replace(replace(replace(text, '''', ''''''), '"', '""'), '\', '\\')) AS digest FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(S.sanitize_sql("text")).alias("digest"))


@query("map26_sanitize_html", r"""
SELECT page_id, md5(regexp_replace(
  replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'),
  '[^\p{L}\p{M}\p{N}_\s\-.,@#$%^&*()+=\[\]{}|;:!?]', '', 'g')) AS digest FROM pages""")
def _(t):
    return t.pages.select("page_id", F.md5(S.sanitize_html("html")).alias("digest"))


@query("map27_standardize_schema", """
SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance, NULL::BIGINT AS extra FROM customer
UNION ALL SELECT s_suppkey, s_name, CAST(s_acctbal AS VARCHAR), NULL FROM supplier""")
def _(t):
    schema = T.StructType.fromDDL("id bigint, name string, balance string, extra bigint")
    a = mapping.standardize_schema(t.customer, schema, {"id": "c_custkey", "name": "c_name", "balance": "c_acctbal"})
    b = mapping.standardize_schema(t.supplier, schema, {"id": "s_suppkey", "name": "s_name", "balance": "s_acctbal"})
    return a.unionByName(b)


def _filter(name, table, keep, rule, where, **more):
    """One filter rule against its WHERE clause."""
    cols = ", ".join(keep)

    @query(name, f"SELECT {cols} FROM {table} WHERE {where}")
    def _(t):
        return filters.all_of(getattr(t, table), [{**rule, **more}]).select(*keep)


_filter("fil01_equals", "orders", ["o_orderkey"],
        {"field": "o_orderstatus", "operator": "equals", "value": "F"}, "o_orderstatus = 'F'")
_filter("fil02_not_equals", "orders", ["o_orderkey"],
        {"field": "o_orderstatus", "operator": "!=", "value": "F"}, "o_orderstatus <> 'F'")
_filter("fil03_greater_than", "lineitem", ["l_orderkey", "l_quantity"],
        {"field": "l_quantity", "operator": "greater_than", "value": "30"}, "l_quantity > 30")
_filter("fil04_greater_equal", "lineitem", ["l_orderkey", "l_quantity"],
        {"field": "l_quantity", "operator": ">=", "value": 30}, "l_quantity >= 30")
_filter("fil05_less_than", "lineitem", ["l_orderkey", "l_quantity"],
        {"field": "l_quantity", "operator": "<", "value": 5}, "l_quantity < 5")
_filter("fil06_less_equal", "lineitem", ["l_orderkey", "l_quantity"],
        {"field": "l_quantity", "operator": "less_equal", "value": 5}, "l_quantity <= 5")
_filter("fil07_in", "customer", ["c_custkey", "c_mktsegment"],
        {"field": "c_mktsegment", "operator": "in", "value": ["MACHINERY", "FURNITURE"]},
        "c_mktsegment IN ('MACHINERY','FURNITURE')")
_filter("fil08_not_in", "customer", ["c_custkey", "c_mktsegment"],
        {"field": "c_mktsegment", "operator": "not_in", "value": ["MACHINERY", "FURNITURE"]},
        "c_mktsegment NOT IN ('MACHINERY','FURNITURE')")
_filter("fil09_contains", "part", ["p_partkey", "p_name"],
        {"field": "p_name", "operator": "contains", "value": "ring"}, "contains(p_name, 'ring')")
_filter("fil10_not_contains", "part", ["p_partkey", "p_name"],
        {"field": "p_name", "operator": "not_contains", "value": "ring"}, "NOT contains(p_name, 'ring')")
_filter("fil11_starts_with", "part", ["p_partkey", "p_name"],
        {"field": "p_name", "operator": "starts_with", "value": "red"}, "starts_with(p_name, 'red')")
_filter("fil12_ends_with", "part", ["p_partkey", "p_name"],
        {"field": "p_name", "operator": "ends_with", "value": "bolt"}, "ends_with(p_name, 'bolt')")
_filter("fil13_regex", "documents", ["doc_id"],
        {"field": "text", "operator": "regex", "value": r"[0-9]{3}-[0-9]{4}"},
        r"regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
_filter("fil16_unknown_operator", "nation", ["n_nationkey"],
        {"field": "n_name", "operator": "resembles", "value": "x"}, "true")

# Customers joined to their 1998 urgent orders: many have none, so nulls are real.
URGENT = """(SELECT c_custkey, c_nationkey, o_orderkey, o_totalprice, o_orderstatus FROM customer
 LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1998)
 ON c_custkey = o_custkey)"""


def urgent(t):
    orders = t.orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 1998))
    joined = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_nationkey", "o_orderkey", "o_totalprice", "o_orderstatus")


@query("fil14_is_null", f"SELECT c_custkey FROM {URGENT} WHERE o_orderkey IS NULL")
def _(t):
    return filters.all_of(urgent(t), [{"field": "o_orderkey", "operator": "is_null"}]).select("c_custkey")


@query("fil15_is_not_null", f"SELECT c_custkey, o_orderkey FROM {URGENT} WHERE o_orderkey IS NOT NULL")
def _(t):
    return filters.all_of(urgent(t), [{"field": "o_orderkey", "operator": "is_not_null"}]).select("c_custkey", "o_orderkey")


@query("fil17_all_of", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 10 AND l_discount <= 0.05 AND l_returnflag IN ('A','R')""")
def _(t):
    return filters.all_of(t.lineitem, [
        {"field": "l_quantity", "operator": ">", "value": 10},
        {"field": "l_discount", "operator": "<=", "value": 0.05},
        {"field": "l_returnflag", "operator": "in", "value": ["A", "R"]},
    ]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("fil18_null_handling", f"""
SELECT c_custkey, o_totalprice FROM {URGENT} WHERE o_totalprice > 200000 OR o_totalprice IS NULL""")
def _(t):
    rule = {"field": "o_totalprice", "operator": "greater_than", "value": 200000, "null_handling": "include"}
    return filters.all_of(urgent(t), [rule]).select("c_custkey", "o_totalprice")


@query("fil19_short_names", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_totalprice < 300000
AND o_orderpriority <> '5-LOW' AND o_custkey > 5 AND o_custkey <= 1400""")
def _(t):
    return filters.all_of(t.orders, [
        {"field": "o_orderstatus", "operator": "eq", "value": "O"},
        {"field": "o_totalprice", "operator": "gte", "value": 100000},
        {"field": "o_totalprice", "operator": "lt", "value": 300000},
        {"field": "o_orderpriority", "operator": "ne", "value": "5-LOW"},
        {"field": "o_custkey", "operator": "gt", "value": 5},
        {"field": "o_custkey", "operator": "lte", "value": 1400},
    ]).select("o_orderkey")


@query("fil20_typed_condition", """
SELECT p_partkey FROM part WHERE p_size > 20 AND contains(p_name, 'bolt')""")
def _(t):
    df = t.part
    return df.filter(
        filters.typed_condition(df, "p_size", "greater_than", 20)
        & filters.typed_condition(df, "p_name", "contains", "bolt")
        & ~filters.typed_condition(df, "p_name", "greater_than", 3)
        & ~filters.typed_condition(df, "absent", "equals", 3)
    ).select("p_partkey")


@query("fil21_drop_nulls", f"SELECT * FROM {URGENT} WHERE o_orderkey IS NOT NULL AND o_orderstatus <> 'F'")
def _(t):
    holed = urgent(t).withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "NULL").otherwise(F.col("o_orderstatus")))
    return mapping.drop_nulls(holed)
