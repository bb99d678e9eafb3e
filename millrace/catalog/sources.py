"""Sources, sinks, SQL surface, declared chains and custom functions (SRC, SNK, SQL, PIP, UDF)."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions import patterns as PT
from ..operators import custom as C
from ..operators import validate as V
from ..plans import chain, sqlsurface
from ..session import scratch_path
from ..sources import keyed, payloads, readers, sinks
from .profiling import rounded
from .registry import query
from .relational import runs

COLUMN = '"column"'


@query("src01_read_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _(t):
    path = scratch_path(t.spark, "nation") + ".csv"
    sinks.write_file(t.nation.coalesce(1), path, "csv", sep=";")
    return readers.read_csv(t.spark, path)


@query("src02_read_json", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def _(t):
    path = scratch_path(t.spark, "region") + ".json"
    one = t.region.agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))
    sinks.write_file(one, path, "text")
    return readers.read_json(t.spark, path, "r_regionkey bigint, r_name string")


@query("src03_read_jsonl", "SELECT event_id, user_id, event_type, value, props FROM events")
def _(t):
    path = scratch_path(t.spark, "events") + ".jsonl"
    sinks.write_file(t.events.select("event_id", "user_id", "event_type", "value", "props"), path, "json")
    return readers.read_auto(t.spark, path).select("event_id", "user_id", "event_type", "value", "props")


@query("src04_read_parquet", "SELECT * FROM part")
def _(t):
    return readers.read_parquet(t.spark, t.path("part"))


@query("src05_read_auto", "SELECT * FROM supplier")
def _(t):
    return readers.read_auto(t.spark, t.path("supplier"))


_ENDINGS = [".csv", ".tsv", ".jsonl", ".pq", ".xml", ".log", ".avro", ".orc", ".html"]


@query("src06_detect_format", "SELECT page_id, ['csv','csv','json','parquet','xml','text','avro','orc','unknown'][page_id % 9 + 1] AS format FROM pages")
def _(t):
    ends = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("page_id") % 9 + 1).cast("int"))
    return t.pages.select("page_id", readers.detect_format(F.concat("url", ends)).alias("format"))


@query("src06_detect_format_urls", "SELECT CASE " + " ".join(
    f"WHEN regexp_matches(lower(url), '{p}') THEN '{k}'" for k, p in PT.FORMAT_SUFFIXES.items()) + " ELSE 'unknown' END AS format, count(*) AS n FROM pages GROUP BY 1")
def _(t):
    return t.pages.groupBy(readers.detect_format("url").alias("format")).agg(F.count("*").alias("n"))


@query("src07_read_orc", "SELECT * FROM nation")
def _(t):
    path = scratch_path(t.spark, "nation") + ".orc"
    sinks.write_file(t.nation, path, "orc")
    return readers.read_auto(t.spark, path)


@query("src07_read_xml", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(t):
    path = scratch_path(t.spark, "nation-xml")
    t.nation.select("n_nationkey", "n_name").write.format("xml").option("rowTag", "nation").option("rootTag", "nations").save(path)
    return readers.read_xml(t.spark, path, "nation", "n_nationkey bigint, n_name string")


@query("src07_read_text", "SELECT n_name AS value FROM nation")
def _(t):
    path = scratch_path(t.spark, "nation") + ".txt"
    sinks.write_file(t.nation.select("n_name"), path, "text")
    return readers.read_auto(t.spark, path)


@query("src09_sql_source", """
SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND o_totalprice > 200000 GROUP BY c_mktsegment""")
def _(t):
    t.orders.createOrReplaceTempView("orders")
    t.customer.createOrReplaceTempView("customer")
    return readers.sql_source(t.spark, """
        SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_orderstatus = :status AND o_totalprice > :least GROUP BY c_mktsegment""", {"status": "F", "least": 200000})


@query("src10_batch_plan", "SELECT count(*) AS total_records, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS batches FROM lineitem")
def _(t):
    return readers.batch_plan(t.lineitem, 1000)


@query("src11_object_store", "SELECT * FROM region")
def _(t):
    return readers.object_store_source(t.spark, t.folder, "region.parquet")


@query("src12_column_sample")
def _(t):
    return readers.column_sample(t.orders, 100)


@query("src12_column_sample_check", "SELECT least(100, count(*))::BIGINT AS n, least(100, count(*))::BIGINT AS distinct_rows, 0::BIGINT AS strange FROM orders")
def _(t):
    """Size of the sample, its different orders, and rows of it that the table does not hold."""
    few = readers.column_sample(t.orders, 100)
    strange = few.join(t.orders, few.columns, "left_anti").agg(F.count("*").alias("n")).scalar()
    return few.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_rows")).withColumn("strange", strange)


def files(t):
    """The data folder's own listing with names made relative."""
    return readers.list_files(t.spark, t.folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "length")


@query("src14_file_inventory", "SELECT 'parquet' AS format, 14::BIGINT AS files FROM region LIMIT 1")
def _(t):
    return readers.file_inventory(files(t)).select("format", "files")


@query("src14_sample_keys")
def _(t):
    return readers.sample_keys(files(t), 10)


@query("src15_detect_partitions", """
SELECT DISTINCT unnest(['event_type', 'hour']) AS partition FROM events UNION SELECT 'year/month/day' FROM events""")
def _(t):
    paths = t.events.select(F.concat(
        F.lit("data/event_type="), "event_type", F.lit("/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/hour="), F.hour("ts"), F.lit("/x.parquet")).alias("path"))
    return readers.detect_partitions(paths)


@query("src16_parquet_stats", """
SELECT column_name AS "column", CASE WHEN column_type IN ('BIGINT','INTEGER','DOUBLE') THEN 'numeric' WHEN column_type LIKE 'TIMESTAMP%' THEN 'date' ELSE 'text' END AS kind,
 (SELECT count(*) FROM orders) AS row_count FROM (DESCRIBE SELECT * FROM orders)""")
def _(t):
    return readers.parquet_stats(t.orders)


@query("src17_unwrap_envelope", """
SELECT 'list' AS kind, n_nationkey, n_name FROM nation UNION ALL SELECT 'results', n_nationkey, n_name FROM nation UNION ALL SELECT 'object', n_nationkey, n_name FROM nation""")
def _(t):
    row = F.struct("n_nationkey", "n_name")
    per = t.nation.groupBy("n_regionkey").agg(F.collect_list(row).alias("rows"))
    a = per.select(F.lit("list").alias("kind"), F.to_json("rows").alias("payload"))
    b = per.select(F.lit("results").alias("kind"), F.to_json(F.struct(F.lit("no list").alias("data"), F.col("rows").alias("results"))).alias("payload"))
    c = t.nation.select(F.lit("object").alias("kind"), F.to_json(row).alias("payload"))
    rows = payloads.unwrap_envelope(a.unionByName(b).unionByName(c), "payload", ["kind"])
    made = F.from_json("record", "n_nationkey int, n_name string").alias("r")
    return rows.select("kind", made).select("kind", "r.n_nationkey", "r.n_name")


@query("src18_flatten_graphql", """
SELECT r_regionkey AS id, '{"name":"' || r_name || '"}' AS record, NULL AS error FROM region WHERE r_regionkey <> 3
UNION ALL SELECT r_regionkey, '{"name":"x"}', NULL FROM region WHERE r_regionkey <> 3
UNION ALL SELECT r_regionkey, '{"name":"y"}', NULL FROM region WHERE r_regionkey <> 3
UNION ALL SELECT r_regionkey, NULL, '["denied"]' FROM region WHERE r_regionkey = 3""")
def _(t):
    good = F.concat(F.lit('{"data":{"region":{"name":"'), "r_name", F.lit('"},"list":[{"name":"x"},{"name":"y"}]}}'))
    payload = F.when(F.col("r_regionkey") == 3, F.lit('{"errors":["denied"]}')).otherwise(good)
    return payloads.flatten_graphql(t.region.select(F.col("r_regionkey").alias("id"), payload.alias("payload")), "payload", ["id"])


@query("src19_xml_leaves", """
SELECT n_nationkey, 'name' AS tag, n_name AS text, 'r' || n_regionkey AS region FROM nation UNION ALL SELECT n_nationkey, 'key', CAST(n_nationkey AS VARCHAR), NULL FROM nation""")
def _(t):
    doc = F.concat(F.lit("<e><body><name region='r"), F.col("n_regionkey"), F.lit("'>"), "n_name", F.lit("</name><key> "), F.col("n_nationkey"), F.lit(" </key><x/></body></e>"))
    out = payloads.xml_leaves(t.nation.select("n_nationkey", doc.alias("payload")), "payload", "n_nationkey")
    return out.select("n_nationkey", "tag", "text", F.col("attributes")["region"].alias("region"))


@query("src20_next_page", """
SELECT c_custkey, 'https://x/api?cursor=c' || (c_custkey + 1) AS by_cursor, 'https://x/api/' || (c_custkey + 1) AS by_link,
 CASE WHEN (c_custkey + 1) * 10 < 1000 THEN 'https://x/api?page=' || (c_custkey + 2) || '&size=10' END AS by_offset FROM customer""")
def _(t):
    k = F.col("c_custkey")
    doc = F.to_json(F.struct(F.concat(F.lit("c"), k + 1).alias("next_cursor"), F.concat(F.lit("https://x/api/"), k + 1).alias("next"), F.lit(1000).alias("total")))
    url = F.lit("https://x/api?old=1")
    return t.customer.select(
        "c_custkey", payloads.next_page(doc, "cursor", url).alias("by_cursor"), payloads.next_page(doc, "link", url).alias("by_link"),
        payloads.next_page(doc, "offset", url, page=k + 1, size=F.lit(10)).alias("by_offset"))


@query("src20_page_gaps", """
SELECT c_nationkey AS source, p + 1 AS missing_from, c_custkey - 1 AS missing_to FROM (
 SELECT c_nationkey, c_custkey, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer) WHERE c_custkey - p > 1""")
def _(t):
    return payloads.page_gaps(t.customer.select(F.col("c_nationkey").alias("source"), F.col("c_custkey").alias("page")), "source", "page")


_URIS = ["https://h/api/v9/x", "https://h/d/x.csv", "https://h/page", "s3://b/k", "jdbc:postgresql://h/db", "mysql://h/db", "x.parquet", "dir/file",
         "kafka-topic-a", "my-sqs-q", "plainname"]
_KINDS = ["api", "file", "api", "s3", "database", "database", "file", "file", "streaming", "message_queue", "unknown"]


@query("src22_classify_source", "SELECT page_id, [" + ", ".join(f"'{k}'" for k in _KINDS) + "][page_id % 11 + 1] AS kind FROM pages")
def _(t):
    uri = F.element_at(F.array(*[F.lit(u) for u in _URIS]), (F.col("page_id") % 11 + 1).cast("int"))
    return t.pages.select("page_id", readers.classify_source(uri).alias("kind"))


@query("src22_classify_urls", r"""
SELECT CASE WHEN regexp_matches(lower(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1)), '/api/|/v1/|/v2/|/rest/|/graphql') THEN 'api'
 WHEN regexp_matches(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '\.(json|xml|csv)$') THEN 'file' ELSE 'api' END AS kind, count(*) AS n FROM pages GROUP BY 1""")
def _(t):
    return t.pages.groupBy(readers.classify_source("url").alias("kind")).agg(F.count("*").alias("n"))


_FIELDS = ["id", "timestamp", "latitude", "props", "label", "version", "zip_code", "value", "created_at"]
_TYPES = ["bigint", "timestamp", "double", "struct<k:int>", "string", "int", "string", "decimal(10,2)", "string"]


@query("src23_data_patterns", f"""
WITH x AS (SELECT 'u' || user_id AS t, [{", ".join(f"'{f}'" for f in _FIELDS)}][event_id % 9 + 1] AS c, [{", ".join(f"'{f}'" for f in _TYPES)}][event_id % 9 + 1] AS k FROM events GROUP BY ALL)
SELECT t AS "table", bool_or(c IN ('timestamp', 'created_at')) AS has_timestamps, bool_or(c IN ('id', 'version')) AS has_incremental_keys, bool_or(c IN ('latitude', 'zip_code')) AS has_geospatial,
 bool_or(k IN ('bigint', 'double', 'int', 'decimal(10,2)')) AS has_numeric, bool_or(k = 'string') AS has_categorical, bool_or(k LIKE 'struct%') AS has_nested, 'simple' AS schema_complexity,
 CASE WHEN bool_or(c IN ('timestamp', 'created_at')) AND bool_or(c IN ('id', 'version')) THEN 'real_time' WHEN bool_or(c IN ('timestamp', 'created_at')) THEN 'batch' ELSE 'unknown' END AS update_frequency
FROM x GROUP BY t""")
def _(t):
    at = (F.col("event_id") % 9 + 1).cast("int")
    columns = t.events.select(
        F.concat(F.lit("u"), "user_id").alias("table"), F.element_at(F.array(*[F.lit(f) for f in _FIELDS]), at).alias("column"),
        F.element_at(F.array(*[F.lit(f) for f in _TYPES]), at).alias("type")).distinct()
    return readers.data_patterns(columns)


@query("src23_schema_table", """
SELECT 'orders' AS "table", column_name AS "column" FROM (DESCRIBE SELECT * FROM orders) UNION ALL SELECT 'events', column_name FROM (DESCRIBE SELECT * FROM events)""")
def _(t):
    return readers.schema_table(t.spark, {"orders": t.orders, "events": t.events}).select("table", "column")


@query("src24_estimate_volume", """
WITH n AS (SELECT page_id % 9 AS f FROM pages), r AS (SELECT sum(CASE WHEN f IN (0, 1) THEN 1000 WHEN f = 2 THEN 500 WHEN f = 3 THEN 10000 WHEN f = 6 THEN 5000 ELSE 100 END)::BIGINT AS v FROM n)
SELECT v AS estimated_records, CASE WHEN v < 10000 THEN 'small' WHEN v < 1000000 THEN 'medium' WHEN v < 100000000 THEN 'large' ELSE 'xlarge' END AS volume FROM r""")
def _(t):
    ends = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("page_id") % 9 + 1).cast("int"))
    listed = t.pages.select(F.concat("url", ends).alias("path"), F.length("html").alias("length"))
    return readers.estimate_volume(readers.file_inventory(listed))


# Sinks write the whole table and read it back.
for _format in ("csv", "json", "parquet"):

    @query(f"snk01_write_{_format}", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
    def _(t, format=_format):
        df = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
        path = scratch_path(t.spark, "orders")
        sinks.write_file(df, path, format)
        reader = t.spark.read.schema(df.schema).format(format)
        return (reader.option("header", True) if format == "csv" else reader).load(path)


@query("snk02_write_json", "SELECT count(*) AS records_loaded FROM nation")
def _(t):
    got = sinks.write_json(t.nation, scratch_path(t.spark, "nation"))
    return t.spark.range(1).select(F.lit(got["records_loaded"]).cast("long").alias("records_loaded"))


def _table(t):
    import uuid

    t.spark.sql("CREATE DATABASE IF NOT EXISTS millrace_scratch LOCATION '" + scratch_path(t.spark, "db") + "'")
    t.spark.catalog.setCurrentDatabase("millrace_scratch")
    return f"t_{uuid.uuid4().hex[:12]}"


def _in_scratch(t, fn):
    before = t.spark.catalog.currentDatabase()
    try:
        name = _table(t)
        fn(name)
        return t.spark.table(f"millrace_scratch.{name}")
    finally:
        t.spark.catalog.setCurrentDatabase(before)


@query("snk03_append", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t):
    def load(name):
        sinks.append(t.customer.select("c_custkey", "c_name"), name, create_table=True)
        sinks.append(t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), name)

    return _in_scratch(t, load)


@query("snk04_replace", "SELECT * FROM nation")
def _(t):
    def load(name):
        sinks.append(t.nation.filter("n_regionkey = 1"), name, create_table=True)
        sinks.replace(t.nation, name)

    return _in_scratch(t, load)


UPSERTED = """(WITH u AS (SELECT c_custkey + 10 * (c_custkey % 2) AS c_custkey, c_name || '!' AS c_name, c_acctbal FROM customer WHERE c_nationkey < 5)
 SELECT c_custkey, c_name, c_acctbal FROM u QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c_acctbal DESC, c_name DESC) = 1
 UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u))"""


def _updates(t):
    k = F.col("c_custkey")
    return t.customer.filter("c_nationkey < 5").select(
        (k + 10 * (k % 2)).alias("c_custkey"), F.concat("c_name", F.lit("!")).alias("c_name"), "c_acctbal")


@query("snk05_upsert", f"SELECT * FROM {UPSERTED}")
def _(t):
    return sinks.upsert(t.customer.select("c_custkey", "c_name", "c_acctbal"), _updates(t), ["c_custkey"], ["c_acctbal", "c_name"])


@query("snk05_upsert_table", f"SELECT * FROM {UPSERTED}")
def _(t):
    def load(name):
        sinks.append(t.customer.select("c_custkey", "c_name", "c_acctbal"), name, create_table=True)
        sinks.upsert_table(t.spark, name, _updates(t), ["c_custkey"], ["c_acctbal", "c_name"])

    return _in_scratch(t, load)


@query("snk05_upsert_keyed", f"SELECT * FROM {UPSERTED}")
def _(t):
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    table = keyed.KeyedTable.create(t.spark, scratch_path(t.spark, "keyed"), rows.schema, ["c_custkey"], 16)
    table.upsert(rows, ["c_acctbal", "c_name"])
    table.upsert(_updates(t), ["c_acctbal", "c_name"])
    return table.read()


@query("snk06_object_store", "SELECT * FROM region")
def _(t):
    folder = scratch_path(t.spark, "bucket")
    sinks.write_object_store(t.region, folder, "out/region.json", "json")
    return t.spark.read.schema(t.region.schema).json(f"{folder}/out/region.json")


@query("snk07_api_batches", """
SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS batch, n_name FROM nation""")
def _(t):
    packed = sinks.api_batches(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], 10)
    rows = packed.select("batch", F.explode(F.from_json("payload", "array<struct<n_nationkey:int,n_name:string>>")).alias("r"))
    return rows.select("batch", "r.n_name")


@query("snk07_api_batches_long", "SELECT (o_orderkey // 100) AS batch, count(*) AS records FROM orders GROUP BY 1")
def _(t):
    return sinks.api_batches(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100).select("batch", "records")


@query("snk09_value_guard", " UNION ALL ".join(
    f"SELECT '{c}' AS {COLUMN}, count(*) FILTER (length(CAST({c} AS VARCHAR)) > 10000) AS too_long FROM documents" for c in ["doc_id", "text", "lang"]))
def _(t):
    return sinks.value_guard(t.documents.select("doc_id", "text", "lang"))


@query("snk10_fan_out", """
SELECT unnest(['csv', 'json', 'orc']) AS format, 'completed' AS status, count(*) AS records FROM supplier""")
def _(t):
    targets = [(scratch_path(t.spark, "fan"), f) for f in ("csv", "json", "orc")]
    return sinks.fan_out(t.supplier, targets).select("format", "status", "records")


@query("snk11_load_stats", """
SELECT count(*) AS total_loads, count(*) FILTER (o_orderstatus = 'F') AS successful_loads, count(*) FILTER (o_orderstatus <> 'F') AS failed_loads,
 CAST(sum(o_orderkey % 1000) AS BIGINT) AS total_records, round(sum(o_totalprice), 2) AS total_seconds, round(sum(o_orderkey % 1000) / sum(o_totalprice), 8) AS throughput FROM orders""")
def _(t):
    rows = runs(t).withColumn("records", F.col("o_orderkey") % 1000)
    out = sinks.load_stats(rows, "status", "records", "duration")
    return rounded(rounded(out, "total_seconds", digits=2), "throughput", digits=8)


@query("sql01_query", """
SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def _(t):
    for name in ("customer", "nation", "region"):
        getattr(t, name).createOrReplaceTempView(name)
    return sqlsurface.query(t.spark, """
        SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""").rows


@query("sql01_window_query", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""")
def _(t):
    t.orders.createOrReplaceTempView("orders")
    return sqlsurface.query(t.spark, """
        WITH ranked AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
        SELECT o_custkey, o_orderkey, o_totalprice FROM ranked WHERE rn <= 2 LIMIT ALL""").rows


@query("sql01_truncated", "SELECT least(count(*), 500) AS row_count, 2 AS column_count, count(*) > 500 AS truncated FROM customer")
def _(t):
    t.customer.createOrReplaceTempView("customer")
    return sqlsurface.query(t.spark, "SELECT c_custkey, c_name FROM customer", limit=500).truncated


_LOG = ["SELECT * FROM t", "drop table x", "SELECT 1; DROP x", "select a union all select b from c", "EXEC sp_who", "update t set a = 1", "with x as (select 1) select * from x"]
_SAFE = [(True, True), (False, False), (False, False), (False, False), (True, False), (False, False), (True, False)]


@query("sql02_guard", "SELECT c_custkey, " + ", ".join(
    "[" + ", ".join(str(s[i]).lower() for s in _SAFE) + f"][c_custkey % 7 + 1] AS {n}" for i, n in enumerate(["safe", "strict_safe"])) + " FROM customer")
def _(t):
    text = F.element_at(F.array(*[F.lit(x) for x in _LOG]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return t.customer.select("c_custkey", sqlsurface.is_safe(text).alias("safe"), sqlsurface.is_safe(text, "strict").alias("strict_safe"))


@query("sql03_add_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def _(t):
    return sqlsurface.add_limit(t.orders.select("o_orderkey").orderBy("o_orderkey"), 25)


@query("sql04_plan")
def _(t):
    t.orders.createOrReplaceTempView("orders")
    return sqlsurface.plan(t.spark, "SELECT o_orderstatus, count(*) FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")


@query("sql05_to_csv", """
SELECT 'n_nationkey,n_name,n_regionkey' AS line UNION ALL SELECT n_nationkey || ',' || CASE WHEN contains(n_name, ' ') THEN n_name ELSE n_name END || ',' || n_regionkey FROM nation""")
def _(t):
    return sqlsurface.to_csv(t.nation)


@query("sql06_history", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def _(t):
    return sqlsurface.history(t.events.select("event_id", "ts"), "ts", "event_id", 30)


@query("sql06_audit_log", "SELECT 'ann' AS user_id, 'SELECT 1' AS sql, count(*) AS row_count, true AS safe FROM orders")
def _(t):
    n = sinks.write_file(t.orders, scratch_path(t.spark, "audit"))
    return sqlsurface.log_entry(t.spark, "SELECT 1", "ann", n, 0.1, dt.datetime(2024, 1, 1)).select("user_id", "sql", "row_count", "safe")


@query("sql07_export", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(t):
    t.orders.createOrReplaceTempView("orders")
    path = scratch_path(t.spark, "export")
    sinks.write_file(sqlsurface.query(t.spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus").rows, path, "parquet")
    return t.spark.read.parquet(path)


@query("sql08_bind_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice BETWEEN 1000 AND 90000")
def _(t):
    t.orders.createOrReplaceTempView("orders")
    return sqlsurface.query(t.spark, "SELECT o_orderkey FROM orders WHERE o_orderstatus = :s AND o_totalprice BETWEEN :a AND :b LIMIT ALL",
                            parameters={"s": "P", "a": 1000, "b": 90000}).rows


SPEC = """
stages:
  - {name: read, type: extractor, config: {input: documents}}
  - name: shape
    type: transformer
    config:
      operations: [lowercase_keys, strip_whitespace, no_such_step, deduplicate]
      rules:
        - {type: filter, rules: [{field: n_chars, operator: gt, value: 200}]}
        - {type: aggregation, group_by: [lang], rules: [{field: doc_id, function: count, alias: n}, {field: n_chars, function: max, alias: longest}]}
"""


@query("pip01_declared_chain", "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents WHERE n_chars > 200 GROUP BY lang")
def _(t):
    return chain.run(t.spark, SPEC, {"documents": t.documents})


@query("pip02_operations", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    twice = t.nation.unionByName(t.nation).toDF("N_NationKey", "N_Name", "N_RegionKey")
    return chain.apply_operations(twice, ["normalize", "lowercase_keys", "strip_whitespace", "drop_nulls", "deduplicate"])


@query("pip03_generic_rules", """
SELECT l_returnflag, count(l_orderkey) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag""")
def _(t):
    out = chain.generic(t.lineitem, [
        {"type": "aggregation", "order": 3, "group_by": ["l_returnflag"], "rules": [
            {"field": "l_orderkey", "function": "count", "alias": "n"}, {"field": "net", "function": "sum", "alias": "revenue"}]},
        {"type": "filter", "order": 1, "rules": [{"field": "l_quantity", "operator": ">", "value": 10}]},
        {"type": "enrichment", "order": 2, "rules": [{"type": "calculated", "target_field": "net",
            "source_fields": ["l_extendedprice", "l_discount"], "expression": "{l_extendedprice}*(1-{l_discount})"}]},
        {"type": "filter", "order": 0, "enabled": False, "rules": [{"field": "l_quantity", "operator": "<", "value": 0}]}])
    return rounded(out, "revenue", digits=2)


for _kind, _spec, _sql in [
    ("mapping", {"rules": [{"source_field": "l_orderkey", "target_field": "id"}]}, "SELECT l_orderkey AS id FROM lineitem"),
    ("filter", {"rules": [{"field": "l_tax", "operator": "eq", "value": 0.0}]}, "SELECT * FROM lineitem WHERE l_tax = 0"),
    ("filtering", {"rules": [{"field": "l_tax", "operator": "less_equal", "value": 0.01}]}, "SELECT * FROM lineitem WHERE l_tax <= 0.01"),
    ("aggregation", {"rules": [{"type": "group_by", "fields": ["l_returnflag", "l_linestatus"]}, {"type": "aggregate", "field": "l_orderkey", "function": "max"}]},
     "SELECT l_returnflag, l_linestatus, max(l_orderkey) AS max_l_orderkey FROM lineitem GROUP BY 1, 2"),
    ("validation", {"rules": [{"type": "range", "field": "l_tax", "min_value": 0, "max_value": 0.05}]},
     "SELECT count(*) AS total_records, count(*) FILTER (l_tax <= 0.05) AS valid_records, count(*) FILTER (l_tax > 0.05) AS invalid_records, 'range:l_tax' AS rule, 'range' AS rule_type, count(*) FILTER (l_tax > 0.05) AS errors FROM lineitem"),
    ("cleaning", {"rules": [{"type": "standardize_case", "fields": ["l_returnflag"]}]}, "SELECT * REPLACE (lower(l_returnflag) AS l_returnflag) FROM lineitem"),
    ("deduplication", {"order_by": ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "rules": [{"fields": ["l_suppkey", "l_returnflag"]}]},
     "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) = 1"),
]:

    @query(f"pip04_typed_{_kind}", _sql)
    def _(t, kind=_kind, spec=_spec):
        return chain.typed(t.lineitem, {"type": kind, **spec})


@query("pip03_single_field_steps", """
SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS price, 'web' AS channel, o_orderstatus || '-' || o_orderpriority AS tag, o_totalprice * o_custkey AS weight
FROM orders WHERE o_orderstatus = 'F'""")
def _(t):
    out = chain.generic(t.orders, [
        {"type": "filter_condition", "condition": {"field": "o_orderstatus", "operator": "equals", "value": "F"}},
        {"type": "add_field", "field_name": "channel", "field_value": "web"},
        {"type": "calculate_field", "field_name": "tag", "calculation": {"type": "concat", "fields": ["o_orderstatus", "o_orderpriority"], "separator": "-"}},
        {"type": "calculate_field", "field_name": "weight", "calculation": {"type": "multiply", "field1": "o_totalprice", "field2": "o_custkey"}},
        {"type": "data_type_conversion", "field_name": "o_totalprice", "target_type": "int"},
        {"type": "rename_field", "old_name": "o_totalprice", "new_name": "price"}])
    return out.select("o_orderkey", "price", "channel", "tag", "weight")


@query("pip05_per_table", "SELECT 'nation' AS \"table\", count(*) AS records FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def _(t):
    tables = {n: getattr(t, n) for n in ("nation", "region", "supplier")}
    return chain.run_tables(t.spark, tables, lambda df: chain.apply_operations(df, ["strip_whitespace"]), scratch_path(t.spark, "tables"))


@query("pip06_stage_metrics", """
SELECT 'read' AS stage, count(*) AS records FROM orders UNION ALL SELECT 'shape', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def _(t):
    spec = {"stages": [
        {"name": "read", "type": "extractor", "config": {"input": "orders"}},
        {"name": "shape", "type": "transformer", "config": {"rules": [
            {"type": "filter", "rules": [{"field": "o_orderstatus", "operator": "eq", "value": "F"}]}]}},
        {"name": "save", "type": "loader", "config": {"destination": scratch_path(t.spark, "staged"), "format": "parquet"}}]}
    metrics = {}
    chain.run(t.spark, spec, {"orders": t.orders}, metrics=metrics)
    return t.spark.createDataFrame([(n, m.get["records"]) for n, m in metrics.items()], "stage string, records long")


@query("udf01_custom_stage", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderpriority = '2-HIGH'")
def _(t):
    spec = {"stages": [{"name": "read", "type": "extractor", "config": {"input": "orders"}}, {"name": "mine", "type": "transformer"}]}
    keep = lambda df: df.filter("o_totalprice > 300000 AND o_orderpriority = '2-HIGH'").select("o_orderkey")
    return chain.run(t.spark, spec, {"orders": t.orders}, handlers={"mine": keep})


@query("udf02_custom_check", "SELECT count(*) FILTER (p_size % 7 = 0) AS failed FROM part")
def _(t):
    check = C.value_check(lambda v: int(v) % 7 != 0)
    rule = {"type": "custom", "name": "seven", "field": "p_size", "check": check}
    return V.validate(t.part, [rule]).select(F.col("errors").alias("failed"))


@query("udf03_item_map", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS k2 FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 10 <> 0")
def _(t):
    import json

    def double(row):
        k = json.loads(row["props"])["k"]
        if k % 10 == 0:
            raise ValueError("dropped")
        return {"event_id": row["event_id"], "k2": k * 2}

    return C.item_map(t.events.select("event_id", "props"), double, "event_id long, k2 long")
