"""Small fixtures with exact results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import aggregate, clean, dedup, enrich, filters, joins, mapping, normalize, profile, quality, sample, validate


def one(df, column):
    return [r[column] for r in df.select(column).collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "Ann", "Engineering", "90000"), (2, "Bob ", "Sales", "70000"), (2, "Bob ", "Sales", "70000"),
         (3, "", "Engineering", None), (4, "Cid", "Engineering", "n/a")],
        "id int, name string, department string, salary string")


def test_scalars(spark):
    df = spark.createDataFrame([("\t x\n", "12.9", "o'neil mc-intyre 3rd", "b a b c a")], "a string, b string, c string, d string")
    row = df.select(S.strip("a").alias("a"), S.to_int("b").alias("b"), S.title_case("c").alias("c"), S.distinct_words("d").alias("d")).head()
    assert tuple(row) == ("x", 12, "O'Neil Mc-Intyre 3Rd", "b a c")


def test_not_a_number_is_no_number(spark):
    df = spark.createDataFrame([("nan",), ("inf",), ("1_000",), ("7",)], "v string")
    assert one(df.select(S.to_float("v").alias("v")), "v") == [None, None, None, 7.0]


def test_sanitize(spark):
    df = spark.createDataFrame([("a'b\"c\\d\x00e",)], "v string")
    assert one(df.select(S.sanitize_sql("v").alias("v")), "v") == ["a''b\"\"c\\\\de"]
    html = spark.createDataFrame([("<b>ä & 'x'</b>",)], "v string")
    assert one(html.select(S.sanitize_html("v").alias("v")), "v") == ["&lt;b&gt;ä &amp; &#39;x&#39;&lt;b&gt;"]


def test_filter_rules(people):
    keep = lambda *rules: [r["id"] for r in filters.all_of(people, list(rules)).collect()]
    assert keep({"field": "department", "operator": "equals", "value": "Engineering"}) == [1, 3, 4]
    assert keep({"field": "salary", "operator": ">", "value": 80000}) == [1]
    assert keep({"field": "salary", "operator": ">", "value": 80000, "null_handling": "include"}) == [1, 3]
    assert keep({"field": "salary", "operator": "is_null"}) == [3]
    assert keep({"field": "name", "operator": "not_in", "value": "x"}) == [1, 2, 2, 3, 4]
    assert keep({"field": "absent", "operator": "equals", "value": 1}) == []
    assert keep({"field": "absent", "operator": "is_null"}) == [1, 2, 2, 3, 4]


def test_numeric_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = filters.all_of(df, [{"field": "l_quantity", "operator": ">", "value": "30"}]).select("l_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in text and "l_comment" not in text


def test_enrichment_guards(people):
    with pytest.raises(ValueError):
        enrich.calculated("__import__('os')", ["id"])
    with pytest.raises(ValueError):
        enrich.calculated("{id}+{secret}", ["id"])
    made = people.select(enrich.calculated("({id}-2)/({id}-2)", ["id"]).alias("v"))
    assert one(made, "v") == [1.0, None, None, 1.0, 1.0]


def test_lookup_keeps_null_values_of_hits(spark, people):
    table = spark.createDataFrame([("Sales", None), ("Engineering", "x")], "k string, v string")
    out = joins_lookup(people, table)
    assert sorted(out) == [(1, "x"), (2, None), (2, None), (3, "x"), (4, "x")]


def joins_lookup(people, table):
    df = enrich.lookup(people, table, "department", "k", "v", "target", "none")
    return [(r["id"], r["target"]) for r in df.collect()]


def test_aggregate_null_group_and_median(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", 5.0), ("a", None)], "g string, v double")
    rows = {r["g"]: r for r in aggregate.aggregate(df, ["g"], [
        {"field": "v", "function": "median"}, {"field": "v", "function": "count"}, {"field": "v", "function": "std"},
        {"field": "v", "function": "concat", "order_by": ["v"]}]).collect()}
    assert (rows[None]["median_v"], rows[None]["count_v"], rows[None]["concat_v"]) == (2.5, 2, "1.0, 4.0")
    assert (rows["a"]["median_v"], rows["a"]["count_v"], rows["a"]["std_v"]) == (5.0, 1, None)


def test_aggregate_without_group(people):
    row = aggregate.aggregate(people, [], [{"field": "id", "function": "median", "alias": "m"}, {"field": "id", "function": "sum", "alias": "s"}]).head()
    assert (row["m"], row["s"]) == (2.0, 12)


def test_concat_and_groups_in_parts(spark):
    df = spark.range(10).selectExpr("'k' AS k", "id", "cast(id AS string) AS v")
    parts = {r["part"]: r["v"] for r in aggregate.concat_parts(df, ["k"], "v", ["id"], rows=4).collect()}
    assert parts == {0: "0, 1, 2, 3", 1: "4, 5, 6, 7", 2: "8, 9"}
    chunks = aggregate.collect_groups(df, "k", ["id"], rows=3).collect()
    assert sorted(len(r["rows"]) for r in chunks) == [1, 3, 3, 3]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, "z")], "k int, b string")
    assert joins.join(a, b, ["k"], "left_anti").count() == 1
    with pytest.raises(ValueError):
        joins.join(a, b, ["k"], "cross")
    assert joins.referential_errors(a, b, "k", "k").head()["errors"] == 1


def test_tolerance_join_against_brute_force(spark, hot):
    a, b = hot.filter("key = 'a'"), hot.filter("key = 'b'")
    got = {(r["a_id"], r["b_id"]) for r in joins.tolerance_join(a, b, "ts", "id", "value", 3.0, last=50).collect()}
    pa = a.toPandas().sort_values(["ts", "id"]).tail(50)
    pb = b.toPandas().sort_values(["ts", "id"])
    want = set()
    for _, r in pa.iterrows():
        near = pb[(pb["ts"] - r["ts"]).abs() <= dt.timedelta(seconds=3)]
        if len(near):
            want.add((r["id"], near.iloc[0]["id"]))
    assert got == want


def test_dedup(people):
    assert [r["id"] for r in dedup.dedup_exact(people, ["id"], ["name"]).orderBy("id").collect()] == [1, 2, 3, 4]
    stats = dedup.dedup_stats(people, ["id"]).head()
    assert tuple(stats) == (5, 4, 1)


def test_dedup_parts_do_not_run_together(spark):
    df = spark.createDataFrame([(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "x"), (4, "", "x")], "id int, a string, b string")
    assert dedup.dedup_exact(df, ["a", "b"], ["id"]).count() == 4


def test_dedup_limits_before_the_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = dedup.dedup_exact(df, ["text"], ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 2


def test_clean(people):
    out = clean.clean(people, [{"type": "fill_nulls", "fields": ["salary"], "fill_value": "0"}, {"type": "unknown"}, {"type": "trim_whitespace"}])
    assert one(out, "salary") == ["90000", "70000", "70000", "0", "0"]
    assert one(out, "name")[1] == "Bob"


def test_map_fields_and_keys(people):
    out = mapping.map_fields(people, [{"source_field": "name", "target_field": "n", "transformation": "uppercase"},
                                      {"source_field": "nope", "target_field": "x", "default_value": 3}])
    assert out.columns == ["n", "x"] and out.head()["x"] == 3
    assert mapping.normalize_keys(people.toDF(" Id", "Full Name", "D", "S")).columns == ["id", "full_name", "d", "s"]


def test_validation(people):
    rules = [{"type": "required", "field": "name"}, {"type": "data_type", "field": "salary", "expected_type": "integer"}, {"type": "enum", "field": "nope", "allowed": []}]
    rows = {r["rule"]: r["errors"] for r in validate.validate(people, rules).collect()}
    assert rows == {"required:name": 1, "data_type:salary": 1, "enum:nope": 5}
    errors = validate.error_rows(people, ["id"], rules[:2]).collect()
    assert {(r["id"], r["rule_type"], r["value"]) for r in errors} == {(3, "required", ""), (4, "data_type", "n/a")}


def test_dates_and_contacts(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-28",), ("02/28/2024",), ("28/02/2024",), ("2024-02-28T01:02:03Z",), ("x",)], "v string")
    assert one(df.select(F.coalesce(validate.date_ok(F.col("v")), F.lit(False)).alias("v")), "v") == [False, True, True, True, True, False]


def test_profile_numbers(spark):
    df = spark.createDataFrame([(float(i),) for i in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "v double")
    assert [r["v"] for r in profile.outliers_iqr(df, "v").collect()] == [100.0]
    assert profile.outliers_iqr(df.filter("v < 4"), "v").count() == 0
    p = profile.percentiles(spark.range(1, 11).selectExpr("cast(id AS double) AS v"), ["v"]).head()
    assert p["p50"] == 5.5
    z = spark.createDataFrame([(float(i),) for i in [1, 2, 3, 4, 5, 6, 7, 8, 9, 50]], "v double")
    assert [r["v"] for r in profile.outliers_zscore(z, "v", 2.0).collect()] == [50.0]
    assert profile.outliers_zscore(spark.createDataFrame([(3.0,)] * 5, "v double"), "v").count() == 0
    m = spark.createDataFrame([(float(i),) for i in [*range(1, 20), 100, 200]], "v double")
    assert sorted(r["v"] for r in profile.outliers_median(m, "v").collect()) == [200.0]


def test_text_profile(spark):
    df = spark.createDataFrame([("hello",), ("world",), ("test",), ("hello",), (None,), ("a",), ("longer string",)], "v string")
    row = profile.null_unique_counts(df).head()
    assert (row["null_count"], row["unique_count"]) == (1, 5)
    lengths = profile.string_lengths(df).head()
    assert (lengths["min_length"], lengths["max_length"]) == (1, 13)
    assert one(profile.modes(df, ["v"]), "value") == ["hello"]
    assert one(df.select(profile.mask("v").alias("v")), "v")[-1] == "AAAAAASAAAAAA"


def test_correlation_needs_more_than_ten_rows(spark):
    few = spark.range(1, 11).selectExpr("cast(id AS double) AS a", "cast(id * 2 AS double) AS b")
    assert profile.correlations(few).count() == 0
    row = profile.correlations(few.unionByName(few)).head()
    assert (round(row["correlation"], 9), row["strength"], row["direction"]) == (1.0, "strong", "positive")


def test_type_inference(spark):
    df = spark.createDataFrame([("1", "1.5", "2024-01-01", None), ("2", "2", "2024-01-02", None), ("3", "x", "2024-01-03", None)],
                               "i string, m string, d string, n string")
    kinds = lambda out: {r["column"]: r["data_type"] for r in out.collect()}
    assert kinds(profile.infer_schema(df)) == {"i": "integer", "m": "string", "d": "string", "n": "unknown"}
    assert kinds(profile.infer_type_share(df)) == {"i": "integer", "m": "string", "d": "date", "n": "null"}
    assert kinds(profile.infer_type_classes(df)) == {"i": "integer", "m": "integer", "d": "date", "n": "unknown"}


def test_quality_issues_and_score(spark):
    df = spark.createDataFrame([(1, "a@b.co", 30.0), (1, "bad", 200.0), (2, None, None)], "id int, email string, age double")
    rows = {(r["issue_type"], r["field_name"]): r["record_count"] for r in quality.issues(df, quality.BUILTIN_RULES).collect()}
    assert rows == {("completeness", "email"): 1, ("completeness", "age"): 1, ("uniqueness", "id"): 1, ("format", "email"): 1, ("range", "age"): 1}
    s = quality.score(quality.issues(df, quality.BUILTIN_RULES), F.lit(3)).head()
    assert s["score"] == round(max(0, 100 - 10 * (2 * 1 / 3 * 2 + 3 * 1 / 3 * 5)), 2)


def test_normalize_edges(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    out = normalize.normalize(df, [{"field": "v", "method": m, "target": m} for m in ("min_max", "z_score", "decimal_scaling")])
    rows = [tuple(r)[1:] for r in out.collect()]
    assert rows == [(0.0, 0.0, 0.5), (0.0, 0.0, 0.5), (None, None, None)]


def test_label_encode_numbers_by_frequency(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "v string")
    got = {r["v"]: r["l"] for r in normalize.label_encode(df, "v", "l").collect()}
    assert got == {"b": 0.0, "a": 1.0, "c": 2.0, None: 3.0}


def test_samples(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS g")
    first = [r["id"] for r in sample.random_rows(df, "id", 50, 1).collect()]
    assert first == [r["id"] for r in sample.random_rows(df.repartition(7), "id", 50, 1).collect()]
    assert [r["id"] for r in sample.systematic(df, ["id"], 10).orderBy("id").collect()] == list(range(0, 1000, 100))
    assert sample.stratified(df, "g", "id", 30).groupBy("g").count().filter("count = 10").count() == 3
    assert sample.reservoir(df, 20).count() == 20
