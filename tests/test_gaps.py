"""Small operators: nested cleaning, key rules, XML by suffix, merge sink."""

import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import lineage, validate
from millrace.session import scratch_path
from millrace.sources import readers, sinks


def test_sanitize_at_any_depth(spark):
    df = spark.sql("""SELECT named_struct('a', "x'y", 'b', array(named_struct('c', 'q"r', 'n', 1)), 'm', map("k'", array('\\\\'))) AS v""")
    df = df.unionByName(spark.createDataFrame([], df.schema)).unionByName(df.select(F.lit(None).cast(df.schema["v"].dataType).alias("v")))
    got = [r["v"] for r in df.select(scalars.sanitize_deep("v", df.schema["v"].dataType).alias("v")).collect()]
    assert got[0]["a"] == "x''y" and got[0]["b"][0]["c"] == 'q""r' and got[0]["b"][0]["n"] == 1
    assert list(got[0]["m"]) == ["k''"]
    slashes = got[0]["m"]["k''"][0]
    assert slashes == "\\" * len(slashes) and len(slashes) == 2 * df.selectExpr("length(element_at(v.m, \"k'\")[0]) AS n").head()["n"]
    assert got[1] is None


def test_primary_key_must_be_declared(spark):
    df = spark.range(3)
    assert validate.schema_check(df, [{"name": "id", "unique": True}], ["id"]).head()["errors"] == 0
    with pytest.raises(ValueError, match="primary key"):
        validate.schema_check(df, [{"name": "id"}], ["other"])


def test_xml_by_suffix(spark):
    path = scratch_path(spark, "rows") + ".xml"
    spark.range(4).withColumn("t", F.lit("a<b")).write.format("xml").option("rowTag", "row").save(path)
    assert sorted(r["id"] for r in readers.read_auto(spark, path).collect()) == [0, 1, 2, 3]


def test_merge_falls_back_to_a_rewrite(spark):
    table = f"m_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS gap_db LOCATION '{scratch_path(spark, 'db')}'")
    spark.catalog.setCurrentDatabase("gap_db")
    try:
        spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, at int").write.saveAsTable(table)
        new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, at int")
        assert sinks.merge_table(spark, table, new, ["id"], ["at"]) == "rewrite"
        assert sorted(map(tuple, spark.table(table).select("id", "v").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    finally:
        spark.catalog.setCurrentDatabase("default")


def test_long_cycles_and_cut_ones(spark):
    ring = spark.createDataFrame([(f"n{k:02d}", f"n{(k + 1) % 12:02d}") for k in range(12)], "src string, dst string")
    whole = lineage.find_cycles(ring).collect()
    assert len(whole) == 1 and len(whole[0]["cycle"]) == 12 and whole[0]["complete"]
    both = ring.unionByName(spark.createDataFrame([("n00", "n11")], "src string, dst string"))
    cut = lineage.find_cycles(both, depth=5).collect()
    assert [r["cycle"] for r in cut] == [["n00", "n11"]] and not cut[0]["complete"]
