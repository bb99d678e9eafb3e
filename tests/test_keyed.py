"""Copy-on-write tables: what a change touches, what a failure leaves, repeated batches."""

import pytest
from pyspark.sql import functions as F

from millrace.session import scratch_path
from millrace.sources import sinks
from millrace.sources.keyed import Conflict, KeyedTable
from millrace.streaming import flow

SCHEMA = "id long, v string, at int"


@pytest.fixture()
def table(spark):
    rows = spark.range(200).selectExpr("id", "concat('v', id) AS v", "0 AS at")
    made = KeyedTable.create(spark, scratch_path(spark, "keyed"), rows.schema, ["id"], 8)
    assert made.upsert(rows, ["at"]) == 8
    return made


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(table):
    return {r["id"]: r["v"] for r in table.read().collect()}


def test_one_key_rewrites_one_bucket(spark, table):
    before = table.state()["folders"]
    assert table.upsert(frame(spark, [(5, "new", 1), (5, "newer", 2), (5, "old", 0)]), ["at"]) == 1
    after = table.state()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    got = rows_of(table)
    assert len(got) == 200 and got[5] == "newer" and got[6] == "v6"


def test_inserts_and_null_keys(spark, table):
    table.upsert(frame(spark, [(None, "a", 1), (1000, "b", 1), (None, "c", 2)]), ["at"])
    table.upsert(frame(spark, [(None, "d", 1)]), ["at"])
    got = table.read().collect()
    assert len(got) == 202 and [r["v"] for r in got if r["id"] is None] == ["d"]
    # A writer with another integer type reaches the same bucket.
    table.upsert(spark.sql("SELECT CAST(1000 AS INT) AS id, 'e' AS v, 1 AS at"), ["at"])
    assert rows_of(table)[1000] == "e" and table.read().count() == 202


def test_repeated_batches_change_nothing(spark, table):
    assert table.upsert(frame(spark, [(1, "x", 1)]), ["at"], ("job", 0)) == 1
    version = table.state()["version"]
    assert table.upsert(frame(spark, [(1, "y", 9)]), ["at"], ("job", 0)) == 0
    assert table.state()["version"] == version and rows_of(table)[1] == "x"
    assert table.upsert(frame(spark, [(1, "y", 9)]), ["at"], ("other", 0)) == 1


def test_failure_before_the_swap_leaves_the_old_state(spark, table, monkeypatch):
    old = table.read()

    def broken(self, state):
        raise OSError("no space")

    monkeypatch.setattr(KeyedTable, "_commit", broken)
    with pytest.raises(OSError):
        table.upsert(frame(spark, [(1, "lost", 1)]), ["at"])
    monkeypatch.undo()
    assert rows_of(table)[1] == "v1"
    table.upsert(frame(spark, [(1, "kept", 1)]), ["at"])
    # A reader goes on with the state it began with; vacuum removes what no version names.
    assert {r["id"]: r["v"] for r in old.collect()}[1] == "v1" and rows_of(table)[1] == "kept"
    assert table.vacuum() >= 2 and rows_of(table)[1] == "kept"


def test_two_writers(spark, table):
    state = table.state()
    table.upsert(frame(spark, [(1, "first", 1)]), ["at"])
    with pytest.raises(Conflict):
        table._commit({**state, "version": state["version"] + 1})
    assert rows_of(table)[1] == "first"


def test_missing_tables_and_keys(spark):
    with pytest.raises(sinks.LoadError):
        KeyedTable(spark, scratch_path(spark, "none")).read()
    with pytest.raises(sinks.LoadError):
        KeyedTable.create(spark, scratch_path(spark, "bad"), frame(spark, []).schema, ["nope"])
    empty = KeyedTable.create(spark, scratch_path(spark, "empty"), frame(spark, []).schema, ["id"])
    assert empty.read().count() == 0 and empty.upsert(frame(spark, []), ["at"]) == 0


def test_stream_into_keyed_table(spark, table):
    run = flow.upsert_into(table, ["id"], ["at"])
    run(frame(spark, [(1, "s", 1)]), 0)
    run(frame(spark, [(1, "t", 2)]), 1)
    run(frame(spark, [(1, "s", 1)]), 0)
    assert rows_of(table)[1] == "t"


def test_plain_table_survives_a_failing_upsert(spark):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS keyed_db LOCATION '{scratch_path(spark, 'db')}'")
    spark.catalog.setCurrentDatabase("keyed_db")
    try:
        frame(spark, [(1, "a", 0)]).write.saveAsTable("plain")
        bad = frame(spark, [(1, "b", 1)]).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
        with pytest.raises(Exception):
            sinks.upsert_table(spark, "plain", bad, ["id"], ["at"])
        assert [tuple(r) for r in spark.table("plain").collect()] == [(1, "a", 0)]
        sinks.upsert_table(spark, "plain", frame(spark, [(1, "b", 1), (2, "c", 1)]), ["id"], ["at"])
        assert sorted(tuple(r) for r in spark.table("plain").collect()) == [(1, "b", 1), (2, "c", 1)]
    finally:
        spark.catalog.setCurrentDatabase("default")
