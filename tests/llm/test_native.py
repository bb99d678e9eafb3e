"""Rule ledger and mixing against SQL, plain Python and by hand."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, rules
from millrace.llm.queries import ORACLES, QUERIES
from tools.compare import kind, rows_of

from ..conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    got, cols = rows_of(df.columns, df.collect())
    want, wcols = rows_of(rel.columns, rel.fetchall())
    assert cols == wcols
    assert {c: kind(t) for c, t in df.dtypes} == {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert got == want


def plain(text):
    """Measurements by plain Python."""
    t = text or ""
    w = WORDS.findall(t)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e", "a a a a a", "a a a a a a", "x y z\nx y z\n\nx y z\r\n", "# * $ %\x0b& | < >",
    "é ü 日本 語 \U0001F600 w", "p q r s t u p q r s t v p q r s t", "\n".join(["same line here now ok"] * 3), "word " * 30000,
]


def test_ledger_edges(spark):
    rnd = random.Random(5)
    texts = TEXTS + [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    rows = [(None if i == 3 else i % 50, t, "x", None, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:4], DOCS).withColumns({"n_words": F.lit("clash"), "fail_bits": F.lit(7), "_t": F.lit(0)})
    got = sorted((r["doc_id"], *r[1:6]) if r["doc_id"] is not None else (-1, *r[1:6]) for r in rules.ledger(df.select("doc_id", "text"), ["doc_id"]).collect())
    want = sorted((-1 if r[0] is None else r[0], *plain(r[1])) for r in rows + rows[:4])
    assert got == want
    assert rules.ledger(df.select("doc_id", "text").limit(0), ["doc_id"]).count() == 0


def test_keep_returns_the_rows_as_they_are(spark):
    good = "these are ten plain words that stand in one line"
    df = spark.createDataFrame([(1, good, None, None, 2), (1, good, None, None, 2), (2, "too few", "en", "s", 1), (None, good + " more", "en", "s", 3)], DOCS)
    df = df.withColumns({"_row": F.lit(1), "n_words": F.lit("x"), "fail_bits": F.lit(9)})
    out = rules.keep(df, "v2")
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(r["n_chars"] for r in out.collect()) == [2, 2, 3]


def test_policies_and_ablations(spark):
    bits = [0, 0, 1, 2, 3, 4, 12, 64, 65]
    led = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    rows = {(r["policy"], r["rule"]): (r["n_rows"], r["n_failed"], r["n_only"], r["n_kept"]) for r in rules.ablations(led).collect()}
    names = [n for n, _ in rules.RULES]
    for policy, chosen in rules.POLICIES.items():
        m = rules.mask(policy)
        for rule in chosen:
            b = 1 << names.index(rule)
            assert rows[policy, rule] == (len(bits), sum(x & b > 0 for x in bits), sum(x & m == b for x in bits), sum(x & m == 0 for x in bits))
    assert rules.ablations(led.limit(0)).count() == 0


def water_fill(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by plain rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in done]
        if not free:
            return done
        level = (total - sum(done.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > epochs * sizes[s] + 1e-9]
        if not over:
            return done | {s: level * w[s] for s in free}
        done |= {s: float(epochs * sizes[s]) for s in over}


@pytest.mark.parametrize("shape", ["even", "hot", "tiny first"])
def test_mix(spark, shape):
    rnd = random.Random(shape)
    sources = {"even": ["a", "b", "c", None], "hot": ["a"] + ["b"] * 8 + [None], "tiny first": ["z"] * 20 + ["a", "é", "Z", None]}[shape]
    rows = [(i, rnd.choice(sources), rnd.choice([0, 1, 5, 40, 300])) for i in range(3000)] + [(None, "a", 7)] * 3
    df = spark.createDataFrame(rows, "id long, source string, size long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = water_fill(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["reps"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["reps"] * r["size"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 301
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    other = mixing.mix(df, seed=8).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, got))


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "id long, source string, size long")
    assert mixing.mix(empty).count() == 0
    zero = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "id long, source string, size long")
    assert [(r["target"], r["reps"]) for r in mixing.mix(zero).collect()] == [(0.0, 0)] * 2
    one = spark.createDataFrame([(1, None, 4)], "id long, source string, size long")
    assert [(r["target"], r["reps"]) for r in mixing.mix(one).collect()] == [(4.0, 1)]
