"""Learned operators by held-out accuracy and by hand; archives by round trip."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bytetext, compression, langid, toxicity, warc
from millrace.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_query(spark, docs):
    got = QUERIES["op8_language"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.98


@pytest.fixture(scope="module")
def speaker(spark):
    return langid.train(spark.read.parquet(f"{SMALL}/documents.parquet").limit(400))


def test_language_edges(spark, speaker):
    rows = [(1, None), (2, ""), (3, "123 — !!! \n"), (None, "the and that with this from"), (5, "…" * 100000), (6, "der die und nicht ein " * 40000), (6, "é"), (6, "é")]
    df = spark.createDataFrame([(i, t, "en", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = langid.predict(df, speaker).collect()
    assert [(r["doc_id"], r["lang_pred"] == "und") for r in got] == [(1, True), (2, True), (3, True), (None, False), (5, True), (6, False), (6, False), (6, False)]
    assert got[3]["lang_pred"] == "en" and got[5]["lang_pred"] == "de"
    none = langid.train(df.limit(0).withColumn("lang", F.lit("x")))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.spans(df, none).count() == 0 and langid.predict(df.limit(0), speaker).count() == 0


def test_mixed_spans(spark, speaker, docs):
    one = next(r["text"] for r in docs.values() if r["lang"] == "de" and 1500 < len(r["text"]) < 4000)
    two = next(r["text"] for r in docs.values() if r["lang"] == "es" and 1500 < len(r["text"]) < 4000)
    df = spark.createDataFrame([(1, one + " " + two)], "doc_id long, text string")
    got = langid.spans(df, speaker).orderBy("first_word").collect()
    big = [r["lang"] for r in got if r["n_words"] > 20]
    assert big[0] == "de" and big[-1] == "es"
    assert sum(r["n_words"] for r in got if r["lang"] in ("de", "es")) > 0.9 * sum(r["n_words"] for r in got)


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(3)
    count = np.array([0, 1, 5, 7, 3, 0, 7])
    score = rnd.normal(0, 2, (count.sum(), 3)).astype(np.float32)
    first = np.cumsum(count) - count
    path = langid.viterbi(score, first, count, 1.5)
    import itertools

    for a, n in zip(first, count):
        value = lambda p: sum(score[a + i, c] for i, c in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023,E731
        if n:
            assert abs(value(path[a: a + n]) - max(value(p) for p in itertools.product(range(3), repeat=int(n)))) < 1e-4


def test_scripts_narrow_the_candidates():
    data = np.frombuffer("слово word 漢字 ελ".encode(), np.uint8)
    start, end, _ = bytetext.words(data, np.array([0, len(data)]), langid._TABLE)
    bits = langid.scripts(data, start, end)
    names = [langid._NAMES[int(b).bit_length() - 1] for b in bits]
    assert names == ["cyrillic", "latin", "han", "greek"]
    counts = np.ones((2, langid.SLOTS))
    shown = np.zeros((2, 64))
    shown[0, langid._NAMES.index("latin")] = shown[1, langid._NAMES.index("cyrillic")] = 10
    model = langid.Model(["la", "ru"], counts, shown)
    assert model.words(data, start, end).argmax(1)[:2].tolist() == [1, 0]


@pytest.mark.parametrize("name, label, n, out, least", [("op9_quality", "quality", 5, 0, 0.95), ("op3_toxicity", "toxic", 4, 2, 0.85)])
def test_classifier_queries(spark, docs, labels, name, label, n, out, least):
    got = QUERIES[name](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (remainder(r["doc_id"], n) == out) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["score"], labels[r["doc_id"]][label]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert auc(held) > least


def test_toxic_words_are_found(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]

    def text(k):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 400))]
        if k % 5 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(["Grobian,", "grobian", "SCHUFT!"])
        return " ".join(w)

    rows = [(k, text(k), int(k % 5 == 0)) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(df.filter("doc_id < 1000"), "doc_id", "text", "y")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.filter("doc_id >= 1000"), model).collect()}
    assert np.mean([(got[k] >= 0.3) == bool(y) for k, _, y in rows if k >= 1000]) > 0.97


@pytest.mark.parametrize("kind", ["toxicity", "compression"])
def test_classifier_edges(spark, kind):
    rows = [(1, None, 1), (2, "", 0), (None, "x", 1), (4, "ab" * 300000, 0), (5, "same", 1), (5, "same", 1), (6, "\U0001F600", None)]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, y int, score double")
    module = toxicity if kind == "toxicity" else compression
    for train in (df, df.filter("y = 1"), df.limit(0)):
        model = module.train(train, "doc_id", "text", "y")
        got = [(r["doc_id"], r["score"]) for r in module.score(df, model).collect()]
        assert [g[0] for g in got] == [r[0] for r in rows]
        assert all(0 <= s <= 1 for _, s in got) and got[4] == got[5]
    assert module.score(df.limit(0), model).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A/b?q=1#top") == "com,example)/a/b?q=1"
    assert warc.url_key("https://m.example.net:8443") == "net,example,m:8443)/"
    assert warc.url_key("https://user@example.org/x y\n") == "org,example)/x%20y"
    assert warc.url_key(None) == warc.url_key("") == ""


def test_records_come_back():
    payload = "é\r\n\r\nWARC/1.1 \x00".encode() * 9
    digest = hashlib.sha256(payload).hexdigest()
    one = warc.parse(warc.record(7, "http://a/\r\nX: y", payload, digest, None, False))
    assert one["payload"] == payload and one["url"] == "http://a/%0d%0aX:%20y" and (one["page_id"], one["record_type"], one["refers_to"]) == (7, "response", None)
    two = warc.parse(warc.record(None, None, payload, digest, -3, True))
    assert (two["page_id"], two["payload_bytes"], two["payload_digest"], two["record_type"], two["refers_to"], two["payload"]) == (None, len(payload), digest, "revisit", -3, None)
    with pytest.raises(ValueError):
        warc.parse(warc.record(7, None, payload, digest, None, False)[:-40])


def test_archive_and_lookup(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(k, f"http://h{rnd.randrange(40)}.example.com/p/{rnd.randrange(8)}", "<p>" + str(rnd.randrange(60)) * 60) for k in range(900)]
    rows += [(2000 + k, "http://hot.example.org/", "<html>" + "hot " * 50) for k in range(700)]
    rows += [(3000, None, None), (3001, "", ""), (3002, "http://b.org/x", ""), (3003, "http://b.org/x", "z" * 99), (3004, "http://b.org/x", "z" * 99),
             (3005, "http://long.org/", "long" * 300000), (5, rows[5][1], rows[5][2]), (None, "http://n.org/", rows[7][2]), (None, "http://n.org/", "only here " * 30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    manifest = warc.write(df, f"file://{tmp_path}/w", lines=16)
    got = sorted(map(repr, map(tuple, warc.read_back(manifest).collect())))
    low = {}
    for page, _, html in rows:
        if page is not None:
            low[html or ""] = min(low.get(html or "", page), page)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = low.get(html or "") if len(raw) >= 100 else None
        again = first is not None and first != page
        want.append(repr((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None)))
    assert got == sorted(want)
    asked = ["http://hot.example.org", "https://www.h3.example.com/p/2#x", "http://nowhere.org/", rows[0][1], "", None]
    found = warc.lookup(spark.createDataFrame([(u,) for u in asked], "url string"), manifest).collect()
    for u in asked:
        mine = sorted(str(r["page_id"]) for r in found if r["url"] == u)
        assert mine == sorted(str(p) for p, x, _ in rows if warc.url_key(x) == warc.url_key(u))
    assert warc.read_back(warc.write(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_few_labels_score_their_share(spark):
    """One label of each class, or of one class alone: fixed results, not an even chance for all."""
    rows = "id long, text string, y int"
    one = toxicity.train(spark.createDataFrame([(1, "you vile creature", 1), (2, "what a lovely day", 0), (3, "fine weather", 0), (4, "good", 0)], rows), "id", "text", "y")
    docs = spark.createDataFrame([(9, "zzz qqq")], "doc_id long, text string")
    assert toxicity.score(docs, one).head()["score"] == pytest.approx(0.25, abs=0.1)
    toxic = toxicity.train(spark.createDataFrame([(1, "a b c", 1), (2, "d e f", 1)], rows), "id", "text", "y")
    assert toxicity.score(docs, toxic).head()["score"] > 0.99
    assert toxicity.score(docs, toxicity.train(spark.createDataFrame([], rows), "id", "text", "y")).head()["score"] == 0.5


def test_rare_languages_are_learned(spark):
    """Of each language up to the bound: 3,000 rows of one and 5 of another, drawn by id."""
    rows = [(i, "the weather and the people of the town", "en") for i in range(3000)] + [(5000 + i, "przyszedł wieczór i śnieg pada cicho", "pl") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, max_rows=50, id_col="doc_id")
    assert model.langs == ["en", "pl"]
    docs = spark.createDataFrame([(1, "śnieg pada wieczór"), (2, "people of the town")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()} == {1: "pl", 2: "en"}


def test_clashing_column_names(spark):
    docs = spark.createDataFrame([("a", "fine weather", 1.0)], "text string, body string, score double")
    model = toxicity.Model(np.full(toxicity.SLOTS, -1, "int16"), np.zeros(0), 0.0)
    assert toxicity.score(docs, model, "text", "body").collect()[0]["score"] == 0.5
