"""Near-duplicates, decontamination and repeated passages against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bytetext, chunks, decontaminate, minhash
from millrace.llm.components import components
from millrace.llm.queries import QUERIES

from ..conftest import SF

RND = random.Random(11)
VOCAB = ["".join(RND.choice("abcdefghijklmnoprstuvw") for _ in range(RND.randint(2, 9))) for _ in range(3000)]


def prose(rnd, n):
    return [rnd.choice(VOCAB) for _ in range(n)]


def edited(rnd, words, share):
    out = []
    for w in words:
        x = rnd.random()
        if x < share / 2:
            out.append(rnd.choice(VOCAB))
        elif x < share * 3 / 4:
            out += [w, rnd.choice(VOCAB)]
        elif x >= share:
            out.append(w)
    return out


def sets(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    either = sum((a | b).values())
    return both / either if either else 0.0


def brute_classes(rows):
    """Smallest id by class, over all pairs."""
    owner = list(range(len(rows)))

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    bags = [sets(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(bags[i], bags[j]) >= 0.8 - 1e-9:
                owner[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted((str(doc_id), str(low.get(find(i)))) for i, (doc_id, _) in enumerate(rows))


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(3)
    rows, k = [], 0
    for _ in range(25):
        base = prose(rnd, rnd.randint(20, 250))
        for share in (0, 0, 0.005, 0.01, 0.02, 0.04, 0.1):
            rows.append((k, " ".join(edited(rnd, base, share))))
            k += 1
    hub = prose(rnd, 160)  # copies of one text that are less alike among themselves
    for _ in range(60):
        rows.append((k, " ".join(edited(rnd, hub, 0.03))))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "\n"), (k + 3, "a b"), (k + 4, "A  b"), (None, "a b"), (k + 5, rows[0][1]), (k + 5, rows[0][1]), (k + 6, "a a a a a a a")]
    rows.append((k + 7, " ".join(prose(rnd, 30000))))
    return rows


def test_classes(spark, copies):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in copies], "doc_id long, text string, class_id int, digest string").repartition(6)
    got = minhash.classes(df).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == brute_classes(copies)
    size = Counter(str(r["class_id"]) for r in got if r["class_id"] is not None)
    assert all(r["class_size"] == size[str(r["class_id"])] for r in got if r["class_id"] is not None)


def test_query_classes(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op1_near_duplicates"](spark, SF).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == brute_classes(rows)


def test_keep_one(spark, copies):
    df = spark.createDataFrame([(i, t, 1) for i, t in copies], "doc_id long, text string, _row int").repartition(6)
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    named = dict(brute_classes([(i, t) for i, t in copies if i is not None]))
    kept = [named[str(r["doc_id"])] for r in out.collect() if r["doc_id"] is not None]
    assert len(kept) == len(set(kept)) == len(set(named.values()))
    assert minhash.keep_one(df.limit(0)).count() == 0
    assert minhash.classes(df.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rnd = np.random.default_rng(1)
    for _ in range(5):
        n = 60
        element = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        a, b = rnd.integers(1, 9, n) * (rnd.random(n) < 0.8), rnd.integers(1, 9, n) * (rnd.random(n) < 0.8)
        b = np.where(rnd.random(n) < 0.7, a, b)
        a[0], b[0] = 3, 3
        owner = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        sig = minhash.signatures(owner, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4000)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(50)] + [(500, k) for k in range(501, 600)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    owner = {x: x for e in edges for x in e}

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        owner[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def align(a, b):
    """Smith-Waterman by the book."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rnd = random.Random(4)
    pairs = [([rnd.randrange(6) for _ in range(rnd.randint(0, 25))], [rnd.randrange(6) for _ in range(rnd.randint(1, 25))]) for _ in range(80)]
    got = decontaminate.smith_waterman([np.array(a, np.int64) for a, _ in pairs], [np.array(b, np.int64) for _, b in pairs])
    assert got.tolist() == [align(a, b) for a, b in pairs]


@pytest.fixture(scope="module")
def leaks():
    rnd = random.Random(9)
    items = [(k, " ".join(prose(rnd, rnd.randint(15, 50))).capitalize() + ".") for k in range(30)] + [(100, "tiny item"), (101, ""), (102, None), (103, "—")]
    rows, planted = [], set()
    for k in range(300):
        words = prose(rnd, rnd.randint(0, 200))
        item = rnd.randrange(30)
        share = rnd.choice([None, None, 0, 0.05, 0.15])
        if share is not None:
            at = rnd.randint(0, len(words))
            words[at:at] = edited(rnd, items[item][1].split(), share)
            planted.add((k, item))
        rows.append((k, " ".join(words)))
    for k in range(300, 500):  # one item in many documents
        rows.append((k, " ".join(prose(rnd, 20)) + "\n" + items[0][1].upper() + " " + " ".join(prose(rnd, 5))))
        planted.add((k, 0))
    rows += [(500, None), (501, ""), (502, "here is a Tiny, ITEM for you"), (502, "x"), (None, items[2][1])]
    planted.add((502, 100))
    return items, rows, planted


def test_matches(spark, leaks):
    items, rows, planted = leaks
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, item_id int, score int").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted
    assert all(decontaminate.THRESHOLD <= r["score"] <= 1 for r in got)
    bad = {d for d, _ in planted}
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns
    left = out.collect()
    assert sorted(r["doc_id"] for r in left) == sorted([i for i, t in rows if i is not None and (i not in bad or t == "x")])
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_query_leaks(spark):
    """All pairs of documents and items, aligned by the book where they share a word run."""
    tidy = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    items = {r["item_id"]: tidy(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: tidy(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = set()
    for d, w in docs.items():
        runs = set(zip(w, w[1:], w[2:]))
        for i, x in items.items():
            common = [k for k in zip(x, x[1:], x[2:]) if k in runs]
            if len(common) > 0.2 * len(x) and align(w, x) / (2 * len(x)) >= decontaminate.THRESHOLD:
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_decontamination"](spark, SF).collect()} == want


def test_chunks_cover_and_resist_shifts():
    rnd = random.Random(6)
    text = " ".join(prose(rnd, 2000)).encode()
    other = text[:3000] + b"inserted words here " + text[3000:]

    def parts(raw):
        start, end, _ = chunks.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert start[0] == 0 and end[-1] == len(raw) and (start[1:] == end[:-1]).all()
        assert (end - start).max() <= chunks.MOST and (end - start)[:-1].min() >= chunks.LEAST
        return [raw[a:b] for a, b in zip(start, end)]

    a, b = parts(text), parts(other)
    assert len(set(a) & set(b)) > 0.95 * len(a)
    h = chunks.gear(np.frombuffer(text, np.uint8))
    slow = 0
    for c in text[:500]:
        slow = ((slow << 1) + int(chunks._GEAR[c])) % (1 << 32)
    assert int(h[499]) == slow


def test_passages(spark):
    rnd = random.Random(8)
    shared = [prose(rnd, n) for n in (51, 60, 80, 120, 300, 55, 70)]
    short = [prose(rnd, n) for n in (20, 40, 45)]
    rows, planted = [], set()
    for k in range(200):
        words = prose(rnd, rnd.randint(5, 300))
        if k % 4 == 0:
            at = rnd.randint(0, len(words))
            words[at:at] = shared[k // 4 % len(shared)]
            planted.add(k)
        elif k % 4 == 1:
            words += short[k % len(short)]
        rows.append((k, " ".join(words)))
    twice = prose(rnd, 70)
    rows += [(200, None), (201, ""), (202, " ".join(twice + ["und"] + twice)), (203, " ".join(prose(rnd, 60))), (None, " ".join(shared[4]))]
    rows.append((203, rows[-2][1]))  # a repeated row is one document
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    got = chunks.passages(df).collect()
    assert {r["doc_id"] for r in got} == planted | {None}
    assert all(r["n_words"] >= 50 for r in got)
    texts = dict(rows)
    for r in got:
        if r["doc_id"] is not None and r["partner"] is not None:
            part = texts[r["doc_id"]].encode()[r["start"]: r["end"]]
            assert part in texts[r["partner"]].encode() and len(part.split()) == r["n_words"]
    left = chunks.cleaned(df)
    assert left.columns == df.columns and left.count() == len(rows)
    again = {r["doc_id"]: r["text"] for r in left.collect()}
    assert sum(" ".join(shared[2]) in (t or "") for t in again.values()) == 1
    assert again[202] == texts[202]
    assert chunks.passages(df.limit(0)).count() == 0


def test_query_passages(spark):
    """Every 50-word run that two documents share lies in a reported passage, and the other way round."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen, want = {}, set()
    for d, t in rows.items():
        # Runs with their exact white space: passages are byte ranges.
        import re

        spots = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        for a in range(len(spots) - 49):
            seen.setdefault(t[spots[a][0]: spots[a + 49][1]], set()).add(d)
    for ds in seen.values():
        if len(ds) > 1:
            want |= ds
    got = {r["doc_id"] for r in QUERIES["op6_repeated_passages"](spark, SF).collect()}
    assert got <= want
    assert len(got) >= 0.98 * len(want)


def test_slices_cut_nothing():
    import pyarrow as pa

    texts = ["", None, "abc", "é" * 50, "", "x" * 1000, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    out = []
    for (ids,), data, off in bytetext.slices([batch.slice(1), batch.slice(0, 0), batch], ["i"], "t", 64):
        out += [(i, data[a:b].tobytes().decode()) for i, a, b in zip(ids.to_pylist(), off[:-1], off[1:])]
    assert out == [(i, t or "") for i, t in enumerate(texts)][1:] + [(i, t or "") for i, t in enumerate(texts)]


def tidy(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def all_pairs(rows, items):
    """(document, item) of every pair that reaches the threshold, aligned without any filter."""
    out = set()
    for d, t in rows:
        for i, x in items:
            a, b = tidy(t), tidy(x)
            if len(b) > 2 and align(a, b) / (2 * len(b)) >= decontaminate.THRESHOLD:
                out.add((d, i))
    return out


def test_frequent_edited_items(spark):
    """Copies with edits are found however many documents hold them, and wherever the edits lie."""
    rnd = random.Random(21)
    items = [(k, " ".join(prose(rnd, n))) for k, n in enumerate((24, 40, 12, 10, 30, 4, 5, 6, 7, 3))]
    word = lambda: "x" + rnd.choice(VOCAB)

    def copy(words, way):
        if way == 0:  # every fourth word changed
            return [word() if k % 4 == 3 else w for k, w in enumerate(words)]
        if way == 1:  # a word after every second one
            return [v for k, w in enumerate(words) for v in ([w, word()] if k % 2 else [w])]
        if way == 2:  # a word after four of five
            return [v for k, w in enumerate(words) for v in ([w] if k % 5 == 4 or k == len(words) - 1 else [w, word()])]
        if way == 3:  # the first 60 in a hundred
            return words[: -(-len(words) * 3 // 5)]
        return edited(rnd, words, 0.25)

    hot = " ".join(copy(items[0][1].split(), 0))
    rows = [(k, " ".join([*prose(rnd, 8), hot, *prose(rnd, 4)])) for k in range(60)]
    for k in range(60, 180):
        _, text = items[rnd.randrange(len(items))]
        rows.append((k, " ".join([*prose(rnd, rnd.randint(0, 15)), *copy(text.split(), k % 5), *prose(rnd, rnd.randint(0, 15))])))
    want = all_pairs(rows, items)
    assert {(k, 0) for k in range(60)} <= want and {i for _, i in want} == {i for i, _ in items}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == want
    texts, sought = dict(rows), dict(items)
    assert all(abs(s - align(tidy(texts[d]), tidy(sought[i])) / (2 * len(tidy(sought[i])))) < 1e-9 for (d, i), s in got.items())
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_repeated_items(spark):
    """Benchmark rows that repeat, and rows of one id with other texts, hide no copy."""
    rnd = random.Random(22)
    texts = [" ".join(prose(rnd, n)) for n in (20, 35, 15, 28)]
    rows = [(k, " ".join([*prose(rnd, 10), *edited(rnd, texts[k % 4].split(), 0.1 * (k % 3 == 0)), *prose(rnd, 10)])) for k in range(40)]
    items = [(0, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[3])] * 10
    want = all_pairs(rows, set(items))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    got = decontaminate.matches(docs, bench).collect()
    assert {d for d, _ in want} == {k for k, _ in rows}
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(want)
    assert decontaminate.clean(docs, bench).count() == 0
    once = decontaminate.matches(docs, bench.distinct()).collect()
    assert sorted(got) == sorted(once)


def test_null_ids_of_items_and_documents(spark):
    rnd = random.Random(23)
    one, two = (" ".join(prose(rnd, 25)) for _ in range(2))
    rows = [(1, "start " + one), (2, two + " end"), (None, "here " + one), (None, "nothing of it"), (3, "nor here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, one), (7, two)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()} == {(1, None), (2, 7)}
    assert sorted(r["text"] for r in decontaminate.clean(docs, bench).collect()) == ["nor here", "nothing of it"]


def repeated_runs(rows, n=50):
    """{(document, byte start, byte end): documents} of every run of ``n`` words that two documents share."""
    import re

    seen = {}
    for d, t in rows:
        raw = (t or "").encode()
        spots = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        for a in range(len(spots) - n + 1):
            x, y = spots[a][0], spots[a + n - 1][1]
            seen.setdefault(raw[x:y], []).append((d, x, y))
    return {spot: {d for d, _, _ in spots} for spots in seen.values() if len({d for d, _, _ in spots}) > 1 for spot in spots}


def held_against_all_runs(spark, rows):
    got = chunks.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    texts, runs = dict(rows), repeated_runs(rows)
    ranges = {}
    for r in got:
        ranges.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["removed"]))
        part = texts[r["doc_id"]].encode()[r["start"]: r["end"]]
        assert part in texts[r["partner"]].encode() and len(part.split()) == r["n_words"] >= 50 and r["partner"] != r["doc_id"]
    for (d, x, y), docs in runs.items():
        assert any(a <= x and y <= b and cut == (d != min(docs)) for a, b, cut in ranges.get(d, [])), (d, x, y, docs)
    assert set(ranges) == {d for d, _, _ in runs}
    return runs


def test_passages_of_several_partners(spark):
    """A passage counts although each of its parts also stands, too short, in an earlier document."""
    rnd = random.Random(31)
    a, b, c = (prose(rnd, n) for n in (20, 22, 24))
    f, g, h = (prose(rnd, n) for n in (70, 30, 30))
    rows = [(k, " ".join(w)) for k, w in enumerate([
        prose(rnd, 60), prose(rnd, 9) + a + b + prose(rnd, 9), prose(rnd, 5) + b + c + prose(rnd, 9), f + prose(rnd, 4), f[:35] + prose(rnd, 30),
        prose(rnd, 3) + f, f[35:] + prose(rnd, 40), prose(rnd, 7) + g + h, prose(rnd, 8) + a + b + c + prose(rnd, 3), a + b + c + prose(rnd, 8),
        g + h + prose(rnd, 5), f[:34], prose(rnd, 5) + f[36:]])]
    runs = held_against_all_runs(spark, rows)
    assert {3, 5, 7, 8, 9, 10} == {d for d, _, _ in runs}
    left = {r["doc_id"]: r["text"] for r in chunks.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert " ".join(a + b + c) in left[8] and " ".join(a + b + c) not in left[9] and " ".join(f) in left[3] and " ".join(f) not in left[5]


def test_passages_of_short_words(spark):
    """Passages are found whatever their bytes: words of one or two letters, no cut places, shifted repeats."""
    rnd = random.Random(32)
    tiny = lambda n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäö") for _ in range(rnd.randint(1, 2))) for _ in range(n)]
    rows, k = [], 0
    for n in (50, 50, 50, 51, 52, 55, 49) * 12:
        passage = tiny(n)
        for _ in range(2):
            rows.append((k, " ".join(tiny(rnd.randint(0, 30)) + passage + tiny(rnd.randint(0, 30)))))
            k += 1
    rows += [(k, "la " * 120), (k + 1, "x\tla " + "la " * 70), (k + 2, "la " * 49), (k + 3, "y" + " la" * 300)]
    held_against_all_runs(spark, rows)


def test_query_passages_whole(spark):
    rows = sorted({(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["doc_id"] is not None})
    if len(dict(rows)) == len(rows):
        held_against_all_runs(spark, rows)
    got = {r["doc_id"] for r in QUERIES["op6_repeated_passages"](spark, SF).collect()}
    assert got - {None} >= {d for d, _, _ in repeated_runs(rows)}


def test_texts_made_to_meet(spark):
    """Words that meet under every polynomial modulo a power of two are different words."""
    from .test_tokens import thue_morse

    a, b = thue_morse(2048)
    rnd = random.Random(12)
    head, tail = " ".join(prose(rnd, 30)), " ".join(prose(rnd, 30))
    df = spark.createDataFrame([(1, a), (2, b), (3, f"{head} {a} {tail}"), (4, f"{head} {b} {tail}")], "doc_id long, text string")
    label = {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()}
    assert label[1] != label[2]
    # 30 words, another word, 30 words: no run of 50.
    assert chunks.passages(df).count() == 0
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.matches(df, items).collect()} == {1, 3}


def test_open_pairs_are_right_and_their_condition_is_compiled(spark, tmp_path):
    """The JVM leaves methods of more than 8,000 bytes interpreted."""
    sig = np.random.default_rng(5).integers(0, 1 << 63, (6, minhash.WIDE)).astype(np.uint64)
    sig[1] = sig[0]
    sig[2, ::7] = sig[0, ::7]
    sig[3, : minhash.WIDE - minhash.WIDE_FAR - 40] = sig[0, : minhash.WIDE - minhash.WIDE_FAR - 40]
    two = (sig >> np.uint64(40)) & np.uint64(3)
    n = minhash.WIDE // 32
    rows = [(k, bytes([i]), bytes([9, i % 5]), [1, 2], *map(int, p)) for k in (1, 2) for i, p in enumerate(minhash.planes(sig).view(np.int64))]
    kind = ", ".join(["key long, digest binary, label binary, keys array<long>", *[f"plane{k} long" for k in range(n)]])
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    # The labels of 0 and 5 are the same, and a pair comes once for two keys.
    want = [(i, j) for i in range(6) for j in range(i + 1, 6) if i % 5 != j % 5 and (two[i] != two[j]).sum() <= minhash.WIDE_FAR]
    assert (0, 1) in want and (0, 3) in want and (0, 2) not in want
    assert sorted((r[0][0], r[1][0]) for r in minhash._open_pairs(table).collect()) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for least in ("10MB", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
            made = minhash._open_pairs(table)._jdf.queryExecution().debug().codegenToSeq()
            sizes = [made.apply(k)._3().maxMethodCodeSize() for k in range(made.size())]
            assert 0 < max(sizes) < 8000, sizes
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
