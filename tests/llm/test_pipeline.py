"""The pipeline against a plain version of its stages."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing
from millrace.llm.model_queries import tokenizer_path

from ..conftest import SF
from .test_native import WORDS, plain, water_fill
from .test_pairs import align, brute_classes


def passes(text):
    n, chars, symbols, lines, repeated = plain(text)
    words = WORDS.findall(text or "")
    all_lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    import regex

    shout = sum(bool(regex.match(r"\p{Lu}[\p{Lu}!-/:-@\[-`{-~]*!!", w)) for w in words)
    return not (n < 10 or 100 * repeated > 20 * n or 10 * symbols > chars or 10 * lines > 3 * len(all_lines)
                or chars < 2 * n or chars > 40 * n or 2 * shout > n)


def test_stages_against_plain(spark, tmp_path):
    folder = SF
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    frames, now = [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(now)
        if k < 4:
            assert now.dtypes == docs.dtypes
    rows = [list(map(tuple, f.collect())) for f in frames]
    # Rules.
    assert sorted(rows[1]) == sorted(r for r in rows[0] if passes(r[1]))
    # One document of each class.
    named = dict(brute_classes([(r[0], r[1]) for r in rows[1]]))
    kept = [named[str(r[0])] for r in rows[2]]
    assert sorted(kept) == sorted(set(named.values())) and set(rows[2]) <= set(rows[1])
    # No benchmark passage.
    tidy = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    items = [tidy(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def leaked(t):
        w = tidy(t)
        runs = set(zip(w, w[1:], w[2:]))
        return any(sum(k in runs for k in zip(x, x[1:], x[2:])) > 0.2 * len(x) and align(w, x) / (2 * len(x)) >= 0.6 for x in items)

    assert sorted(rows[3]) == sorted(r for r in rows[2] if not leaked(r[1]))
    # The mix takes each source to within a document of its target.
    size = lambda t: len(WORDS.findall(t or ""))
    have, took = {}, {}
    for r in rows[3]:
        have[r[3]] = have.get(r[3], 0) + size(r[1])
    for r in rows[4]:
        took[r[3]] = took.get(r[3], 0) + size(r[1])
    largest = max(size(r[1]) for r in rows[3])
    for s, t in water_fill(have).items():
        assert abs(took.get(s, 0) - t) <= largest
    assert set(rows[4]) <= set(rows[3]) and max(rows[4].count(r) for r in rows[4][:50]) <= 3
    # Token files.
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(rows[4], key=lambda r: r[0]):
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows[5]) == sorted(want)
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect())) == sorted(rows[5])


def test_stages_take_odd_rows(spark):
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    rows = [(1, text, "en", "s", 3), (1, text, "en", "s", 3), (None, text + " more", None, None, None), (None, None, None, None, None), (4, "", "en", None, 0),
            (5, text[::-1], None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {c: F.lit(1) for c in ("digest", "key", "row", "size", "reps", "n_words", "_row", "part", "label")})
    for odd in (docs, docs.limit(0)):
        now = odd
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            if k < 4:
                assert now.columns == docs.columns
        now.collect()
    assert mixing.EPOCHS == 3
