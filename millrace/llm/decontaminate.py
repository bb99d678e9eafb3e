"""Benchmark passages in training text: rare word pairs as seeds, then Smith-Waterman alignment.

1. All word pairs of the test items go into a bit map; a scan of the documents keeps the
   pairs whose bit is set (document, positions, hashes) and counts how often each occurs.
2. Of an item's word pairs the rarest ones are its seeds: all but as many as the score
   needs, less one. Of 2n points an inserted word costs 1 and breaks one pair, a changed
   or missing word costs 3 and breaks two, a word left out at an end costs 2 and breaks one,
   so n - 1 - 2n(1 - threshold) pairs remain, and one of them must be a seed. So what other
   documents hold decides which pairs are seeds, but no pair of document and item is lost.
   Items so short that no pair need remain (3 to 5 words at 0.6) are also sought by pairs with one word between.
3. Seeds join documents to items. For these alone all common pairs are looked up and grouped by
   diagonal (position in the document less position in the item) in overlapping buckets
   that hold every alignment of the threshold whole. A group with as many pairs as the score
   needs is a candidate.
4. The candidate's words are aligned with the item's by Smith-Waterman (match 2,
   mismatch -1, gap -1). The score is that of the best local alignment over the score
   of a full match; a document is contaminated from ``threshold`` on. From 0.6 on no
   pair of document and item is missed; a lower one may miss items of up to
   1 / (2 threshold - 1) words.

Words are runs of letters and digits in lower case. Items of one or two words match
only as they stand. Null and empty texts hold no words
and never match; items without words are ignored. Repeated documents are scored as
rows of their own (by id, best score kept); columns other than id and text are only
carried by ``clean``, whatever their names. A null item id is an id like any other. Documents with a null id
have no row in ``matches``, which could not tell them apart; ``clean`` judges them too.
Very long texts are read whole: their pairs are one row, and a candidate is only a window of
them. An empty table of documents or items gives no matches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bytetext
from .store import kept

GRAM = 2
#: Least and most bits (as powers of two) of the map of the items' pairs; the latter are 4 MB.
BITS = (16, 25)
#: Texts of a task that are remembered, so that copies give their pairs once.
SEEN = 1 << 18
THRESHOLD = 0.6

_TABLE = np.zeros(256, bool)
_TABLE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_TABLE[128:] = True


def hashed_words(data: np.ndarray, off: np.ndarray):
    """(lower-cased bytes, start, end, owner, hash) of the words."""
    data, off = bytetext.lower(data, off)
    start, end, owner = bytetext.words(data, off, _TABLE)
    return data, start, end, owner, bytetext.span_hashes(data, start, end)


def _item_words(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """(item, item_id, words: hashes) of the items with words. Rows of equal id and words are
    one item; ``item`` is a number of its own for each, fixed once the rows are written."""
    import pyarrow as pa

    def hashed(batches):
        for (ids,), data, off in bytetext.slices(batches, ["item_id"], "text"):
            _, _, _, owner, h = hashed_words(data, off)
            count = np.bincount(owner, minlength=len(off) - 1)
            ends = np.cumsum(count)
            lists = [h[b - c: b].view(np.int64).tolist() for b, c in zip(ends, count)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lists, pa.list_(pa.int64()))], ["item_id", "words"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(hashed, f"item_id {kind}, words array<long>").filter(F.size("words") > 0).distinct()
    return found.select(F.monotonically_increasing_id().alias("item"), "item_id", "words")


def needed(n: int, threshold: float = THRESHOLD) -> int:
    """Word pairs that an item of ``n`` words must share at ``threshold``; 0 if none need remain."""
    return max(0, math.ceil(n * (2 * threshold - 1) - 1 - 1e-9))


def _gapped(h: np.ndarray, owner: np.ndarray, step: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first position) of the pairs of words ``step`` apart; in documents the item's
    neighbours are sought with one word between."""
    at = np.flatnonzero(owner[:-step] == owner[step:])
    return bytetext.mix(bytetext.mix(h[at]) ^ h[at + step]), at


def _grams(words: list[int], threshold: float) -> tuple[list[int], list[int]]:
    """(hash, position) of an item's seeds."""
    h, owner = np.asarray(words, np.int64).view(np.uint64), np.zeros(len(words), np.int64)
    gram, at = bytetext.grams(h, owner, min(GRAM, len(h)))
    if len(h) > GRAM and not needed(len(h), threshold):
        more, there = _gapped(h, owner, 1)
        gram, at = np.concatenate([gram, more]), np.concatenate([at, there])
    return gram.view(np.int64).tolist(), at.tolist()


def _item_grams(words: DataFrame, threshold: float) -> DataFrame:
    """(item, n_words, gram, at) of every seed of the items."""
    import pyarrow as pa

    def rows(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1).to_pylist()
            grams = [_grams(w, threshold) for w in lists]
            owner = np.repeat(np.arange(len(lists)), [len(g) for g, _ in grams])
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(owner)), pa.array([len(lists[k]) for k in owner], pa.int32()), pa.array([g for x, _ in grams for g in x], pa.int64()),
                pa.array([k for _, x in grams for k in x], pa.int32())], ["item", "n_words", "gram", "at"])

    return words.select("item", "words").mapInArrow(rows, "item long, n_words int, gram long, at int")


def _bit_map(grams: DataFrame) -> tuple[bytes, int]:
    """(map, bits): flags by the top bits of the pairs' hashes, 16 or more for each pair.

    Put together by Spark, 64 flags to a row. A benchmark of more than 2^21 pairs fills
    the map, which then lets more pairs pass to the join.
    """
    n = grams.agg(F.approx_count_distinct("gram")).head()[0]
    bits = min(max(BITS[0], (16 * max(1, n)).bit_length()), BITS[1])
    place = F.shiftrightunsigned("gram", 64 - bits)
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = grams.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(flag).alias("flags")).toArrow()
    out = np.zeros(1 << bits >> 6, np.int64)
    out[words["word"].to_numpy()] = words["flags"].to_numpy()
    return out.tobytes(), bits


def _hits(docs: DataFrame, flags: bytes, bits: int, short: bool, gapped: bool) -> DataFrame:
    """(doc, grams, ats) of the documents with word pairs whose bit is set; ``short``: also runs of
    one to GRAM-1 words; ``gapped``: also pairs with one word between.

    Texts that a task has seen under the same id give no second row.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(flags)
    sizes = list(range(1, GRAM + 1)) if short else [GRAM]

    def rows(batches):
        import hashlib

        table = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").astype(bool)
        seen = set()
        for (ids,), data, off in bytetext.slices(batches, ["doc"], "text"):
            _, _, _, owner, h = hashed_words(data, off)
            count = np.bincount(owner, minlength=len(off) - 1)
            first = np.cumsum(count) - count
            found = []
            for gram, at in [*(bytetext.grams(h, owner, n) for n in sizes), *([_gapped(h, owner)] if gapped else [])]:
                hit = np.flatnonzero(table[(gram >> np.uint64(64 - bits)).astype(np.int64)])
                found.append((gram[hit], at[hit]))
            gram, at = (np.concatenate(x) for x in zip(*found))
            text = owner[at]
            order = np.argsort(text, kind="stable")
            gram, at, text = gram[order].view(np.int64), at[order], text[order]
            start = bytetext.runs_of(text)
            whose = text[start]
            new = []
            for k, own in zip(whose.tolist(), ids.take(pa.array(whose)).to_pylist()):
                key = (own, hashlib.md5(data[off[k]: off[k + 1]].tobytes()).digest())
                new.append(key not in seen)
                seen.add(key)
            if len(seen) > SEEN:
                seen.clear()
            ends = pa.array(np.append(start, len(text)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(whose)), pa.ListArray.from_arrays(ends, pa.array(gram, pa.int64())),
                pa.ListArray.from_arrays(ends, pa.array((at - first[text]).astype(np.int32)))], ["doc", "grams", "ats"]).filter(pa.array(new, pa.bool_()))

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(rows, f"doc {kind}, grams array<long>, ats array<int>")


def smith_waterman(left: list[np.ndarray], right: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = -1) -> np.ndarray:
    """Best local alignment score of each pair of word lists.

    All pairs go through their anti-diagonals together; shorter lists are filled up
    with words that match nothing, which never raises a best score.
    """
    pairs = len(left)
    n, m = max(map(len, left), default=0), max(map(len, right), default=0)
    best = np.zeros(pairs, np.int32)
    if not n or not m:
        return best
    # Marks are small numbers by word, so that fillers cannot meet a word.
    _, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    at = np.cumsum([0, *map(len, left), *map(len, right)])
    a, b = np.full((pairs, n), -1, np.int32), np.full((pairs, m), -2, np.int32)
    for k in range(pairs):
        a[k, : len(left[k])] = code[at[k]: at[k + 1]]
        b[k, : len(right[k])] = code[at[pairs + k]: at[pairs + k + 1]]
    reverse = b[:, ::-1]
    # Cells (i, j) with i + j = d; arrays are indexed by i.
    before, last = np.zeros((pairs, n + 1), np.int32), np.zeros((pairs, n + 1), np.int32)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        here = np.zeros((pairs, n + 1), np.int32)
        step = np.where(a[:, lo - 1: hi] == reverse[:, m - d + lo: m - d + hi + 1], match, mismatch)
        cell = np.maximum(before[:, lo - 1: hi] + step, np.maximum(last[:, lo - 1: hi], last[:, lo: hi + 1]) + gap)
        here[:, lo: hi + 1] = np.maximum(cell, 0)
        best = np.maximum(best, here.max(1))
        before, last = last, here
    return best


def _asked(threshold: float):
    """Word pairs that a document must share with an item; one where the score needs none."""
    return F.greatest(F.lit(1), F.ceil(F.col("n_words") * (2 * threshold - 1) - 1 - 1e-9))


def seeds(grams: DataFrame, hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, gram): each item's rarest word pairs, counted over all documents."""
    often = hits.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    counted = grams.join(often, "gram", "left")
    item = W.partitionBy("item")
    rank = F.row_number().over(item.orderBy(F.coalesce("df", F.lit(0)), "gram", "at"))
    ranked = counted.select("item", "gram", rank.alias("rank"), F.count("*").over(item).alias("all"), _asked(threshold).alias("asked"))
    return ranked.filter(F.col("rank") <= F.col("all") - F.col("asked") + 1).select("item", "gram").distinct()


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, item, low, high): windows of documents (in words) that hold enough word pairs."""
    grams = kept(_item_grams(items, threshold), "bench-grams")
    lengths = [r[0] for r in grams.select("n_words").distinct().collect()]
    hits = kept(_hits(docs, *_bit_map(grams), min(lengths, default=GRAM) < GRAM, any(n > GRAM and not needed(n, threshold) for n in lengths)), "bench-hits")
    rare = kept(seeds(grams, hits, threshold), "bench-seeds")
    met = hits.select("doc", F.explode("grams").alias("gram")).join(rare, "gram").select("doc", "item").distinct()
    # The items that a document shares a seed with; as many at most as the benchmark has.
    asked_of = kept(met.groupBy("doc").agg(F.collect_list("item").alias("items")), "bench-met")
    wide = hits.join(asked_of, "doc").select("doc", "items", F.explode(F.arrays_zip("grams", "ats")).alias("hit"))
    pairs = wide.select("doc", "items", F.col("hit.grams").alias("gram"), F.col("hit.ats").alias("at")).join(
        grams.withColumnRenamed("at", "item_at"), "gram").filter(F.array_contains("items", F.col("item")))
    # An alignment of the threshold leaves its diagonal by less than ``width``.
    width = F.ceil(F.col("n_words") * (2 - 2 * threshold)).cast("int") + GRAM
    place = F.floor((F.col("at") - F.col("item_at")) / width).cast("int")
    # A pair of the item counts once in a bucket, wherever it occurs there.
    once = pairs.select("doc", "item", "n_words", F.explode(F.array(place, place - 1)).alias("bucket"), "item_at").distinct()
    held = once.groupBy("doc", "item", "n_words", "bucket").agg(F.count("*").alias("held"))
    good = held.filter(F.col("held") >= _asked(threshold))
    return good.select("doc", "item", F.greatest(F.col("bucket") * width, F.lit(0)).alias("low"), ((F.col("bucket") + 2) * width + F.col("n_words")).alias("high"))


def _scores(rows: DataFrame, bench: DataFrame, item_col: str, item_text: str, threshold: float) -> DataFrame:
    """(doc, digest, item_id, score) of the windows of ``rows`` (doc, text) that reach the threshold."""
    import pyarrow as pa

    items = kept(_item_words(bench, item_col, item_text), "bench-words")
    found = kept(candidates(rows, items, threshold), "bench-candidates")
    kinds = f"doc {rows.schema['doc'].dataType.simpleString()}, digest binary, item_id {items.schema['item_id'].dataType.simpleString()}"
    # A document meets its own candidates only: texts by id, then items by id.
    texts = rows.join(found.select("doc").distinct(), "doc", "left_semi")
    pairs = found.join(items, "item").join(texts, "doc").select("doc", _digest(F.col("text")).alias("digest"), "item_id", "low", "high", "words", "text")

    def aligned(batches):
        for (doc, digest, item, low, high, words), data, off in bytetext.slices(batches, ["doc", "digest", "item_id", "low", "high", "words"], "text"):
            _, _, _, owner, h = hashed_words(data, off)
            first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(off) - 1))])
            h = h.view(np.int64)
            own = [h[first[k] + a: min(first[k + 1], first[k] + b)] for k, (a, b) in enumerate(zip(low.to_pylist(), high.to_pylist()))]
            other = [np.asarray(x, np.int64) for x in words.to_pylist()]
            got = [smith_waterman(own[a: a + 256], other[a: a + 256]) for a in range(0, len(own), 256)]
            score = np.concatenate(got) / (2 * np.array([len(x) for x in other]))
            yield pa.RecordBatch.from_arrays([doc, digest, item, pa.array(score, pa.float64())], ["doc", "digest", "item_id", "score"])

    return pairs.mapInArrow(aligned, f"{kinds}, score double").filter(F.col("score") >= threshold)


def _digest(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """Per contaminated document and item: doc_id, item_id, score (0 to 1), n_windows."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    best = _scores(rows, bench, item_col, item_text, threshold).groupBy("doc", "item_id").agg(F.max("score").alias("score"), F.count("*").alias("n_windows"))
    return best.select(F.col("doc").alias(id_col), F.col("item_id").alias(item_col), "score", "n_windows")


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns unchanged, whose text holds no benchmark passage.

    Texts go by a hash of 8 bytes, and in the last step by their md5 as well, so ids may be
    null or repeat, and texts that share the short hash are still told apart.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    keyed = packed.select("_row", F.xxhash64(F.col("_row")[text]).alias("_key"), _digest(F.col("_row")[text]).alias("_digest"))
    texts = keyed.select(F.col("_key").alias("doc"), F.col("_row")[text].alias("text"))
    bad = _scores(texts, bench, item_col, item_text, threshold).select(F.col("doc").alias("_key"), F.col("digest").alias("_digest")).distinct()
    return keyed.join(bad, ["_key", "_digest"], "left_anti").select("_row.*")
