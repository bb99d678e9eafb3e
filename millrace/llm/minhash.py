"""Near-duplicate documents by DartMinHash signatures, banded joining and an exact check.

Shingles of five words are elements, their counts in the text the weights; similarity
is the weighted Jaccard similarity, and documents of 0.8 and more are linked. A class
is a connected component of links.

Signature: every element throws darts at (weight, rank). In a dyadic cell of the
weight axis the ranks of an element's darts are a Poisson process drawn from hashes,
so two texts that hold an element throw the same darts. A text sees the darts that lie
below its weight of the element and below a rank bound at which ``K`` ln ``K`` + 2 ``K``
of them are expected; each dart falls to one of ``K`` coordinates and the earliest per
coordinate is kept. If a coordinate stays empty the bound is doubled.

Joining: ``BANDS`` keys of ``ROWS`` coordinates each. A pair of similarity 0.8 has no
common key with probability (1 - 0.8^5)^32 = 3e-6. Equal texts (by md5) are one node.
Keys of several nodes are buckets; in each the node that shares most keys leads, and
all others are compared with it, never with each other. What is linked already needs
no more comparisons; nodes of a bucket that belong to different components after that
are compared with each other where a sketch of a wider signature (2 bits of each of
``WIDE`` coordinates, differing in at most ``WIDE_FAR``) allows a similarity of 0.8 at
4.5 standard deviations. All comparisons that count are of whole texts, by 64-bit hashes
of their shingles (see ``bytetext``).

Words are runs of ``[^\\x20\\x09-\\x0D]``, in lower case. A text of one to four words is
one shingle; null and empty texts (and blank ones) have none: they link to nothing,
but equal texts are one class, null counting as empty. An empty table gives no rows. Very
long texts are signed and compared whole. Null ids are rows like any other; a class that
holds none but them has a null class_id. Other columns are carried by ``keep_one`` alone,
whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .components import components
from .store import kept, partitions

SHINGLE = 5
SIMILAR = 0.8
K, ROWS, BANDS = 192, 5, 32
FAR = 51
WIDE, WIDE_FAR = 1536, 293
#: Texts of a task that are remembered, so that copies are signed once.
SEEN = 1 << 20
#: Places of the filter that keeps most texts nobody asks for out of a join. It is
#: broadcast, and never holds more rows than this.
PLACES = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _salt(n: int) -> np.uint64:
    return np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), sorted, of each text."""
    data, off = bytetext.lower(data, off)
    start, end, owner = bytetext.words(data, off)
    h = bytetext.span_hashes(data, start, end)
    gram, at = bytetext.grams(h, owner, SHINGLE)
    own = owner[at]
    count = np.bincount(owner, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    for n in range(1, SHINGLE):
        few = np.flatnonzero(count == n)
        if len(few):
            x = h[first[few]].copy()
            for k in range(1, n):
                x = x * _GOLD + h[first[few] + k]
            gram, own = np.concatenate([gram, bytetext.mix(x + np.uint64(n))]), np.concatenate([own, few])
    order = np.lexsort((gram, own))
    gram, own = gram[order], own[order]
    if not len(gram):
        return own, gram, np.zeros(0, np.int64)
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])])
    at = np.flatnonzero(new)
    return own[at], gram[at], np.diff(np.append(at, len(gram)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """n x k dart ids (0 where a set is empty) of weighted sets (owner, element, weight > 0)."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    todo = total > 0
    bound = np.zeros(n)
    bound[todo] = (k * np.log(k) + 2 * k) / total[todo]
    while todo.any():
        mine = todo[owner]
        found = _darts(owner[mine], element[mine], weight[mine].astype(float), bound, k)
        slot, rank, dart = (np.concatenate(x) if x else np.zeros(0) for x in found)
        # Written from the latest to the earliest, so that the earliest of a coordinate stays.
        order = np.argsort(-rank)
        slot = slot[order].astype(np.int64)
        out.ravel()[slot] = dart[order]
        seen = np.zeros(n * k, bool)
        seen[slot] = True
        filled = seen.reshape(n, k).all(1)
        todo &= ~filled
        bound[todo] *= 2
    return out


def _darts(owner, element, weight, bound, k):
    """Lists of (set * k + coordinate, rank, dart id) of all darts within weight and bound.

    An element's darts are drawn in the order of rank: one for all elements at a time, and
    many at a time once few elements are left, as those of very short texts are.
    """
    slots, ranks, darts = [], [], []
    low, cell = 0.0, 0
    while len(owner):
        high = 1.0 if cell == 0 else 2.0 * max(low, 1.0)
        seed = bytetext.mix(element + _salt(cell + 1))
        who, rank = np.arange(len(owner)), np.zeros(len(owner))
        limit, whole, j = bound[owner], not cell and not (weight < 1).any(), 0
        while len(who):
            wide = 1 if len(who) > 2048 else min(512, 65536 // len(who))
            salt = (np.uint64(3) * np.arange(j, j + wide, dtype=np.uint64) + np.uint64(1)) * _GOLD
            steps = np.log(_unit(bytetext.mix(seed[:, None] + salt))) / (low - high)
            steps[:, 0] += rank
            np.cumsum(steps, axis=1, out=steps)
            near = steps <= limit[:, None]
            row, col = np.nonzero(near)
            if not whole:
                hit = low + _unit(bytetext.mix(seed[row] + salt[col] + _GOLD)) * (high - low) <= weight[who[row]]
                row, col = row[hit], col[hit]
            dart = bytetext.mix(seed[row] + salt[col] + np.uint64(2) * _GOLD)
            slots.append(owner[who[row]] * k + (dart % np.uint64(k)).astype(np.int64))
            ranks.append(steps[row, col])
            darts.append(dart)
            on = near[:, -1]
            who, rank, limit, seed, j = who[on], steps[on, -1], limit[on], seed[on], j + wide
        more = weight > high
        owner, element, weight, low, cell = owner[more], element[more], weight[more], high, cell + 1
    return slots, ranks, darts


def band_keys(sig: np.ndarray) -> np.ndarray:
    """n x BANDS keys."""
    part = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to((np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _GOLD, part.shape[:2]).copy()
    for r in range(ROWS):
        key = bytetext.mix(key ^ part[:, :, r])
    return key


def sketches(sig: np.ndarray) -> np.ndarray:
    """n x k/32 numbers of 32 coordinates, 2 bits each."""
    two = ((sig >> np.uint64(40)) & np.uint64(3)).reshape(len(sig), -1, 32)
    return np.bitwise_or.reduce(two << (np.uint64(2) * np.arange(32, dtype=np.uint64)), axis=2)


def planes(sig: np.ndarray) -> np.ndarray:
    """n x k/32 numbers: the low bits of 64 coordinates each, then their high bits."""
    two = ((sig >> np.uint64(40)) & np.uint64(3)).reshape(len(sig), -1, 64)
    place = np.arange(64, dtype=np.uint64)
    return np.concatenate([np.bitwise_or.reduce(((two >> np.uint64(b)) & np.uint64(1)) << place, axis=2) for b in (0, 1)], axis=1)


def _apart_wide(x: str, y: str) -> Column:
    """Coordinates of ``WIDE`` in which the planes in columns x0, x1 … and y0, y1 … differ."""
    n, gap = WIDE // 64, lambda i: F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))
    parts = [F.bit_count(gap(i).bitwiseOR(gap(n + i))) for i in range(n)]
    return sum(parts[1:], parts[0])


def _apart(x: str, y: str) -> Column:
    """Coordinates of ``K`` in which two sketches differ."""
    parts = []
    for i in range(K // 32):
        gap = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        parts.append(F.bit_count(gap.bitwiseOR(F.shiftrightunsigned(gap, 1)).bitwiseAND(F.lit(0x5555555555555555))))
    return sum(parts[1:], parts[0])


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signed(texts: DataFrame) -> DataFrame:
    """(digest, keys, sketch) of the different texts with words; ``texts``: digest, text."""
    import pyarrow as pa

    def fresh(batches):
        """Without the copies of texts that this task has signed already."""
        seen = set()
        for batch in batches:
            new = []
            for d in batch.column(0).to_pylist():
                new.append(d not in seen)
                seen.add(d)
            if len(seen) > SEEN:
                seen.clear()
            yield batch.filter(pa.array(new, pa.bool_()))

    def rows(batches):
        for (digest,), data, off in bytetext.slices(fresh(batches), ["digest"], "text"):
            owner, element, weight = shingles(data, off)
            some = np.unique(owner)
            if not len(some):
                continue
            sig = signatures(np.searchsorted(some, owner), element, weight, len(some))
            keys, sketch = band_keys(sig).view(np.int64), sketches(sig).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                digest.take(pa.array(some)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())),
                pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), K // 32).cast(pa.list_(pa.int64()))], ["digest", "keys", "sketch"])

    return texts.select("digest", "text").mapInArrow(rows, "digest binary, keys array<long>, sketch array<long>")


def widened(texts: DataFrame) -> DataFrame:
    """(digest, planes) of ``WIDE`` coordinates; ``texts``: digest, text."""
    import pyarrow as pa

    def rows(batches):
        for (digest,), data, off in bytetext.slices(batches, ["digest"], "text"):
            owner, element, weight = shingles(data, off)
            some = np.unique(owner)
            if len(some):
                found = planes(signatures(np.searchsorted(some, owner), element, weight, len(some), WIDE)).view(np.int64)
                yield pa.RecordBatch.from_arrays([digest.take(pa.array(some)), pa.FixedSizeListArray.from_arrays(
                    pa.array(found.ravel()), WIDE // 32).cast(pa.list_(pa.int64()))], ["digest", "planes"])

    # Few bytes, much work.
    return texts.repartition(partitions(texts.sparkSession), F.xxhash64("digest")).mapInArrow(rows, "digest binary, planes array<long>")


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(digest, text) of the nodes, once each.

    A filter of bounded size goes ahead of the join, so that few of the other texts
    are shuffled as long as the nodes are few; with many of them it lets all pass.
    """
    place = F.pmod(F.xxhash64("digest"), F.lit(PLACES)).alias("place")
    some = texts.withColumn("place", place).join(F.broadcast(nodes.select(place).distinct()), "place", "left_semi").drop("place")
    # Copies are combined before the shuffle, so that a text that fills a third of the rows is a row per task.
    return some.groupBy("digest").agg(F.first("text").alias("text")).join(nodes.select("digest"), "digest", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose texts are similar, exactly; ``texts``: digest, text, once each."""
    import pyarrow as pa

    both = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("left")), "a").join(
        texts.select(F.col("digest").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")

    def checked(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                n = part.num_rows
                texts = pa.RecordBatch.from_arrays([pa.concat_arrays([part.column(2).cast(pa.large_string()), part.column(3).cast(pa.large_string())])], ["text"])
                sets = []
                for _, data, off in bytetext.slices([texts], [], "text"):
                    owner, element, weight = shingles(data, off)
                    cut = np.searchsorted(owner, np.arange(len(off)))
                    sets += [(element[x:y], weight[x:y]) for x, y in zip(cut[:-1], cut[1:])]
                keep = []
                for k in range(n):
                    (e, v), (f, w) = sets[k], sets[n + k]
                    _, i, j = np.intersect1d(e, f, assume_unique=True, return_indices=True)
                    common = np.minimum(v[i], w[j]).sum()
                    keep.append(common >= similar * (v.sum() + w.sum() - common) - 1e-9 and common > 0)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return kept(both.mapInArrow(checked, "a binary, b binary"), "links")


def _open_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of a bucket (key, digest, label, keys, planes) whose labels differ and whose planes are near.

    Sketches are plain columns: on elements of arrays the condition is one method of 26,000 bytes, which
    the JVM leaves interpreted; on so many plain columns Spark makes short methods of it.
    """
    other = rows.select("key", *[F.col(c).alias(f"other_{c}") for c in rows.columns if c != "key"])
    # A pair counts in the first of its common buckets: no earlier key may be common.
    place = F.array_position("keys", F.col("key")).cast("int") - 1
    earlier = F.arrays_overlap(F.slice("keys", F.lit(1), place), F.slice("other_keys", F.lit(1), place))
    near = rows.join(other, "key").filter(
        (F.col("digest") < F.col("other_digest")) & (F.col("label") != F.col("other_label"))
        & (_apart_wide("plane", "other_plane") <= WIDE_FAR) & ~earlier)
    return near.select(F.col("digest").alias("a"), F.col("other_digest").alias("b"))


def links(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) between different texts, as many as connect each class; ``texts``: digest, text."""
    once = signed(texts).groupBy("digest").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    sigs = kept(once, "signatures")
    bands = sigs.select("digest", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = kept(bands.join(shared, "key"), "members")
    degree = members.groupBy("digest").agg(F.sum(F.col("n") - 1).alias("degree"))
    nodes = kept(sigs.select("digest", "sketch").join(degree, "digest"), "nodes")
    placed = kept(members.select("key", "digest").join(nodes, "digest"), "placed")
    heads = placed.groupBy("key").agg(F.max(F.struct("degree", "digest", "sketch")).alias("h")).select(
        "key", F.col("h.digest").alias("head"), F.col("h.sketch").alias("head_sketch"))
    star = kept(placed.join(heads, "key").filter((F.col("digest") != F.col("head")) & (_apart("sketch", "head_sketch") <= FAR)).select(
        F.least("digest", "head").alias("a"), F.greatest("digest", "head").alias("b")).distinct(), "star-pairs")
    known = kept(_texts_of(texts, nodes), "pair-texts")
    first = verified(star, known, similar)
    label = components(first)
    parted = placed.join(label.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    mixed = parted.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    some = kept(parted.join(mixed, "key", "left_semi").select("key", "digest", "label"), "open")
    left_over = some.select("digest").distinct()
    wide = widened(known.join(left_over, "digest", "left_semi")).join(sigs.select("digest", "keys"), "digest")
    flat = kept(wide, "wide").select("digest", "keys", *[F.col("planes")[i].alias(f"plane{i}") for i in range(WIDE // 32)])
    rest = _open_pairs(kept(some.join(flat, "digest"), "open-wide")).join(star, ["a", "b"], "left_anti")
    return first.union(verified(kept(rest, "rest-pairs"), known, similar))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Per row: id, class_id (the smallest id of its class) and class_size (its rows)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), _digest(F.col(text)).alias("digest"))
    label = kept(components(links(rows.select("digest", "text"), similar)), "labels")
    ids = kept(rows.select("id", "digest"), "ids")
    exact = ids.groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    named = kept(exact.join(label.withColumnRenamed("node", "digest"), "digest", "left"), "exact")
    alone = named.filter("label IS NULL").select("digest", F.col("low").alias("class_id"), F.col("n").alias("class_size"))
    wide = named.filter("label IS NOT NULL")
    total = wide.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    table = alone.unionByName(wide.select("digest", "label").join(total, "label").select("digest", "class_id", "class_size"))
    return ids.join(table, "digest").select(F.col("id").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of each class, all columns unchanged: of the text with the smallest md5,
    the row with the smallest id (nulls last), then the smallest hash of all its columns."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    rows = packed.withColumn("digest", _digest(F.col("_row")[text]))
    label = kept(components(links(rows.select("digest", F.coalesce(F.col("_row")[text], F.lit("")).alias("text")), similar)), "labels")
    left = rows.join(label.filter("node <> label").select(F.col("node").alias("digest")), "digest", "left_anti")
    # Equal texts: the place of the row to keep is found without the texts, map-side combined.
    rank = F.struct(F.col("_row")[id_col].isNull(), F.col("_row")[id_col], F.xxhash64("_row"))
    best = left.select("digest", rank.alias("rank")).groupBy("digest").agg(F.min("rank").alias("best"), F.count("*").alias("n"))
    one = left.withColumn("rank", rank).join(best, "digest").filter(F.col("rank") == F.col("best"))
    # Rows that agree in all columns: one of them.
    single = one.filter("n = 1").select("_row")
    several = one.filter("n > 1").groupBy("digest").agg(F.first("_row").alias("_row")).select("_row")
    return single.unionByName(several).select("_row.*")
