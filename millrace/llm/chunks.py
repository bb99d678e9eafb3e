"""Repeated passages of ``min_words`` whole words and more, by their content.

1. Chunks are cut by content: of the places in a window of ``min_words`` words at which a
   run of two fifths of ``min_words`` words ends, the one with the least gear hash (over the run's last 32 bytes) is the window's cut.
   Equal windows have equal cuts, whatever was inserted before them, so a passage that two
   documents share cannot escape. The run at the cut marks the window, and consecutive windows
   with the same cut form a block, the chunk that is compared by digest: about one for 16 words.
2. Blocks whose mark stands in one document only are dropped. Equal blocks are looked
   at once, in the first document that holds them: their windows are hashed, and a
   window is repeated if documents of all its blocks are two or more.
3. Each repeated window has a partner: the first document (by id) that holds it, or the last
   one for the first document itself. Windows that overlap and stand at the same distance
   in the same partner are one passage, which stands there whole. A longer run whose
   parts have different first documents gives several passages that overlap.

``cuts`` gives chunks without overlap by a gear hash below a bound.

The first document keeps a passage, the others are marked ``removed``; ``cleaned``
cuts those out. Documents are told apart by id and text: rows that repeat both are
one document, and a passage repeated only inside one document is none. Null and empty
texts have no passages. Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytetext
from .store import kept, removed

LEAST, MOST, CUT = 32, 256, 5
MIN_WORDS = 50
#: A random number per byte; only its being fixed matters.
_GEAR = bytetext.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: the sum of the last 32 bytes' numbers, each shifted by
    its distance, built by doubling the window five times."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        wide = h.copy()
        wide[k:] += h[:-k] << np.uint32(k)
        h = wide
    return h


def cut_values(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Gear hash at the end of each range, of its own bytes alone (of the last 32 at most)."""
    h = gear(data)
    size = end - start
    before = np.where(start > 0, h[start - 1], np.uint32(0))
    return h[end - 1] - np.where(size < 32, before << np.minimum(size, 31).astype(np.uint32), np.uint32(0))


def cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the chunks of all texts."""
    # The top bits see the whole window.
    places = np.flatnonzero(gear(data) >> np.uint32(32 - CUT) == 0).tolist()
    start, end, owner = [], [], []
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        at = bisect.bisect_left(places, a + LEAST - 1)
        while a < b:
            at = bisect.bisect_left(places, a + LEAST - 1, at)
            stop = min(b, a + MOST)
            if at < len(places) and places[at] < stop:
                stop = places[at] + 1
            start.append(a)
            end.append(stop)
            owner.append(k)
            a = stop
    return np.array(start, np.int64), np.array(end, np.int64), np.array(owner, np.int64)


def marked(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, tag, mark, block, at, size, word) of every block; ``docs``: doc, tag, text. ``at``
    and ``size`` are bytes, ``word`` is the number of its first word, ``block`` a hash of it and its mark."""
    import pyarrow as pa

    run = max(1, min_words * 2 // 5)
    width = min_words - run + 1

    def rows(batches):
        for (doc, tag), data, off in bytetext.slices(batches, ["doc", "tag"], "text"):
            start, end, owner = bytetext.words(data, off)
            n = len(start) - min_words + 1
            if n < 1:
                continue
            spans = bytetext.hasher(data)
            at = np.flatnonzero(owner[:n] == owner[min_words - 1:])
            if not len(at):
                continue
            places = cut_values(data, start[: len(start) - run + 1], end[run - 1:])
            least = np.lib.stride_tricks.sliding_window_view(places, width).argmin(1)[at] + at
            # A mark of one text is no mark of the next, so a change of mark ends every block.
            first = bytetext.runs_of(least)
            low, high = at[first], at[np.append(first[1:], len(at)) - 1] + min_words - 1
            who = pa.array(owner[low])
            begun = np.searchsorted(owner, owner[low])
            cut = least[first]
            mark = spans(start[cut], end[cut + run - 1])
            yield pa.RecordBatch.from_arrays([
                doc.take(who), tag.take(who), pa.array(mark.view(np.int64)),
                pa.array(bytetext.mix(mark ^ bytetext.mix(spans(start[low], end[high]))).view(np.int64)),
                pa.array((start[low] - off[owner[low]]).astype(np.int32)), pa.array((end[high] - start[low]).astype(np.int32)),
                pa.array((low - begun).astype(np.int32))], ["doc", "tag", "mark", "block", "at", "size", "word"])

    return docs.mapInArrow(rows, "doc long, tag long, mark long, block long, at int, size int, word int")


def _windows(both: DataFrame, min_words: int) -> DataFrame:
    """(h, more, block, k, s, e, low_at, high_at and documents) of the windows of blocks;
    ``both``: doc, tag, text, blocks."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def rows(batches):
        for (doc, tag, blocks), data, off in bytetext.slices(batches, ["doc", "tag", "blocks"], "text"):
            start, end, _ = bytetext.words(data, off)
            flat = blocks.flatten()
            text_of = np.repeat(np.arange(len(off) - 1), pc.list_value_length(blocks).to_numpy(zero_copy_only=False))
            at = flat.field("at").to_numpy(zero_copy_only=False) + off[text_of]
            first = np.searchsorted(start, at)
            last = np.searchsorted(end, at + flat.field("size").to_numpy(zero_copy_only=False))
            count = last - first + 2 - min_words
            here, of = bytetext.spread(first, count), np.repeat(np.arange(len(first)), count)
            a, b, whose = start[here], end[here + min_words - 1], pa.array(of)
            own = pa.array(text_of[of])
            yield pa.RecordBatch.from_arrays([
                pa.array(bytetext.span_hashes(data, a, b).view(np.int64)),
                pa.array((bytetext.span_hashes(data, a, b, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                flat.field("block").take(whose),
                pa.array((here - first[of]).astype(np.int32)), pa.array((a - at[of]).astype(np.int32)), pa.array((b - at[of]).astype(np.int32)),
                doc.take(own), tag.take(own), flat.field("at").take(whose),
                *(flat.field(c).take(whose) for c in ("high_doc", "high_tag", "high_at"))],
                ["h", "more", "block", "k", "s", "e", "doc", "tag", "at", "high_doc", "high_tag", "high_at"])

    return both.mapInArrow(rows, "h long, more int, block long, k int, s int, e int, doc long, tag long, at int, "
                                 "high_doc long, high_tag long, high_at int")


def _apart(low: str, high: str):
    return (F.col(f"{low}.doc") != F.col(f"{high}.doc")) | (F.col(f"{low}.tag") != F.col(f"{high}.tag"))


def passages(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per repeated passage: id, start, end, n_words, partner (an id), removed."""
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    found = _passages(rows, min_words)
    return found.select(F.col("doc").alias(id_col), "start", "end", "n_words", "partner", "removed")


def _passages(rows: DataFrame, min_words: int) -> DataFrame:
    null = F.lit(-(1 << 63))
    # Null ids as the smallest number, so that plain minima order documents.
    docs = rows.select(F.coalesce("doc", null).alias("doc"), "tag", "text")
    spots = kept(marked(docs, min_words), "marks", "zstd")
    place = F.struct("doc", "tag", "at")
    blocks = spots.groupBy("mark", "block").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.first("size").alias("size"))
    blocks = kept(blocks, "blocks")
    often = blocks.groupBy("mark").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter(_apart("low", "high")).select("mark")
    chosen = blocks.join(often, "mark").groupBy(F.col("low.doc").alias("doc"), F.col("low.tag").alias("tag")).agg(F.collect_list(F.struct(
        F.col("low.at").alias("at"), "size", "block", F.col("high.doc").alias("high_doc"), F.col("high.tag").alias("high_tag"),
        F.col("high.at").alias("high_at"))).alias("blocks"))
    chosen = kept(chosen, "blocks-again")
    removed(rows.sparkSession, blocks)
    # Rows that repeat id and text give their windows twice, which changes no minimum.
    windows = kept(_windows(docs.join(chosen, ["doc", "tag"]).select("doc", "tag", "text", "blocks"), min_words), "windows", "zstd")
    removed(rows.sparkSession, chosen)
    here = F.struct("doc", "tag", (F.col("at") + F.col("s")).alias("at"))
    there = F.struct(F.col("high_doc").alias("doc"), F.col("high_tag").alias("tag"), (F.col("high_at") + F.col("s")).alias("at"))
    # Written first, so that the shuffle files of the counting are gone when the windows are dealt out again.
    shared = kept(windows.groupBy("h", "more").agg(F.min(here).alias("low"), F.max(there).alias("high")).filter(_apart("low", "high")), "shared", "zstd")
    found = windows.select("h", "more", "block", "k", "s", "e").join(shared, ["h", "more"])
    # A block has fewer windows than a window words, so all of them overlap.
    ends = [F.struct(F.col(f"{x}.doc"), F.col(f"{x}.tag"), (F.col(f"{x}.at") - F.col("s")).alias("at")).alias(x) for x in ("low", "high")]
    pieces = kept(found.groupBy("block", *ends).agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.min("k").alias("first"), F.max("k").alias("last")), "pieces")
    removed(rows.sparkSession, windows)
    removed(rows.sparkSession, shared)
    own = (F.col("low.doc") == F.col("doc")) & (F.col("low.tag") == F.col("tag"))
    each = spots.drop("mark").join(pieces, "block").withColumn("p", F.when(own, F.col("high")).otherwise(F.col("low"))).select(
        "doc", "tag", F.col("p.doc").alias("partner"), F.col("p.tag").alias("partner_tag"), (F.col("at") - F.col("p.at")).alias("shift"),
        (F.col("at") + F.col("s")).alias("start"), (F.col("at") + F.col("e")).alias("end"), (F.col("word") + F.col("first")).alias("first"),
        (F.col("word") + F.col("last") + min_words).alias("last"), (~own).alias("removed")).distinct()
    line = ["doc", "tag", "partner", "partner_tag", "shift"]
    by_line = W.partitionBy(*line).orderBy("start", "end")
    reached = F.max("end").over(by_line.rowsBetween(W.unboundedPreceding, -1))
    numbered = each.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1))).withColumn(
        "run", F.sum("new").over(by_line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    got = numbered.groupBy(*line, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first")).alias("n_words"), F.first("removed").alias("removed"))
    # The smallest partner stands for all that share one range.
    one = got.groupBy("doc", "tag", "start", "end").agg(F.max("n_words").alias("n_words"), F.min("partner").alias("partner"), F.max("removed").alias("removed"))
    return one.select(F.nullif("doc", null).alias("doc"), "tag", "start", "end", "n_words", F.nullif("partner", null).alias("partner"), "removed")


def cleaned(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows, other columns unchanged, without the passages marked ``removed``."""
    import pyarrow as pa

    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"))
    keyed = packed.select("_row", F.col("_row")[id_col].cast("long").alias("doc"), F.xxhash64(F.col("_row")[text]).alias("tag"))
    found = _passages(keyed.select("doc", "tag", F.col("_row")[text].alias("text")), min_words).filter("removed")
    spans = found.groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = spans.select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "spans")
    joined = keyed.join(spans, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left").select("_row", "spans")

    @F.pandas_udf("string")
    def without(texts, spans):
        out = []
        for t, cut in zip(texts, spans):
            raw, kept_parts, at = t.encode(), [], 0
            for s in cut:
                if s["start"] > at:
                    kept_parts.append(raw[at: s["start"]])
                at = max(at, s["end"])
            out.append(b"".join([*kept_parts, raw[at:]]).decode("utf-8", "replace"))
        return type(texts)(out, dtype=object)

    same = joined.filter("spans IS NULL").select("_row.*")
    cut = joined.filter("spans IS NOT NULL").withColumn("_text", without(F.col("_row")[text], "spans"))
    changed = cut.select(*[F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns])
    return same.unionByName(changed)
