"""Importance resampling towards a target text distribution, by hashed word runs.

1. A text's features are its runs of one to three consecutive words, joined by one space,
   repeats counted. A feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.
2. ``bucket_counts`` adds up features per bucket over all documents, and over all target
   texts; ``gains`` compares both: a thousandth of a nat per unit, rounded down.
3. ``weigh`` adds up the gains of each document; ``draw`` adds Gumbel noise seeded by the
   document id and takes the highest scores, which draws without replacement in
   proportion to the importance weights.

CRC-32 is linear, so a byte adds a value that depends on the byte and its distance from
the end of the feature alone. These come from a table (``Crc.table``), are combined by
``bitwise_xor.reduceat`` over all words of a slice at once, once per word that can end
the feature, and a constant per length is added. Features longer than the table are cut
into blocks from their end, and the blocks' values folded in order.

Only A-Z are lowered. Words are runs of digits, a-z and all characters past U+007F. Null,
empty and wordless texts have no features and weight 0. A null id draws noise as the
empty text does. Equal ids are rows of their own; ties go to the smaller id (nulls last), then to
the row with fewer features and less weight; what is left is equal in every column.
Other columns are not read. An empty table gives no rows, an empty target equal shares.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .store import kept
from ..plans import ranged

BUCKETS = 10000
MOST_WORDS = 3
_POLYNOMIAL = 0xEDB88320
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Crc:
    """CRC-32 of many byte ranges of one array."""

    def __init__(self, width: int = 128, slice_bytes: int = 1 << 20):
        self.width, self.slice_bytes = width, slice_bytes
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = (byte >> np.uint32(1)) ^ (byte & np.uint32(1)) * np.uint32(_POLYNOMIAL)
        table = np.zeros((width, 256), np.uint32)
        table[0] = byte
        for d in range(1, width):
            table[d] = (table[d - 1] >> np.uint32(8)) ^ byte[table[d - 1] & np.uint32(255)]
        self.table = table
        #: The register after 0 .. width zero bytes, from its starting value.
        self.zeros = np.full(width + 1, 0xFFFFFFFF, np.uint32)
        for k in range(width):
            self.zeros[k + 1] = (self.zeros[k] >> np.uint32(8)) ^ byte[self.zeros[k] & np.uint32(255)]

    def _past(self, register: np.ndarray) -> np.ndarray:
        """The registers after ``width`` zero bytes: a register acts as the next four bytes do."""
        out = np.zeros_like(register)
        for k in range(4):
            out ^= self.table[self.width - 1 - k][(register >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def _blocks(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Combined contributions of ranges of 1 to ``width`` bytes, a bounded number of bytes at a time."""
        size = end - start
        upto = np.cumsum(size)
        out, a, flat = np.zeros(len(start), np.uint32), 0, self.table.ravel()
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] - size[a] + self.slice_bytes, "right")))
            some = size[a:b]
            stop = np.cumsum(some)
            step = np.arange(int(stop[-1]))
            place = np.repeat(start[a:b] - (stop - some), some) + step
            away = np.repeat(stop - 1, some) - step
            out[a:b] = np.bitwise_xor.reduceat(flat[(away << 8) | data[place]], stop - some)
            a = b
        return out

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of ranges of any length (none empty), in blocks of ``width`` bytes from their end."""
        if not len(start):
            return np.zeros(0, np.uint32)
        count = -(-(end - start) // self.width)
        first = np.cumsum(count) - count
        of = np.repeat(np.arange(len(start)), count)
        later = count[of] - 1 - (np.arange(len(of)) - first[of])
        stop = end[of] - later * self.width
        begin = np.maximum(start[of], stop - self.width)
        value = self._blocks(data, begin, stop)
        register = self.zeros[(stop - begin)[first]] ^ value[first]
        live, j = np.flatnonzero(count > 1), 1
        while len(live):
            register[live] = self._past(register[live]) ^ value[first[live] + j]
            j += 1
            live = live[count[live] > j]
        return register ^ np.uint32(0xFFFFFFFF)

    def runs(self, data: np.ndarray, place: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
        """CRC-32 of every run of 1 .. ``most`` neighbouring words, by its first word. ``data`` holds
        the words (``place``, ``size``) with one byte between and after them.

        A byte's distance from the end of a run depends on the word that ends it: its own
        or one of the next. Per such word the contributions are combined word by word, and
        a run is the combination of its words'.
        """
        m, stop = len(place), place + size
        step, flat = np.arange(len(data), dtype=np.int32), self.table.ravel()
        parts, found = [], []
        for k in range(min(most, m)):
            last = stop[np.minimum(np.arange(m) + k, m - 1)]
            away = np.repeat((last - 1).astype(np.int32), size + 1)
            away -= step
            np.clip(away, 0, self.width - 1, out=away)
            value = flat[(away << 8) | data]
            if not k:
                value[stop] = 0  # the byte after a run
            parts.append(np.bitwise_xor.reduceat(value, place))
        for n in range(1, most + 1):
            at = np.arange(max(0, m - n + 1))
            length = stop[at + n - 1] - place[at]
            value = self.zeros[np.minimum(length, self.width)] ^ np.uint32(0xFFFFFFFF)
            for k in range(min(n, len(parts))):
                value ^= parts[k][at + n - 1 - k]
            long = np.flatnonzero(length > self.width)
            value[long] = self.spans(data, place[long], stop[long + n - 1])
            found.append(value)
        return found


def features(crc: Crc, data: np.ndarray, off: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, text number, bucket) of the features of all texts."""
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    start, end, owner = bytetext.words(data, off, _WORD)
    size = end - start
    # The words alone, one blank after each.
    place = np.cumsum(size + 1) - (size + 1)
    flat = np.full(int((size + 1).sum()), 32, np.uint8)
    flat[bytetext.spread(place, size)] = data[bytetext.spread(start, size)]
    texts, found = [], []
    for n, value in enumerate(crc.runs(flat, place, size, MOST_WORDS), 1):
        at = np.flatnonzero(owner[: len(value)] == owner[n - 1: n - 1 + len(value)])
        texts.append(owner[at])
        found.append((value[at] % np.uint32(buckets)).astype(np.int64))
    return np.bincount(owner, minlength=len(off) - 1), np.concatenate(texts), np.concatenate(found)


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all texts; at most ``buckets`` rows leave a task."""
    import pyarrow as pa

    def counted(batches):
        crc, total = Crc(), np.zeros(buckets, np.int64)
        for _, data, off in bytetext.slices(batches, [], "text"):
            total += np.bincount(features(crc, data, off, buckets)[2], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(counted, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the ``bucket_counts`` of both sides."""
    spark = raw.sparkSession
    all_of = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = all_of.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    whole = both.select(F.struct(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))).scalar()
    share = (t + 1) * (whole["s"] + buckets) / ((s + 1) * (whole["t"] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def weigh(df: DataFrame, gain: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight) of every document."""
    import pyarrow as pa

    table = np.zeros(buckets, np.int64)
    for r in gain.collect():  # ``buckets`` rows
        table[r["bucket"]] = r["gain"]
    sent = df.sparkSession.sparkContext.broadcast(table.tobytes())
    kind = df.schema[id_col].dataType.simpleString()

    def weighed(batches):
        crc, own = Crc(), np.frombuffer(sent.value, np.int64)
        for (ids,), data, off in bytetext.slices(batches, ["id"], "text"):
            n_words, texts, bucket = features(crc, data, off, buckets)
            total = np.zeros(len(off) - 1, np.int64)
            np.add.at(total, texts, own[bucket])
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(n_words, pa.int64()), pa.array(np.bincount(texts, minlength=len(off) - 1), pa.int64()), pa.array(total)],
                ["id", "n_words", "n_features", "weight"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(weighed, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def draw(weighed: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20) -> DataFrame:
    """Adds score and rank: of the rows with ``least_words`` words, ``percent`` in a hundred
    have a rank, from 1 by falling score.

    Ranks come from a range partitioning of the small score rows, so no task sorts all.
    """
    # Written, so that sampling the range bounds reads scores and not texts again.
    scored = kept(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    order = scored.filter(F.col("n_words") >= least_words).withColumns({"_low": -F.col("score"), "_null": F.col("id").isNull()})
    placed = ranged.row_index(order, [], ["_low", "_null", "id", "n_features", "weight"], "_at", "_all")
    ranked = placed.withColumn("rank", F.when(F.col("_at") <= F.floor(percent * F.col("_all") / F.lit(100)), F.col("_at"))).drop("_low", "_null", "_at", "_all")
    few = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(few)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = 5, seed: int = 42, least_words: int = 20) -> DataFrame:
    """Per document: id, n_words, n_features, weight, score, rank (null if not drawn)."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    return draw(weigh(docs, gain, id_col, text), percent, seed, least_words).withColumnRenamed("id", id_col)
