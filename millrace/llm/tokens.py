"""Token ids in a binary format: frequency-ranked, byte-aligned, separate control bytes.

1. ``tokenized``: documents in ascending id order, as blocks of token ids of whole
   documents, in a table in the shared folder.
2. ``ranking``: the ids by how often they occur in all documents, so that the most
   frequent 256 ids need one byte.
3. ``write``: each block as four parts: a header, the documents' token counts, one
   control byte per four numbers (two bits each: bytes used less one) and the data
   bytes. Blocks follow each other in files; the returned manifest names them.
4. ``read``: blocks are read by range and decoded with table lookups by numpy.

The tokenizers library encodes every text. A text is first cut at places where its
byte-level pre-tokenizer always cuts (see ``_cuts``), and equal pieces are encoded
once per worker; texts with signs whose class a byte does not show are encoded whole.

Null and empty texts have only the end id. Rows with equal ids follow each other in
order of their text. An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bytetext
from .store import Appender, kept, partitions, read_range, removed, short_shuffles, worker_state
from ..session import scratch_path

MAGIC = b"MRT1"
#: Documents of a block hold up to so many bytes of text (or are a single document).
BLOCK_BYTES = 1 << 19
#: Pieces that a worker remembers.
MEMORY = 3_000_000
#: Size at which a new file is begun.
FILE_BYTES = 128 << 20

# Classes of bytes for cutting.
_NONE, _LETTER, _DIGIT, _BLANK, _SIGN, _LINE, _HIGH, _QUOTE = range(8)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[33:48] = _SIGN
_CLASS[58:65] = _SIGN
_CLASS[91:97] = _SIGN
_CLASS[123:127] = _SIGN
_CLASS[ord("'")] = _QUOTE
_CLASS[32] = _BLANK
_CLASS[10] = _LINE
_CLASS[128:] = _HIGH
_GAP = np.isin(np.arange(8), [_BLANK, _LINE])
_INK = np.isin(np.arange(8), [_LETTER, _DIGIT, _SIGN, _HIGH, _QUOTE])
#: Class pairs (8 x first + second) between which there is always a cut.
_PAIRS = np.zeros(64, bool)
for _a, _b in [(_LETTER, _SIGN), (_HIGH, _SIGN), (_DIGIT, _SIGN), (_LETTER, _DIGIT), (_HIGH, _DIGIT)]:
    _PAIRS[[8 * _a + _b, 8 * _b + _a]] = True


def _whole(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts with characters past U+007F other than the letters U+00C0 to U+023F (which
    hold two signs), and texts with a "<|": a special token may follow."""
    lead = data >= 0xC0
    odd = lead & ~((data >= 0xC3) & (data <= 0xC8))
    if len(data) > 1:
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    flags = np.zeros(len(off) - 1, bool)
    at = np.flatnonzero(odd)
    flags[np.searchsorted(off, at, "right") - 1] = True
    return flags


def _cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places before which the pre-tokenizer always cuts, whatever surrounds them.

    Its pattern takes a blank into the word, number or sign run after it. So it cuts
    before a single blank between two characters that are no white space, between a
    letter or digit and a sign (no apostrophe: those begin contractions), between a
    sign and a letter or digit, between a letter and a digit, and around a single
    line end between two characters that are no white space.
    """
    kind = _CLASS[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[1:-1] = _PAIRS[(kind[:-1] << 3) | kind[1:]]
        gap = np.flatnonzero(_GAP[kind])
        gap = gap[(gap > 0) & (gap < n - 1)]
        gap = gap[_INK[kind[gap - 1]] & _INK[kind[gap + 1]]]
        # At a text's rim a gap would look at the neighbour text.
        rim = np.zeros(n + 1, bool)
        rim[off] = True
        gap = gap[~rim[gap] & ~rim[gap + 1]]
        cut[gap] = True
        cut[gap[kind[gap] == _LINE] + 1] = True
    cut[off] = True
    return np.flatnonzero(cut)


class _Rows:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.all, self.n = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> int:
        """Append; returns the place of the first one."""
        at, self.n = self.n, self.n + len(more)
        if self.n > len(self.all):
            wide = np.zeros(max(self.n, 2 * len(self.all)), self.all.dtype)
            wide[:at] = self.all[:at]
            self.all = wide
        self.all[at: self.n] = more
        return at


class _Index:
    """Numbers of 64-bit keys, by open addressing: a look-up or insertion costs the same
    however many keys are known."""

    def __init__(self):
        self.key, self.slots = _Rows(np.uint64), np.full(1 << 14, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if unknown."""
        out, slot, todo = np.full(len(keys), -1, np.int64), self._slot(keys), np.arange(len(keys))
        while len(todo):
            entry = self.slots[slot[todo]]
            hit = (entry >= 0) & (self.key.all[entry] == keys[todo])
            out[todo[hit]] = entry[hit]
            todo = todo[(entry >= 0) & ~hit]
            slot[todo] = (slot[todo] + 1) % len(self.slots)
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for different, unknown keys."""
        at = self.key.add(keys)
        if 2 * self.key.n > len(self.slots):
            self.slots = np.full(4 << self.key.n.bit_length(), -1, np.int32)
            self._place(np.arange(self.key.n))
        else:
            self._place(np.arange(at, self.key.n))
        return np.arange(at, self.key.n)

    def _place(self, entries: np.ndarray) -> None:
        slot, todo = self._slot(self.key.all[entries]), np.arange(len(entries))
        while len(todo):
            s = slot[todo]
            free = self.slots[s] < 0
            self.slots[s[free]] = entries[todo[free]]
            todo = todo[self.slots[s] != entries[todo]]
            slot[todo] = (slot[todo] + 1) % len(self.slots)


class Pieces:
    """Token ids of pieces of text, remembered by hash. A piece's bytes are remembered too,
    and ids are used only where they are the same."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.index, self.ids, self.raw = _Index(), _Rows(np.uint32), _Rows(np.uint8)
        # Of each piece: place and count in ids, place and count in raw.
        self.at, self.size, self.raw_at, self.raw_size = _Rows(np.int64), _Rows(np.int32), _Rows(np.int64), _Rows(np.int32)

    @property
    def flat(self) -> np.ndarray:
        return self.ids.all

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces; (place in ``flat``, count) of each."""
        raw = data.tobytes()
        ids = self._each([raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())])
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        at = self.ids.add(np.fromiter((x for one in ids for x in one), np.uint32, int(size.sum())))
        return at + np.cumsum(size) - size, size

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place in ``flat``, count) of each piece."""
        import pandas as pd

        back, uniq = pd.factorize(key)
        if self.index.key.n + len(uniq) > MEMORY:
            self.forget()
        known = self.index.find(uniq)
        new = np.flatnonzero(known < 0)
        if len(new):
            first = np.zeros(len(uniq), np.int64)
            first[back[::-1]] = np.arange(len(key) - 1, -1, -1)
            a, b = start[first[new]], end[first[new]]
            at, size = self._fresh(data, a, b)
            known[new] = self.index.add(uniq[new])
            place = self.raw.add(data[bytetext.spread(a, b - a)])
            for rows, more in ((self.at, at), (self.size, size), (self.raw_at, place + np.cumsum(b - a) - (b - a)), (self.raw_size, b - a)):
                rows.add(more)
        known = known[back]
        at, size = self.at.all[known], self.size.all[known]
        odd = self._differ(data, start, end, known)
        if len(odd):
            at[odd], size[odd] = self._fresh(data, start[odd], end[odd])
        return at, size

    def _differ(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those remembered under their hash."""
        long = end - start
        unlike = self.raw_size.all[known] != long
        size = np.where(unlike, 0, long)
        wrong = np.flatnonzero(self.raw.all[bytetext.spread(self.raw_at.all[known], size)] != data[bytetext.spread(start, size)])
        if len(wrong):
            unlike[np.searchsorted(np.cumsum(size), wrong, "right")] = True
        return np.flatnonzero(unlike)

    def _each(self, pieces: list[str], run: int = 64) -> list[list[int]]:
        """Ids of each piece. Pieces without white space but a blank in front are
        joined by line ends, which are tokens of their own between them."""
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        plain = [len(line) == 1 and p[p[0] == " ":].split() == [p[p[0] == " ":]] for p in pieces]
        single = [p for p, ok in zip(pieces, plain) if ok]
        runs = [single[a: a + run] for a in range(0, len(single), run)]
        joined: list[list[int]] = []
        for part, got in zip(runs, self.whole(["\n".join(r) for r in runs])):
            flat = np.asarray(got, np.uint32)
            found = np.split(flat, np.flatnonzero(flat == line[0]))
            if len(found) != len(part):
                raise ValueError("a line end is no token of its own here")
            joined += [found[0].tolist(), *[x[1:].tolist() for x in found[1:]]]
        rest = iter(self.whole([p for p, ok in zip(pieces, plain) if not ok]))
        first = iter(joined)
        return [next(first) if ok else next(rest) for ok in plain]


def encode_slice(pieces: Pieces, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, count per text), without end ids."""
    edges = _cuts(data, off)
    start, end = edges[:-1], edges[1:]
    owner = np.searchsorted(off, start, "right") - 1
    whole = _whole(data, off)
    if whole.any():
        usable = ~whole[owner]
        start, end, owner = start[usable], end[usable], owner[usable]
    at, size = pieces.encode(data, start, end, bytetext.span_hashes(data, start, end))
    ids = pieces.flat[bytetext.spread(at, size.astype(np.int64))]
    counts = np.bincount(owner, weights=size, minlength=len(off) - 1).astype(np.int64)
    if not whole.any():
        return ids, counts
    odd, raw = np.flatnonzero(whole), data.tobytes()
    direct = dict(zip(odd.tolist(), pieces.whole([raw[off[k]: off[k + 1]].decode() for k in odd.tolist()])))
    ends = np.cumsum(counts)
    parts = [np.asarray(direct[k], np.uint32) if k in direct else ids[ends[k] - counts[k]: ends[k]] for k in range(len(counts))]
    return np.concatenate(parts) if parts else ids, np.fromiter(map(len, parts), np.int64, len(parts))


def tokenized(df: DataFrame, id_col: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """Blocks of whole documents in ascending id order: part, block, n_docs, n_ids,
    doc_ids (with nulls first), counts, ids (little-endian unsigned 16 or 32 bits)."""
    import pyarrow as pa

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    rows = rows.withColumn("part", F.spark_partition_id())
    schema = "part int, block int, n_docs int, n_ids long, doc_ids array<long>, counts binary, ids binary"

    def blocks(batches):
        pieces = worker_state("pieces_" + tokenizer, lambda: Pieces(tokenizer))
        width = np.uint16 if max(pieces.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        for k, ((ids, part), data, off) in enumerate(bytetext.slices(batches, ["id", "part"], "text", BLOCK_BYTES)):
            got, counts = encode_slice(pieces, data, off)
            ends = np.cumsum(counts)
            full = np.insert(got, ends, end_id).astype(width)
            counts = (counts + 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                pa.array([part[0].as_py()], pa.int32()), pa.array([k], pa.int32()), pa.array([len(counts)], pa.int32()),
                pa.array([len(full)], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                pa.array([counts.tobytes()], pa.binary()), pa.array([full.tobytes()], pa.binary())],
                ["part", "block", "n_docs", "n_ids", "doc_ids", "counts", "ids"])

    return kept(rows.mapInArrow(blocks, schema), "token-blocks", "zstd")


def ranking(blocks: DataFrame, size: int) -> np.ndarray:
    """Token ids by falling frequency in all documents, then by id: one entry per id
    of the tokenizer, so its size does not depend on the documents."""
    import pyarrow as pa

    def counted(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw, n in zip(batch.column(0), batch.column(1)):
                total += np.bincount(np.frombuffer(raw.as_buffer(), f"<u{raw.as_buffer().size // max(1, n.as_py())}"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    found = blocks.select("ids", "n_ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(size, np.int64)
    for r in found.collect():
        total[r["id"]] = r["n"]
    return np.lexsort((np.arange(size), -total)).astype(np.uint32)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    n = len(numbers)
    size = 1 + (numbers > 0xFF).astype(np.int64) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    code = np.zeros((n + 3) // 4 * 4, np.uint8)
    code[:n] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | (code[:, 1] << 2) | (code[:, 2] << 4) | (code[:, 3] << 6)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        long = np.flatnonzero(size > k) if k else slice(None)
        data[at[long] + k] = (numbers[long] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


#: Byte counts of the four numbers of each control byte.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers of ``pack``."""
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    flat = np.frombuffer(data, np.uint8)
    out = flat[at].astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(size > k)
        if not len(long):
            break
        out[long] |= flat[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block_bytes(doc_ids: list, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    """Header (magic, documents, ids, bytes of the four parts), then null flags and ids
    of the documents, counts and ids of tokens."""
    null = np.array([i is None for i in doc_ids], np.uint8)
    own = np.array([0 if i is None else i for i in doc_ids], "<i8")
    head = [null.tobytes(), own.tobytes(), *pack(counts), *pack(ranks)]
    return MAGIC + struct.pack("<8Q", len(doc_ids), len(ranks), *map(len, head)) + b"".join(head)


def read_block(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, counts, ranks) of ``block_bytes``."""
    if raw[:4] != MAGIC:
        raise ValueError("no block of token ids")
    n_docs, n_ids, *sizes = struct.unpack("<8Q", raw[4:68])
    parts, at = [], 68
    for s in sizes:
        parts.append(raw[at: at + s])
        at += s
    null, own = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<i8")
    ids = [None if z else int(i) for z, i in zip(null, own)]
    return ids, unpack(parts[2], parts[3], n_docs), unpack(parts[4], parts[5], n_ids)


def write(blocks: DataFrame, rank_to_id: np.ndarray, folder: str) -> DataFrame:
    """The blocks in files below ``folder``; returns the manifest (part, block, path,
    offset, length, n_docs, n_ids, start), ``start`` being the ids before the block."""
    import pyarrow as pa

    order = np.zeros(len(rank_to_id), np.uint32)
    order[rank_to_id] = np.arange(len(rank_to_id), dtype=np.uint32)
    names = ["part", "block", "path", "offset", "length", "n_docs", "n_ids"]

    def files(batches):
        out, last = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if out and ((r["part"], r["block"] - 1) != last or out.size >= FILE_BYTES):
                    out.close()
                    out = None
                out = out or Appender(folder, ".tok")
                raw = block_bytes(r["doc_ids"], np.frombuffer(r["counts"], "<u4"),
                                  order[np.frombuffer(r["ids"], f"<u{len(r['ids']) // max(1, r['n_ids'])}")])
                at, last = out.write(raw), (r["part"], r["block"])
                yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in ("part", "block", "n_docs", "n_ids")}, "path": out.uri, "offset": at, "length": len(raw)}],
                                                 pa.schema([("part", pa.int32()), ("block", pa.int32()), ("path", pa.string()), ("offset", pa.int64()),
                                                            ("length", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64())])).select(names)
        if out:
            out.close()

    made = kept(blocks.mapInArrow(files, "part int, block int, path string, offset long, length long, n_docs int, n_ids long"), "token-manifest")
    # Ids before each part, then within the part: a row per part, and per block of one part.
    parts = made.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "ahead", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return made.withColumn("start", inside).join(parts.select("part", "ahead"), "part").withColumn("start", F.col("start") + F.col("ahead")).drop("ahead")


def read(manifest: DataFrame, rank_to_id: np.ndarray) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    import pyarrow as pa

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own, counts, ranks = read_block(read_range(r["path"], r["offset"], r["length"]))
                raw = rank_to_id[ranks].astype("<u4").tobytes()
                ends = np.cumsum(counts.astype(np.int64))
                begin = ends - counts
                view = memoryview(raw)
                crc = [zlib.crc32(view[4 * a: 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int64()), pa.array(begin + r["start"], pa.int64()),
                    pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    rows = manifest.select("part", "block", "path", "offset", "length", "start").repartition(partitions(spark), "part", "block")
    return rows.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(spark: SparkSession, df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Tokenize, rank and write ``df``; returns the manifest and the ranking."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    blocks = tokenized(df, id_col, text, tokenizer, end_id)
    rank_to_id = ranking(blocks, size)
    with short_shuffles(spark):
        manifest = kept(write(blocks, rank_to_id, scratch_path(spark, "tokens")), "token-index")
    removed(spark, blocks)
    return manifest, rank_to_id
