"""Texts of an Arrow batch as one byte array: words, rolling hashes and n-grams by numpy.

Everything works on slices of whole texts of half a MB, so a task's memory
follows the slice (or its one longest text), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .store import worker_state

#: Bytes of the class [^\x20\x09-\x0D].
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PRIME = np.uint64((1 << 31) - 1)
#: Two independent pairs of bases.
_BASES = ((1_362_918_571, 771_340_227), (1_918_204_633, 402_653_471))
#: Places of the tables of powers.
_BLOCK = 1 << 19
#: Bytes that running sums take at a time, so that their numbers stay in the cache.
_PART = 1 << 14


def slices(batches, columns: list[str], text: str, limit: int = 1 << 19) -> Iterator[tuple]:
    """(other columns as Arrow arrays, bytes, offsets) of runs of whole texts.

    A run holds up to ``limit`` bytes of text, or a single longer text. Null
    texts have no bytes.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        col = pc.fill_null(col.cast(pa.large_string()), "")
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(col):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1)
            off = (ends[a: b + 1] - ends[a]).astype(np.int64)
            yield [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in columns], data[ends[a]: ends[b]], off
            a = b


def lower(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts in lower case (Unicode)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(np.ascontiguousarray(data)))
    low = pc.utf8_lower(arr)
    ends = np.frombuffer(low.buffers()[1], np.int64)[low.offset: low.offset + len(low) + 1]
    raw = low.buffers()[2]
    flat = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return flat[ends[0]: ends[-1]], (ends - ends[0]).astype(np.int64)


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the maximal runs of bytes of ``table``."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^62 modulo the prime, in place."""
    for _ in range(2):
        high = x >> np.uint64(31)
        x &= _PRIME
        x += high
    x -= _PRIME * (x >= _PRIME)
    return x


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """(powers, inverse powers) of ``base`` modulo the prime, from 0 to ``_BLOCK``."""
    tables = worker_state("prime_powers", dict)
    if base not in tables:
        both = []
        for v in (base, pow(base, -1, int(_PRIME))):
            out, have = np.ones(_BLOCK + 1, np.uint64), 1
            while have <= _BLOCK:
                more = min(have, _BLOCK + 1 - have)
                out[have: have + more] = _reduced(out[:more] * np.uint64(pow(v, have, int(_PRIME))))
                have += more
            both.append(out)
        tables[base] = tuple(both)
    return tables[base]


def _sums(data: np.ndarray, base: int) -> np.ndarray:
    """Running sums of (byte + 1) times the power of its place: numbers below 2^32, right modulo the prime."""
    up, _ = _powers(base)
    out = np.zeros(len(data) + 1, np.uint32)
    high, last = np.empty(_PART, np.uint64), np.uint64(0)
    for a in range(0, len(data), _PART):
        part = data[a: a + _PART].astype(np.uint64)
        n, at = len(part), a % _BLOCK
        part += np.uint64(1)
        part *= up[at: at + n]
        np.cumsum(part, out=part)  # below 2^53
        if a >= _BLOCK:
            part = _reduced(part)
            part *= np.uint64(pow(base, a - at, int(_PRIME)))
        part += last
        for _ in range(2):
            np.right_shift(part, np.uint64(31), out=high[:n])
            part &= _PRIME
            part += high[:n]
        out[a + 1: a + 1 + n] = part
        last = part[-1]
    return out


def hasher(data: np.ndarray, which: int = 0):
    """A function of (start, end) that gives 64-bit hashes of byte ranges.

    Two polynomials modulo the prime 2^31 - 1, taken from running sums: ranges of n bytes
    that differ meet in one of them for at most n of the 2^31 bases. (Modulo a power of two
    some texts meet for every base.)
    """
    bases = _BASES[which]
    sums = [_sums(data, b) for b in bases]

    def value(k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        gap = sums[k][end].astype(np.uint64)
        gap += _PRIME + _PRIME
        gap -= sums[k][start]
        _, down = _powers(bases[k])
        got = _reduced(_reduced(gap) * down[start % _BLOCK])
        far = start >= _BLOCK
        if far.any():
            block = start[far] // _BLOCK
            back = pow(int(down[1]), _BLOCK, int(_PRIME))
            step = np.array([pow(back, k, int(_PRIME)) for k in range(int(block.max()) + 1)], np.uint64)
            got[far] = _reduced(got[far] * step[block])
        return got

    def hashes(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        both = (value(0, start, end) << np.uint64(32)) | value(1, start, end)
        return mix(both + (end - start).astype(np.uint64) * np.uint64(_ODD[0]))

    return hashes


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return hasher(data, which)(start, end)


def grams(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first position) of every run of ``n`` words of one text."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(_ODD[0]) + h[k: m + k]
    at = np.flatnonzero(owner[:m] == owner[n - 1:])
    return mix(out[at]), at


def runs_of(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, … (size[0] of them), start[1], …"""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(start - (ends - size), size)
