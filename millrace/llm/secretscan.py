"""Secrets in texts: three fixed patterns, and random strings by their token efficiency.

1. ``assign``, ``access`` and ``hex`` are patterns, found leftmost and without overlap
   per kind; matches that are too short are dropped after matching.
2. ``random``: runs of ``[A-Za-z0-9+/_-]`` (and up to two "=" after them) of ``LEAST``
   characters and more. A byte-pair vocabulary learned on text holds few pieces of a
   random string, so it needs about two thirds of a token per character against a
   quarter for words. A run with fewer than ``RATIO`` characters per token is reported,
   unless it is a known digest (hex of a digest's length, an integrity string), an
   identifier (UUID, ULID, object id, words and numbers joined by separators or in camel case), named
   in ``known``, or overlaps a match of 1. Long runs are tokenized in blocks.

Spans are code points, end exclusive, sorted by start, then by kind in the order above,
then by end. Null and empty texts have none. Texts are read whole; each row is judged by itself, so
repeated rows and ids, null ids and empty tables need no rule; other columns are only
carried by ``redacted``.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .store import worker_state

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
LEAST, RATIO, BLOCK = 20, 2.0, 512
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

_HEX, _UPPER, _RUN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_UPPER[[*range(48, 58), *range(65, 91)]] = True
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True

#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512, and of object ids.
_DIGESTS = {32, 40, 56, 64, 96, 128, 24}
_IS_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_INTEGRITY = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_ULID = re.compile(r"[0-7][0-9A-HJKMNP-TV-Z]{25}")
_NAME = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})+[0-9]{0,4}|[A-Za-z]?[0-9]+(?:[A-Za-z][0-9]+)?Z?|[A-Za-z]?")


def digest_like(run: str) -> bool:
    """Hex of a digest's length, or an integrity string."""
    return bool(len(run) in _DIGESTS and _IS_HEX.fullmatch(run) or _INTEGRITY.fullmatch(run))


def identifier_like(run: str) -> bool:
    """A UUID or ULID, or words and numbers joined by separators or in camel case."""
    return bool(_UUID.fullmatch(run) or _ULID.fullmatch(run) or all(_NAME.fullmatch(p) for p in re.split(r"[/_+=-]", run)))


class Efficiency:
    """Characters per token of strings under a tiktoken vocabulary."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, run: str) -> float:
        tokens = sum(len(self.encoding.encode_ordinary(run[a: a + BLOCK])) for a in range(0, len(run), BLOCK))
        return len(run) / max(1, tokens)


def _long_runs(data: np.ndarray, off: np.ndarray, table: np.ndarray, least: int):
    """(start, end, text number) of maximal runs of at least ``least`` bytes of ``table``."""
    start, end, owner = bytetext.words(data, off, table)
    long = np.flatnonzero(end - start >= least)
    return start[long].tolist(), end[long].tolist(), owner[long].tolist()


def spans_of(efficiency: Efficiency, data: np.ndarray, off: np.ndarray, known: frozenset = frozenset()) -> list[list[tuple]]:
    """Per text the sorted spans (start, kind number, end, characters per token or None)."""
    raw = data.tobytes()
    # Code points before each byte.
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    found: list[list[tuple]] = [[] for _ in range(len(off) - 1)]

    def add(kind: int, k: int, a: int, b: int, ratio: float | None = None) -> None:
        at = before[off[k]]
        found[k].append((int(before[a] - at), kind, int(before[b] - at), ratio))

    for k, own in enumerate(found):
        text = raw[off[k]: off[k + 1]].decode()
        own += [(m.start(), 0, m.end(), None) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for a, b, k in zip(*_long_runs(data, off, _UPPER, 18)):
        first = raw.find(b"AKIA", a, b)
        if first >= 0 and b - first >= 18:
            add(1, k, first, b)
    for a, b, k in zip(*_long_runs(data, off, _HEX, 16)):
        add(2, k, a, b)
    taken = [sorted((s, e) for s, _, e, _ in own) for own in found]
    for a, b, k in zip(*_long_runs(data, off, _RUN, LEAST)):
        stop = b
        while stop < min(off[k + 1], b + 2) and raw[stop] == 61:
            stop += 1
        run = raw[a:stop].decode()
        if run in known or digest_like(run) or identifier_like(run):
            continue
        s, e = before[a] - before[off[k]], before[stop] - before[off[k]]
        if any(x < e and s < y for x, y in taken[k]):
            continue
        ratio = efficiency(run)
        if ratio < RATIO:
            add(3, k, a, stop, ratio)
    return [sorted(own, key=lambda x: x[:3]) for own in found]


def _found(texts: DataFrame, passed: str, vocabulary: str, pattern: str, known: frozenset) -> DataFrame:
    """Column ``passed`` and the ``spans`` of column text."""
    import pyarrow as pa

    kind = texts.schema[passed].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])

    def rows(batches):
        efficiency = worker_state("efficiency_" + vocabulary, lambda: Efficiency(vocabulary, pattern))
        for (own,), data, off in bytetext.slices(batches, [passed], "text"):
            found = [[{"kind": KINDS[k], "start": a, "end": b, "ratio": r} for a, k, b, r in one] for one in spans_of(efficiency, data, off, known)]
            yield pa.RecordBatch.from_arrays([own, pa.array(found, pa.list_(span))], [passed, "spans"])

    return texts.mapInArrow(rows, f"{passed} {kind}, spans array<struct<kind:string,start:bigint,end:bigint,ratio:double>>")


def scan(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text", known: frozenset = frozenset()) -> DataFrame:
    """(id, spans) of every row; ``vocabulary`` and ``pattern`` are a tiktoken file and its pattern."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return _found(rows, "id", vocabulary, pattern, known).select(F.col("id").alias(id_col), "spans")


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redacted(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", known: frozenset = frozenset(), mark: str = "[secret]") -> DataFrame:
    """The rows, other columns unchanged, with ``mark`` in place of every span; spans that
    overlap or touch are one."""
    import pyarrow as pa

    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"))
    rows = packed.select(F.struct("_row", F.col("_row")[text].alias("_text")).alias("both"), F.col("_row")[text].alias("text"))
    found = _found(rows, "both", vocabulary, pattern, known)

    def cut(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts, at, last = [], 0, -1
                for s in spans or []:
                    if s["start"] > last:
                        parts += [t[at: s["start"]], mark]
                    at = last = max(last, s["end"])
                out.append("".join([*parts, t[at:]]) if spans else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["_row", "_text"])

    row = found.schema["both"].dataType["_row"].dataType.simpleString()
    done = found.select("both._row", F.col("both._text").alias("_text"), "spans").mapInArrow(cut, f"_row {row}, _text string")
    return done.select(*[F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns])
