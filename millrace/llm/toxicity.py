"""Toxicity by a linear model over character n-grams scaled by naive Bayes ratios.

Features are the byte 3-, 4- and 5-grams present in a lower-cased text, with ASCII
signs and white space as blanks, in 2^18 slots. Each feature's value is its log-count
ratio between toxic and clean training texts; the ``FEATURES`` slots that tell the
classes apart best (chi-square) get weights by ridge logistic regression on top.

Training reads about ``max_rows`` labelled rows at most, chosen by a hash of the id;
slot counts are summed by Spark, and what the driver gets is bounded by the slots and
by ``max_rows`` times ``FEATURES``. Scoring reads every whole text in slices.

Null and empty texts have no feature and score the intercept. Without both classes
every text scores the share of toxic rows. Repeated rows score alike; columns other
than id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .store import partitions

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
FEATURES = 2048
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:48] = 32
_FOLD[58:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def slots(data: np.ndarray, off: np.ndarray):
    """For n = 3, 4, 5: (slot at every byte, usable: the n-gram ends inside its text).

    ``data`` is lower case already.
    """
    folded = _FOLD[data].astype(np.uint32)
    n = len(data)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    if n < 3:
        return
    gram = folded[:-2] | (folded[1:-1] << np.uint32(8)) | (folded[2:] << np.uint32(16))
    for size in (3, 4, 5):
        if size > 3:
            gram = gram[:-1] * np.uint32(0x01000193) + folded[size - 1:]
            if not len(gram):
                return
        h = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x85EBCA6B + 2 * size)
        yield (h >> np.uint32(32 - SLOT_BITS)).astype(np.int32), left[: len(gram)] >= size


def present(data: np.ndarray, off: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once; ``table`` maps slots to features (-1: none)."""
    data, off = bytetext.lower(data, off)
    width = SLOTS if table is None else max(1, int(table.max()) + 1)
    found = []
    for slot, usable in slots(data, off):
        if table is not None:
            slot = table[slot]
            usable &= slot >= 0
        at = np.flatnonzero(usable)
        found.append((np.searchsorted(off, at, "right") - 1) * width + slot[at])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // width, keys % width


class Model:
    """Weight of each feature, and the slots they stand for."""

    def __init__(self, table: np.ndarray, weight: np.ndarray, offset: float):
        self.table, self.weight, self.offset = table, weight, offset

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        total = np.full(len(off) - 1, self.offset)
        if len(self.weight):
            text, feature = present(data, off, self.table)
            total += np.bincount(text, weights=self.weight[feature], minlength=len(total))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sample(df: DataFrame, id_col: str, text: str, label: str, max_rows: int) -> DataFrame:
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("y"))
    rows = rows.filter("y IN (0, 1)")
    n = rows.select("y").count()
    bound = int((1 << 20) * min(1.0, max_rows / max(1, n)))
    return rows.filter(F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 20)) < F.lit(bound))


def train(df: DataFrame, id_col: str, text: str, label: str, max_rows: int = 20000, ridge: float = 1.0) -> Model:
    import pyarrow as pa

    rows = _sample(df, id_col, text, label, max_rows).select("y", "text").repartition(min(12, partitions(df.sparkSession)))

    def counted(batches):
        have = np.zeros((2, SLOTS + 1), np.int64)
        for (y,), data, off in bytetext.slices(batches, ["y"], "text"):
            y = y.to_numpy(zero_copy_only=False)
            have[:, SLOTS] += np.bincount(y, minlength=2)
            owner, slot = present(data, off)
            for k in (0, 1):
                have[k, :SLOTS] += np.bincount(slot[y[owner] == k], minlength=SLOTS)
        used = np.flatnonzero(have.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(have[0, used]), pa.array(have[1, used])], ["slot", "n0", "n1"])

    found = rows.mapInArrow(counted, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # The row behind the last slot holds the documents of each class.
    found = found.filter(f"n0 + n1 >= 3 OR slot >= {SLOTS}").toPandas()
    have = np.zeros((2, SLOTS + 1))
    have[0, found["slot"]], have[1, found["slot"]] = found["n0"], found["n1"]
    docs = have[:, SLOTS].copy()
    none = np.full(SLOTS, -1, np.int16)
    if not docs.all():
        share = docs[1] / max(1.0, docs.sum())
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))) if docs.sum() else 0.0)
    n0, n1 = have[0, :SLOTS], have[1, :SLOTS]
    ratio = np.log((n1 + 1) / (docs[1] + 2)) - np.log((n0 + 1) / (docs[0] + 2))
    all_docs, hit = docs.sum(), n0 + n1
    expected = hit * docs[1] / all_docs
    chi = np.where(hit > 0, (n1 - expected) ** 2 / np.maximum(expected * (1 - hit / all_docs) * docs[0] / all_docs, 1e-9), 0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])
    chosen = chosen[hit[chosen] > 0]
    table = none.copy()
    table[chosen] = np.arange(len(chosen))

    def listed(batches):
        for (y,), data, off in bytetext.slices(batches, ["y"], "text"):
            owner, feature = present(data, off, table)
            yield pa.RecordBatch.from_arrays([
                pa.array([y.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                pa.array([owner.astype(np.int32).tobytes()], pa.binary()), pa.array([feature.astype(np.int16).tobytes()], pa.binary())], ["y", "owner", "feature"])

    got = rows.mapInArrow(listed, "y binary, owner binary, feature binary").collect()
    ys = [np.frombuffer(r["y"], np.uint8) for r in got]
    base = np.cumsum([0, *map(len, ys)])
    owner = np.concatenate([np.frombuffer(r["owner"], np.int32) + b for r, b in zip(got, base)])
    feature = np.concatenate([np.frombuffer(r["feature"], np.int16) for r in got]).astype(np.int64)
    weight, offset = _fit(owner, feature, np.concatenate(ys).astype(float), ratio[chosen], ridge)
    return Model(table, weight * ratio[chosen], offset)


def _fit(owner: np.ndarray, feature: np.ndarray, y: np.ndarray, scale: np.ndarray, ridge: float, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on presence times ``scale``, by accelerated gradient steps."""
    n, width = len(y), len(scale)
    size = np.bincount(owner, weights=scale[feature] ** 2, minlength=n)
    # Bound of the curvature; 1 stands for the intercept.
    step = 4.0 / (np.mean(size) * 4 + 1 + 4 * ridge / n)
    w, b = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    last = np.inf
    for _ in range(rounds):
        z = np.bincount(owner, weights=(v * scale)[feature], minlength=n) + c
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)) + ridge / n / 2 * v @ v
        if loss > last:
            step, t = step / 2, 1.0
            v, c = w.copy(), b
            last = np.inf
            continue
        last = loss
        gap = (p - y) / n
        new_w = v - step * (np.bincount(feature, weights=gap[owner], minlength=width) * scale + ridge / n * v)
        new_b = c - step * gap.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1, higher: more toxic)."""
    import pyarrow as pa

    # Arrays and numbers: tasks need no copy of the package to read them.
    sent = df.sparkSession.sparkContext.broadcast((model.table, model.weight, model.offset))

    def scored(batches):
        model = Model(*sent.value)
        for (ids,), data, off in bytetext.slices(batches, ["id"], "text"):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(data, off), pa.float64())], [id_col, "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")
