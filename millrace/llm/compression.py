"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes, each compressed with both dictionaries. The difference of the
two compressed sizes by the size of the text is the feature, and a logistic curve
fitted on training rows that built no dictionary turns it into a score. All blocks
count, so long texts are judged by all they hold.

Training reads a bounded sample: the whole texts of at most about ``max_rows`` labelled rows,
chosen by a hash of the id, of fewer if those are more than ``max_bytes`` on average. Texts that
are null or empty take the score of a feature of 0. With one class only, or too
little text for a dictionary, every text scores the share of good rows. Rows that
repeat get equal scores; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .store import worker_state

BLOCK = 2048
LEVEL = 3
DICT_BYTES = 65536


class Model:
    """Two dictionaries and the curve."""

    def __init__(self, good: bytes, bad: bytes, slope: float, offset: float, share: float):
        self.good, self.bad, self.slope, self.offset, self.share = good, bad, slope, offset, share

    def curve(self, x: np.ndarray) -> np.ndarray:
        if not self.good or not self.bad:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30)))


def _compressors(good: bytes, bad: bytes):
    import zstandard as zs

    out = []
    for raw in (good, bad):
        d = zs.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zs.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def differences(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(bytes with the bad dictionary - bytes with the good one) / bytes, per text."""
    out = np.zeros(len(off) - 1)
    if not model.good or not model.bad:
        return out
    good, bad = worker_state(f"zstd_{hash((model.good, model.bad))}", lambda: _compressors(model.good, model.bad))
    raw = memoryview(data.tobytes())
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        gap = 0
        for at in range(a, b, BLOCK):
            part = raw[at: min(b, at + BLOCK)]
            gap += len(bad.compress(part)) - len(good.compress(part))
        out[k] = gap / (b - a) if b > a else 0.0
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps with a small ridge."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-2
        step = np.linalg.solve(hess, a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[0] / scale, w[1]


def train(df: DataFrame, id_col: str, text: str, label: str, max_rows: int = 6000, max_bytes: int = 48 << 20,
          share: float | None = None) -> Model:
    """``label`` is 1 for good and 0 for bad; other rows are not read. ``share`` is the
    share of good texts to calibrate to (that of the rows, if none is given).

    Whole texts of ``max_rows`` rows, half of each class; of fewer where texts are so long that these
    would be more than ``max_bytes`` on average.
    """
    import zstandard as zs

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("y"))
    rows = rows.filter("id IS NOT NULL AND text <> '' AND y IN (0, 1)")
    found = rows.groupBy("y").agg(F.count("*").alias("n"), F.avg(F.octet_length("text")).alias("size")).collect()
    if not found:
        return Model(b"", b"", 0.0, 0.0, 0.5)
    seen = {r["y"]: r["n"] for r in found}
    share = seen.get(1, 0) / sum(seen.values()) if share is None else share
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    bound = {r["y"]: int((1 << 20) * min(1.0, min(max_rows, max_bytes / r["size"]) / 2 / r["n"])) for r in found}
    rows = rows.filter(spot < F.when(F.col("y") == 1, F.lit(bound.get(1, 0))).otherwise(F.lit(bound.get(0, 0))))
    got = sorted((r["id"], r["y"], r["text"].encode()) for r in rows.select("id", "y", "text").collect())
    books = {}
    for y in (0, 1):
        blocks = [t[a: a + BLOCK] for k, (_, v, t) in enumerate(got) if v == y and k % 2 == 0 for a in range(0, len(t), BLOCK)]
        try:
            books[y] = zs.train_dictionary(DICT_BYTES, blocks).as_bytes() if len(blocks) > 7 else b""
        except zs.ZstdError:
            joined = b"".join(blocks)[-DICT_BYTES:]
            books[y] = joined if len(joined) > 7 else b""
    model = Model(books[1], books[0], 0.0, 0.0, share)
    if books[0] and books[1]:
        own = [(y, t) for k, (_, y, t) in enumerate(got) if k % 2 == 1]
        off = np.concatenate([[0], np.cumsum([len(t) for _, t in own])]).astype(np.int64)
        x = differences(model, np.frombuffer(b"".join(t for _, t in own), np.uint8), off)
        y = np.array([v for v, _ in own], float)
        if len(set(y)) == 2:
            model.slope, model.offset = _fit(x, y)
            # The sample holds the classes evenly; move the curve to their true shares.
            here, share = y.mean(), min(max(share, 1e-3), 1 - 1e-3)
            model.offset += np.log(share / (1 - share)) - np.log(here / (1 - here))
        else:
            model.good = b""
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1, higher: better)."""
    import pyarrow as pa

    # Bytes and numbers: tasks need no copy of the package to read them.
    sent = df.sparkSession.sparkContext.broadcast((model.good, model.bad, model.slope, model.offset, model.share))

    def scored(batches):
        model = Model(*sent.value)
        for (ids,), data, off in bytetext.slices(batches, ["id"], "text"):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.curve(differences(model, data, off)), pa.float64())], [id_col, "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")
