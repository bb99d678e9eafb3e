"""Per-key state over streams, in event time: rate limits, running means, alert episodes.

Rows wait in their key's state until the watermark has passed them, and are then
folded in order of time and row id. So the result does not depend on the order of
files or on how rows fall into micro-batches; rows that come later than ``delay``
behind the newest one are dropped (and counted by Spark).

Keys share ``LANES`` lanes by their hash, so that a batch costs calls per lane and not
per key or row. The waiting rows of a lane lie in buckets of event time, a ``SHARE``-th of the delay
long but ``BUCKET`` seconds at least, one entry of a map state each, packed as Arrow. A batch
touches the buckets its rows fall into and no others; a timer at the end of each bucket
folds it when the watermark gets there. What a lane holds is the rows of the last
``delay`` and a few numbers a key. A key without rows for ``idle`` seconds of event time starts anew
at its next row, and a timer drops its numbers.

The newest ``delay`` of a stream that has ended stays in the state; a later row, of
any key, lets it out. State is kept by RocksDB, which the map state needs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .windows import late

MONTH = 30 * 86400.0
#: The least seconds of event time whose rows of a lane are one entry of the state.
BUCKET = 60
#: A delay has at most so many buckets.
SHARE = 256
#: Lanes the keys are dealt over; a checkpoint goes with its number of lanes.
LANES = 128
#: Rows packed at a time, and packs of a bucket before they are made one.
BLOCK, PACKS = 100_000, 32
#: A fold takes the key's numbers and one row (microseconds, row id, value), and
#: returns the numbers and an output row, or None.
Fold = Callable[[list, int, int, float], tuple[list, tuple | None]]
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_ROWS = pa.schema([("key", pa.string()), ("at", pa.int64()), ("id", pa.int64()), ("value", pa.float64())])


def _pack(columns) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=True) for f in _ROWS], schema=_ROWS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ROWS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(packs: list[bytes]) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(p).read_all() for p in packs)


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in frames of at least ``BLOCK`` rows, but the last; times in microseconds."""
    have, n = [], 0
    for pdf in frames:
        # By place: the optimizer may name columns as their sources.
        pdf = pdf.iloc[:, -4:].set_axis(["key", "at", "id", "value"], axis=1)
        have.append(pdf.assign(at=pdf["at"].astype("datetime64[us]").astype("int64")))
        n += len(pdf)
        if n >= BLOCK:
            yield pd.concat(have)
            have, n = [], 0
    if have:
        yield pd.concat(have)


def _processor(fold: Fold, names: list[str], idle: float, may_forget: Callable[[list], bool], bucket: int):
    """The processor of one operator, for the keys of a lane. A class made here travels with its code."""
    width, gap = bucket * 1_000_000, int(idle * 1_000_000)

    class InTimeOrder(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "bucket long", "packs array<binary>")
            # For each key its numbers and the time of its last row; and when to look for idle keys.
            self.held = handle.getValueState("held", "keys binary, look long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            new: dict[int, list[bytes]] = {}
            for block in _blocks(rows):
                for b, part in block.groupby(block["at"] // width):
                    new.setdefault(int(b), []).append(_pack(part))
            for b, packs in new.items():
                if self.waiting.containsKey((b,)):
                    packs = [bytes(p) for p in self.waiting.getValue((b,))[0]] + packs
                else:
                    # The first instant at which no row of the bucket can come any more.
                    self.handle.registerTimer((b + 1) * bucket * 1000)
                if len(packs) > PACKS:
                    packs = [_pack(_unpack(packs))]
                self.waiting.updateValue((b,), (packs,))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            b, inside = divmod(now, bucket * 1000)
            known, look, out = {}, 0, []
            if self.held.exists():
                kept = self.held.get()
                known, look = pickle.loads(bytes(kept[0])), kept[1]
            if not inside and self.waiting.containsKey((b - 1,)):
                rows = _unpack([bytes(p) for p in self.waiting.getValue((b - 1,))[0]])
                self.waiting.removeKey((b - 1,))
                rows = rows.take(np.lexsort((rows["id"].to_numpy(), rows["at"].to_numpy())))
                for k, at, rid, value in zip(*(rows[f.name].to_pylist() for f in _ROWS)):
                    numbers, last = known.get(k, ([], at))
                    if at - last > gap and may_forget(numbers):
                        numbers = []
                    numbers, row = fold(numbers, at, rid, value)
                    known[k] = numbers, at
                    if row is not None:
                        out.append((k, *row))
            elif now == look:
                # Rows to come are no older than the bucket that this time lies in.
                known, look = {k: (n, last) for k, (n, last) in known.items() if last + gap >= b * width or not may_forget(n)}, 0
            else:
                return
            ends = [last + gap for _, last in known.values() if last + gap >= b * width] if not look else []
            if ends:
                # Inside a bucket, never at its end.
                look = (min(ends) // width + 1) * bucket * 1000 + 1
                self.handle.registerTimer(look)
            if known:
                self.held.update((pickle.dumps(known), look))
            else:
                self.held.clear()
            if out:
                yield pd.DataFrame(out, columns=names)

        def close(self) -> None:
            pass

    return InTimeOrder()


def _seconds(spark, interval: str) -> int:
    return spark.sql(f"SELECT unix_seconds(timestamp_seconds(0) + INTERVAL {interval})").first()[0]


def _in_time_order(df: DataFrame, key: str, ts: str, row_id: str, value, fold: Fold, fields: list[tuple[str, str]],
                   delay: str, idle: float, may_forget: Callable[[list], bool] = lambda held: True, bucket: int | None = None) -> DataFrame:
    names = [key, *[n for n, _ in fields]]
    df.sparkSession.conf.set(_STORE, _ROCKS)
    kind = df.schema[key].dataType
    bucket = bucket or max(BUCKET, _seconds(df.sparkSession, delay) // SHARE)
    # Keys travel as text: integers with nulls would become doubles.
    rows = late(df, ts, delay).select(
        F.pmod(F.xxhash64(key), F.lit(LANES)).alias("_lane"), F.col(key).cast("string").alias(key), ts,
        F.col(row_id).cast("long").alias(row_id), value.alias("_value"))
    out = rows.groupBy("_lane").transformWithStateInPandas(
        _processor(fold, names, idle, may_forget, bucket),
        f"`{key}` string, " + ", ".join(f"`{n}` {t}" for n, t in fields), "Append", "EventTime")
    return out.withColumn(key, F.col(key).cast(kind))


def rate_limit(df: DataFrame, user: str, ts: str, row_id: str, limit: int = 100, seconds: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """Accept a request when fewer than ``limit`` were accepted in the last ``seconds``, else refuse it."""
    window = int(seconds * 1_000_000)

    def fold(held, at, rid, _):
        accepted = [a for a in held if at - a < window]
        ok = len(accepted) < limit
        return (accepted + [float(at)] if ok else accepted), (rid, ok)

    return _in_time_order(df, user, ts, row_id, F.lit(0.0), fold, [(row_id, "long"), ("accepted", "boolean")], delay, seconds)


def ema(df: DataFrame, key: str, ts: str, row_id: str, value: str, alpha: float = 0.1, delay: str = "10 minutes", idle: float = MONTH) -> DataFrame:
    """Running mean and variance per point with the spread and slowness flags; null values are skipped."""

    def fold(held, _, rid, v):
        if v is None or v != v:
            return held, None
        mean, var, count = held or (0.0, 0.0, 0.0)
        if count == 0:
            mean, var = v, 0.0
        else:
            gap = v - mean
            mean, var = alpha * v + (1 - alpha) * mean, (1 - alpha) * var + alpha * gap * gap
        count += 1
        z = abs(v - mean) / var ** 0.5 if count >= 10 and var > 0 else None
        level = None if z is None or z <= 3 else "high" if z > 4 else "medium"
        return [mean, var, count], (rid, mean, var, int(count), z, level, count > 1 and v > mean * 1.5)

    fields = [(row_id, "long"), ("mean", "double"), ("variance", "double"), ("count", "long"), ("z_score", "double"), ("severity", "string"),
              ("degraded", "boolean")]
    return _in_time_order(df, key, ts, row_id, F.col(value).cast("double"), fold, fields, delay, idle)


def episodes(df: DataFrame, key: str, ts: str, row_id: str, value: str, above: float, delay: str = "10 minutes", idle: float = MONTH) -> DataFrame:
    """Alert episodes: opened by the first value above the limit, counted, given out when a good value closes them.

    Null values neither open nor close one. A key with an open episode is not forgotten.
    """

    def fold(held, at, _, v):
        opened, last, count = held or (0.0, 0.0, 0.0)
        if v is None or v != v:
            return held, None
        if v > above:
            return ([at, at, 1.0] if count == 0 else [opened, at, count + 1]), None
        done = (int(opened), int(last), int(count), at) if count else None
        return [0.0, 0.0, 0.0], done

    fields = [("opened_us", "long"), ("last_us", "long"), ("trigger_count", "long"), ("resolved_us", "long")]
    return _in_time_order(df, key, ts, row_id, F.col(value).cast("double"), fold, fields, delay, idle, lambda held: not held or held[2] == 0)
