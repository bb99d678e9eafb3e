"""What a stream's state holds and what a batch touches of it, on a state made of dicts."""

import numpy as np
import pandas as pd

from millrace.streaming import flow, stateful


class Map:
    def __init__(self):
        self.have, self.written = {}, []

    def containsKey(self, k):
        return k in self.have

    def getValue(self, k):
        return self.have[k]

    def updateValue(self, k, v):
        self.written.append((k, len(v[0])))
        self.have[k] = v

    def removeKey(self, k):
        del self.have[k]


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Handle:
    def __init__(self):
        self.map, self.value, self.timers = Map(), Value(), set()

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return self.value

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def processor(idle=3600.0, may_forget=lambda held: True):
    def fold(held, at, rid, v):
        total = (held[0] if held else 0.0) + v
        return [total], (rid, total)

    made = stateful._processor(fold, ["key", "id", "total"], idle, may_forget, 60)
    handle = Handle()
    made.init(handle)
    return made, handle


def batch(seconds, ids):
    return pd.DataFrame({"k": "a", "t": pd.to_datetime(np.asarray(seconds) * 1_000_000, unit="us"), "i": ids, "v": 1.0})


def pass_to(made, handle, seconds):
    """All timers up to a watermark, in order."""
    rows = []
    while any(t <= seconds * 1000 for t in handle.timers):
        first = min(handle.timers)
        handle.timers.discard(first)
        for pdf in made.handleExpiredTimer(("a",), None, Expired(first)):
            rows += pdf.values.tolist()
    return rows


def test_a_batch_touches_only_its_buckets():
    made, handle = processor()
    n = 100_000
    seconds = np.random.default_rng(1).integers(0, 200 * 60, n)
    list(made.handleInputRows(("a",), iter([batch(seconds, range(n))]), None))
    assert len(handle.map.have) == 200 and len(handle.map.written) == 200
    handle.map.written.clear()
    list(made.handleInputRows(("a",), iter([batch([61], [n]), batch([62], [n + 1])]), None))
    assert [k for k, _ in handle.map.written] == [(1,)] and handle.map.written[0][1] < n / 100
    got = pass_to(made, handle, 120)
    assert set(handle.map.have) == {(b,) for b in range(2, 200)}
    every = sorted([(s, i) for i, s in enumerate(seconds.tolist())] + [(61, n), (62, n + 1)])
    assert [r[1] for r in got] == [i for s, i in every if s < 120]
    assert [r[2] for r in got] == list(range(1, len(got) + 1))


def test_idle_keys_are_forgotten_unless_kept():
    for keep in (False, True):
        made, handle = processor(idle=600, may_forget=lambda held, keep=keep: not keep)
        list(made.handleInputRows(("a",), iter([batch([10], [1])]), None))
        assert len(pass_to(made, handle, 60)) == 1 and handle.value.exists()
        list(made.handleInputRows(("a",), iter([batch([500], [2])]), None))
        pass_to(made, handle, 700)
        # The timer of the first row was moved on by the second one.
        assert handle.value.exists() and len(handle.timers) == 1
        pass_to(made, handle, 540 + 601)
        assert handle.value.exists() == keep and not handle.map.have


def lane_batch(keys, seconds, ids, values):
    return pd.DataFrame({"lane": 7, "k": keys, "t": pd.to_datetime(np.asarray(seconds) * 1_000_000, unit="us"), "i": ids, "v": values})


def test_calls_follow_buckets_and_not_keys():
    made, handle = processor()
    rnd, n = np.random.default_rng(2), 20_000
    keys = [None if k == 0 else f"u{k}" for k in rnd.integers(0, 4000, n).tolist()]
    seconds, values = rnd.integers(0, 20 * 60, n).tolist(), rnd.integers(0, 9, n).astype(float).tolist()
    for half in (slice(0, n // 2), slice(n // 2, n)):
        frames = [lane_batch(keys[half][i:i + 900], seconds[half][i:i + 900], range(half.start + i, half.start + min(i + 900, n // 2)), values[half][i:i + 900])
                  for i in range(0, n // 2, 900)]
        list(made.handleInputRows((7,), iter(frames), None))
    # Two batches, each writes an entry for a bucket.
    assert len(handle.map.written) == 2 * 20 and len(handle.timers) == 20
    want, total = {}, {}
    for i in sorted(range(n), key=lambda i: (seconds[i], i)):
        total[keys[i]] = total.get(keys[i], 0.0) + values[i]
        want[i] = (keys[i], total[keys[i]])
    got = pass_to(made, handle, 20 * 60)
    assert {i: (k, t) for k, i, t in got} == want and len(got) == n


def test_idle_keys_of_a_lane_start_anew_while_others_go_on():
    made, handle = processor(idle=600)
    steps = list(range(10, 2000, 100))
    list(made.handleInputRows((7,), iter([lane_batch(["on"] * len(steps), steps, range(len(steps)), 1.0),
                                          lane_batch(["off"] * 3, [20, 620, 1900], [100, 101, 102], 1.0)]), None))
    # Timers of idle keys may be late: what counts is the time of the rows.
    late = [t for t in sorted(handle.timers) if t <= 2_100_000]
    rows = [r for t in late for pdf in made.handleExpiredTimer((7,), None, Expired(t)) for r in pdf.values.tolist()]
    assert [r[2] for r in rows if r[0] == "off"] == [1.0, 2.0, 1.0]
    assert [r[2] for r in rows if r[0] == "on"] == list(range(1, len(steps) + 1))
    pass_to(made, handle, 4000)
    assert not handle.value.exists() and not handle.map.have and not handle.timers


def test_keys_beyond_doubles_and_null_keys_come_back(spark, tmp_path):
    rows = [(None if k == 0 else 2 ** 60 + k, 3 * k + i, 1_700_000_000 + 86400 * i) for k in range(6) for i in range(3)]
    rows.append((None, -1, 1_700_000_000 + 86400 * 900))
    df = spark.createDataFrame(rows, "user long, id long, sec long").selectExpr("user", "id", "timestamp_seconds(sec) AS ts")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = flow.drain(stateful.rate_limit(stream, "user", "ts", "id", 1, 2 * 86400 - 1, "200 days"))
    assert out.schema["user"].dataType == df.schema["user"].dataType
    assert {tuple(r) for r in out.collect()} == {(u, i, (i % 3) != 1) for u, i, _ in rows if i >= 0}
