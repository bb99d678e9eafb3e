"""Embedding whitening by incremental eigendecomposition.

1. ``whole_numbers``: vectors whose entries all are finite, as whole numbers
   floor(``SCALE`` * c). ``distinct`` is the fit list: every different vector once.
2. ``spectrum``: each partition starts from nothing and takes its vectors one by one. A
   vector adds a rank-one term, centred on the mean so far, to the scatter matrix; the
   eigenvalues after it are the roots of a secular equation, solved for all at once
   between their poles, after deflation of components that the term does not touch and
   of equal eigenvalues (``Spectrum.add``). Spectra of partitions are combined in a
   tree, each by one rank-one update per eigenpair and one for the means' difference.
3. ``refined``: a Rayleigh-Ritz step over all distinct vectors: partitions project their
   centred vectors on the basis and add up the products, and the eigenvectors of that
   small matrix turn the basis. Errors of the updates do not stay in the result.
4. ``whiten``: all rows projected on the leading components, over the root of the eigenvalue.

Memory: a task holds one spectrum of d x d numbers and one batch; the driver holds one.

Rows whose vector is null, empty, or has null or non-finite entries are left out. So are vectors of
another length than the most frequent one (of equally frequent ones the longest), as
they lie in another space. Equal vectors count once in the fit, and every row has its own
result. Null and repeated ids are ids like any other; other columns are not read. A component without
variance has null ``whitened`` and ``explained`` 0 and takes no part in ``identity_error``.
``deviation`` is null where it exceeds a long. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept, partitions

SCALE = 256
COMPONENTS = 4
FAN_IN = 8
_EPS = np.finfo(float).eps


def _roots(pole: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Matrix of pole[j] - root[i] for the roots of 1 + sum(weight / (pole - x)) = 0.

    ``pole`` rises strictly and ``weight`` is positive: there is one root above each
    pole and below the next. A root is kept as its distance from the nearer pole, and
    improved by the root of a function that fits both neighbouring poles; steps that
    leave the bracket are replaced by halving it.
    """
    k = len(pole)
    here = np.arange(k)
    width = np.append(np.diff(pole), weight.sum())
    gap = pole[None, :] - pole[:, None]
    low = here[None, :] <= here[:, None]
    # The pole nearer to the root, by the sign halfway.
    half = 1 + (weight / (gap - (width / 2)[:, None])).sum(1)
    upper = (half < 0) & (here < k - 1)
    origin = np.where(upper, here + 1, here)
    gap = pole[None, :] - pole[origin][:, None]
    a = np.where(upper, -width / 2, 0.0)
    b = np.where(upper, 0.0, np.where((half < 0), width, width / 2))
    a = np.where(~upper & (half < 0), width / 2, a)
    x = (a + b) / 2
    ahead = np.minimum(here + 1, k - 1)
    for _ in range(80):
        away = gap - x[:, None]
        term = weight / away
        steep = term / away
        f = 1 + term.sum(1)
        b, a = np.where(f > 0, x, b), np.where(f > 0, a, x)
        bound = 8 * _EPS * (1 + np.abs(term).sum(1))
        done = (np.abs(f) <= bound) | (b - a <= 2 * _EPS * np.minimum(np.abs(a), np.abs(b)))
        if done.all():
            break
        left, right = away[here, here], np.where(here < k - 1, away[here, ahead], 1.0)
        d_low = (steep * low).sum(1)
        d_high = np.where(here < k - 1, steep.sum(1) - d_low, 0.0)
        s, t = left * left * d_low, right * right * d_high
        c = f - left * d_low - right * d_high
        with np.errstate(all="ignore"):
            p = c * (left + right) + s + t
            q = left * right * f
            root = np.sqrt(np.abs(p * p - 4 * c * q))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            last = left + s / c
        step = np.where(here < k - 1, step, last)
        new = x + step
        good = np.isfinite(new) & (new > a) & (new < b)
        x = np.where(done, x, np.where(good, new, (a + b) / 2))
    return gap - x[:, None]


class Spectrum:
    """Count, mean and eigenpairs of the scatter matrix (sum of centred outer products)."""

    def __init__(self, d: int):
        self.n, self.mean = 0, np.zeros(d)
        self.values, self.vectors = np.zeros(d), np.eye(d)

    def add(self, v: np.ndarray) -> None:
        """One more vector: its centred rank-one term, then the mean."""
        away = v - self.mean
        self.n += 1
        self.mean += away / self.n
        if self.n > 1:
            self._rank_one(away * math.sqrt((self.n - 1) / self.n))

    def combine(self, other: Spectrum) -> None:
        """The spectrum of both sets of vectors."""
        if not other.n:
            return
        away, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._rank_one(math.sqrt(value) * vector)
        if self.n:
            self._rank_one(away * math.sqrt(self.n * other.n / n))
        self.mean += away * (other.n / n)
        self.n = n

    def _rank_one(self, u: np.ndarray) -> None:
        """Eigenpairs of values, vectors plus the outer product of ``u``."""
        z = u @ self.vectors
        size = float(z @ z)
        if not size > 0:
            return
        scale = max(self.values[-1], size)
        tiny = 8 * _EPS * scale
        # Deflation 1: components that the term hardly touches.
        z = np.where(z * z + np.abs(z) * math.sqrt(size) <= tiny, 0.0, z)
        # Deflation 2: equal values; their share of the term is turned into one of them.
        live = np.flatnonzero(z)
        near = np.flatnonzero(np.diff(self.values[live]) * np.abs(z[live[1:]] * z[live[:-1]]) <= tiny * (z[live[1:]] ** 2 + z[live[:-1]] ** 2))
        for at in near:
            i, j = live[at], live[at + 1]
            r = math.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if (self.values[j] - self.values[i]) * abs(c * s) > tiny:
                continue
            one, two = self.vectors[:, i].copy(), self.vectors[:, j]
            self.vectors[:, i], self.vectors[:, j] = c * one - s * two, s * one + c * two
            lo, hi = self.values[i], self.values[j]
            self.values[i], self.values[j] = c * c * lo + s * s * hi, s * s * lo + c * c * hi
            z[i], z[j] = 0.0, r
        live = np.flatnonzero(z)
        pole = self.values[live]
        # Turning may leave equal or crossed neighbours by rounding; poles must rise.
        order = np.argsort(pole, kind="stable")
        live, pole = live[order], pole[order]
        pole = np.maximum.accumulate(pole)
        same = np.flatnonzero(np.diff(pole) <= 0)
        for k in same:
            pole[k + 1] = np.nextafter(pole[k], np.inf) if pole[k + 1] <= pole[k] else pole[k + 1]
        away = _roots(pole, z[live] ** 2)
        # The term for which these roots are exact, so that the new vectors are orthogonal.
        ratio = away / (pole[None, :] - pole[:, None] + np.eye(len(pole)))
        fitted = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z[live])
        turn = fitted / away
        turn /= np.sqrt((turn * turn).sum(1))[:, None]
        self.vectors[:, live] = self.vectors[:, live] @ turn.T
        self.values[live] = pole - np.diagonal(away)
        order = np.argsort(self.values, kind="stable")
        if (order[1:] < order[:-1]).any():
            self.values, self.vectors = self.values[order], np.ascontiguousarray(self.vectors[:, order])

    def dump(self) -> bytes:
        return np.concatenate([[float(self.n)], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @staticmethod
    def load(raw: bytes, d: int) -> Spectrum:
        x, out = np.frombuffer(raw, float), Spectrum(d)
        out.n, out.mean, out.values = int(x[0]), x[1: d + 1].copy(), x[d + 1: 2 * d + 1].copy()
        out.vectors = x[2 * d + 1:].reshape(d, d).copy()
        return out


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x) of the usable rows; x is an array of longs."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = df.select(F.col(id_col).alias("id"), entries.alias("v"))
    fine = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    return fine.select("id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def distinct(rows: DataFrame) -> DataFrame:
    """Every different x once; equal ones are combined before the shuffle."""
    return rows.select("x").distinct()


def _matrices(batches, d: int):
    """The vectors of Arrow batches as matrices of longs."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows:
            yield batch, pc.list_flatten(batch.column(batch.schema.get_field_index("x"))).to_numpy(zero_copy_only=False).reshape(-1, d)


def _tree(states: DataFrame, merged) -> bytes | None:
    """The state of many (part, state), merged ``FAN_IN`` at a time, as deep as the number of tasks asks."""
    import pandas as pd

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN_IN], "state": [merged(pdf.sort_values("part")["state"].tolist())]})

    n = partitions(states.sparkSession)
    while n > FAN_IN:
        states = states.groupBy(F.floor(F.col("part") / FAN_IN).alias("_g")).applyInPandas(step, "part long, state binary")
        n = -(-n // FAN_IN)
    found = states.groupBy(F.lit(0).alias("_g")).applyInPandas(step, "part long, state binary").collect()
    return found[0]["state"] if found else None


def _states(fit: DataFrame, d: int, of) -> DataFrame:
    """(part, state) of every task with vectors; ``of`` turns its matrices into one state.

    Tasks are as many as shuffle partitions: the vectors are few bytes, but each of them costs an update.
    """
    import pyarrow as pa

    def rows(batches):
        from pyspark import TaskContext

        state = of(x for _, x in _matrices(batches, d))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state], pa.binary())], ["part", "state"])

    spread = fit.select("x").repartition(partitions(fit.sparkSession), F.xxhash64("x"))
    return spread.mapInArrow(rows, "part long, state binary")


def spectrum(fit: DataFrame, d: int) -> Spectrum:
    """Eigenpairs of the scatter matrix of ``fit``."""

    def one(matrices):
        own = Spectrum(d)
        for x in matrices:
            for v in x.astype(float):
                own.add(v)
        return own.dump() if own.n else None

    def merged(states):
        first, *rest = [Spectrum.load(s, d) for s in states]
        for s in rest:
            first.combine(s)
        return first.dump()

    found = _tree(_states(fit, d, one), merged)
    return Spectrum.load(found, d) if found else Spectrum(d)


def _products(fit: DataFrame, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the centred vectors, projected on ``basis``."""
    d, k = basis.shape
    sent = fit.sparkSession.sparkContext.broadcast((centre.tobytes(), basis.tobytes()))

    def one(matrices):
        mid, on = np.frombuffer(sent.value[0]), np.frombuffer(sent.value[1]).reshape(d, k)
        total = None
        for x in matrices:
            y = (x - mid) @ on
            total = y.T @ y if total is None else total + y.T @ y
        return None if total is None else total.tobytes()

    def merged(states):
        return np.sum([np.frombuffer(s) for s in states], axis=0).tobytes()

    found = _tree(_states(fit, d, one), merged)
    return np.frombuffer(found).reshape(k, k) if found else np.zeros((k, k))


def refined(fit: DataFrame, n: int, centre: np.ndarray, rough: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the covariance, falling, by a Rayleigh-Ritz step."""
    basis, _ = np.linalg.qr(rough.vectors[:, ::-1])
    small = _products(fit, centre, basis) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    vectors = basis @ turn[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[::-1], vectors * np.where(sign == 0, 1.0, sign)


class Fit:
    """Rows, sums, eigenvalues and eigenvectors (falling) of the fit list. Eigenvalues that
    are rounding of zero are zero. ``error`` is the largest deviation of the
    whitened list's covariance from the identity, None without variance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.vectors, self.error = n, sums, vectors, None
        self.centre = np.array([s / n for s in sums]) if n else np.zeros(len(sums))
        floor = _EPS * len(sums) * max(values[0], _EPS * float(np.square(self.centre).sum()))
        self.values = np.where(values > floor, values, 0.0)


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Fit:
    """``rows``: id, x, all of length ``d``."""
    vectors = kept(distinct(rows), "vectors")
    n, sums = _sums(vectors, d)
    if not n:
        return Fit(0, sums, np.zeros(d), np.eye(d))
    centre = Fit(n, sums, np.zeros(d), np.eye(d)).centre
    model = Fit(n, sums, *refined(vectors, n, centre, spectrum(vectors, d)))
    some = np.flatnonzero(model.values[:components])
    if len(some):
        cov = _products(vectors, centre, model.vectors[:, some] / np.sqrt(model.values[some])) / n
        model.error = float(np.abs(cov - np.eye(len(some))).max())
    return model


def _sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, sum per dimension), exact."""
    import pyarrow as pa

    def rows(batches):
        n, total = 0, [0] * d
        for _, x in _matrices(batches, d):
            # Halves of the numbers add up without overflow.
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            n, total = n + len(x), [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high, low)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], ["n", "dim", "total"])

    parts = vectors.select("x").mapInArrow(rows, "n long, dim int, total string")
    got = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (got[0]["n"], [int(r["total"]) for r in got]) if got else (0, [0] * d)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    most = n * float(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * x.shape[1] < 2.0 ** 62:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, d: int, model: Fit, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    import pyarrow as pa

    k = min(components, d)
    total = float(model.values.sum())
    lead = model.values[:k]
    explained = [float(v / total) if total > 0 else 0.0 for v in lead]
    on = model.vectors[:, :k] / np.sqrt(np.where(lead > 0, lead, 1.0))
    real, n, sums, error = (lead > 0).tolist(), model.n, model.sums, model.error
    sent = rows.sparkSession.sparkContext.broadcast((model.centre.tobytes(), np.ascontiguousarray(on).tobytes()))

    def projected(batches):
        mid, onto = np.frombuffer(sent.value[0]), np.frombuffer(sent.value[1]).reshape(d, k)
        for batch, x in _matrices(batches, d):
            y, m = (x - mid) @ onto, len(x)
            white = pa.array([v if ok else None for row in y.tolist() for v, ok in zip(row, real)], pa.float64())
            own = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(own), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(own), white, pa.array(np.tile(explained, m)), pa.array([error] * (m * k), pa.float64())],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(
        projected, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and leading component: id, component, n, deviation, whitened, explained, identity_error."""
    usable = whole_numbers(df, id_col, vector)
    widths = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    d = widths["d"] if widths else 1
    rows = usable.filter(F.size("x") == d)
    return whiten(rows, d, fit(rows, d, components), components).withColumnRenamed("id", id_col)
