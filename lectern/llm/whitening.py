"""Whitening of embeddings by an incremental eigendecomposition (operator 13).

Entries become whole numbers floor(1024 c) + 100000; counts and sums are exact, and every vector is centred by the
exact mean before anything is multiplied. Each partition then keeps a spectrum, the count, mean, eigenvalues and
eigenvectors of what it has seen, and a vector changes it by one centred rank-one update: the new eigenvalues are
the roots of a secular equation between the old ones, components that the update does not touch are deflated,
and so are all but one of equal eigenvalues. Spectra meet in a tree, one taking the other's components and the
difference of means as successive rank-one updates. Rounding gathers over many updates, so the last basis is made
orthonormal and refined by Rayleigh and Ritz: one pass sums the covariance within it, whose own eigenvectors
turn it into the exact one. A last pass measures the covariance of the whitened vectors themselves.

What a task or the driver holds is a few matrices of dimensions squared, whatever the number of vectors.

Nulls and edge cases: vectors that are null or hold null or non-finite entries take no part, nor do those with
entries beyond 2^42, which have no such whole number in double precision, empty ones, and those not of the commonest
length (of equally common ones the least). A null vec_id is kept; equal rows each count and return their own row.
Components whose variance is zero, of which a single vector has only such, cannot be whitened and are left out.
deviation is null where it is beyond a long. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, OFFSET = 1024, 100_000
_LARGEST = 2.0**42
_EPS = np.finfo(float).eps
#: Spectra that meet in one task of the tree.
FAN_IN = 8


def vectors_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_ids and whole numbers (rows x length) of the vectors of a batch that take part, by length."""
    lists = batch.column("embedding")
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float)  # null entries become NaN
    with np.errstate(invalid="ignore"):
        good = np.isfinite(values) & (np.abs(values) <= _LARGEST)
    starts = np.concatenate([[0], np.cumsum(length)])
    wrong = np.concatenate([[0], np.cumsum(~good)])
    fits = (length > 0) & (wrong[starts[1:]] == wrong[starts[:-1]])
    for d in np.unique(length[fits]):
        rows = np.flatnonzero(fits & (length == d))
        x = values[starts[rows][:, None] + np.arange(d)]
        yield batch.column("vec_id").take(pa.array(rows)), np.floor(SCALE * x).astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: whole numbers of 64 bits, or Python's where they would not do."""
    if x.size and n * int(np.abs(x).max()) + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int | None]:
    """Sums of squares, exactly."""
    if d.dtype != object and d.size and d.shape[1] * int(np.abs(d).max()) ** 2 < 2**63:
        return (d * d).sum(1).tolist()
    sums = (d.astype(object) ** 2).sum(1).tolist()
    return [s if s < 2**63 else None for s in sums]


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """gaps[i, j] = d_i - root_j for the roots of 1 + rho sum z_i^2 / (d_i - root) = 0, of which one lies above each
    of the ascending d. Each is sought as its distance from the nearer pole, so that no digits are lost."""
    k, zz = len(d), rho * z * z
    top = zz.sum()
    nxt = np.append(d[1:], d[-1] + top)
    gap = nxt - d
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        at_middle = 1 + (zz[:, None] / (d[:, None] - (d + gap / 2))).sum(0)
    left = at_middle >= 0
    left[-1] = True
    delta = start = d[:, None] - np.where(left, d, nxt)
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[-1] = top
    tau = (low + high) / 2
    own = np.arange(k)
    other = np.minimum(own + 1, k - 1)
    under = np.where(own[:, None] <= own, zz[:, None], 0)
    for _ in range(60):
        # Only roots that are still sought.
        r = delta - tau[own]
        with np.errstate(all="ignore"):
            inverse = 1 / r
            squares = inverse * inverse
            f, slope, size = 1 + zz @ inverse, zz @ squares, 1 + zz @ np.abs(inverse)
            t = tau[own]
            low[own], high[own] = np.where(f <= 0, t, low[own]), np.where(f >= 0, t, high[own])
            lo, hi = low[own], high[own]
            more = (np.abs(f) > 64 * _EPS * size) & (hi - lo > 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if not more.any():
                break
            # The function as a constant and the two nearest poles, with the slopes of either side; one pole for the last.
            at = np.arange(len(own))
            a, b = r[own, at], r[other[own], at]
            psi = np.einsum("ij,ij->j", under, squares)
            c = f - a * psi - b * (slope - psi)
            p = (a + b) * f - a * b * slope
            root = np.sqrt(np.maximum(p * p - 4 * a * b * f * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * a * b * f / (p + root))
            step = np.where(own == k - 1, a + a * a * slope / (f - a * slope), step)
            new = t + step
        inside = np.isfinite(new) & (new > lo) & (new < hi)
        tau[own] = np.where(more, np.where(inside, new, (lo + hi) / 2), t)
        own, under, delta = own[more], under[:, more], delta[:, more]
    return start - tau


def rank_one(values: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of q diag(values) q' + rho v v'."""
    z = q.T @ v
    size = z @ z
    if rho * size <= _EPS * _EPS * max(values[-1], 1e-300):
        return values, q
    z, rho = z / np.sqrt(size), rho * size
    least = 8 * _EPS * max(values[-1], rho)
    q = q.copy()
    # Equal eigenvalues: a reflection leaves one of their vectors to carry the update.
    close = np.diff(values) <= least
    if close.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]]).astype(int)))
        for a, b in zip(edges[::2], edges[1::2] + 1, strict=True):
            own = z[a:b].copy()
            own[-1] += np.copysign(np.linalg.norm(own), own[-1] or 1.0)
            if (length := own @ own) > 0:
                turn = np.outer(q[:, a:b] @ own, own) * (2 / length)
                q[:, a:b] -= turn
                z[a:b] -= own * (2 * (z[a:b] @ own) / length)
                z[a : b - 1] = 0
    live = np.flatnonzero(rho * np.abs(z) > least)
    if not len(live):
        return values, q
    d, y = values[live], z[live]
    gaps = secular_roots(d, y, rho)
    # The weights of which these roots are exact give orthogonal vectors.
    poles = d[None, :] - d[:, None]
    np.fill_diagonal(poles, 1.0)
    with np.errstate(all="ignore"):
        exact = np.sqrt(np.abs(np.prod(-gaps / poles, axis=1)))
        u = np.copysign(exact, y)[:, None] / gaps
    u /= np.linalg.norm(u, axis=0)
    if not np.isfinite(u).all():  # a pole met to the last digit
        h, u = np.linalg.eigh(np.diag(d) + rho * np.outer(y, y))
    else:
        h = d - np.diag(gaps)
    q[:, live] = q[:, live] @ u
    values = values.copy()
    values[live] = h
    order = np.argsort(values, kind="stable")
    return np.maximum(values[order], 0), q[:, order]


class Spectrum:
    """Count, mean and scatter of vectors, the scatter as eigenvalues and eigenvectors."""

    def __init__(self, dimensions: int):
        self.n, self.mean = 0, np.zeros(dimensions)
        self.values, self.q = np.zeros(dimensions), np.eye(dimensions)

    def add(self, y: np.ndarray, times: int = 1) -> None:
        off = y - self.mean
        self.values, self.q = rank_one(self.values, self.q, off, self.n * times / (self.n + times))
        self.n += times
        self.mean = self.mean + off * (times / self.n)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.q = other.n, other.mean, other.values, other.q
            return
        for value, vector in zip(other.values, other.q.T, strict=True):
            if value > 0:
                self.values, self.q = rank_one(self.values, self.q, vector, value)
        off, n = other.mean - self.mean, self.n + other.n
        self.values, self.q = rank_one(self.values, self.q, off, self.n * other.n / n)
        self.mean, self.n = self.mean + off * (other.n / n), n

    def row(self) -> list[float]:
        return np.concatenate([[self.n], self.mean, self.values, self.q.ravel()]).tolist()

    @classmethod
    def of(cls, row: np.ndarray, dimensions: int) -> Spectrum:
        self, d = cls(dimensions), dimensions
        self.n, self.mean, self.values, self.q = int(row[0]), row[1 : d + 1], row[d + 1 : 2 * d + 1], row[2 * d + 1 :].reshape(d, d)
        return self


_STATE = "slot long, state array<double>"


def _state(slot: int, state: list[float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([state], pa.list_(pa.float64()))], ["slot", "state"])


def _tree(states: DataFrame, combine: Callable[[list[np.ndarray]], list[float]], name: str) -> np.ndarray | None:
    """The states of all partitions combined, FAN_IN at a time."""
    states = materialize(states, name)
    top = states.agg(F.max("slot")).first()[0]
    if top is None:
        return None

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        ordered = table.sort_by("slot").column("state").to_pylist()
        return pa.Table.from_batches([_state(key[0].as_py(), combine([np.array(s) for s in ordered]))])

    while top > 0:
        states = states.withColumn("up", F.floor(F.col("slot") / FAN_IN)).groupBy("up").applyInArrow(meet, _STATE)
        top //= FAN_IN
    return np.array(states.first()["state"])


def _per_partition(vectors: DataFrame, dimensions: int, start: Callable[[], object], add: Callable, end: Callable) -> DataFrame:
    """A state for each partition that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = start(), False
        for batch in batches:
            for _, x in vectors_of(batch):
                if x.shape[1] == dimensions:
                    state, some = add(state, x), True
        if some:
            yield _state(TaskContext.get().partitionId(), end(state))

    return vectors.mapInArrow(run, _STATE)


def _moments(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors of the commonest length there are, and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, x in vectors_of(batch):
                d = x.shape[1]
                n, s = sums.get(d, (0, np.zeros(d, object)))
                fits = len(x) * int(np.abs(x).max()) < 2**62
                sums[d] = n + len(x), s + (x.sum(0).astype(object) if fits else x.astype(object).sum(0))
        for d, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))], ["length", "dimension", "n", "total"])

    summed = vectors.mapInArrow(run, "length int, dimension int, n long, total decimal(38,0)").groupBy("length", "dimension").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    summed = materialize(summed, "whiten-moments")
    best = summed.filter("dimension = 0").orderBy(F.desc("n"), "length").first()
    if best is None:
        return 0, []
    rows = summed.filter(F.col("length") == best["length"]).orderBy("dimension").collect()  # one for each dimension
    return best["n"], [int(r["total"]) for r in rows]


def spectrum(vectors: DataFrame, n: int, sums: list[int]) -> Spectrum | None:
    """The spectrum of all vectors about their mean, by rank-one updates in partitions and a tree of merges."""
    d = len(sums)

    def add(state: Spectrum, x: np.ndarray) -> Spectrum:
        rows, times = np.unique(x, axis=0, return_counts=True)  # equal vectors are one weighted update
        for y, k in zip(np.asarray(centred(rows, n, sums) / n, float), times.tolist(), strict=True):
            state.add(y, k)
        return state

    def combine(states: list[np.ndarray]) -> list[float]:
        first = Spectrum.of(states[0], d)
        for s in states[1:]:
            first.merge(Spectrum.of(s, d))
        return first.row()

    found = _tree(_per_partition(vectors, d, lambda: Spectrum(d), add, lambda s: s.row()), combine, "whiten-spectra")
    return None if found is None else Spectrum.of(found, d)


def _sum(states: list[np.ndarray]) -> list[float]:
    return np.sum(states, axis=0).tolist()


def refine(vectors: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: eigenvalues (falling) and eigenvectors of the covariance within an orthonormal basis."""
    d, k = basis.shape

    def add(state: np.ndarray, x: np.ndarray) -> np.ndarray:
        y = np.asarray(centred(x, n, sums) / n, float) @ basis
        return state + y.T @ y

    total = _tree(_per_partition(vectors, d, lambda: np.zeros((k, k)), add, lambda s: s.ravel().tolist()), _sum, "whiten-ritz")
    values, turned = np.linalg.eigh(total.reshape(k, k) / n)
    return values[::-1], basis @ turned[:, ::-1]


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and
    each of the first components."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    n, sums = _moments(vectors)
    found = spectrum(vectors, n, sums) if n else None
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = len(sums)
    values, axes = refine(vectors, n, sums, np.linalg.qr(found.q)[0])
    trace = float(np.maximum(values, 0).sum())
    kept = int((values[:components] > d * _EPS * trace).sum())
    axes, values = axes[:, :kept], values[:kept]
    scales = 1 / np.sqrt(values)

    def whitened(c: np.ndarray) -> np.ndarray:
        return (np.asarray(c / n, float) @ axes) * scales

    def add(state: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = whitened(centred(x, n, sums))
        return state + np.vstack([w.sum(0), w.T @ w])

    if not kept:
        return vectors.sparkSession.createDataFrame([], schema)
    moments = _tree(_per_partition(vectors, d, lambda: np.zeros((kept + 1, kept)), add, lambda s: s.ravel().tolist()), _sum, "whiten-error").reshape(kept + 1, kept) / n
    error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(kept)).max())
    explained = values / trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in vectors_of(batch):
                if x.shape[1] != d:
                    continue
                c, m = centred(x, n, sums), len(x)
                each = np.repeat(np.arange(m), kept)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n, np.int64)), pa.array(deviations(c), pa.int64()).take(pa.array(each)),
                     pa.array(whitened(c).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(rows, schema)
