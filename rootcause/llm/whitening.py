"""Whitening of vectors by their leading principal components.

Entries are whole numbers x = floor(scale * entry) + shift, so that sums are
exact. Three passes with partial sums in every task: the sums of each
dimension; the covariance, centred before it is multiplied; and the covariance
of what came out. Between them the driver holds matrices of the dimension,
whatever the number of vectors: Householder reflections make the covariance
tridiagonal, Sturm counts bisect its leading eigenvalues, inverse iteration
finds their vectors, made orthogonal again within clusters of near eigenvalues,
and the reflections take them back. The projection goes out with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.llm.tables import map_batches

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on (scaled) are no exact whole numbers as doubles.
LARGEST = float(1 << 52)
#: Components with less than this share of the largest eigenvalue are rounding.
RANK = 1e-12
EPS = np.finfo(np.float64).eps


# -- symmetric eigenvectors -------------------------------------------------

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix.

    Reflector k is a unit vector u of the last d - k - 1 dimensions; the matrix
    is Q T Q' with Q the product of all I - 2 u u'.
    """
    a, reflectors = np.array(v, np.float64), []
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        u = x
        if norm > 0:
            u[0] += norm if u[0] >= 0 else -norm
            u /= np.linalg.norm(u)
            block = a[k + 1:, k + 1:]
            p = block @ u
            w = 2 * (p - (u @ p) * u)
            block -= np.outer(u, w) + np.outer(w, u)
            a[k + 1:, k] -= 2 * (u @ a[k + 1:, k]) * u
            a[k, k + 1:] = a[k + 1:, k]
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues under each point: the negative pivots of T - x I."""
    tiny = np.finfo(np.float64).tiny / EPS
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diagonal[k] - at - off[k - 1] ** 2 / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until the ends meet."""
    d = len(diagonal)
    radius = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    low = np.full(k, (diagonal - radius).min())
    high = np.full(k, (diagonal + radius).max())
    pad = EPS * max(np.abs(low).max(), np.abs(high).max()) * d
    low, high = low - pad, high + pad
    rank = d - np.arange(k)  # eigenvalues up to and with the one looked for
    while True:
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        enough = count_below(diagonal, off, middle) >= rank
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)


def _solver(diagonal: np.ndarray, off: np.ndarray, at: float):
    """Solve (T - at I) x = b: elimination with row exchanges, pivots kept off zero."""
    d = len(diagonal)
    scale = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    least = EPS * scale
    steps, rows = [], []
    a, b, c = float(diagonal[0] - at), float(off[0]) if d > 1 else 0.0, 0.0
    for k in range(d - 1):
        below, mid, right = float(off[k]), float(diagonal[k + 1] - at), float(off[k + 1]) if k + 2 < d else 0.0
        swap = abs(below) > abs(a)
        if swap:
            a, b, c, below, mid, right = below, mid, right, a, b, c
        if abs(a) < least:
            a = least if a >= 0 else -least
        m = below / a
        steps.append((swap, m))
        rows.append((a, b, c))
        a, b, c = mid - m * b, right - m * c, 0.0
    rows.append((a if abs(a) >= least else (least if a >= 0 else -least), 0.0, 0.0))

    def solve(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for k, (swap, m) in enumerate(steps):
            if swap:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= m * x[k]
        for k in range(d - 1, -1, -1):
            a, b, c = rows[k]
            rest = (b * x[k + 1] if k + 1 < d else 0.0) + (c * x[k + 2] if k + 2 < d else 0.0)
            x[k] = (x[k] - rest) / a
            if abs(x[k]) > 1e150:
                x /= abs(x[k])
        return x
    return solve


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (as columns) of the given falling eigenvalues."""
    d, out = len(diagonal), np.zeros((len(diagonal), len(values)))
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    rng = np.random.default_rng(1)
    first, used = 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first, used = j, None
        # Equal eigenvalues are taken a little apart, or they give one vector.
        used = value if used is None else min(value, used - 4 * EPS * norm)
        solve = _solver(diagonal, off, used)
        x = rng.standard_normal(d)
        for _ in range(5):
            x = solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_eigenvectors(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix."""
    size = np.abs(v).max(initial=0.0)
    if size == 0:
        return np.zeros(min(k, len(v))), np.eye(len(v), min(k, len(v)))
    diagonal, off, reflectors = tridiagonal(v / size)
    values = leading_eigenvalues(diagonal, off, min(k, len(diagonal)))
    vectors = tridiagonal_vectors(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        u = reflectors[at]
        vectors[at + 1:] -= 2 * np.outer(u, u @ vectors[at + 1:])
    return values * size, vectors


# -- passes over the vectors ------------------------------------------------

def _usable(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their whole-number vectors of length d)."""
    col = batch["embedding"]
    lists = col.cast(pa.large_list(pa.float64()))
    sizes = np.where(lists.is_valid(), lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), -1)
    rows = np.flatnonzero(sizes == d)
    flat = lists.take(pa.array(rows)).flatten()
    whole = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), d)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = whole * SCALE
        ok = (np.abs(scaled) < LARGEST).all(1)
    return rows[ok], np.floor(scaled[ok]).astype(np.int64) + SHIFT


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for b in batches:
        for n in set(b["embedding"].value_lengths().drop_null().to_pylist()):
            if n:
                counts[n] = counts.get(n, 0) + len(_usable(b, n)[0])
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["d", "n"])


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * d, [0] * d
        for b in batches:
            _, x = _usable(b, d)
            n += len(x)
            # Halves of 32 bits: no sum of a batch can overflow.
            high = [s + int(t) for s, t in zip(high, (x >> 32).sum(0))]
            low = [s + int(t) for s, t in zip(low, (x & 0xFFFFFFFF).sum(0))]
        if n:
            total = [str((h << 32) + s) for h, s in zip(high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(total)], ["at", "n", "total"])
    return run


@dataclass(frozen=True)
class Mean:
    """n vectors' exact sums, as whole parts and remainders of the mean."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 of each row, exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        y = x - whole
        most = int(np.abs(y).max(initial=0)) * self.n + self.n
        if len(self.sums) * most * most < 1 << 63:
            return ((y * self.n - rest.astype(np.int64)) ** 2).sum(1).tolist()
        return [int(sum((v * self.n - r) ** 2 for v, r in zip(row, rest))) for row in y.astype(object).tolist()]


def _products(d: int, of_vectors):
    """A task's sums of products of what ``of_vectors`` makes of its vectors,
    upper triangle, with the plain sums in row -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = plain = None
        for b in batches:
            y = of_vectors(_usable(b, d)[1])
            total = y.T @ y if total is None else total + y.T @ y
            plain = y.sum(0) if plain is None else plain + y.sum(0)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i, np.full(len(plain), -1)), pa.int32()), pa.array(np.append(j, np.arange(len(plain))), pa.int32()),
                 pa.array(np.append(total[i, j], plain))], ["i", "j", "product"])
    return run


def _covariance(vectors: DataFrame, d: int, n: int, width: int, of_vectors) -> np.ndarray:
    """The width x width covariance, divisor n, of ``of_vectors`` of the rows."""
    sums = (vectors.transform(map_batches, _products(d, of_vectors), "i int, j int, product double")
            .groupBy("i", "j").agg(F.sum("product").alias("s")).toPandas())
    v, mean = np.zeros((width, width)), np.zeros(width)
    plain = sums["i"] < 0
    mean[sums["j"][plain]] = sums["s"][plain] / n
    i, j, s = (sums[c][~plain].to_numpy() for c in ("i", "j", "s"))
    v[i, j] = v[j, i] = s / n
    return v - np.outer(mean, mean)


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: mean, components (as columns) and eigenvalues."""

    d: int
    mean: Mean
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable rows of ``vectors``; None without any."""
    vectors = vectors.select("embedding")
    sizes = (vectors.transform(map_batches, _lengths, "d int, n long").groupBy("d").agg(F.sum("n").alias("n"))
             .where("n > 0").orderBy(F.desc("n"), F.desc("d")).first())
    if sizes is None:
        return None
    d = sizes["d"]
    sums = (vectors.transform(map_batches, _sums(d), "at int, n long, total string")
            .groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).orderBy("at").collect())
    mean = Mean(sums[0]["n"], [int(r["s"]) for r in sums])
    v = _covariance(vectors, d, mean.n, d, mean.centred)
    values, found = leading_eigenvectors(v, components)
    good = values > RANK * max(values[0], 0.0)
    return Whitening(d, mean, values[good], found[:, good], float(np.trace(v)))


_WHITE = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
          "identity_error double, eigenvalue double")


def _project(w: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        for b in batches:
            rows, x = _usable(b, w.d)
            if not len(rows) or not k:
                continue
            each = pa.array(np.repeat(rows, k))
            # As text: Arrow takes no Python ints for decimals of this width.
            deviation = pa.array([str(v) for v in w.mean.deviations(x)]).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"].take(each), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                 pa.array(np.full(len(each), w.mean.n), pa.int64()), deviation.take(pa.array(np.repeat(np.arange(len(rows)), k))),
                 pa.array(w.apply(x).ravel()), pa.array(np.tile(w.values / w.trace, len(rows))),
                 pa.array(np.full(len(each), error)), pa.array(np.tile(w.values, len(rows)))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component (numbered from 1 by falling
    eigenvalue): vec_id, component, n (usable vectors), deviation (exact squared
    distance from the mean, times n squared), whitened, explained (the
    eigenvalue's share of the variance), identity_error (largest entry of the
    whitened rows' covariance minus the identity, measured in a pass of its
    own) and eigenvalue.

    Vectors that are null, hold null or non-finite entries, or entries of 2^46
    or more are left out, and so are those that have not the commonest length
    (the longer of two as common). Every row counts, repeated ones too, a null
    vec_id as well. Components without variance are left out: one vector, or
    equal ones, give no rows, and neither does an empty table. Other columns are
    ignored.
    """
    vectors = vectors.select("vec_id", "embedding")
    w = fit(vectors, components)
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], _WHITE)
    k = len(w.values)
    white = _covariance(vectors.select("embedding"), w.d, w.mean.n, k, w.apply)
    error = float(np.abs(white - np.eye(k)).max())
    return vectors.transform(map_batches, _project(w, error), _WHITE)
