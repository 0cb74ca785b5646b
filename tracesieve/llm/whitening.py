"""Whitening of embeddings by an incrementally updated eigendecomposition.

Vectors are first put on a grid (``floor(scale * c)``), so their sums and the deviations from the mean are exact integers, and the
distribution is fitted on each distinct vector once. A task keeps the spectrum of what it has seen, count, mean, eigenvalues and eigenvectors
of the scatter matrix, and never the matrix itself. New data enter by centred rank-one updates

    Q diag(d) Q' + rho v v'   ->   eigenvalues: the roots of 1 + rho sum_i z_i^2 / (d_i - x), z = Q'v,

after entries with a negligible z_i and equal d_i have been deflated. Spectra of tasks are merged the same way, one rank-one update per
eigenvector and one for the distance of the means, in rounds of ``FAN_IN``, so a task holds two spectra and the driver one. A last distributed
Rayleigh-Ritz step projects the whole fit list on the merged basis and diagonalises that small matrix, which removes what rounding the many
updates left, and one more pass measures the covariance of the result.
"""
from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.frames import arrow_schema
from tracesieve.session import checkpoint_dir

SCALE, COMPONENTS = 256, 4
#: Vectors whose centred block is turned (QR) into at most ``dimension`` rows with the same scatter; each row is one rank-one update.
BLOCK = 4096
FAN_IN = 16
#: Grid values are kept below this; larger ones are treated like infinite ones.
LARGEST = 1 << 40
_EPS = np.finfo(float).eps


class Spectrum(NamedTuple):
    """Number of vectors, mean, eigenvalues (ascending) and eigenvectors (columns) of their scatter matrix."""

    n: int
    mean: np.ndarray
    d: np.ndarray
    q: np.ndarray

    @staticmethod
    def empty(dim: int) -> Spectrum:
        return Spectrum(0, np.zeros(dim), np.zeros(dim), np.eye(dim))


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(origin, offset): root k of ``1 + sum z2 / (d - x)`` is ``d[origin[k]] + offset[k]``. ``d`` ascends strictly, ``z2`` is positive.

    Root k lies between d[k] and d[k + 1], the last one behind d[-1]. All roots move together: two-pole interpolation of both
    halves of the sum, held inside a shrinking bracket, with the nearer pole as origin so that differences stay exact.
    """
    k = len(d)
    at = np.arange(k)
    right = np.append(d[1:], d[-1] + z2.sum())
    gap = d[None, :] - d[:, None]
    half = (right - d) / 2
    mid = 1 + (z2 / (gap - half[:, None])).sum(1)
    origin = np.where((mid >= 0) | (at == k - 1), at, at + 1)
    delta = d[None, :] - d[origin][:, None]  # poles seen from the origin of each root
    low, high = np.where(origin == at, 0.0, -half), np.where(origin == at, half, 0.0)
    low[-1], high[-1] = (half[-1], 2 * half[-1]) if mid[-1] < 0 else (0.0, half[-1])
    left = at[None, :] <= at[:, None]
    to_left, to_right = d - d[origin], np.append(d[1:] - d[origin[:-1]], np.inf)
    x = (low + high) / 2
    for _ in range(80):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            gaps = delta - x[:, None]
            term = z2 / gaps
            slope = term / gaps
            psi, phi = np.where(left, term, 0).sum(1), np.where(left, 0, term).sum(1)
            dpsi, dphi = np.where(left, slope, 0).sum(1), np.where(left, 0, slope).sum(1)
            f = 1 + psi + phi
            done = np.abs(f) <= 4 * _EPS * k * (1 + np.abs(psi) + np.abs(phi))
            low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
            done |= (high - low) <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
            if done.all():
                break
            dl, dr = to_left - x, to_right - x
            s = dpsi * dl * dl
            last = ~np.isfinite(dr)
            dr_ = np.where(last, 1.0, dr)
            S = np.where(last, 0.0, dphi * dr_ * dr_)
            c = 1 + psi - dpsi * dl + np.where(last, 0.0, phi - dphi * dr_)
            a, b = c * (dl + dr_) + s + S, dl * dr_ * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(last, dl + s / c, step)
            new = x + step
            inside = (new > low) & (new < high) & np.isfinite(new)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return origin, x


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``q diag(d) q' + rho v v'``, rho >= 0.

    Deflation: an entry of ``z = q'v`` too small to move its eigenvalue leaves it as it is, and of several (nearly) equal eigenvalues a
    rotation leaves z in one only. The new vectors come from the z for which the computed roots are exact, so they are
    orthogonal to working precision.
    """
    z = math.sqrt(rho) * (q.T @ v)
    total = float(z @ z)
    if not total:
        return d, q
    d, q = d.copy(), q.copy()
    slack = 8 * _EPS * max(abs(d[-1]), total)
    z[np.abs(z) * math.sqrt(total) <= slack] = 0
    live = np.flatnonzero(z)
    if len(live) > 1 and np.diff(d[live]).min() <= slack:
        for i, j in zip(live, live[1:]):
            r = math.hypot(z[i], z[j])
            cos, sin = z[j] / r, z[i] / r
            if (d[j] - d[i]) * abs(cos * sin) <= slack:
                q[:, [i, j]] = q[:, [i, j]] @ np.array([[cos, sin], [-sin, cos]])
                d[i], d[j] = d[i] * cos * cos + d[j] * sin * sin, d[i] * sin * sin + d[j] * cos * cos
                z[i], z[j] = 0.0, r
        live = np.flatnonzero(z)
    if len(live):
        poles = d[live]
        origin, offset = secular_roots(poles, z[live] ** 2)
        gaps = (poles[:, None] - poles[origin]) - offset  # pole i less root k, without cancellation
        # z_i^2 = prod_k (root_k - pole_i) / prod_{k != i} (pole_k - pole_i), in pairs of factors of one size
        at = np.arange(len(live))
        others = np.where(at[:-1] < at[:, None], poles[:-1] - poles[:, None], poles[1:] - poles[:, None])
        z2 = np.prod(-gaps[:, :-1] / others, 1) * -gaps[:, -1]
        u = (np.sqrt(np.abs(z2)) * np.sign(z[live]))[:, None] / gaps
        q[:, live] = q[:, live] @ (u / np.linalg.norm(u, axis=0))
        d[live] = poles[origin] + offset
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def merge(a: Spectrum, b: Spectrum) -> Spectrum:
    """Spectrum of both inputs together, by rank-one updates of the first."""
    if not a.n or not b.n:
        return a if a.n else b
    d, q = a.d, a.q
    for k in np.flatnonzero(b.d > 0):
        d, q = rank_one(d, q, b.q[:, k], b.d[k])
    n = a.n + b.n
    d, q = rank_one(d, q, b.mean - a.mean, a.n * b.n / n)
    return Spectrum(n, a.mean + (b.mean - a.mean) * (b.n / n), d, q)


def add_rows(s: Spectrum, x: np.ndarray, block: int = BLOCK) -> Spectrum:
    """Spectrum after the rows of ``x``, ``block`` at a time: its centred rows, or their triangle if there are more than dimensions, and the
    distance of the means are rank-one updates. With ``block=1`` each row is one update."""
    for at in range(0, len(x), block):
        part = x[at:at + block].astype(float)
        mean = part.mean(0)
        part -= mean
        d, q = s.d, s.q
        if len(part) > 1:
            for row in np.linalg.qr(part, "r") if len(part) > len(mean) else part:
                d, q = rank_one(d, q, row)
        n = s.n + len(part)
        if s.n:
            d, q = rank_one(d, q, mean - s.mean, s.n * len(part) / n)
        s = Spectrum(n, s.mean + (mean - s.mean) * (len(part) / n), d, q)
    return s


def grid(vector: Column, scale: int = SCALE) -> Column:
    """The vector on the grid, long entries; null for a null or empty vector and one with a null, non-finite or too large entry."""
    c = F.transform(vector, lambda v: v.cast("double") * scale)
    fits = F.forall(c, lambda v: v.isNotNull() & (F.abs(v) < float(LARGEST)))  # NaN is larger than any number
    return F.when((F.size(vector) > 0) & fits, F.transform(c, lambda v: F.floor(v)))


def _rows(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _reduced(fit: DataFrame, make: Callable[[Iterator[np.ndarray]], tuple], add: Callable[[tuple, tuple], tuple], schema: str) -> tuple:
    """One row for the whole table: ``make`` per task, then ``add`` in rounds of ``FAN_IN`` rows a task; the driver gets the last row."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = next((b for b in batches if b.num_rows), None)
        if some is not None:
            def rest() -> Iterator[np.ndarray]:
                yield _rows(some)
                yield from (_rows(b) for b in batches if b.num_rows)
            yield row(make(rest()))

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                total = r if total is None else add(total, r)
        if total is not None:
            yield row(total)

    def row(values: tuple) -> pa.RecordBatch:
        shape = arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, shape)], schema=shape)

    parts, out = fit.rdd.getNumPartitions(), fit.mapInArrow(first, schema)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        out = out.repartition(parts).mapInArrow(later, schema)
    return tuple(out.first())


def _pack(s: Spectrum, sums: list[int]) -> tuple[int, bytes, str]:
    return s.n, np.concatenate([s.mean, s.d, s.q.ravel()]).tobytes(), json.dumps(sums)


def _unpack(n: int, state: bytes, sums: str) -> tuple[Spectrum, list[int]]:
    exact = json.loads(sums)
    dim, v = len(exact), np.frombuffer(state)
    return Spectrum(n, v[:dim], v[dim:2 * dim], v[2 * dim:].reshape(dim, dim)), exact


def _exact_sums(x: np.ndarray) -> list[int]:
    safe = len(x) * int(np.abs(x).max()) < 1 << 62
    return [int(v) for v in (x if safe else x.astype(object)).sum(0)]


def spectrum_of(fit: DataFrame, block: int = BLOCK) -> tuple[Spectrum, list[int]]:
    """Spectrum and exact sums per dimension of a table with one column of long vectors of one length, at least one row."""
    def make(blocks: Iterator[np.ndarray]) -> tuple:
        s, sums = None, None
        for x in blocks:
            s = add_rows(s or Spectrum.empty(x.shape[1]), x, block)
            sums = [a + b for a, b in zip(sums or [0] * x.shape[1], _exact_sums(x))]
        return _pack(s, sums)

    def add(a: tuple, b: tuple) -> tuple:
        (s, m), (t, n) = _unpack(*a), _unpack(*b)
        return _pack(merge(s, t), [x + y for x, y in zip(m, n)])
    return _unpack(*_reduced(fit, make, add, "n long, state binary, sums string"))


def _moments(fit: DataFrame, mean: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``y`` and of ``y y'`` over the table, y a row less the mean times ``weights``."""
    def make(blocks: Iterator[np.ndarray]) -> tuple:
        first, second = np.zeros(weights.shape[1]), np.zeros((weights.shape[1],) * 2)
        for x in blocks:
            y = (x - mean) @ weights
            first += y.sum(0)
            second += y.T @ y
        return first.tobytes(), second.tobytes()

    def add(a: tuple, b: tuple) -> tuple:
        return tuple((np.frombuffer(x) + np.frombuffer(y)).tobytes() for x, y in zip(a, b))
    first, second = (np.frombuffer(v) for v in _reduced(fit, make, add, "first binary, second binary"))
    return first, second.reshape(len(first), -1)


class Whitening(NamedTuple):
    """Fitted transform: count, exact sums, unit components (columns), their eigenvalues, shares of the trace, and the error measured."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def weights(self) -> np.ndarray:
        """Columns that whiten; NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.components / np.sqrt(self.values), np.nan)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitening:
    """Components of a table with one column of distinct long vectors of one length, at least one row."""
    s, sums = spectrum_of(fit, block)
    mean = np.array([v / s.n for v in sums])
    basis = np.linalg.qr(s.q)[0]  # the updates' rounding; the Rayleigh-Ritz step wants a basis that is orthogonal to the last digit
    _, small = _moments(fit, mean, basis)
    values, turn = np.linalg.eigh(small / s.n)
    values, trace = values[::-1], float(np.trace(small)) / s.n
    chosen = (basis @ turn[:, ::-1])[:, :components]
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(0), np.arange(chosen.shape[1])])  # the largest entry is positive
    values = values[:components]
    values = np.where(values > len(mean) * _EPS * max(values[0], 0), values, 0.0)
    out = Whitening(s.n, sums, chosen, values, values / trace if trace > 0 else np.zeros(len(values)), None)
    kept = values > 0
    if not kept.any():
        return out
    first, second = _moments(fit, mean, out.weights[:, kept])
    covariance = second / s.n - np.outer(first, first) / s.n ** 2
    return out._replace(error=float(np.abs(covariance - np.eye(len(covariance))).max()))


def fit_list(vectors: DataFrame, folder: str) -> tuple[DataFrame, int] | None:
    """Each distinct vector of the column ``x`` once, written to ``folder``, and the dimension: the commonest length (the least on a tie)."""
    vectors.select("x").where("x IS NOT NULL").distinct().write.parquet(folder)
    kept = vectors.sparkSession.read.schema(vectors.select("x").schema).parquet(folder)
    size = kept.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return size and (kept.where(F.size("x") == size["dim"]), size["dim"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Squared distances of n * x from the sums, exact; None where one is no long."""
    reach = n * int(np.abs(x).max()) + max(map(abs, sums))
    y = (x if reach * reach * len(sums) < 1 << 62 else x.astype(object)) * n - np.array(sums, object if reach >= 1 << 62 else np.int64)
    return [int(v) if v < 1 << 63 else None for v in (y * y).sum(1)]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row and each of the first components.

    Rows with a null or empty vector, or with a null, non-finite or (2^40 and more on the grid) too large entry are dropped, and so are
    vectors of another length than the commonest. Null and repeated keys stay; equal vectors get equal rows. A component without variance has
    whitened null and explained 0; identity_error is null if there is none with variance. With fewer dimensions than ``components`` there
    are as many components as dimensions. A deviation beyond a long is null. Other columns are not read.
    """
    spark = df.sparkSession
    out = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.select(F.col(key).cast("long").alias(key), grid(F.col(vector), scale).alias("x")).where("x IS NOT NULL")
    found = fit_list(rows, f"{checkpoint_dir(spark)}/whitening-{uuid.uuid4().hex}")
    if not found:
        return spark.createDataFrame([], out)
    fit, dim = found
    w = fit_whitening(fit, components)
    mean, weights, count = w.mean, w.weights, len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(out)
        for b in batches:
            if b.num_rows:
                x, many = _rows(b, 1), b.num_rows
                values = ((x - mean) @ weights).ravel()
                columns = [np.repeat(np.arange(many), count), np.tile(np.arange(1, count + 1), many), np.full(many * count, w.n),
                           [v for v in _deviations(x, w.n, w.sums) for _ in range(count)], pa.array(values, mask=np.isnan(values)),
                           np.tile(w.explained, many), [w.error] * (many * count)]
                columns[0] = b.column(0).take(pa.array(columns[0]))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    return rows.where(F.size("x") == dim).mapInArrow(run, out)
