"""Whitening of embeddings by an eigendecomposition that is kept up row by row.

A spectrum is the state of some rows: their number, their sums (exact whole numbers), and the
eigenvalues and eigenvectors of their scatter about their mean. Adding a vector to the scatter is a
rank-one update: its coordinates in the eigenbasis, deflation of those that change nothing and of
equal eigenvalues, the roots of the secular equation, and the new eigenvectors from coordinates
recomputed out of the roots, so that they stay orthogonal.

1. Every partition takes its rows in blocks, centred at the block's mean. A block of more rows than
   dimensions enters as the rows of its triangular factor: the same scatter in at most as many
   updates as there are dimensions. One more update carries the shift between the means.
2. Spectra are combined by the same updates (one an eigenvector, scaled, and one for the shift), at
   most ``FAN_IN`` of them in a task, in as many steps as their number takes.
3. Rayleigh-Ritz: one pass projects all rows, centred at the exact mean, on the combined basis and
   sums the small covariances; rotating the basis by their eigenvectors removes what rounding the
   updates left.
4. One pass measures the covariance of the whitened rows; the last one puts them out.

No step holds more than a block of rows or ``FAN_IN`` spectra, and the driver one spectrum.

Entries become whole numbers, ``floor(1024 c) + 100000``; their large common offset is why rows are
centred before anything is multiplied.

Defined results: rows whose vector is null, or holds a null, a non-finite entry or one beyond
2**40, take no part; nor do those whose length is not the commonest one (of equals the shorter).
Directions without variance (eigenvalue at most ``dimensions * 2**-52`` of the largest) cannot be
whitened and give no rows, so a table of one row or of equal rows gives none. A deviation beyond
64 bits is null. Repeated and null ids are carried as they are; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, with_package

SCALE, OFFSET = 1024, 100_000
LARGEST = 2.0**40
BLOCK_ROWS = 16384
FAN_IN = 32
COMPONENTS = 8
EPS = float(np.finfo(float).eps)
STATE = "part bigint, state binary"


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z**2 / (d - x)) for rising, distinct ``d`` and nonzero ``z``.

    Root i lies right of d[i], as (index of the nearer pole, distance from it): the distance is
    accurate where the root itself would round onto the pole. Each step fits the poles on either
    side of a root by the sums to its left and right; a step that leaves the root's bracket is
    replaced by a bisection.
    """
    m, w = len(d), z * z
    reach = np.append(d, d[-1] + w.sum())
    i = np.arange(m)
    gap = reach[1:] - reach[:-1]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + (w[None, :] / ((d[None, :] - d[:, None]) - gap[:, None] / 2)).sum(1)
    pole = np.where((middle >= 0) | (i == m - 1), i, i + 1)
    delta = d[None, :] - d[pole][:, None]
    left, right = reach[i] - d[pole], reach[i + 1] - d[pole]
    low = np.where(pole == i, 0.0, left / 2)
    high = np.where(pole == i, np.where(i == m - 1, right, right / 2), 0.0)
    low = np.where((i == m - 1) & (middle < 0), right / 2, low)
    high = np.where((i == m - 1) & (middle >= 0), right / 2, high)
    x = (low + high) / 2
    before = np.arange(m)[None, :] <= i[:, None]
    for _ in range(100):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            q = 1.0 / (delta - x[:, None])
            terms = w[None, :] * q
            slopes = terms * q
        psi, phi = np.where(before, terms, 0).sum(1), np.where(before, 0, terms).sum(1)
        dpsi, dphi = np.where(before, slopes, 0).sum(1), np.where(before, 0, slopes).sum(1)
        f = 1 + psi + phi
        low, high = np.where(f < 0, np.maximum(low, x), low), np.where(f >= 0, np.minimum(high, x), high)
        done = (np.abs(f) <= 4 * EPS * m * (1 + np.abs(psi) + np.abs(phi))) | (
            high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
        )
        if done.all():
            break
        a, b = left - x, right - x
        with np.errstate(all="ignore"):
            c = f - a * dpsi - b * dphi
            p, s = (a + b) * f - a * b * (dpsi + dphi), a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * s * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * s / (p + root))
            y = x + step
        inside = np.isfinite(y) & (y > low) & (y < high)
        x = np.where(done, x, np.where(inside, y, (low + high) / 2))
    return pole, x


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``basis diag(values) basis' + vector vector'``."""
    z = basis.T @ vector
    size = max(values[-1], float(z @ z))
    if not size > 0:
        return values, basis
    close = 8 * EPS * size
    same = np.flatnonzero(np.diff(values) <= close)
    if len(same):  # of equal eigenvalues one takes all of the vector
        basis, z = basis.copy(), z.copy()
        for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1):
            at = slice(run[0], run[-1] + 2)
            turn = z[at].copy()
            length = float(np.linalg.norm(turn))
            if length > 0:
                sign = 1.0 if turn[-1] >= 0 else -1.0
                turn[-1] += sign * length
                turn /= np.linalg.norm(turn)
                basis[:, at] -= 2 * np.outer(basis[:, at] @ turn, turn)
                z[at] = 0
                z[run[-1] + 1] = -sign * length
    live = np.flatnonzero(np.abs(z) * np.linalg.norm(z) > close)
    if not len(live):
        return values, basis
    d, w = values[live], z[live]
    pole, x = secular_roots(d, w)
    away = (d[None, :] - d[pole][:, None]) - x[:, None]  # d[j] - root[i]
    between = d[None, :] - d[:, None]  # d[j] - d[i]
    m = len(d)
    i, j = np.indices((m, m))
    with np.errstate(divide="ignore", invalid="ignore"):
        # z[j]**2 = prod over roots (root - d[j]) / prod over other poles (d[i] - d[j])
        ratio = np.where(i == j, -away, away / between)
        exact = np.sqrt(np.maximum(np.prod(np.where(np.isfinite(ratio), ratio, 1.0), axis=0), 0))
        vectors = np.copysign(exact, w)[None, :] / away
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    values, basis = values.copy(), basis.copy()
    values[live] = d[pole] + x
    basis[:, live] = basis[:, live] @ vectors.T
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """Rows seen, their exact sums, and the eigendecomposition of their scatter (values rising)."""

    n: int
    sums: list[int]
    values: np.ndarray
    basis: np.ndarray

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, [0] * size, np.zeros(size), np.eye(size))

    def _join(self, n: int, sums: list[int], vectors: np.ndarray) -> Spectrum:
        """With ``n`` more rows of such sums, whose scatter is that of ``vectors`` about zero."""
        values, basis = self.values, self.basis
        for v in vectors:
            values, basis = rank_one(values, basis, v)
        if self.n and n:  # the means' distance from whole numbers: no digits cancel
            shift = np.array([a * n - b * self.n for a, b in zip(self.sums, sums)], dtype=object)
            apart = np.array([float(s) for s in shift]) / (float(self.n) * n)
            values, basis = rank_one(values, basis, apart * np.sqrt(float(self.n) * n / (self.n + n)))
        return Spectrum(self.n + n, [a + b for a, b in zip(self.sums, sums)], values, basis)

    def add(self, block: np.ndarray) -> Spectrum:
        """With the rows of a block of whole numbers."""
        n = len(block)
        if not n:
            return self
        sums = [int(s) for s in block.sum(axis=0)]
        anchor = np.array([s // n for s in sums])
        rest = (block - anchor).astype(float)
        centred = rest - rest.mean(axis=0)
        if n > block.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        return self._join(n, sums, centred)

    def merge(self, other: Spectrum) -> Spectrum:
        if self.n < other.n:
            self, other = other, self
        scaled = (other.basis * np.sqrt(np.maximum(other.values, 0))).T
        return self._join(other.n, other.sums, scaled)

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole part and rest."""
        whole = np.array([s // self.n for s in self.sums])
        return whole, np.array([s % self.n / self.n for s in self.sums])


def whole_numbers(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=float)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, whole_numbers(part.column("embedding"))


def _spectra(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, part = Spectrum.empty(size), 0
        for batch, block in _blocks(batches):
            part = batch.column("part")[0].as_py()
            spectrum = spectrum.add(block)
        if spectrum.n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([pickle.dumps(spectrum)], pa.binary())], ["part", "state"]
            )

    return run


def _combine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    states = [pickle.loads(s) for _, s in sorted(zip(group["part"], group["state"]), key=lambda r: r[0])]
    return pd.DataFrame({"part": [int(key[0])], "state": [pickle.dumps(reduce(Spectrum.merge, states))]})


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, embedding (doubles) and number of the input partition of the rows that take part,
    and their length."""
    entries = F.col("embedding").cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    good = rows.where(F.col("embedding").isNotNull() & sound & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), entries.alias("embedding"), F.spark_partition_id().cast("bigint").alias("part")
    )
    sizes = good.groupBy(F.size("embedding").alias("size")).count()
    top = sizes.agg(F.max_by("size", F.struct("count", -F.col("size"))).alias("size")).first()["size"]
    return good.where(F.size("embedding") == F.lit(top or 0)), top or 0


def spectrum_of(good: DataFrame, size: int) -> Spectrum | None:
    """Spectrum of all rows: one a partition, then combined in a tree."""
    states = stage(with_package(good).mapInArrow(_spectra(size), STATE), "spectra")
    left = states.agg(F.max("part").alias("p")).first()["p"]
    if left is None:
        return None
    while left:
        states = states.groupBy(F.floor(F.col("part") / FAN_IN).alias("part")).applyInPandas(_combine, STATE)
        left //= FAN_IN
        if left:
            states = stage(states, "spectra")
    return pickle.loads(states.first()["state"])


def _grams(project):
    """Sum over a partition of the outer products of its projected rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, block in _blocks(batches):
            y = project(block)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            at = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel())], ["at", "v"])

    return run


def gram(good: DataFrame, project, k: int) -> np.ndarray:
    sums = with_package(good).mapInArrow(_grams(project), "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(k * k)
    for r in sums.collect():  # k * k numbers
        out[r["at"]] = r["v"]
    return out.reshape(k, k)


@dataclass
class Whitening:
    """Mean, components (columns) with their eigenvalues, trace, and how far the whitened
    covariance is from the identity."""

    n: int
    sums: list[int]
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, block: np.ndarray) -> np.ndarray:
        return ((block - self.whole).astype(float) - self.rest) @ self.components

    def whiten(self, block: np.ndarray) -> np.ndarray:
        return self.project(block) / np.sqrt(self.values)

    def deviations(self, block: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n x - sum)**2."""
        n, sums = self.n, np.array(self.sums, dtype=object)
        reach = max(abs(int(block.max())), abs(int(block.min()))) * n + max(map(abs, self.sums))
        if reach < 1 << 62:
            apart = block * np.int64(n) - np.array(self.sums, np.int64)
            if float(np.abs(apart).max()) ** 2 * block.shape[1] < 2.0**62:
                return (apart * apart).sum(axis=1).tolist()
        exact = ((block.astype(object) * n - sums) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def fit(good: DataFrame, size: int, k: int = COMPONENTS) -> Whitening | None:
    spectrum = spectrum_of(good, size)
    if spectrum is None:
        return None
    whole, rest = spectrum.mean()
    basis = spectrum.basis[:, ::-1]
    full = Whitening(spectrum.n, spectrum.sums, whole, rest, basis, np.ones(size), 0.0)
    small = gram(good, full.project, size) / spectrum.n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    top = int((values[:k] > size * EPS * values[0]).sum()) if values[0] > 0 else 0
    found = Whitening(spectrum.n, spectrum.sums, whole, rest, (basis @ turn)[:, :top], values[:top], float(np.trace(small)))
    if top:
        error = gram(good, found.whiten, top) / spectrum.n - np.eye(top)
        found.identity_error = float(np.abs(error).max())
    return found


ROWS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _rows(found: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.values)
        for batch, block in _blocks(batches):
            m = len(block)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, found.n)),
                pa.array([v for v in found.deviations(block) for _ in range(k)], pa.int64()),
                pa.array(found.whiten(block).ravel()),
                pa.array(np.tile(found.values / found.trace, m)),
                pa.array(np.full(m * k, found.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROWS.split(", ")])

    return run


def whitened(rows: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component up to ``k``."""
    good, size = usable(rows)
    found = fit(good, size, k) if size else None
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], ROWS)
    return with_package(good).mapInArrow(_rows(found), ROWS)
