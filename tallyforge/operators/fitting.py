"""Multinomial logistic regression for a whole grid of recipes in the same scans.

Every recipe (penalty, class balance, iterations) has a limited-memory quasi-Newton state on the
driver, as large as its head. One scan takes the points that all unfinished recipes ask about to
the rows, and brings back the penalised loss and gradient of each: so the number of scans is that of
the slowest recipe, however many there are. A recipe ends with a certificate, the norm of the
penalised gradient at its head, which tells how far from the optimum it can be.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, with_package

LAYER_NORM_EPS = 1e-5
SLICE_ROWS = 1024
MEMORY = 10
TOLERANCE = 1e-6
NEVER = -1e9  # bias of a class without rows


@dataclass(frozen=True)
class Recipe:
    l2: float = 0.01
    balanced: bool = False
    max_iter: int = 50


@dataclass(frozen=True)
class Fit:
    """Weights (classes x features) and biases, mean penalised loss, and the certificate."""

    weights: np.ndarray
    bias: np.ndarray
    loss: float
    gradient_norm: float
    iterations: int
    converged: bool


@dataclass
class Descent:
    """L-BFGS with backtracking; ``trial`` is the next point to evaluate."""

    trial: np.ndarray
    max_iter: int
    tolerance: float
    point: np.ndarray | None = None
    loss: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    iterations: int = 0
    done: bool = False
    pairs: list = field(default_factory=list)

    @property
    def gradient_norm(self) -> float:
        return float(np.linalg.norm(self.gradient))

    def _two_loops(self) -> np.ndarray:
        q, kept = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        return -q

    def observe(self, loss: float, gradient: np.ndarray) -> None:
        if self.point is not None:
            slope = self.gradient @ self.direction
            if not loss <= self.loss + 1e-4 * self.step * slope + 1e-15 * abs(self.loss):
                short = -slope * self.step / (2 * (loss - self.loss - slope * self.step)) if np.isfinite(loss) else 0.1
                self.step *= min(max(short, 0.1), 0.5)
                self.trial = self.point + self.step * self.direction
                self.done = self.step < 1e-12
                return
            s, y = self.trial - self.point, gradient - self.gradient
            if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
            self.iterations += 1
        self.point, self.loss, self.gradient = self.trial, loss, gradient
        self.done = self.gradient_norm <= self.tolerance or self.iterations >= self.max_iter
        self.direction = self._two_loops()
        if self.gradient @ self.direction >= 0:
            self.pairs, self.direction = [], -self.gradient
        self.step = 1.0 if self.pairs else 1 / max(1.0, self.gradient_norm)
        self.trial = self.point + self.step * self.direction


def normalised_rows(column: pa.Array) -> np.ndarray:
    """Layer-normalised features of a batch, with a one for the bias behind them."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    x = x - x.mean(axis=1, keepdims=True)
    x /= np.sqrt((x * x).mean(axis=1, keepdims=True) + LAYER_NORM_EPS)
    return np.hstack([x, np.ones((len(x), 1))])


def _slices(batches: Iterator[pa.RecordBatch], features: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield np.asarray(part.column("label")), normalised_rows(part.column(features))


def _losses(points: np.ndarray, weights: np.ndarray, place: dict[int, int], features: str):
    """Per recipe: weighted loss (at the end) and its gradient, summed over a partition."""
    r, c, d = points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((r, c * d + 1))
        for label, x in _slices(batches, features):
            y, row = np.array([place[int(v)] for v in label]), np.arange(len(x))
            z = (x @ points.reshape(r * c, d).T).reshape(-1, r, c)
            top = z.max(axis=2, keepdims=True)
            e = np.exp(z - top)
            s = e.sum(axis=2, keepdims=True)
            w = weights[:, y].T
            total[:, -1] += (w * ((top + np.log(s))[:, :, 0] - z[row, :, y])).sum(axis=0)
            p = e / s
            p[row, :, y] -= 1
            p *= w[:, :, None]
            total[:, :-1] += (p.reshape(-1, r * c).T @ x).reshape(r, c * d)
        at = np.arange(total.size, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    return run


def losses(rows: DataFrame, points: np.ndarray, weights: np.ndarray, place: dict[int, int], features: str) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient sums at one point a recipe, in one scan of (label, features)."""
    r, c, d = points.shape
    parts = with_package(rows).mapInArrow(_losses(points, weights, place, features), "at bigint, v double")
    table = parts.groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # as long as all heads
    total = np.zeros(r * (c * d + 1))
    total[np.asarray(table.column("at"))] = np.asarray(table.column("v"))
    total = total.reshape(r, c * d + 1)
    return total[:, -1], total[:, :-1].reshape(r, c, d)


def fit_grid(
    rows: DataFrame, k: int, recipes: Sequence[Recipe], features: str = "features", tolerance: float = TOLERANCE
) -> list[Fit]:
    """Heads of all recipes for rows of (label, features); rows with either missing take no part.

    The loss is the class-weighted mean of -log p plus ``l2 / 2`` times the squared weights; biases
    are not penalised. Classes without rows get no weights and a bias that rules them out.
    """
    used = rows.where(F.col("label").between(0, k - 1) & F.col(features).isNotNull())
    used = stage(used.select(F.col("label").cast("int").alias("label"), F.col(features).cast("array<double>").alias(features)), "fit")
    facts = used.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size(features)).alias("low"), F.max(F.size(features)).alias("high"))
    facts = sorted(facts.collect())  # one row a class
    if not facts:
        raise ValueError("nothing to fit: no row has a label and features")
    width = facts[0]["low"]
    if any(f["low"] != width or f["high"] != width for f in facts):
        raise ValueError("features differ in length")
    place = {f["label"]: i for i, f in enumerate(facts)}
    n, c, d = np.array([f["n"] for f in facts], float), len(facts), width + 1
    weights = np.array([n.sum() / (k * n) if r.balanced else np.ones(c) for r in recipes])
    mass = weights @ n
    start = np.zeros((len(recipes), c, d))
    start[:, :, -1] = np.log(weights * n / mass[:, None])
    runs = [Descent(start[i].ravel(), r.max_iter, tolerance) for i, r in enumerate(recipes)]
    while left := [i for i, run in enumerate(runs) if not run.done]:
        points = np.array([runs[i].trial.reshape(c, d) for i in left])
        loss, gradient = losses(used, points, weights[left], place, features)
        for j, i in enumerate(left):
            penalised = points[j].copy()
            penalised[:, -1] = 0
            runs[i].observe(
                float(loss[j] / mass[i] + recipes[i].l2 / 2 * (penalised**2).sum()),
                (gradient[j] / mass[i] + recipes[i].l2 * penalised).ravel(),
            )
    fits = []
    for run in runs:
        own = run.point.reshape(c, d)
        head, bias = np.zeros((k, d - 1)), np.full(k, NEVER)
        head[list(place)], bias[list(place)] = own[:, :-1], own[:, -1] - own[:, -1].mean()
        fits.append(Fit(head, bias, run.loss, run.gradient_norm, run.iterations, run.gradient_norm <= tolerance))
    return fits


def _confusions(heads: np.ndarray, features: str):
    r, c, d = heads.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((r, c, c), np.int64)
        for label, x in _slices(batches, features):
            pred = (x @ heads.reshape(r * c, d).T).reshape(-1, r, c).argmax(axis=2)
            np.add.at(n, (np.arange(r)[None, :], label[:, None], pred), 1)
        at = np.argwhere(n)
        columns = [pa.array(at[:, i].astype(np.int32)) for i in range(3)] + [pa.array(n[tuple(at.T)])]
        yield pa.RecordBatch.from_arrays(columns, ["candidate", "label", "pred", "n"])

    return run


def confusions(rows: DataFrame, fits: Sequence[Fit], features: str = "features") -> DataFrame:
    """(candidate, label, pred, n) of all heads over rows of (label, features), in one scan."""
    heads = np.array([np.hstack([f.weights, f.bias[:, None]]) for f in fits])
    k = heads.shape[1]
    used = rows.where(F.col("label").between(0, k - 1) & F.col(features).isNotNull())
    used = used.select(F.col("label").cast("int").alias("label"), F.col(features).cast("array<double>").alias(features))
    counted = with_package(used).mapInArrow(_confusions(heads, features), "candidate int, label int, pred int, n bigint")
    return counted.groupBy("candidate", "label", "pred").agg(F.sum("n").alias("n"))
