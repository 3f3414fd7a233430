"""Linear heads on feature tables: scoring, training, prediction."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax, literal_array, with_softmax
from ..session import with_package
from .classes import lookup
from .fitting import LAYER_NORM_EPS, Fit, Recipe, fit_grid


@dataclass(frozen=True)
class Head:
    """Class weights over normalised features: K x D numbers, independent of the row count."""

    weights: list[list[float]]
    bias: list[float]

    @property
    def k(self) -> int:
        return len(self.bias)


def _moments(rows: DataFrame, features: str) -> DataFrame:
    """Add the features as doubles (``__x``), their mean and their regularised deviation."""
    x, size = F.col("__x"), F.size("__x")
    total = F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    squares = F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v)
    variance = F.greatest(F.col("__sq") / size - F.col("__mean") * F.col("__mean"), F.lit(0.0))
    return (
        rows.withColumn("__x", F.col(features).cast("array<double>"))
        .withColumns({"__mean": total / size, "__sq": squares})
        .withColumn("__scale", F.sqrt(variance + LAYER_NORM_EPS))
        .drop("__sq")
    )


def normalised(rows: DataFrame, features: str = "features", out: str = "x") -> DataFrame:
    """Row-wise layer normalisation without an affine part.

    Mean and deviation reach the elements through a repeated struct: named inside the lambda
    they would be inlined there and computed again for every element.
    """
    stats = F.array_repeat(
        F.struct(F.col("__mean").alias("mean"), F.col("__scale").alias("scale")), F.size("__x")
    )
    return (
        _moments(rows, features)
        .withColumn(out, F.zip_with("__x", stats, lambda v, m: (v - m["mean"]) / m["scale"]))
        .drop("__x", "__mean", "__scale")
    )


def score_linear(rows: DataFrame, head: Head, features: str = "features") -> DataFrame:
    """Layer norm and linear head as expressions; adds ``logits``.

    A class score over normalised features is (w·x - mean Σw) / scale + bias, so the
    normalised array itself is never built.
    """
    scores = []
    for weights, bias in zip(head.weights, head.bias):
        products = F.zip_with(literal_array(weights), F.col("__x"), lambda a, b: a * b)
        dot = F.aggregate(products, F.lit(0.0), lambda t, v: t + v)
        scores.append((dot - F.col("__mean") * math.fsum(weights)) / F.col("__scale") + float(bias))
    return (
        _moments(rows, features)
        .withColumn("logits", F.array(*scores))
        .drop("__x", "__mean", "__scale")
    )


def head_scorer(head: Head, features: str = "features") -> Callable[[], Callable]:
    """The same head as a batch model for :func:`score_batches`."""

    def load():
        weights, bias = np.array(head.weights).T, np.array(head.bias)

        def score(batch: pd.DataFrame) -> np.ndarray:
            x = np.stack(batch[features].to_numpy()).astype(np.float64)
            x -= x.mean(axis=1, keepdims=True)
            x /= np.sqrt((x * x).mean(axis=1, keepdims=True) + LAYER_NORM_EPS)
            return x @ weights + bias

        return score

    return load


def score_batches(
    rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], np.ndarray]], features: str
) -> DataFrame:
    """Apply the caller's model to every row once, in Arrow batches.

    ``load`` runs once per task and returns the batch model. Spark's own partitioning
    decides which task scores a row, so nothing is padded or repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            if len(batch):
                yield pd.DataFrame(
                    {
                        "idx": batch["idx"],
                        "label": batch["label"],
                        "logits": list(np.asarray(model(batch), dtype=np.float64)),
                    }
                )

    return with_package(rows).select("idx", "label", features).mapInPandas(
        run, "idx bigint, label int, logits array<double>"
    )


def predict(
    scored: DataFrame, names: Sequence[str], temperature: float = 1.0, keep: Sequence[str] = ("idx",)
) -> DataFrame:
    """Class name and name-to-probability map of every scored row."""
    labels = F.array(*[F.lit(n) for n in names])
    return with_softmax(scored, len(names), temperature).select(
        *keep,
        lookup(names, argmax(F.col("probs")), "string").alias("prediction"),
        F.lit(float(temperature)).alias("temperature"),
        F.map_from_arrays(labels, "probs").alias("probabilities"),
    )


def centroid_head(rows: DataFrame, k: int, features: str = "features") -> Head:
    """Head whose weights are the mean normalised features of each class.

    The driver receives K x D numbers.
    """
    means = (
        _moments(rows, features)
        .select("label", "__mean", "__scale", F.posexplode_outer("__x").alias("d", "v"))
        .groupBy("label", "d")
        .agg(F.avg((F.col("v") - F.col("__mean")) / F.col("__scale")).alias("v"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("w"))
        .select("label", F.transform("w", lambda e: e["v"]).alias("w"))
        .collect()
    )
    found = {r["label"]: list(r["w"]) for r in means}
    width = len(next(iter(found.values())))
    return Head([found.get(i, [0.0] * width) for i in range(k)], [0.0] * k)


def as_head(fit: Fit) -> Head:
    return Head(fit.weights.tolist(), fit.bias.tolist())


def train_probe(
    rows: DataFrame,
    k: int,
    l2: float = 0.01,
    balanced: bool = False,
    max_iter: int = 50,
    features: str = "features",
) -> Head:
    """Multinomial logistic regression on layer-normalised frozen features."""
    return as_head(fit_grid(rows, k, [Recipe(l2, balanced, max_iter)], features)[0])
