"""Temperature scaling fitted on validation logits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TEMPERATURE_BOUNDS
from ..functions.vectors import UNROLL_LIMIT, at, element, map_over, sum_over


def _weighted_sums(
    frame: DataFrame, k: int, s: float, tag: str
) -> tuple[DataFrame, Column, Column, Column]:
    """Σw, Σwx and Σwx² with w = exp(s (x - max x)), the weights computed once per row."""
    names = [f"{n}{tag}" for n in ("z", "a", "b")]
    if k <= UNROLL_LIMIT:
        weights = {
            f"w{tag}_{c}": F.exp((element(F.col("x"), c) - F.col("top")) * F.lit(s)) for c in range(k)
        }
        frame = frame.withColumns(weights)
        pairs = [(F.col(w), element(F.col("x"), c)) for c, w in enumerate(weights)]
        z = reduce(add, [w for w, _ in pairs])
        first = reduce(add, [w * x for w, x in pairs])
        second = reduce(add, [w * x * x for w, x in pairs])
    else:
        w = f"w{tag}"
        frame = frame.withColumn(w, map_over(F.col("x"), k, lambda v: F.exp((v - F.col("top")) * s)))
        pairs = F.zip_with(w, "x", lambda v, x: F.struct(v.alias("w"), x.alias("x")))
        z = sum_over(F.col(w), k, lambda v: v)
        first = F.aggregate(pairs, F.lit(0.0), lambda t, q: t + q["w"] * q["x"])
        second = F.aggregate(pairs, F.lit(0.0), lambda t, q: t + q["w"] * q["x"] * q["x"])
    return frame.withColumns(dict(zip(names, (z, first, second)))), *map(F.col, names)


def _moments(rows: DataFrame, k: int, scales: Sequence[float]) -> list[tuple[float, float, float]]:
    """Mean loss, slope and curvature in s = 1/T at each scale, in one pass.

    With weights p_c = softmax(s x)_c the loss is logsumexp(s x) - s x_y, its slope
    E_p[x] - x_y and its curvature Var_p[x], so the loss is convex in s.
    """
    frame = rows.select(
        F.col("logits").alias("x"),
        F.coalesce(F.when(F.col("label") < k, at(F.col("logits"), F.col("label"))), F.lit(math.nan)).alias("own"),
        F.coalesce(F.array_max("logits"), F.lit(math.nan)).alias("top"),
    )
    aggregates: list[Column] = []
    for i, s in enumerate(scales):
        frame, z, first, second = _weighted_sums(frame, k, s, str(i))
        mean = first / z
        aggregates += [
            F.avg(F.log(z) + s * (F.col("top") - F.col("own"))).alias(f"loss{i}"),
            F.avg(mean - F.col("own")).alias(f"slope{i}"),
            F.avg(second / z - mean * mean).alias(f"curve{i}"),
        ]
    # A wrong label, length or value makes its row's terms NaN.
    bad = F.isnan("own") | F.isnan("top") | (F.abs("top") == math.inf) | (F.abs("own") == math.inf)
    bad = bad | (F.size("x") != k) | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf))
    row = frame.agg(*aggregates, F.count_if(F.coalesce(bad, F.lit(True))).alias("bad")).first()
    if row["bad"]:
        raise ValueError(f"calibration rows with bad labels or logits: {row['bad']}")
    return [(row[f"loss{i}"], row[f"slope{i}"], row[f"curve{i}"]) for i in range(len(scales))]


def _hermite_root(a: float, b: float, fa: float, fb: float, da: float, db: float) -> float:
    """Root in [a, b] of the cubic with values ``fa`` < 0 < ``fb`` and slopes ``da``, ``db`` there."""
    h = b - a

    def value(t: float) -> float:
        u = 1 - t
        return (1 + 2 * t) * u * u * fa + t * u * u * h * da + t * t * (3 - 2 * t) * fb - t * t * u * h * db

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return a + h * low


# First scales: between the ends and 1, evenly in the logarithm. Later ones: the estimated root, points
# around it that are these shares of the bracket away, and its geometric middle.
FIRST_SCALES = 2
SHARES = (1 / 16, 1 / 512)


def fit_temperature(rows: DataFrame, k: int, tolerance: float = 4e-3, rounds: int = 12) -> float:
    """Temperature of least mean NLL within the bounds; 1 if nothing beats it.

    The loss is convex in s = 1/T. One scan brings loss, slope and curvature at seven scales over
    the bounds, of which two neighbours bracket the minimum. Each further scan does so at six scales
    around the root of the cubic through the bracket's slopes and curvatures, so that it shrinks by
    about 500 where the cubic fits and by its half at least elsewhere: two or three scans in all.
    Once the bracket is as narrow as ``tolerance`` (relative) the cubic's root is the answer, with an
    error of the fourth power of that. Rows with a label outside the classes, or logits that are not
    ``k`` finite numbers, raise ValueError. ``rows`` holds validation (label, logits) only.
    """
    low, high = 1 / TEMPERATURE_BOUNDS[1], 1 / TEMPERATURE_BOUNDS[0]
    inner = [e ** (i / (FIRST_SCALES + 1)) for e in (low, high) for i in range(1, FIRST_SCALES + 1)]
    scales = sorted({low, 1.0, high, *inner})
    found = dict(zip(scales, _moments(rows, k, scales)))
    at_one = found[1.0]
    if at_one[0] is None:
        raise ValueError("calibration needs at least one row")
    for end, beyond in ((low, found[low][1] >= 0), (high, found[high][1] <= 0)):
        if beyond:
            return 1 / end if found[end][0] <= at_one[0] else 1.0
    for step in range(rounds + 1):
        a = max(s for s in found if found[s][1] < 0)
        b = min(s for s in found if found[s][1] >= 0)
        (_, fa, da), (_, fb, db) = found[a], found[b]
        root = _hermite_root(a, b, fa, fb, da, db)
        if b - a <= tolerance * a or step == rounds:
            break
        near = [root + side * share * (b - a) for share in SHARES for side in (-1, 1)]
        scales = sorted({s for s in (root, math.sqrt(a * b), *near) if a < s < b})
        found |= zip(scales, _moments(rows, k, scales))
    # Convexity: the loss at the root is below that at either end, hence below that at 1.
    return 1 / root


def temperature_grid(rows: DataFrame, k: int, temperatures: Sequence[float]) -> DataFrame:
    """Mean validation NLL at fixed temperatures, in one pass."""
    frame = rows.select(
        F.col("logits").alias("x"),
        F.coalesce(at(F.col("logits"), F.col("label")), F.lit(math.nan)).alias("own"),
        F.coalesce(F.array_max("logits"), F.lit(math.nan)).alias("top"),
    )
    losses = [
        F.avg(
            F.log(sum_over(F.col("x"), k, lambda v, t=t: F.exp((v - F.col("top")) / t)))
            + (F.col("top") - F.col("own")) / t
        ).alias(f"t{i}")
        for i, t in enumerate(temperatures)
    ]
    pairs = [
        F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll"))
        for i, t in enumerate(temperatures)
    ]
    return frame.agg(*losses).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
