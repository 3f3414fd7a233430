"""Expressions over per-row score arrays.

With few classes the element loops are written out, so a projection stays inside whole-stage
code generation (array lambdas are interpreted, about twice the time on three classes).
Longer arrays use the higher-order functions, since generated methods have a size limit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PROBABILITY_FLOOR

UNROLL_LIMIT = 24


def literal_array(values: Sequence[float]) -> Column:
    """Array of finite doubles, parsed in one call rather than built element by element."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def at(values: Column, index: Column | int) -> Column:
    return F.get(values, F.lit(index) if isinstance(index, int) else index)


def element(values: Column, i: int) -> Column:
    """Element ``i``, NaN where it is missing.

    Being non-null it needs no null branches: long sums of nullable terms generate deeply
    nested code that compiles slowly or not at all.
    """
    return F.coalesce(at(values, i), F.lit(float("nan")))


def exact_size(values: Column, k: int) -> Column:
    """0.0 for an array of ``k`` elements, NaN for any other and for null.

    Added to a result, it makes both forms of a loop treat wrong lengths alike.
    """
    return F.when(F.size(values) == k, F.lit(0.0)).otherwise(F.lit(float("nan")))


def sum_over(values: Column, k: int, term: Callable[[Column], Column]) -> Column:
    """Sum of ``term(element)`` over an array of ``k`` elements; NaN for other lengths."""
    if k <= UNROLL_LIMIT:
        terms = [term(element(values, i)) for i in range(k)]
        return reduce(lambda total, value: total + value, terms) + exact_size(values, k)
    total = F.aggregate(values, F.lit(0.0), lambda total, x: total + term(x))
    return F.coalesce(total, F.lit(0.0)) + exact_size(values, k)


def map_over(values: Column, k: int, term: Callable[[Column], Column]) -> Column:
    """``term`` of each element; all NaN where the array has not ``k`` elements."""
    if k <= UNROLL_LIMIT:
        return F.array(*[term(element(values, i)) + exact_size(values, k) for i in range(k)])
    wrong = F.array_repeat(F.lit(float("nan")), k)
    return F.when(F.size(values) == k, F.transform(values, term)).otherwise(wrong)


def dot(left: Column, right: Column, k: int) -> Column:
    fits = exact_size(left, k) + exact_size(right, k)
    if k <= UNROLL_LIMIT:
        terms = [element(left, i) * element(right, i) for i in range(k)]
        return reduce(lambda total, value: total + value, terms) + fits
    products = F.zip_with(left, right, lambda a, b: a * b)
    total = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    return F.coalesce(total, F.lit(0.0)) + fits


def argmax(values: Column) -> Column:
    """First index of the largest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confidence_bin(confidence: Column, n_bins: int) -> Column:
    return F.least((confidence * n_bins).cast("int"), F.lit(n_bins - 1))


def clip_probability(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(PROBABILITY_FLOOR)), F.lit(1.0))


def log_clip(p: Column) -> Column:
    return F.log(clip_probability(p))


def with_softmax(
    df: DataFrame, k: int, temperature: float | Column = 1.0, logits: str = "logits", out: str = "probs"
) -> DataFrame:
    """Add the max-shifted softmax of ``logits / temperature``; NaN for a wrong length.

    Each exponential is a column of its own: the optimizer would inline an array that is
    only indexed, and compute every element once per use.
    """
    if isinstance(temperature, (int, float)):
        if not 0 < temperature < float("inf"):
            raise ValueError("temperature must be finite and positive")
        temperature = F.lit(float(temperature))
    x, largest = F.col(logits), F.col("__largest")
    largest_of = F.coalesce(F.array_max(x), F.lit(float("nan"))) + exact_size(x, k)
    shifted = df.withColumn("__largest", largest_of)
    if k > UNROLL_LIMIT:
        return (
            shifted.withColumn("__e", F.transform(x, lambda v: F.exp((v - largest) / temperature)))
            .withColumn("__sum", F.aggregate("__e", F.lit(0.0), lambda t, v: t + v))
            .withColumn(out, F.transform("__e", lambda v: v / F.col("__sum")))
            .drop("__largest", "__e", "__sum")
        )
    names = [f"__e{i}" for i in range(k)]
    exps = {n: F.exp((element(x, i) - largest) / temperature) for i, n in enumerate(names)}
    return (
        shifted.withColumns(exps)
        .withColumn("__sum", reduce(lambda t, n: t + F.col(n), names[1:], F.col(names[0])))
        .withColumn(out, F.array(*[F.col(n) / F.col("__sum") for n in names]))
        .drop("__largest", "__sum", *names)
    )
