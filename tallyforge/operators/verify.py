"""Comparisons of recomputed tables with recorded ones. Rows returned are disagreements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify_counts(recomputed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Both sides hold (split, name, n); matching by class *name* absorbs a permuted list."""
    left = recomputed.select("split", "name", F.col("n").alias("recomputed"))
    right = recorded.select("split", "name", F.col("n").alias("recorded"))
    return left.join(right, ["split", "name"], "full_outer").filter(
        ~F.col("recomputed").eqNullSafe(F.col("recorded"))
    )


def verify_summary(
    recomputed: DataFrame, stored: DataFrame, keys: Sequence[str], tolerance: float = 1e-12
) -> DataFrame:
    """Both sides hold keys, metric, value; counts go in as values with the same tolerance."""
    on = [*keys, "metric"]
    left = recomputed.select(*on, F.col("value").cast("double").alias("recomputed"))
    right = stored.select(*on, F.col("value").cast("double").alias("stored"))
    close = F.abs(F.col("recomputed") - F.col("stored")) <= tolerance
    both_null = F.col("recomputed").isNull() & F.col("stored").isNull()
    return left.join(right, on, "full_outer").filter(~(F.coalesce(close, F.lit(False)) | both_null))


def verify_fingerprints(recomputed: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows whose fingerprint differs, or that only one side has."""
    left = recomputed.select("idx", F.col("fp").alias("recomputed"))
    right = cached.select("idx", F.col("fp").alias("cached"))
    return left.join(right, "idx", "full_outer").filter(
        ~F.col("recomputed").eqNullSafe(F.col("cached"))
    )


def comparable_observations(left: DataFrame, right: DataFrame) -> DataFrame:
    """Observations (idx, label) that the two prediction sets do not share.

    A stacked aggregate: one shuffle, no join, and repeats show up as counts.
    """
    both = left.select("idx", "label", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("idx", "label", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return (
        both.groupBy("idx")
        .agg(
            F.sum("l").alias("n_left"),
            F.sum("r").alias("n_right"),
            F.min("label").alias("min_label"),
            F.max("label").alias("max_label"),
        )
        .filter("n_left <> 1 or n_right <> 1 or min_label <> max_label")
    )


def paired_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Side-by-side metrics (metric, left, right, difference) of two comparable runs."""
    a = left.select("metric", F.col("value").alias("left_value"))
    b = right.select("metric", F.col("value").alias("right_value"))
    return a.join(b, "metric", "full_outer").withColumn(
        "difference", F.col("right_value") - F.col("left_value")
    )


def tall(row: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Wide metric columns to (by..., metric, value)."""
    pairs = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns
    ]
    return row.select(*by, F.explode(F.array(*pairs)).alias("m")).select(*by, "m.metric", "m.value")
