"""Exact AUROC with ties, distributed over the score axis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if, stage
from .classes import high_risk_ids
from .metrics import high_risk_counts, high_risk_score


RANGE_ROWS = 200_000  # distinct scores of a group that one task sorts
SUBRANGES = 4096
MAX_DEPTH = 8


def score_range(score: Column) -> Column:
    """Number of a score's first range; it rises with the score.

    Probabilities fall into ranges of 1/64 in log-odds, where scores of a model spread evenly;
    scores outside (0, 1) into ranges of 1/64 in the logarithm of their size.
    """
    inside = (score > 0) & (score < 1)
    odds = F.log(score / (1 - score)) * 64
    far = F.signum(score) * F.least(F.log1p(F.abs(score)), F.lit(800.0)) * 64
    return F.when(inside, F.floor(odds)).otherwise(
        F.floor(far) + F.when(score >= 1, 1 << 20).otherwise(-(1 << 20))
    )


def same_group(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda c, k: c & left[k].eqNullSafe(right[k]), keys, F.lit(True))


def with_ranges(collapsed: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """Rows of (by..., score, ...) with ``part``: ranges that rise with the score and hold at most
    ``limit`` rows of a group each, however close its scores lie.

    A cell starts as a fixed range. One histogram finds the cells with over half the limit; these
    are cut evenly between their own least and greatest score, counted again, and so on: each time a
    cell's scores must lie thousands of times closer to be heavy once more. Neighbouring cells are
    then joined up to half the limit. Only histograms are aggregated and joined; ``collapsed``, best
    a staged table, is read once a depth and not shuffled.
    """
    keys, half = [*by, "cell"], max(1, limit // 2)
    rows = collapsed.withColumn("cell", F.array(score_range(F.col("score"))))
    whole, fresh = None, rows
    for depth in range(MAX_DEPTH):
        counted = fresh.groupBy(*keys).agg(
            F.count("*").alias("size"), F.min("score").alias("low"), F.max("score").alias("high")
        )
        counted = stage(counted, "score-ranges")
        dense = (F.col("size") > half) & (F.col("low") < F.col("high"))
        heavy = counted.where(dense)
        n = heavy.count() if depth < MAX_DEPTH - 1 else 0
        settled = counted.where(~dense) if n else counted
        whole = settled if whole is None else whole.unionByName(settled)
        if not n:
            break
        heavy = broadcast_if(heavy.withColumnRenamed("size", "dense"), n)
        width = F.col("high") - F.col("low")
        at = F.floor(F.nanvl((F.col("score") - F.col("low")) / width, F.lit(0.0)) * SUBRANGES)
        rows = (
            rows.join(heavy, same_group(rows, heavy, keys), "left")
            .drop(*[heavy[k] for k in keys])
            .withColumn("cell", F.when(F.col("dense").isNull(), F.col("cell")).otherwise(F.concat("cell", F.array(at))))
        )
        fresh = rows.where("dense is not null")
        rows = rows.drop("dense", "low", "high")
    earlier = Window.partitionBy(*by).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    ranges = stage(whole.withColumn("part", F.floor(before / half)).select(*keys, "part"), "score-ranges")
    ranges = broadcast_if(ranges, ranges.count())
    return rows.join(ranges, same_group(rows, ranges, keys)).drop(*[ranges[k] for k in keys], "cell")


def auroc(scored: DataFrame, by: Sequence[str], limit: int = RANGE_ROWS) -> DataFrame:
    """AUROC per group of (by..., score, positive); null unless both outcomes occur.

    1. Equal scores collapse to two counts, on the map side first, so a score shared by a
       third of the rows is one row. Distinct scores are staged.
    2. They go to ranges of at most ``limit`` of them a group (one range if there are no more in
       all), found by histograms that are refined where scores are dense.
    3. Inside each range a running count of negatives gives the range's own share. This is the
       only shuffle of the distinct scores.
    4. A running sum over the few ranges adds the negatives that lie below each.
    Ties count one half. No group or class is ever sorted in one task.
    """
    by = list(by)
    collapsed = scored.groupBy(*by, "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    collapsed = stage(collapsed, "distinct-scores")
    if collapsed.count() > limit:
        ranged = with_ranges(collapsed, by, limit)
    else:
        ranged = collapsed.withColumn("part", F.lit(0).cast("bigint"))
    inside = Window.partitionBy(*by, "part").orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1
    )
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    ranges = (
        ranged.withColumn("below", below)
        .groupBy(*by, "part")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2)).alias("won"),
        )
    )
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
        .groupBy(*by)
        .agg(
            F.sum("pos").alias("n_pos"),
            F.sum("neg").alias("n_neg"),
            F.sum(F.col("won") + F.col("pos").cast("double") * F.col("below")).alias("won"),
        )
        .select(
            *by,
            F.when(
                (F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                F.col("won") / (F.col("n_pos").cast("double") * F.col("n_neg")),
            ).alias("auroc"),
        )
    )


def class_scores(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per example and class for one-vs-rest ranking.

    The outer form: a plain explode of a column infers a not-empty filter, which would be
    pushed below the softmax and compute it twice.
    """
    return predictions.select(
        *by, "label", F.posexplode_outer("probs").alias("class_id", "score")
    ).select(*by, "class_id", "score", (F.col("label") == F.col("class_id")).alias("positive"))


def auroc_per_class(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return auroc(class_scores(predictions, by), [*by, "class_id"])


def macro_auroc(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the classes that have one, and which classes those are."""
    return per_class.groupBy(*by).agg(
        F.avg("auroc").alias("macro_auroc"),
        F.array_sort(F.collect_list(F.when(F.col("auroc").isNotNull(), F.col("class_id")))).alias(
            "macro_auroc_classes"
        ),
    )


def high_risk(
    cell_rows: DataFrame, predictions: DataFrame, names: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Screening metrics of the high-risk group with its AUROC on the summed probability.

    Both parts are one row per group; they are stacked and folded, which needs no join key.
    """
    rates = ("support", "precision", "recall", "f1")
    ids = high_risk_ids(names)
    scored = predictions.select(
        *by, high_risk_score(names).alias("score"), F.col("label").isin(ids).alias("positive")
    )
    counts = high_risk_counts(cell_rows, names, by)
    if not ids:
        return counts
    parts = counts.unionByName(auroc(scored, by), allowMissingColumns=True)
    return parts.groupBy(*by).agg(*[F.max(c).alias(c) for c in (*rates, "auroc")])
