"""Classification, calibration, ordinal and screening metrics.

One wide pass reduces predictions to *cells* (true class, predicted class, confidence bin)
with additive sums. Cells number at most classes² x bins per group whatever the row count,
combine on the map side, and every scalar below is derived from them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ECE_BINS
from ..functions.scalars import ratio_or_null, safe_div
from ..functions.vectors import argmax, at, clip_probability, confidence_bin, element, sum_over
from .classes import class_ranks, high_risk_ids, lookup

FRAME_COLUMNS = ("label", "pred", "conf", "bin", "nll", "brier")


def score_frame(
    predictions: DataFrame, k: int, keep: Sequence[str] = (), n_bins: int = ECE_BINS
) -> DataFrame:
    """Narrow per-row frame; nothing downstream touches the arrays again.

    Keys are non-null (-1 for a row without label or probabilities, which the checks
    reject). Otherwise a join on a key derived from them would infer a not-null filter and
    push it, with all the arithmetic behind it, below these projections.
    """
    p, y = F.col("probs"), F.col("label")
    missing, nothing = F.lit(-1), F.lit(float("nan"))
    target = F.coalesce(at(p, y), nothing)
    top = F.coalesce(F.array_max(p), nothing)
    return predictions.select(
        *keep,
        F.coalesce(y.cast("int"), missing).alias("label"),
        F.coalesce(argmax(p), missing).alias("pred"),
        top.alias("conf"),
        F.coalesce(confidence_bin(F.array_max(p), n_bins), missing).alias("bin"),
        (-F.log(clip_probability(target))).alias("nll"),
        (sum_over(p, k, lambda v: v * v) - 2 * target + 1).alias("brier"),
    )


def cells(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return frame.groupBy(*by, "label", "pred", "bin").agg(
        F.count("*").alias("n"),
        F.sum("conf").alias("conf"),
        F.sum("nll").alias("nll"),
        F.sum("brier").alias("brier"),
    )


def tallies(cell_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells folded to per-class and per-bin sums, in one shuffle of small rows.

    kind 'class': support, predicted, hit. kind 'bin': support, hit, conf, nll, brier.
    """
    n, zero, nothing = F.col("n"), F.lit(0).cast("bigint"), F.lit(0.0)
    right = F.col("label") == F.col("pred")
    hit = F.when(right, n).otherwise(zero)

    def entry(kind: str, key: str, support: Column, predicted: Column, hits: Column, sums) -> Column:
        conf, nll, brier = sums
        return F.struct(
            F.lit(kind).alias("kind"), F.col(key).alias("key"), support.alias("support"),
            predicted.alias("predicted"), hits.alias("hit"), conf.alias("conf"),
            nll.alias("nll"), brier.alias("brier"),
        )

    empty = (nothing, nothing, nothing)
    entries = F.array(
        entry("class", "label", n, zero, hit, empty),
        entry("class", "pred", zero, n, zero, empty),
        entry("bin", "bin", n, zero, hit, (F.col("conf"), F.col("nll"), F.col("brier"))),
    )
    return merge_tallies(cell_rows.select(*by, F.explode(entries).alias("t")).select(*by, "t.*"), by)


def merge_tallies(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tallies add up: over partitions, files, batches or resamples."""
    sums = ("support", "predicted", "hit", "conf", "nll", "brier")
    return parts.groupBy(*by, "kind", "key").agg(*[F.sum(c).alias(c) for c in sums])


def _rates() -> tuple[Column, Column, Column]:
    precision = safe_div(F.col("hit"), F.col("predicted"))
    recall = safe_div(F.col("hit"), F.col("support"))
    return precision, recall, safe_div(2 * precision * recall, precision + recall)


def per_class(tally: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every declared class; 0/0 counts as 0."""
    dense = _dense(tally, by, k, "class_id")
    found = tally.filter("kind = 'class'").withColumnRenamed("key", "class_id")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "predicted", "hit")]
    precision, recall, f1 = _rates()
    return (
        dense.join(found, [*by, "class_id"], "left")
        .select(*by, "class_id", *zero)
        .select(*by, "class_id", "support", precision.alias("precision"), recall.alias("recall"),
                f1.alias("f1"))
    )


def _dense(rows: DataFrame, by: Sequence[str], size: int, name: str) -> DataFrame:
    """Every position 0..size-1 for every group that occurs."""
    positions = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name)
    if by:
        return rows.select(*by).distinct().select(*by, positions)
    one = rows.sparkSession.range(1, numPartitions=1)
    return one.select(positions)


def scalars(tally: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The seven scalars in one aggregate over the tallies.

    Balanced accuracy averages the classes that occur; macro F1 all declared ones.
    """
    is_class, is_bin = F.col("kind") == "class", F.col("kind") == "bin"
    _, recall, f1 = _rates()
    support, count = F.col("support"), F.sum(F.when(is_bin, F.col("support")))
    gap = F.abs(safe_div(F.col("hit"), support) - safe_div(F.col("conf"), support)) * support

    def over(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value))

    return tally.groupBy(*by).agg(
        count.alias("n_examples"),
        (over(is_bin, F.col("hit")) / count).alias("accuracy"),
        F.avg(F.when(is_class & (support > 0), recall)).alias("balanced_accuracy"),
        (over(is_class, f1) / k).alias("macro_f1"),
        (over(is_class, f1 * support) / count).alias("weighted_f1"),
        (over(is_bin, F.col("nll")) / count).alias("nll"),
        (over(is_bin, F.col("brier")) / count).alias("brier"),
        (over(is_bin, gap) / count).alias("ece"),
    )


def mean_nll(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log-likelihood alone: reads labels and probabilities once."""
    loss = -F.log(clip_probability(at(F.col("probs"), F.col("label"))))
    return predictions.groupBy(*by).agg(F.avg(loss).alias("nll"))


def mean_brier(predictions: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    p = F.col("probs")
    score = sum_over(p, k, lambda v: v * v) - 2 * at(p, F.col("label")) + 1
    return predictions.groupBy(*by).agg(F.avg(score).alias("brier"))


def confusion(cell_rows: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Dense true x predicted counts."""
    flat = (F.col("label") * k + F.col("pred")).alias("flat")
    found = cell_rows.groupBy(*by, flat).agg(F.sum("n").alias("n"))
    return (
        _dense(cell_rows, by, k * k, "flat")
        .join(found, [*by, "flat"], "left")
        .select(
            *by,
            F.floor(F.col("flat") / k).cast("int").alias("label"),
            (F.col("flat") % k).cast("int").alias("pred"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def confusion_normalized(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fractions of each true class; rows without examples are 0. Input: k² rows."""
    support = matrix.groupBy(*by, "label").agg(F.sum("n").alias("support"))
    return matrix.join(support, [*by, "label"]).select(
        *by, "label", "pred", safe_div(F.col("n"), F.col("support")).alias("fraction")
    )


def reliability_bins(tally: DataFrame, n_bins: int = ECE_BINS, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width confidence bins, empty ones included with null rates."""
    if n_bins < 1:
        raise ValueError("n_bins must be positive")
    found = tally.filter("kind = 'bin'").withColumnRenamed("key", "bin")
    n = F.coalesce(F.col("support"), F.lit(0))
    return (
        _dense(tally, by, n_bins, "bin")
        .join(found, [*by, "bin"], "left")
        .select(
            *by,
            "bin",
            (F.col("bin") / n_bins).alias("lower"),
            ((F.col("bin") + 1) / n_bins).alias("upper"),
            n.alias("count"),
            ratio_or_null(F.col("hit"), F.col("support")).alias("accuracy"),
            ratio_or_null(F.col("conf"), F.col("support")).alias("confidence"),
        )
    )


def expected_calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ECE from a reliability table."""
    gap = F.coalesce(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("count"), F.lit(0.0))
    return bins.groupBy(*by).agg((F.sum(gap) / F.sum("count")).alias("ece"))


def high_risk_counts(cell_rows: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Screening metrics of the high-risk group without AUROC; no rows if no class is in it."""
    ids = high_risk_ids(names)
    if not ids:
        return cell_rows.groupBy(*by).agg(F.lit(None).alias("support")).limit(0)
    actual, flagged, n = F.col("label").isin(ids), F.col("pred").isin(ids), F.col("n")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    counts = cell_rows.groupBy(*by).agg(
        total(actual & flagged).alias("tp"),
        total(~actual & flagged).alias("fp"),
        total(actual & ~flagged).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by,
        (tp + fn).alias("support"),
        safe_div(tp, tp + fp).alias("precision"),
        ratio_or_null(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def high_risk_score(names: Sequence[str]) -> Column:
    """Summed probability of the screening group."""
    p = F.col("probs")
    return reduce(lambda total, i: total + element(p, i), high_risk_ids(names), F.lit(0.0))


def _ranked(cell_rows: DataFrame, names: Sequence[str]) -> DataFrame:
    ranks = class_ranks(names)
    return cell_rows.withColumn("true_rank", lookup(ranks, F.col("label"), "int")).withColumn(
        "pred_rank", lookup(ranks, F.col("pred"), "int")
    )


def ordinal(cell_rows: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Errors on the ordered classes, with coverage; rates are null without a pair.

    Kappa weighs squared rank distance against the distance expected from the marginals:
    the expected sum Σ n_i m_j (i-j)² needs only first and second moments of the ranks, so it
    is one aggregate. It is null where truth and prediction are one single rank.
    """
    n, t, p = F.col("n"), F.col("true_rank"), F.col("pred_rank")
    target, pair = t.isNotNull(), t.isNotNull() & p.isNotNull()
    diff = p - t

    def total(condition: Column, value: Column = F.lit(1)) -> Column:
        return F.coalesce(F.sum(F.when(condition, n * value)), F.lit(0))

    sums = _ranked(cell_rows, names).groupBy(*by).agg(
        total(target).alias("n_risk_targets"),
        total(pair).alias("n_ordered_pairs"),
        total(target & p.isNull()).alias("risk_predictions_outside_order"),
        total(pair, F.abs(diff)).alias("abs_diff"),
        total(pair & (F.abs(diff) <= 1)).alias("near"),
        total(pair & (diff <= -2)).alias("severe"),
        total(pair, diff * diff).alias("sq"),
        total(pair, t).alias("t1"), total(pair, t * t).alias("t2"),
        total(pair, p).alias("p1"), total(pair, p * p).alias("p2"),
        F.min(F.when(pair & (n > 0), F.least(t, p))).alias("low"),
        F.max(F.when(pair & (n > 0), F.greatest(t, p))).alias("high"),
    )
    pairs = F.col("n_ordered_pairs").cast("double")
    chance = F.col("t2") + F.col("p2") - F.try_divide(
        2 * F.col("t1").cast("double") * F.col("p1").cast("double"), pairs
    )
    kappa = F.when(F.col("low") < F.col("high"), 1 - F.try_divide(F.col("sq").cast("double"), chance))
    return sums.select(
        *by,
        "n_risk_targets",
        "n_ordered_pairs",
        "risk_predictions_outside_order",
        ratio_or_null(F.col("n_ordered_pairs"), F.col("n_risk_targets")).alias("coverage"),
        ratio_or_null(F.col("abs_diff"), pairs).alias("mae"),
        ratio_or_null(F.col("near"), pairs).alias("within_one_level_accuracy"),
        ratio_or_null(F.col("severe"), pairs).alias("severe_underestimation_rate"),
        kappa.alias("quadratic_weighted_kappa"),
    )


def risk_error_groups(cell_rows: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Error groups over *all* risk targets, plus accuracy on the unranked classes."""
    n, t, p = F.col("n"), F.col("true_rank"), F.col("pred_rank")
    target = t.isNotNull()

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    sums = _ranked(cell_rows, names).groupBy(*by).agg(
        total(target).alias("risk_targets"),
        total(target & (t == p)).alias("exact"),
        total(target & p.isNull()).alias("outside"),
        total(t > p).alias("under"),
        total(t - p >= 2).alias("under_two"),
        total(F.abs(t - p) <= 1).alias("within_one"),
        total(t.isNull()).alias("unranked_targets"),
        total(t.isNull() & (F.col("label") == F.col("pred"))).alias("unranked_exact"),
    )
    targets = F.col("risk_targets")
    return sums.withColumns(
        {
            "exact_rate": safe_div(F.col("exact"), targets),
            "outside_rate": safe_div(F.col("outside"), targets),
            "within_one_rate": safe_div(F.col("within_one"), targets),
            "unranked_rate": safe_div(F.col("unranked_exact"), F.col("unranked_targets")),
        }
    )


def top_confusions(matrix: DataFrame, k: int, limit: int = 10) -> DataFrame:
    """Largest off-diagonal cells; among equals the later cell of the matrix comes first."""
    support = matrix.groupBy("label").agg(F.sum("n").alias("support"))
    errors = F.when(F.col("label") == F.col("pred"), 0).otherwise(F.col("n"))
    return (
        matrix.join(support, "label")
        .withColumn("flat", F.col("label") * k + F.col("pred"))
        .orderBy(errors.desc(), F.col("flat").desc())
        .limit(limit)
        .select("label", "pred", "n", safe_div(F.col("n"), F.col("support")).alias("fraction"))
    )


def cross_entropy(
    predictions: DataFrame,
    k: int,
    smoothing: float = 0.0,
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """Mean per-row cross entropy of logits, divided by the row count even with weights."""
    z = F.col("logits")
    log_sum = F.col("largest") + F.log(
        sum_over(z, k, lambda v: F.exp(v - F.col("largest")))
    )
    weight = [float(v) for v in (weights or [1.0] * k)]
    w = F.array(*[F.lit(v) for v in weight])
    log_p = [element(z, i) - F.col("log_sum") for i in range(k)]
    spread = reduce(
        lambda total, i: total + weight[i] * log_p[i], range(1, k), weight[0] * log_p[0]
    )
    own = at(w, F.col("label")) * (at(z, F.col("label")) - F.col("log_sum"))
    loss = -((1.0 - smoothing) * own + (smoothing / k) * spread)
    return (
        predictions.withColumn("largest", F.array_max(z))
        .withColumn("log_sum", log_sum)
        .agg(F.avg(loss).alias("cross_entropy"))
    )


def class_weights(counts: DataFrame, k: int) -> DataFrame:
    """Loss weight total/(k*count), 0 for an absent class; sampler weight 1/count.

    Input: one row per declared class (class_id, n).
    """
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("total", total).select(
        "class_id",
        "n",
        safe_div(F.col("total"), k * F.col("n")).alias("loss_weight"),
        safe_div(F.lit(1.0), F.col("n")).alias("sampler_weight"),
    )
