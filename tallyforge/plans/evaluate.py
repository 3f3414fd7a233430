"""Predictions to metric tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SCALARS
from ..functions.vectors import with_softmax
from ..operators import bootstrap, calibration, checks, metrics, ranking
from ..operators.classes import check_names, high_risk_ids
from ..operators.verify import tall
from ..session import stage

BY = ("split", "variant")
ORDINAL = (
    "n_risk_targets", "n_ordered_pairs", "risk_predictions_outside_order",
    "coverage", "mae", "within_one_level_accuracy", "severe_underestimation_rate",
    "quadratic_weighted_kappa",
)


@dataclass
class Evaluation:
    """Metric tables by (split, variant); ``bootstrap`` is None if not asked for.

    ``auroc`` has a row per class, and one of class -1 for the screening group.
    """

    temperature: float
    metrics: DataFrame
    per_class: DataFrame
    auroc: DataFrame
    confusion: DataFrame
    reliability: DataFrame
    bootstrap: DataFrame | None
    n_bootstrap: int = 0
    seed: int = 0


def metric_table(cell_rows: DataFrame, ranked: DataFrame, names: Sequence[str], by=BY) -> DataFrame:
    """(by..., metric, value): scalars, ordinal, screening and ranking metrics."""
    k = len(names)
    scalar = metrics.scalars(metrics.tallies(cell_rows, by), k, by)
    parts = [tall(scalar, ["n_examples", *SCALARS], by)]

    def prefixed(row: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
        return tall(row, columns, by).withColumn(
            "metric", F.concat(F.lit(prefix + "."), F.col("metric"))
        )

    parts.append(prefixed(metrics.ordinal(cell_rows, names, by), "ordinal", ORDINAL))
    if high_risk_ids(names):
        parts.append(
            prefixed(
                metrics.high_risk_counts(cell_rows, names, by), "high_risk",
                ["support", "precision", "recall", "f1"],
            )
        )
    macro = ranked.filter("class_id >= 0").groupBy(*by).agg(F.avg("auroc").alias("macro_auroc"))
    parts.append(tall(macro, ["macro_auroc"], by))
    parts.append(
        ranked.filter("class_id < 0").select(
            *by, F.lit("high_risk.auroc").alias("metric"), F.col("auroc").alias("value")
        )
    )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def ranking_scores(scored: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One-vs-rest scores of every class, and the screening group as class -1."""
    ids = high_risk_ids(names)
    one_vs_rest = F.transform(
        "probs",
        lambda p, i: F.struct(
            i.alias("class_id"), p.alias("score"), (F.col("label") == i).alias("positive")
        ),
    )
    if ids:
        group = F.struct(
            F.lit(-1).alias("class_id"),
            metrics.high_risk_score(names).alias("score"),
            F.col("label").isin(ids).alias("positive"),
        )
        one_vs_rest = F.array_append(one_vs_rest, group)
    return scored.select(*by, F.explode(one_vs_rest).alias("s")).select(*by, "s.*")


def variants(predictions: DataFrame, k: int, temperature: float) -> DataFrame:
    """Raw and calibrated probabilities of each row, from one read of its logits."""
    both = with_softmax(predictions, k, 1.0, out="raw")
    both = with_softmax(both, k, temperature, out="calibrated")
    pair = F.array(
        F.struct(F.lit("raw").alias("variant"), F.col("raw").alias("probs")),
        F.struct(F.lit("calibrated").alias("variant"), F.col("calibrated").alias("probs")),
    )
    return both.select("split", "idx", "label", F.explode(pair).alias("v")).select(
        "split", "idx", "label", "v.variant", "v.probs"
    )


def evaluate(
    predictions: DataFrame,
    names: Sequence[str],
    n_bootstrap: int = 1000,
    seed: int = 42,
    calibrate: bool = True,
    bootstrap_split: str = "test",
) -> Evaluation:
    """Evaluate (split, idx, label, logits). The temperature sees validation rows only.

    The four columns are staged once: the rounds of the fit, the cells and the ranking read them
    from there, and what made the logits runs once.
    """
    check_names(names)
    k = len(names)
    predictions = stage(predictions.select("split", "idx", "label", "logits"), "logits")
    temperature = 1.0
    if calibrate:
        temperature = calibration.fit_temperature(
            predictions.filter("split = 'validation'").select("label", "logits"), k
        )
    scored = variants(predictions, k, temperature)
    if not calibrate:
        scored = scored.filter("variant = 'raw'")
    return evaluate_scored(
        scored, names, temperature, n_bootstrap, seed, bootstrap_split
    )


def evaluate_scored(
    scored: DataFrame,
    names: Sequence[str],
    temperature: float,
    n_bootstrap: int,
    seed: int,
    bootstrap_split: str = "test",
) -> Evaluation:
    k = len(names)
    flag = checks.invalid_row(k).alias("invalid")
    frame = stage(metrics.score_frame(scored, k, [*BY, "idx", flag]), "scores")
    checks.enforce(
        frame.agg(
            F.when(F.count("*") == 0, 1).otherwise(0).alias("empty"),
            F.count_if("invalid").alias("invalid_rows"),
        ).transform(lambda counts: checks.report(counts, ["empty", "invalid_rows"])),
        "invalid predictions",
    )
    cell_rows = stage(metrics.cells(frame, BY), "cells")
    tally = metrics.tallies(cell_rows, BY)
    resampled = None
    if n_bootstrap:
        resampled = bootstrap.frame_ci(
            frame.filter((F.col("split") == bootstrap_split) & (F.col("variant") == "raw")),
            k, n_bootstrap, seed,
        )
    ranked = stage(ranking.auroc(ranking_scores(scored, names, BY), [*BY, "class_id"]), "auroc")
    return Evaluation(
        temperature=temperature,
        metrics=metric_table(cell_rows, ranked, names),
        auroc=ranked,
        per_class=metrics.per_class(tally, k, BY),
        confusion=metrics.confusion(cell_rows, k, BY),
        reliability=metrics.reliability_bins(tally, by=BY),
        bootstrap=resampled,
        n_bootstrap=n_bootstrap,
        seed=seed,
    )
