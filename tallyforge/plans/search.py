"""Validation-only recipe search and the run matrix of linear probes."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import with_softmax
from ..operators import fitting, metrics, probe
from ..session import literal_table, stage
from ..sources.documents import exists

RESULT_SCHEMA = (
    "candidate int, l2 double, balanced boolean, max_iter int, score double, loss double, "
    "gradient_norm double, converged boolean"
)
KEY = ("l2", "balanced", "max_iter")


def validation_score(rows: DataFrame, head: probe.Head) -> float:
    scored = with_softmax(probe.score_linear(rows, head), head.k)
    tally = metrics.tallies(metrics.cells(metrics.score_frame(scored, head.k)))
    return metrics.scalars(tally, head.k).first()["macro_f1"]


def macro_f1_of_all(rows: DataFrame, fits: Sequence[fitting.Fit], k: int) -> list[float]:
    """Macro F1 of every head, from one scan."""
    cells = fitting.confusions(rows, fits).withColumns(
        {"bin": F.lit(0), **{c: F.lit(0.0) for c in ("conf", "nll", "brier")}}
    )
    scores = metrics.scalars(metrics.tallies(cells, ["candidate"]), k, ["candidate"])
    found = {r["candidate"]: r["macro_f1"] for r in scores.select("candidate", "macro_f1").collect()}
    return [found[i] for i in range(len(fits))]


def tune_probe(
    rows: DataFrame,
    k: int,
    l2: Sequence[float] = (0.001, 0.1),
    balanced: Sequence[bool] = (False,),
    max_iter: Sequence[int] = (30,),
    done: DataFrame | None = None,
    store: str | None = None,
) -> DataFrame:
    """Score every recipe of the grid on validation.

    ``rows`` has (idx, label, features, split). All recipes are fitted side by side, in the same scans
    of the training rows, and scored in one scan of the validation rows; test rows are never read.
    Recipes in ``done`` (l2, balanced, max_iter, score) or in the Parquet table ``store`` are not
    trained again; new results are appended to ``store``. A result carries the penalised loss, the
    norm of its gradient, and whether that reached the tolerance.
    """
    spark = rows.sparkSession
    grid = [fitting.Recipe(*r) for r in itertools.product(l2, balanced, max_iter)]
    kept = {}
    stored = spark.read.parquet(store) if store and exists(spark, store) else None
    for table in (done, stored):
        for r in [] if table is None else table.collect():  # as long as the grids of earlier calls
            kept[tuple(r[c] for c in KEY)] = r.asDict()
    new = [r for r in dict.fromkeys(grid) if (r.l2, r.balanced, r.max_iter) not in kept]
    if new:
        usable = stage(
            rows.filter(F.col("split").isin("train", "validation")).select("label", "features", "split"),
            "probe",
        )
        fits = fitting.fit_grid(usable.filter("split = 'train'"), k, new)
        scores = macro_f1_of_all(usable.filter("split = 'validation'"), fits, k)
        for r, fit, score in zip(new, fits, scores):
            facts = {"score": score, "loss": fit.loss, "gradient_norm": fit.gradient_norm, "converged": fit.converged}
            kept[r.l2, r.balanced, r.max_iter] = facts
    results, fresh = [], []
    for number, r in enumerate(grid):
        facts = kept[r.l2, r.balanced, r.max_iter]
        score = float(facts["score"])
        row = (number, r.l2, r.balanced, r.max_iter, score, *[facts.get(c) for c in ("loss", "gradient_norm", "converged")])
        results.append(row)
        if r in new:
            fresh.append(row)
    if store and fresh:
        literal_table(spark, fresh, RESULT_SCHEMA).coalesce(1).write.mode("append").parquet(store)
    return literal_table(spark, results, RESULT_SCHEMA)
