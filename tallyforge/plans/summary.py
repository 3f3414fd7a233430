"""Metric tables to the nested run document, and back into a run folder."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BOOTSTRAP_METHOD, CONFIDENCE_LEVEL, ENSEMBLE_NAME
from ..functions.hashing import protocol_hash
from ..operators import runs
from ..operators.classes import high_risk_ids
from ..sources import documents
from ..sources.predictions import write_predictions
from .ensemble import Ensemble
from .evaluate import Evaluation, evaluate

COUNTS = (
    "n_examples", "high_risk.support", "ordinal.n_risk_targets", "ordinal.n_ordered_pairs",
    "ordinal.risk_predictions_outside_order",
)


def expected_protocol(
    spark: SparkSession, data_revision: str, split_hash: str, names: Sequence[str]
) -> str:
    row = spark.range(1, numPartitions=1).select(
        protocol_hash(
            F.lit(data_revision), F.lit(split_hash), F.array(*[F.lit(n) for n in names])
        ).alias("h")
    )
    return row.first()["h"]


def evaluation_document(result: Evaluation, names: Sequence[str], bootstrap_split: str = "test") -> dict:
    """{split: {raw, calibrated, temperature, bootstrap}}; undefined values are null.

    What reaches the driver is metric tables: per split and variant, classes² counts at most.
    """
    found: dict = defaultdict(lambda: defaultdict(dict))
    for r in result.metrics.collect():
        target = found[r["split"]][r["variant"]]
        *parents, leaf = r["metric"].split(".")
        for parent in parents:
            target = target.setdefault(parent, {})
        whole = r["metric"] in COUNTS and r["value"] is not None
        target[leaf] = int(r["value"]) if whole else r["value"]
    for r in result.per_class.collect():
        rows = found[r["split"]][r["variant"]].setdefault("per_class", {})
        rows[names[r["class_id"]]] = {
            c: r[c] for c in ("precision", "recall", "f1", "support")
        }
    for r in result.auroc.filter("class_id >= 0").orderBy("class_id").collect():
        metrics = found[r["split"]][r["variant"]]
        metrics["per_class"][names[r["class_id"]]]["auroc"] = r["auroc"]
        ranked = metrics.setdefault("macro_auroc_classes", [])
        if r["auroc"] is not None:
            ranked.append(names[r["class_id"]])
    size = len(names)
    for r in result.confusion.collect():
        matrix = found[r["split"]][r["variant"]].setdefault(
            "confusion_matrix", [[0] * size for _ in range(size)]
        )
        matrix[r["label"]][r["pred"]] = r["n"]
    for by_variant in found.values():
        for metrics in by_variant.values():
            metrics["class_names"] = list(names)
            if not high_risk_ids(names):
                metrics["high_risk"] = None
        by_variant["temperature"] = result.temperature
    if result.bootstrap is not None:
        found[bootstrap_split]["bootstrap"] = {
            "method": BOOTSTRAP_METHOD,
            "n_bootstrap": result.n_bootstrap,
            "seed": result.seed,
            "confidence_level": CONFIDENCE_LEVEL,
            "metrics": {
                r["metric"]: {c: r[c] for c in ("estimate", "lower", "upper")}
                for r in result.bootstrap.collect()
            },
        }
    return {split: dict(parts) for split, parts in found.items()}


def evaluate_run(
    spark: SparkSession,
    run_dir: str,
    predictions: DataFrame,
    names: Sequence[str],
    split: str = "test",
    n_bootstrap: int = 1000,
    seed: int = 42,
    data_revision: str | None = None,
) -> dict:
    """Evaluate a completed run's predictions and record them in its folder.

    ``predictions`` holds (split, idx, label, logits) of validation and of ``split``. With a
    data revision the recorded protocol hash is recomputed first.
    """
    path = f"{run_dir.rstrip('/')}/summary.json"
    summary = documents.read_document(spark, path)
    if summary.get("status") != "complete":
        raise ValueError("only a run with status complete can be evaluated")
    if data_revision is not None:
        wanted = expected_protocol(spark, data_revision, summary["split_hash"], names)
        if summary["protocol_hash"] != wanted:
            raise ValueError("protocol of the data is not the one the run was trained on")
    result = evaluate(predictions, names, n_bootstrap, seed, bootstrap_split=split)
    summary.setdefault("evaluation", {})[split] = evaluation_document(result, names, split)[split]
    documents.write_document(spark, path, summary)
    return summary


def write_ensemble(
    spark: SparkSession,
    result: Ensemble,
    members: DataFrame,
    names: Sequence[str],
    out: str,
    bootstrap_seed: int = 42,
) -> dict:
    """Predictions, a run document that comparisons accept, and beside it what was calibrated and
    configured. ``members`` are run documents; their list is declared, so it is short."""
    path = f"{out.rstrip('/')}/summary.json"
    if documents.exists(spark, path):
        raise FileExistsError(f"{out} holds something already; an ensemble is written once")
    common = members.agg(
        F.min(F.variant_get("summary", "$.protocol_hash", "string")).alias("protocol_hash"),
        F.min(F.variant_get("summary", "$.split_hash", "string")).alias("split_hash"),
        F.coalesce(
            F.bool_or(F.try_variant_get("summary", "$.smoke_test", "boolean")), F.lit(False)
        ).alias("smoke_test"),
    ).first()
    identity = runs.replication_id(runs.member_recipes(members)).first()
    listed = members.withColumn("sha256", F.sha2(F.to_json("summary"), 256)).select(
        "run", "sha256", F.col("summary")
    )
    listed = sorted(
        runs.member_recipes(listed).join(listed.select("run", "sha256"), "run").collect(), key=lambda r: r["run"]
    )
    recipes = sorted(r["recipe"] for r in listed)
    model = {
        "name": ENSEMBLE_NAME, "mode": "ensemble", "image_size": None,
        "member_recipes": recipes, "n_members": len(recipes),
    }
    summary = {
        "status": "complete",
        "config": {"model": model, "training": {}, "experiment": {"seed": identity["report_seed"]}},
        "model": model,
        "seed": identity["report_seed"],
        "bootstrap_seed": bootstrap_seed,
        "replication_id": identity["replication_id"],
        "replication_members": sorted(
            ({"recipe": r["recipe"], "training_seed": r["seed"]} for r in listed), key=lambda m: (m["recipe"], m["training_seed"])
        ),
        "member_training_seeds": [r["seed"] for r in listed],
        "members": [
            {"run": r["run"], "seed": r["seed"], "summary_sha256": r["sha256"], "weight": 1 / len(listed)} for r in listed
        ],
        "class_names": list(names),
        "calibration": {"fit_split": "validation", "temperature": result.evaluation.temperature},
        "mean_member_validation_macro_f1": result.mean_member_score.first()["mean_member_score"],
        "evaluation": evaluation_document(result.evaluation, names),
        **common.asDict(),
    }
    summary["best_val_macro_f1"] = summary["evaluation"]["validation"]["raw"]["macro_f1"]
    write_predictions(
        result.predictions.withColumn("run", F.lit("ensemble")), f"{out.rstrip('/')}/predictions"
    )
    for name in ("calibration", "config"):
        documents.write_document(spark, f"{out.rstrip('/')}/{name}.json", summary[name])
    documents.write_document(spark, path, summary, replace=False)
    return summary
