"""Check members, average them, calibrate on validation, evaluate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import with_softmax
from ..operators import calibration, checks, ensemble, metrics, runs
from ..session import stage
from .evaluate import Evaluation, evaluate_scored


@dataclass
class Ensemble:
    predictions: DataFrame
    evaluation: Evaluation
    identity: DataFrame | None
    mean_member_score: DataFrame


HELD_OUT = ("validation", "test")


def evaluated(split: str) -> Column:
    """Whether a run document records metrics of a split."""
    raw = F.try_variant_get("summary", f"$.evaluation.{split}.raw", "variant")
    return raw.isNotNull() & ~F.coalesce(F.is_variant_null(raw), F.lit(True))


def check_documents(documents: DataFrame, expected_names: Sequence[str]) -> None:
    """Members must be different runs, complete, seeded, evaluated on both held-out splits, of one
    protocol and of the given class list."""
    names = F.try_variant_get("summary", "$.class_names", "array<string>")
    wanted = F.array(*[F.lit(n) for n in expected_names])
    seed = F.try_variant_get("summary", "$.seed", "bigint")
    record = documents.select(
        F.try_variant_get("summary", "$.status", "string").alias("status"),
        F.try_variant_get("summary", "$.protocol_hash", "string").alias("protocol_hash"),
        F.try_variant_get("summary", "$.split_hash", "string").alias("split_hash"),
        F.coalesce(names == wanted, F.lit(False)).alias("same_classes"),
        F.coalesce(seed >= 0, F.lit(False)).alias("seeded"),
        F.forall(F.array(*[evaluated(s) for s in HELD_OUT]), lambda e: e).alias("evaluated"),
        "run",
    )
    found = record.agg(
        F.count_if(~checks.check_complete_member(F.col("status"))).alias("not_complete"),
        F.count_if(~F.col("same_classes")).alias("class_schema"),
        F.count_if(~F.col("seeded")).alias("seed"),
        F.count_if(~F.col("evaluated")).alias("not_evaluated"),
    )
    repeated = record.groupBy("run").agg((F.count("*") - 1).alias("again")).agg(
        F.lit("repeated_member").alias("rule"), F.coalesce(F.sum("again"), F.lit(0)).alias("violations")
    )
    rules = (
        checks.report(found, ["not_complete", "class_schema", "seed", "not_evaluated"])
        .unionByName(checks.check_compatible(record.drop("run")))
        .unionByName(repeated)
    )
    checks.enforce(rules, "incompatible ensemble members")


def average(members: DataFrame, k: int, n_members: int) -> DataFrame:
    """Aligned equal-weight mean as a staged table (split, idx, label, probs, logits)."""
    if n_members < 2:
        raise ValueError("an ensemble needs at least two members")
    artifact = checks.check_artifact(members, k, ["run", "split"])
    valid = checks.check_probs(members, k).unionByName(checks.check_labels(members, k))
    checks.enforce(artifact.unionByName(valid), "invalid member predictions")
    aligned = stage(ensemble.align_members(members, k), "aligned")
    overlap = ensemble.members_overlap(aligned).agg(
        F.lit("split_overlap").alias("rule"), F.count("*").alias("violations")
    )
    absent = aligned.agg(
        F.lit("missing_split").alias("rule"),
        sum((F.count_if(F.col("split") == s) == 0).cast("bigint") for s in HELD_OUT).alias("violations"),
    )
    checks.enforce(
        ensemble.check_members(aligned, n_members).unionByName(overlap).unionByName(absent),
        "members do not hold the same observations",
    )
    return stage(ensemble.ensemble_mean(aligned, k, n_members), "ensemble")


def ensemble_runs(
    members: DataFrame,
    names: Sequence[str],
    n_members: int,
    documents: DataFrame | None = None,
    n_bootstrap: int = 1000,
    seed: int = 42,
) -> Ensemble:
    """Ensemble of a declared member list, evaluated on both held-out splits.

    Test labels never reach the calibration: it reads validation rows only. Raw metrics use
    the mean itself, calibrated ones the softmax of its scaled log-probabilities.
    """
    k = len(names)
    identity = None
    if documents is not None:
        check_documents(documents, names)
        identity = runs.replication_id(runs.member_recipes(documents))
    mean = average(members, k, n_members)
    validation = mean.filter("split = 'validation'").select("label", "logits")
    temperature = calibration.fit_temperature(validation, k)
    columns = ["split", "idx", "label", "variant", "probs"]
    raw = mean.withColumn("variant", F.lit("raw")).select(columns)
    calibrated = (
        with_softmax(mean, k, temperature)
        .withColumn("variant", F.lit("calibrated"))
        .select(columns)
    )
    member_cells = metrics.cells(
        metrics.score_frame(members.filter("split = 'validation'"), k, ["run"]), ["run"]
    )
    member_scores = metrics.scalars(metrics.tallies(member_cells, ["run"]), k, ["run"])
    return Ensemble(
        predictions=mean,
        evaluation=evaluate_scored(
            raw.unionByName(calibrated), names, temperature, n_bootstrap, seed
        ),
        identity=identity,
        mean_member_score=runs.mean_member_score(member_scores),
    )
