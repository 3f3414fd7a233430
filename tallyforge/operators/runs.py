"""Run records, grouping across seeds and comparison statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import REPORT_METRICS
from ..functions.hashing import multiset_hash, multiset_lanes, recipe_hash, recipe_json
from ..functions.scalars import format_interval, format_metric
from ..functions.student import t_quantile_975

GROUP_KEYS = ("protocol_hash", "split_hash", "model", "mode", "image_size", "recipe_hash")


def _value(path: str, kind: str) -> Column:
    return F.try_variant_get("summary", path, kind)


def run_record(runs: DataFrame) -> DataFrame:
    """Flatten run documents to one row of metadata and held-out metrics."""
    model_name = F.coalesce(
        _value("$.model.name", "string"),
        _value("$.config.model.name", "string"),
        F.when(~_value("$.model", "string").startswith("{"), _value("$.model", "string")),
        F.lit("unknown"),
    )
    raw = "$.evaluation.test.raw"
    metrics = [
        _value(
            f"{raw}.high_risk.recall" if m == "high_risk_recall" else f"{raw}.{m}", "double"
        ).alias(m)
        for m in REPORT_METRICS
    ]
    bounds = [
        _value(f"$.evaluation.test.bootstrap.metrics.{m}.{side}", "double").alias(
            f"{m}_example_ci_{side}"
        )
        for m in ("accuracy", "macro_f1")
        for side in ("lower", "upper")
    ]
    return runs.select(
        "run",
        _value("$.status", "string").alias("status"),
        _value("$.protocol_hash", "string").alias("protocol_hash"),
        _value("$.split_hash", "string").alias("split_hash"),
        recipe_hash(F.col("summary")).alias("recipe_hash"),
        F.coalesce(_value("$.smoke_test", "boolean"), F.lit(False)).alias("smoke_test"),
        model_name.alias("model"),
        F.coalesce(
            _value("$.model.mode", "string"), _value("$.config.model.mode", "string"),
            F.lit("unknown"),
        ).alias("mode"),
        F.coalesce(
            _value("$.model.image_size", "int"), _value("$.config.model.image_size", "int")
        ).alias("image_size"),
        F.coalesce(
            _value("$.seed", "bigint"), _value("$.config.experiment.seed", "bigint")
        ).alias("seed"),
        _value("$.best_epoch", "int").alias("best_epoch"),
        _value("$.best_val_macro_f1", "double").alias("best_val_macro_f1"),
        _value("$.training_seconds", "double").alias("training_seconds"),
        _value("$.peak_gpu_memory_gb", "double").alias("peak_gpu_memory_gb"),
        _value(f"{raw}.n_examples", "bigint").alias("n_test_examples"),
        _value(raw, "variant").isNotNull().alias("has_test_metrics"),
        *metrics,
        *bounds,
    )


def filter_smoke(runs: DataFrame, include: bool = False) -> DataFrame:
    return runs if include else runs.filter(~F.coalesce(F.col("smoke_test"), F.lit(False)))


def excluded_smoke(runs: DataFrame) -> DataFrame:
    return runs.filter(F.coalesce(F.col("smoke_test"), F.lit(False)))


def distinct_protocols(runs: DataFrame) -> DataFrame:
    return runs.select("protocol_hash", "split_hash").distinct()


def duplicate_seeds(runs: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Seeds repeated inside a comparison group; must be empty."""
    return runs.groupBy(*keys, "seed").agg(F.count("*").alias("n")).filter("n > 1")


def seed_statistics(
    runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """n, mean, sample deviation and 95 % t interval per group and metric, in long form.

    Null and non-finite values drop out per metric. The aggregate stays wide, with partial
    sums per group, and only its result is unpivoted.
    """
    aggregates = []
    for m in metrics:
        value = F.col(m).cast("double")
        finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
        aggregates += [
            F.count(finite).alias(f"{m}__n"),
            F.avg(finite).alias(f"{m}__mean"),
            F.stddev_samp(finite).alias(f"{m}__std"),
        ]
    wide = runs.groupBy(*keys).agg(F.count("*").alias("n_seeds"), *aggregates)
    entries = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"{m}__n").alias("n"),
            F.col(f"{m}__mean").alias("mean"),
            F.col(f"{m}__std").alias("std"),
        )
        for m in metrics
    ]
    long = wide.select(*keys, "n_seeds", F.explode(F.array(*entries)).alias("s")).select(
        *keys, "n_seeds", "s.*"
    )
    std = F.when(F.col("n") > 1, F.col("std"))
    half = t_quantile_975(F.col("n") - 1) * std / F.sqrt(F.col("n"))
    return (
        long.withColumn("std", std)
        .withColumn("half", F.when(F.col("n") > 1, half))
        .select(
            *keys, "n_seeds", "metric", "n", "mean", "std",
            (F.col("mean") - F.col("half")).alias("ci_lower"),
            (F.col("mean") + F.col("half")).alias("ci_upper"),
        )
    )


def compare_runs(
    runs: DataFrame,
    keys: Sequence[str] = GROUP_KEYS,
    metrics: Sequence[str] = REPORT_METRICS,
) -> DataFrame:
    """One row per group with every statistic as a column."""
    stats = seed_statistics(runs, keys, metrics)
    fields = ("n", "mean", "std", "ci_lower", "ci_upper")
    columns = [
        F.max(F.when(F.col("metric") == m, F.col(f))).alias(f"{m}_{f}")
        for m in metrics
        for f in fields
    ]
    return stats.groupBy(*keys, "n_seeds").agg(*columns)


def comparison_lines(comparison: DataFrame) -> DataFrame:
    """Markdown table rows, keyed for ordering by the group."""

    def metric(name: str) -> Column:
        return format_metric(F.col(f"{name}_mean"), F.col(f"{name}_std"))

    def cell(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))

    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            F.replace(F.col("model"), F.lit("|"), F.lit("\\|")),
            cell(F.col("mode")),
            cell(F.col("image_size")),
            cell(F.col("n_seeds")),
            metric("accuracy"),
            metric("macro_f1"),
            metric("balanced_accuracy"),
            metric("ece"),
            format_interval(F.col("macro_f1_ci_lower"), F.col("macro_f1_ci_upper")),
            F.substring("protocol_hash", 1, 12),
            F.substring("recipe_hash", 1, 12),
            F.when(F.col("smoke_test"), "yes").otherwise("no"),
        ),
        F.lit(" |"),
    )
    return comparison.select(*GROUP_KEYS, line.alias("line"))


def mean_member_score(members: DataFrame, score: str = "macro_f1") -> DataFrame:
    return members.agg(F.avg(score).alias("mean_member_score"))


def replication_id(members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Identity of a member multiset (recipe, seed), whatever its order.

    It comes from sums of hashes, so a group of any size is one aggregate with partial sums. The
    report seed is the seed all members share, else the first 15 hex digits of the identity.
    """
    entry = F.concat(
        F.lit('{"recipe":'), F.coalesce("recipe", F.lit("null")),
        F.lit(',"training_seed":'), F.coalesce(F.col("seed").cast("string"), F.lit("null")), F.lit("}"),
    )
    ids = members.groupBy(*by).agg(
        F.min("seed").alias("low_seed"), F.max("seed").alias("high_seed"), *multiset_lanes(entry)
    ).withColumn("replication_id", multiset_hash())
    own = F.conv(F.substring("replication_id", 1, 15), 16, 10).cast("bigint")
    seed = F.when(F.col("low_seed") == F.col("high_seed"), F.col("low_seed")).otherwise(own)
    return ids.select(*by, F.col("n_entries").alias("n_members"), "replication_id", seed.alias("report_seed"))


def member_recipes(runs: DataFrame) -> DataFrame:
    """Run documents to (run, recipe, seed) of ensemble members."""
    return runs.select(
        "run",
        recipe_json(F.col("summary"), with_smoke=False).alias("recipe"),
        _value("$.seed", "bigint").alias("seed"),
    )


def run_matrix(recipes: DataFrame, seeds: Sequence[int], done: DataFrame) -> DataFrame:
    """Runs still to do: every recipe with every seed, less the completed ones."""
    wanted = recipes.select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    return wanted.join(done, ["recipe", "seed"], "left_anti")


def select_recipe(results: DataFrame, score: str = "score", order: str = "candidate") -> DataFrame:
    """Candidate with the largest finite score; the first one wins a tie."""
    results = results.filter(F.col(score).isNotNull() & (F.abs(score) < float("inf")))
    best = F.max(F.struct(F.col(score), (-F.col(order)).alias("o"), F.struct("*").alias("r")))
    return results.agg(best.alias("best")).select("best.r.*")
