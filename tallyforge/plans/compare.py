"""Run documents to comparison tables and report files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, runs
from ..session import literal_table, stage
from ..sources.runs import scan_runs

# Head of the Markdown comparison table.
HEADER = (
    "| Model | Mode | Size | Seeds | Accuracy | Macro F1 | Balanced accuracy | ECE "
    "| Macro F1 mean 95% CI | Protocol | Recipe | Smoke |"
)
RULE = "|---|---|---:|---:|---:|---:|---:|---:|---|---|---|---|"
KEYS = (*runs.GROUP_KEYS, "smoke_test")


@dataclass
class Comparison:
    """Run rows, one row per group, the seeds of each group, and the excluded smoke runs."""

    runs: DataFrame
    groups: DataFrame
    seeds: DataFrame
    excluded: DataFrame


def compare_documents(
    documents: DataFrame, allow_mixed: bool = False, include_smoke: bool = False
) -> Comparison:
    everything = stage(runs.run_record(documents), "runs")
    excluded = runs.excluded_smoke(everything).limit(0) if include_smoke else (
        runs.excluded_smoke(everything)
    )
    kept = runs.filter_smoke(everything, include_smoke)
    found = kept.agg(
        F.when(F.count("*") == 0, 1).otherwise(0).alias("no_runs"),
        F.count_if(~checks.check_complete_reported(F.col("status"))).alias("not_complete"),
        F.count_if(~F.col("has_test_metrics")).alias("no_test_metrics"),
        F.count_if(F.col("seed").isNull()).alias("no_seed"),
    )
    rules = checks.report(found, ["no_runs", "not_complete", "no_test_metrics", "no_seed"])
    repeated = runs.duplicate_seeds(kept).agg(
        F.lit("duplicate_seed").alias("rule"), F.count("*").alias("violations")
    )
    rules = rules.unionByName(checks.check_compatible(kept, allow_mixed)).unionByName(repeated)
    checks.enforce(rules, "runs cannot be compared")
    return Comparison(
        runs=kept,
        groups=runs.compare_runs(kept, KEYS),
        seeds=kept.select(*KEYS, "seed"),
        excluded=excluded,
    )


def report_lines(comparison: DataFrame) -> DataFrame:
    """Markdown lines with their order: a header, then groups by key."""
    body = runs.comparison_lines(comparison)
    head = literal_table(
        comparison.sparkSession, [(0, HEADER), (1, RULE)], "part int, line string"
    )
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in runs.GROUP_KEYS]
    empty = [F.lit("").alias(k) for k in runs.GROUP_KEYS]
    return head.select("part", *empty, "line").unionByName(
        body.select(F.lit(2).alias("part"), *keys, "line")
    )


def write_report(result: Comparison, out: str) -> None:
    """runs, comparison and seeds as CSV, comparison as JSON lines, the table as Markdown text.

    Groups are as few as recipes, so each report is one ordered file; runs stay partitioned. Tables
    of one row a run are gzipped, which readers of CSV and text undo by the files' names.
    """
    groups = stage(result.groups, "comparison")
    ordered = groups.orderBy(*KEYS).coalesce(1)
    result.runs.write.mode("overwrite").option("header", True).csv(f"{out}/runs.csv", compression="gzip")
    ordered.write.mode("overwrite").option("header", True).csv(f"{out}/comparison.csv")
    ordered.write.mode("overwrite").json(f"{out}/comparison.json")
    result.seeds.write.mode("overwrite").option("header", True).csv(f"{out}/seeds.csv", compression="gzip")
    result.excluded.select("run").write.mode("overwrite").text(f"{out}/excluded", compression="gzip")
    lines = report_lines(groups).orderBy("part", *runs.GROUP_KEYS).coalesce(1)
    lines.select("line").write.mode("overwrite").text(f"{out}/comparison.md")


def compare(
    spark: SparkSession,
    paths: str | Sequence[str],
    out: str,
    allow_mixed: bool = False,
    include_smoke: bool = False,
) -> Comparison:
    result = compare_documents(scan_runs(spark, paths), allow_mixed, include_smoke)
    write_report(result, out)
    return result
