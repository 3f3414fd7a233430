"""Row and table checks. Each returns (rule, violations); :func:`enforce` raises on any."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sum_over


def report(counts: DataFrame, rules: Sequence[str]) -> DataFrame:
    """One aggregate row to one row per rule."""
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(r), F.lit(0)).alias("violations"))
                    for r in rules
                ]
            )
        ).alias("r")
    ).select("r.rule", F.col("r.violations").cast("bigint").alias("violations"))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(True)))


def enforce(checked: DataFrame, message: str) -> None:
    """Raise with the failing rules; the table holds one row per rule."""
    failed = {r["rule"]: r["violations"] for r in checked.filter("violations > 0").collect()}
    if failed:
        raise ValueError(f"{message}: {failed}")


def check_labels(rows: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Whole labels in [0, k), and at least one row."""
    y = F.col(label)
    whole = y.cast("double") == F.floor(y.cast("double"))
    counts = rows.agg(
        F.when(F.count("*") == 0, 1).otherwise(0).alias("empty"),
        _count(~whole).alias("not_whole"),
        _count((y < 0) | (y >= k)).alias("out_of_range"),
    )
    return report(counts, ["empty", "not_whole", "out_of_range"])


def _prob_rules(k: int, probs: str) -> dict[str, Column]:
    p = F.col(probs)
    shaped = F.coalesce(F.size(p) == k, F.lit(False))
    broken = F.exists(p, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    finite = shaped & ~F.coalesce(broken, F.lit(False))
    total = sum_over(p, k, lambda v: v)
    return {
        "shape": ~shaped,
        "not_finite": shaped & ~finite,
        "outside_unit": finite & F.exists(p, lambda v: (v < 0) | (v > 1)),
        "sum_not_one": finite & (F.abs(total - 1) > 2e-6),
    }


def check_probs(rows: DataFrame, k: int, probs: str = "probs") -> DataFrame:
    """k finite values in [0, 1] that sum to one within 1e-6 absolute plus relative."""
    rules = _prob_rules(k, probs)
    return report(rows.agg(*[F.count_if(c).alias(r) for r, c in rules.items()]), list(rules))


def invalid_row(k: int, probs: str = "probs", label: str = "label") -> Column:
    """True for a row that breaks any probability or label rule."""
    broken = reduce(lambda a, b: a | b, _prob_rules(k, probs).values())
    y = F.col(label)
    return F.coalesce(broken | (y < 0) | (y >= k), F.lit(True))


def check_artifact(rows: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Indices non-negative and unique, logits finite and as long as the probabilities.

    One shuffle by index: row violations are summed in the same partial aggregation that
    counts repeats.
    """
    z = F.col("logits")
    bad_logits = (F.size(z) != k) | F.exists(
        z, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    )
    per_index = rows.groupBy(*by, "idx").agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.size("probs"), F.lit(-1)) != F.coalesce(F.size(z), F.lit(-1))).alias(
            "shape"
        ),
        _count(bad_logits).alias("logits"),
    )
    counts = per_index.agg(
        F.sum(F.when(F.col("idx").isNull() | (F.col("idx") < 0), F.col("n")).otherwise(0)).alias(
            "bad_index"
        ),
        F.sum(F.col("n") - 1).alias("repeated_index"),
        F.sum("shape").alias("shape_differs"),
        F.sum("logits").alias("bad_logits"),
    )
    return report(counts, ["bad_index", "repeated_index", "shape_differs", "bad_logits"])


def check_offsets(
    offsets: DataFrame, position: str, offset: str, total: Column | str | int, bucket: int = 100_000
) -> DataFrame:
    """Offsets start at 0, strictly increase and end at ``total``; positions leave no gap.

    ``position`` should count 0, 1, 2, ... Neighbours are compared inside runs of ``bucket``
    positions; then the last row present of each run meets the first of the next run present,
    over one row per run, so no window sees the whole table. ``gap`` counts absent positions.
    """
    if isinstance(total, int):
        total = F.lit(total)
    rows = offsets.select(
        F.col(position).alias("pos"),
        F.col(offset).alias("offset"),
        (F.col(total) if isinstance(total, str) else total).alias("total"),
    ).withColumn("run", F.floor(F.col("pos") / bucket))
    inside = Window.partitionBy("run").orderBy("pos")
    runs = (
        rows.withColumn("step", F.lead("offset").over(inside) - F.col("offset"))
        .withColumn("hop", F.lead("pos").over(inside) - F.col("pos"))
        .groupBy("run")
        .agg(
            F.min("pos").alias("low"),
            F.max("pos").alias("high"),
            F.min_by("offset", "pos").alias("first"),
            F.max_by("offset", "pos").alias("last"),
            F.max("total").alias("total"),
            F.count_if(F.col("step") <= 0).alias("falls"),
            F.coalesce(F.sum(F.when(F.col("hop") > 1, F.col("hop") - 1)), F.lit(0)).alias("absent"),
        )
    )
    across = Window.orderBy("run")
    fall = F.lead("first").over(across) <= F.col("last")
    absent = F.lead("low").over(across) - F.col("high") - 1
    counts = (
        runs.withColumns({"fall": fall.cast("int"), "between": absent})
        .agg(
            F.when(F.min("low").isNull() | (F.min_by("first", "run") != 0), 1).otherwise(0).alias("start"),
            (F.sum("falls") + F.coalesce(F.sum("fall"), F.lit(0))).alias("not_increasing"),
            F.when(F.max_by("last", "run") != F.max("total"), 1).otherwise(0).alias("end"),
            (F.sum("absent") + F.coalesce(F.sum("between"), F.lit(0)) + F.min("low")).alias("gap"),
        )
        .select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("start", "not_increasing", "end", "gap")])
    )
    return report(counts, ["start", "not_increasing", "end", "gap"])


def check_inventory(required: DataFrame, present: DataFrame) -> DataFrame:
    """Per file: ok, missing or size_mismatch, and the bytes that still have to arrive."""
    joined = required.join(present, "file", "left")
    status = (
        F.when(F.col("present_bytes").isNull(), "missing")
        .when(F.col("present_bytes") != F.col("expected_bytes"), "size_mismatch")
        .otherwise("ok")
    )
    return joined.select(
        "file",
        status.alias("status"),
        F.when(status != "ok", F.col("expected_bytes")).otherwise(F.lit(0)).alias("missing_bytes"),
    )


def check_class_set(declared: Column, expected: Column) -> Column:
    """Same classes in any order, without repeats."""
    return (
        (F.size(declared) == F.size(expected))
        & (F.size(F.array_except(declared, expected)) == 0)
        & (F.size(F.array_except(expected, declared)) == 0)
    )


def check_complete_reported(status: Column) -> Column:
    """For reports a missing status counts as complete."""
    return F.coalesce(status, F.lit("complete")) == "complete"


def check_complete_member(status: Column) -> Column:
    """Ensemble members must say they are complete."""
    return F.coalesce(status == "complete", F.lit(False))


def check_compatible(runs: DataFrame, allow_mixed: bool = False) -> DataFrame:
    """Hashes present, and one (protocol, split) pair unless mixing is allowed.

    Whether pairs differ needs only the extremes of the pair, not a distinct count.
    """
    pair = F.struct("protocol_hash", "split_hash")
    blank = (F.coalesce(F.col("protocol_hash"), F.lit("")) == "") | (
        F.coalesce(F.col("split_hash"), F.lit("")) == ""
    )
    mixed = F.min(pair) != F.max(pair)
    counts = runs.agg(
        F.count_if(blank).alias("missing_hash"),
        F.when(mixed & F.lit(not allow_mixed), 1).otherwise(0).alias("mixed_protocol"),
    )
    return report(counts, ["missing_hash", "mixed_protocol"])
