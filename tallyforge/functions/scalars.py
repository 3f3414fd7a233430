"""Small scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0 where the denominator is 0 (ANSI division would raise)."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def canonical_name(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "- ", "__")


def canonical_text(name: str) -> str:
    """Driver-side twin of :func:`canonical_name` for class lists."""
    return name.strip().lower().translate(str.maketrans("- ", "__"))


def pinned_revision(revision: Column) -> Column:
    return F.coalesce(revision.rlike("^[0-9a-fA-F]{40}$"), F.lit(False))


def smoke_flag(
    max_shards: Column, max_train_batches: Column, max_eval_batches: Column, pretrained: Column
) -> Column:
    """A run on a subset, with bounded batches or without pretrained weights is a smoke run."""

    def set_to_value(c: Column) -> Column:
        return F.coalesce(c, F.lit(0)) != 0

    return (
        set_to_value(max_shards)
        | set_to_value(max_train_batches)
        | set_to_value(max_eval_batches)
        | ~F.coalesce(pretrained, F.lit(False))
    )


def format_metric(mean: Column, std: Column) -> Column:
    """``0.1234 ± 0.0123``; only the mean without a spread, a dash without a mean."""
    return (
        F.when(mean.isNull(), F.lit("—"))
        .when(std.isNull(), F.format_string("%.4f", mean))
        .otherwise(F.format_string("%.4f ± %.4f", mean, std))
    )


def format_interval(lower: Column, upper: Column) -> Column:
    return F.when(lower.isNull(), F.lit("—")).otherwise(
        F.format_string("[%.4f, %.4f]", lower, upper)
    )
