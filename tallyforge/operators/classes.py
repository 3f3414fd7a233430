"""The class dimension: id, name, ordinal rank, screening group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import HIGH_RISK, RISK_ORDER
from ..functions.scalars import canonical_text
from ..session import literal_table


def class_ranks(names: Sequence[str]) -> list[int | None]:
    ranks = {name: rank for rank, name in enumerate(RISK_ORDER)}
    return [ranks.get(canonical_text(name)) for name in names]


def high_risk_ids(names: Sequence[str]) -> list[int]:
    return [i for i, name in enumerate(names) if canonical_text(name) in HIGH_RISK]


def check_names(names: Sequence[str]) -> None:
    if not names or len(set(names)) != len(names):
        raise ValueError("class names must be non-empty and unique")


def class_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """One row per declared class; its length is the length of the list given."""
    check_names(names)
    high = set(high_risk_ids(names))
    rows = [
        (i, name, rank, i in high)
        for i, (name, rank) in enumerate(zip(names, class_ranks(names)))
    ]
    return literal_table(spark, rows, "class_id INT, name STRING, risk_rank INT, is_high BOOLEAN")


def attach_class(
    rows: DataFrame, classes: DataFrame, label: str = "label", prefix: str = ""
) -> DataFrame:
    """Name, rank and group of a class column. The class table is as long as the class list."""
    named = classes.select(
        F.col("class_id").alias(label),
        F.col("name").alias(prefix + "name"),
        F.col("risk_rank").alias(prefix + "risk_rank"),
        F.col("is_high").alias(prefix + "is_high"),
    )
    return rows.join(F.broadcast(named), label, "left")


def lookup(names_or_ranks: Sequence, label: F.Column, kind: str) -> F.Column:
    """Literal array lookup by class id: a map-side projection."""
    values = F.array(*[F.lit(v).cast(kind) for v in names_or_ranks])
    return F.get(values, label)
