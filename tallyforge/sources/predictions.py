"""Prediction tables and split tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_SCHEMA = (
    "run STRING, split STRING, idx BIGINT, label INT, "
    "logits ARRAY<DOUBLE>, probs ARRAY<DOUBLE>"
)
SPLIT_SCHEMA = "idx BIGINT, split STRING, label INT"


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Parquet partitioned by run and split, so an evaluation opens only its own files.

    Rows are clustered first, so a run and split is a few files in index order, not one a task.
    """
    clustered = predictions.repartitionByRange("run", "split", "idx").sortWithinPartitions("run", "split", "idx")
    clustered.write.partitionBy("run", "split").mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).parquet(path)


def sorted_predictions(predictions: DataFrame) -> DataFrame:
    """Index order for files: range partitions, each sorted, without a single-task sort."""
    return predictions.repartitionByRange("idx").sortWithinPartitions("idx")


def write_splits(splits: DataFrame, path: str) -> None:
    splits.select("idx", "split", "label").write.mode("overwrite").parquet(path)


def read_splits(spark: SparkSession, path: str, expected_hash: str | None = None) -> DataFrame:
    """Split table; with a recorded hash the content is verified first."""
    from ..operators.splits import split_hash

    splits = spark.read.schema(SPLIT_SCHEMA).parquet(path)
    if expected_hash is not None:
        found = split_hash(splits).first()["split_hash"]
        if found != expected_hash:
            raise ValueError(f"split table {path} does not match its recorded hash")
    return splits


def select_split(rows: DataFrame, split: str) -> DataFrame:
    """Rows of one split; ``val`` stands for ``validation``."""
    name = "validation" if split == "val" else split
    if name not in ("train", "validation", "test"):
        raise ValueError(f"unknown split {split!r}")
    return rows.filter(F.col("split") == name)
