"""Run documents and training histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_ENTRY = (
    "epoch BIGINT, train_loss DOUBLE, val_macro_f1 DOUBLE, val_accuracy DOUBLE, lr ARRAY<DOUBLE>"
)


def scan_runs(
    spark: SparkSession,
    paths: str | Sequence[str],
    glob: str = "summary.json",
    lines: bool = False,
) -> DataFrame:
    """(run, path, summary) with ``summary`` as a VARIANT, so no schema-inference pass is needed.

    Each file is one document; with ``lines`` each line is one. A run is named by its folder.
    """
    sources = [paths] if isinstance(paths, str) else list(paths)
    reader = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
    )
    text = reader.text(sources, wholetext=not lines)
    if not text.inputFiles():
        raise ValueError("these folders hold no run document")
    path = F.col("_metadata.file_path")
    return text.select(
        F.element_at(F.split(path, "/"), -2).alias("run"),
        path.alias("path"),
        F.parse_json("value").alias("summary"),
    )


def scan_history(
    spark: SparkSession,
    paths: str | Sequence[str],
    glob: str = "history.json",
    lines: bool = False,
) -> DataFrame:
    """One row per epoch; the run is the folder that holds the list (or the JSON lines)."""
    sources = [paths] if isinstance(paths, str) else list(paths)
    path = F.col("_metadata.file_path")
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("multiLine", str(not lines).lower())
        .schema(HISTORY_ENTRY)
        .json(sources)
        .select(F.element_at(F.split(path, "/"), -2).alias("run"), "*")
    )
