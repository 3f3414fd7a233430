"""Equal-weight averaging of member predictions.

Members are stacked, not joined pairwise: one shuffle by (split, idx) aligns any number of
members, averages them and counts every disagreement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import UNROLL_LIMIT, at, log_clip, map_over
from .checks import report


def align_members(members: DataFrame, k: int) -> DataFrame:
    """One row per (split, idx): member counts, label range and summed probabilities.

    ``members`` has run, split, idx, label, probs. Sums are one aggregate column per class;
    long class lists fold positions in a second grouping key instead.
    """
    common = [
        F.count("*").alias("n_rows"),
        F.min("run").alias("first_run"),
        F.max("run").alias("last_run"),
        F.min("label").alias("label"),
        F.max("label").alias("max_label"),
    ]
    if k <= UNROLL_LIMIT:
        p = F.col("probs")
        sums = [F.sum(at(p, c)).alias(f"p{c}") for c in range(k)]
        grouped = members.groupBy("split", "idx").agg(*common, *sums)
        return grouped.withColumn("total", F.array(*[f"p{c}" for c in range(k)])).drop(
            *[f"p{c}" for c in range(k)]
        )
    keys = members.groupBy("split", "idx").agg(*common)
    sums = (
        members.select("split", "idx", F.posexplode_outer("probs").alias("c", "p"))
        .groupBy("split", "idx", "c")
        .agg(F.sum("p").alias("p"))
        .groupBy("split", "idx")
        .agg(F.array_sort(F.collect_list(F.struct("c", "p"))).alias("s"))
        .select("split", "idx", F.transform("s", lambda e: e["p"]).alias("total"))
    )
    return keys.join(sums, ["split", "idx"])


def same_observations(aligned: DataFrame, n_members: int) -> DataFrame:
    """Observations that some member lacks or repeats; must be empty."""
    return aligned.filter(F.col("n_rows") != n_members).select("split", "idx", "n_rows")


def same_labels(aligned: DataFrame) -> DataFrame:
    return aligned.filter("label <> max_label").select("split", "idx", "label", "max_label")


def check_members(aligned: DataFrame, n_members: int) -> DataFrame:
    """Violation counts of the alignment in one aggregate."""
    counts = aligned.agg(
        F.when(F.count("*") == 0, 1).otherwise(0).alias("empty"),
        F.count_if(F.col("n_rows") != n_members).alias("observations_differ"),
        F.count_if(F.col("label") != F.col("max_label")).alias("labels_differ"),
    )
    return report(counts, ["empty", "observations_differ", "labels_differ"])


def members_overlap(aligned: DataFrame) -> DataFrame:
    """Indices present in more than one split; must be empty."""
    return (
        aligned.groupBy("idx")
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter("first_split <> last_split")
    )


def ensemble_mean(aligned: DataFrame, k: int, n_members: int) -> DataFrame:
    """Mean probabilities, and their clipped logarithms as logits."""
    probs = map_over(F.col("total"), k, lambda v: v / n_members)
    return aligned.select("split", "idx", "label", probs.alias("probs")).withColumn(
        "logits", map_over(F.col("probs"), k, log_clip)
    )
