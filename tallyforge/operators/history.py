"""Per-epoch histories: early stopping, best epochs, learning curves, run status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import stopping


def with_position(rows: DataFrame, key: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Position 1, 2, ... of each row within its key, without one task per key or per time span.

    Rows are range-partitioned by (key, order), which cuts a hot key wherever it is long, sorted,
    numbered as they lie, and staged. A key's first number in each part and its rows in earlier
    parts are one row per key and part.
    """
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = placed.withColumn("__row", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("__part", F.shiftright("__row", 33)), "positions")
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(key, "__part")
        .agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
        .withColumn("__shift", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .select(F.col(key).alias("__key"), F.col("__part").alias("__in"), "__first", "__shift")
    )
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__in"))
    return (
        placed.join(shifts, same)
        .withColumn(name, F.col("__row") - F.col("__first") + F.col("__shift") + 1)
        .drop("__part", "__in", "__key", "__row", "__first", "__shift")
    )


def _chunks(history: DataFrame, chunk: int) -> DataFrame:
    """(run, chunk, top, last, climb) per ``chunk`` epochs of a run: the highest score, the last
    epoch, and the scores that exceed all earlier ones of the chunk. One shuffle by (run, chunk)."""
    by_chunk = Window.partitionBy("run", "chunk").orderBy("epoch")
    score = F.when(~F.isnan("score"), F.col("score"))
    placed = (
        history.select("run", F.col("epoch").cast("bigint").alias("epoch"), score.alias("score"))
        .withColumn("chunk", F.floor((F.col("epoch") - 1) / chunk))
        .withColumn("near", F.max("score").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)))
    )
    rises = F.col("score") > F.coalesce("near", F.lit(float("-inf")))
    return placed.groupBy("run", "chunk").agg(
        F.max("score").alias("top"),
        F.max("epoch").alias("last"),
        F.array_sort(F.collect_list(F.when(rises, F.struct("epoch", "score")))).alias("climb"),
    )


def _climbs(chunks: DataFrame) -> DataFrame:
    """Staged chunks with ``before``, the highest score of the run ahead of them, and ``climb`` cut to
    the scores above it. What meets in one task of a run is two numbers a chunk."""
    ahead = Window.partitionBy("run").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = chunks.select(
        F.col("run").alias("__run"), F.col("chunk").alias("__chunk"), F.max("top").over(ahead).alias("before")
    )
    same = F.col("run").eqNullSafe(F.col("__run")) & (F.col("chunk") == F.col("__chunk"))
    above = F.filter("climb", lambda c: F.col("before").isNull() | (c["score"] > F.col("before")))
    return chunks.join(tops, same).drop("__run", "__chunk").withColumn("climb", above)


def rising_scores(history: DataFrame, chunk: int = 4096) -> DataFrame:
    """Epochs whose score exceeds every earlier score of the run.

    Only these can improve on the best one (a score that beats best + min_delta beats all
    before it, since none of those exceeded that mark).
    """
    climbs = _climbs(stage(_chunks(history, chunk), "chunks"))
    return climbs.select("run", F.explode("climb").alias("c")).select("run", "c.epoch", "c.score")


def early_stop(
    history: DataFrame, patience: int, min_delta: float = 0.0, chunk: int = 4096
) -> DataFrame:
    """Per run: best epoch and score, and the epoch at which training stops.

    Best starts at -1 and moves only when a score exceeds best + min_delta; training stops
    after ``patience`` epochs in a row without that. ``history`` has (run, epoch, score) with
    epochs 1, 2, ... The fold runs over the rising scores of the first ``chunk`` epochs: between two
    improvements only their distance matters. Later chunks, if any run has them, are reduced to maps
    that are composed in a tree (see ``stopping``), so no run is gathered however long it climbs.
    """
    if not min_delta >= 0:
        raise ValueError("min_delta must be at least zero")
    chunks = stage(_chunks(history, chunk), "chunks")
    nodes = chunks.agg(F.max("chunk").alias("n")).first()["n"]
    start = F.struct(
        F.lit(stopping.START).alias("best"),
        F.lit(0).cast("bigint").alias("best_epoch"),
        F.lit(None).cast("bigint").alias("stopped"),
    )

    def advance(acc: Column, entry: Column) -> Column:
        late = entry["epoch"] - acc["best_epoch"] > patience
        stopped = F.coalesce(
            acc["stopped"], F.when(late, acc["best_epoch"] + patience)
        )
        improves = stopped.isNull() & (entry["score"] > acc["best"] + min_delta)
        return F.struct(
            F.when(improves, entry["score"]).otherwise(acc["best"]).alias("best"),
            F.when(improves, entry["epoch"]).otherwise(acc["best_epoch"]).alias("best_epoch"),
            stopped.alias("stopped"),
        )

    folded = chunks.where("chunk = 0").select(
        "run", F.col("last").alias("epochs"), F.aggregate("climb", start, advance).alias("s")
    )
    if nodes:
        folded = _through_later_chunks(folded, chunks, nodes, start, patience, min_delta)
    end = F.coalesce(
        F.col("s.stopped"),
        F.when(
            F.col("epochs") - F.col("s.best_epoch") >= patience, F.col("s.best_epoch") + patience
        ),
    )
    return folded.select(
        "run",
        F.when(F.col("s.best_epoch") > 0, F.col("s.best_epoch")).alias("best_epoch"),
        F.col("s.best").alias("best_score"),
        F.coalesce(end, F.col("epochs")).alias("last_epoch"),
        end.isNotNull().alias("stopped_early"),
    )


def _through_later_chunks(
    folded: DataFrame, chunks: DataFrame, nodes: int, start: Column, patience: int, min_delta: float
) -> DataFrame:
    """States after the first chunk, taken through the composed map of the run's other chunks."""
    later = _climbs(chunks).where((F.col("chunk") > 0) & (F.size("climb") > 0))
    maps = stopping.stretches(later.withColumn("node", F.col("chunk") - 1), min_delta, patience)
    maps = stopping.composed(maps, nodes, min_delta, patience).withColumnRenamed("run", "__mapped")
    ends = chunks.groupBy(F.col("run").alias("__run")).agg(F.max("last").alias("__last"))
    rows = ends.join(folded, F.col("__run").eqNullSafe(F.col("run")), "left").drop("run", "epochs")
    rows = rows.join(maps, F.col("__run").eqNullSafe(F.col("__mapped")), "left").select(
        F.col("__run").alias("run"), F.col("__last").alias("epochs"), F.coalesce("s", start).alias("s"),
        F.coalesce("key", F.array().cast("array<double>")).alias("key"), "first", "best", "epoch", "stopped",
    )
    at = F.size(F.filter("key", lambda k: k <= F.col("s.best") + min_delta))
    met = F.col("s.stopped").isNull() & (F.col("at") < F.size("key"))
    late = F.get("first", F.col("at")) - F.col("s.best_epoch") > patience
    gone = F.get("stopped", F.col("at"))
    moved = F.struct(
        F.get("best", F.col("at")).alias("best"),
        F.get("epoch", F.col("at")).alias("best_epoch"),
        F.when(gone != stopping.RUNNING, gone).alias("stopped"),
    )
    left = F.struct("s.best", "s.best_epoch", (F.col("s.best_epoch") + patience).alias("stopped"))
    state = F.when(~met, F.col("s")).when(late, left).otherwise(moved)
    return rows.withColumn("at", at).select("run", "epochs", state.alias("s"))


def best_epoch(history: DataFrame) -> DataFrame:
    """Earliest epoch of the highest score (the rule without a minimum step or patience).

    A NaN score counts as none.
    """
    history = history.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    return history.groupBy("run").agg(
        F.min_by("epoch", F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), F.col("epoch")))).alias(
            "best_epoch"
        ),
        F.max("score").alias("best_score"),
    )


def learning_curves(history: DataFrame, series: Sequence[str]) -> DataFrame:
    """Tidy (run, epoch, series, value); null values stay out."""
    points = [
        F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("value")) for s in series
    ]
    return (
        history.select("run", "epoch", F.explode(F.array(*points)).alias("p"))
        .select("run", "epoch", "p.series", "p.value")
        .filter("value is not null")
    )


def run_status(runs: DataFrame, history: DataFrame) -> DataFrame:
    """Progress of each run; a run without history has completed no epoch."""
    progress = history.groupBy("run").agg(
        F.max("epoch").alias("completed_epochs"),
        F.max(F.when(~F.isnan("val_macro_f1"), F.col("val_macro_f1"))).alias("best_val_macro_f1"),
    )
    return runs.join(progress, "run", "left").select(
        "run",
        "status",
        F.coalesce("completed_epochs", F.lit(0)).alias("completed_epochs"),
        "best_val_macro_f1",
        F.coalesce("smoke_test", F.lit(False)).alias("smoke_test"),
        "test_evaluated",
    )
