"""Running metrics over a stream of prediction files that may be written again.

An index counts with its last version. State is kept per block of neighbouring indices: the cell
(true class, predicted class, confidence bin) and the sums that each of its rows put there. A row
that comes again, in whatever file or batch, takes its earlier share back out: a batch yields the
differences that it makes to the cells. One state row has at most ``BLOCK`` entries, so state grows
by as many rows as there are blocks, and a batch touches only its own.

Cells are additive. Each batch writes its differences to a folder of its own, overwriting it, so a
batch that is retried counts once. Every ``compact_every`` batches their sum becomes a new base; a
pointer file is replaced in one step, and folders that the pointer before it no longer needed are
deleted. So a reader always finds a base and the batches after it, and folders stay few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import metrics
from ..session import with_package
from ..sources.documents import children, delete, exists, read_document, write_document
from ..sources.predictions import PREDICTION_SCHEMA

CELL_SCHEMA = "label int, pred int, bin int, n bigint, conf double, nll double, brier double"
CELL, SUMS = ["label", "pred", "bin"], ["conf", "nll", "brier"]
BLOCK = 1024
ROW = np.dtype(
    [("slot", "<i4"), ("label", "<i4"), ("pred", "<i4"), ("bin", "<i4"), ("written", "<i8"), ("tie", "<i8")]
    + [(s, "<f8") for s in SUMS]
)


def latest(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to keep, one a slot and the last one written; old rows to take out; new rows to add.

    Of rows written at one time (a file has one) the larger tie number counts, then the larger cell
    and sums, so that neither the order of rows nor that of files matters.
    """
    both = np.concatenate([old, new])
    order = np.lexsort([both[c] for c in [*SUMS, *CELL, "tie", "written", "slot"]])
    slot = both["slot"][order]
    kept = order[np.append(slot[1:] != slot[:-1], True)] if len(order) else order
    stays = np.zeros(len(both), bool)
    stays[kept] = True
    return both[kept], old[~stays[: len(old)]], new[stays[len(old) :]]


def differences(out: np.ndarray, added: np.ndarray) -> pd.DataFrame:
    """What replacing some rows by others does to the cells."""
    rows, sign = np.concatenate([added, out]), np.repeat([1, -1], [len(added), len(out)])
    table = pd.DataFrame({c: rows[c] for c in CELL} | {"n": sign} | {s: rows[s] * sign for s in SUMS})
    return table.groupby(CELL, as_index=False)[["n", *SUMS]].sum()


def _replace(ttl: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = np.frombuffer(state.get[0], ROW) if state.exists else np.zeros(0, ROW)
        parts = []
        for batch in batches:
            part = np.zeros(len(batch), ROW)
            for name in ROW.names:
                part[name] = batch[name].to_numpy()
            parts.append(part)
        kept, out, added = latest(old, np.concatenate(parts))
        state.update((kept.tobytes(),))
        if ttl is not None:
            state.setTimeoutTimestamp(int(kept["written"].max()) // 1000 + ttl)
        yield differences(out, added)

    return run


def stream_metrics(
    spark: SparkSession,
    source: str,
    state: str,
    k: int,
    max_files: int = 1000,
    available_now: bool = True,
    horizon: str | None = None,
    compact_every: int = 16,
):
    """Start the query; it reads prediction files of ``source`` and keeps sums in ``state``.

    The version of a row is when its file was written. With a ``horizon`` (such as "2 days") files
    written that much earlier than the newest one seen are late and left out, and a block of indices
    whose files are all that old is forgotten: for sources that rewrite files only so late. Without
    it blocks are kept for ever. One query at a time owns ``state``.
    """
    ttl = None if horizon is None else int(pd.Timedelta(horizon).total_seconds() * 1000)

    def add(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ("n", *SUMS)])
        sums.write.mode("overwrite").parquet(f"{state}/sums/batch={batch_id}")
        compact(batch.sparkSession, state, batch_id, compact_every)

    stream = (
        spark.readStream.schema(PREDICTION_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .parquet(source)
        .select(
            "run", "split", F.coalesce("idx", F.lit(-1)).alias("idx"), "label", "probs",
            F.col("_metadata.file_modification_time").alias("seen"), F.xxhash64("_metadata.file_path").alias("tie"),
        )
    )
    if horizon is not None:
        stream = stream.withWatermark("seen", horizon)
    stream = stream.withColumn("written", F.unix_micros("seen"))
    keyed = metrics.score_frame(stream, k, ["run", "split", "idx", "seen", "written", "tie"]).select(
        "run",
        "split",
        "seen",
        F.floor(F.col("idx") / BLOCK).alias("block"),
        F.pmod("idx", F.lit(BLOCK)).cast("int").alias("slot"),
        *[c for c in ROW.names if c != "slot"],
    )
    changes = with_package(keyed).groupBy("run", "split", "block").applyInPandasWithState(
        _replace(ttl),
        CELL_SCHEMA,
        "rows binary",
        "update",
        GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout,
    )
    writer = (
        changes.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{state}/offsets")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _pointer(spark: SparkSession, state: str) -> dict:
    path = f"{state}/sums/current.json"
    return read_document(spark, path) if exists(spark, path) else {"upto": -1, "base": None, "kept_from": -1}


def _batches(spark: SparkSession, state: str) -> list[int]:
    found = children(spark, f"{state}/sums")
    return sorted(int(name.removeprefix("batch=")) for name in found if name.startswith("batch="))


def current_cells(spark: SparkSession, state: str) -> DataFrame:
    """Cells of the last version of every row seen so far."""
    at = _pointer(spark, state)
    paths = [at["base"]] if at["base"] else []
    paths += [f"batch={b}" for b in _batches(spark, state) if b > at["upto"]]
    if not paths:
        return spark.createDataFrame([], CELL_SCHEMA)
    sums = spark.read.schema(CELL_SCHEMA).parquet(*[f"{state}/sums/{p}" for p in paths])
    cells = sums.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ("n", *SUMS)])
    return cells.where("n > 0")  # of an emptied cell only rounding is left


def compact(spark: SparkSession, state: str, batch_id: int, every: int) -> None:
    """Fold the batches after the base into a new one, once there are ``every`` of them.

    What the pointer so far names is kept until the next time, for readers who have just read it.
    """
    at = _pointer(spark, state)
    batches = _batches(spark, state)
    if sum(at["upto"] < b <= batch_id for b in batches) < every:
        return
    base = f"base={batch_id}"
    current_cells(spark, state).coalesce(1).write.mode("overwrite").parquet(f"{state}/sums/{base}")
    write_document(spark, f"{state}/sums/current.json", {"upto": batch_id, "base": base, "kept_from": at["upto"]})
    for b in batches:
        if b <= at["upto"]:
            delete(spark, f"{state}/sums/batch={b}")
    for name in children(spark, f"{state}/sums"):
        if name.startswith("base=") and name not in (base, at["base"]):
            delete(spark, f"{state}/sums/{name}")


def current_metrics(spark: SparkSession, state: str, k: int) -> DataFrame:
    return metrics.scalars(metrics.tallies(current_cells(spark, state)), k)
