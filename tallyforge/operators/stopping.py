"""Early stopping of long runs as a composable fold.

What a stretch of epochs does to the state of a run (best score, its epoch, whether training has
stopped) depends on the best score on entry alone, and only through the first score that beats it.
So a stretch is a map: piece i holds for entries whose first better score is ``key[i]``, reached at
epoch ``first[i]``, and says what the state is at the end. Entries that nothing beats pass through.
Two neighbouring maps compose into one, so maps of chunks are combined in a tree, in as many steps
as the logarithm of their number.

Scores of a stretch are those that exceed all before them in the run, hence rise. A run enters a
stretch with a best score within ``min_delta`` of the highest one so far (or with the -1 of the
start), so a map keeps pieces up to the first key beyond that: as many as there are rising scores in
a span of ``min_delta``, however many epochs it covers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_package

FAN_IN = 16
START = -1.0  # the best score before the first epoch
RUNNING = -1  # in place of the epoch of a stop
PIECES = (
    "node bigint, before double, key array<double>, first array<bigint>, best array<double>, "
    "epoch array<bigint>, stopped array<bigint>"
)
ARRAYS = ("key", "first", "best", "epoch", "stopped")


@dataclass
class Stretch:
    """Map of a stretch; ``before`` is the highest score of the run ahead of it."""

    before: float
    key: np.ndarray
    first: np.ndarray
    best: np.ndarray
    epoch: np.ndarray
    stopped: np.ndarray

    def within_reach(self, min_delta: float) -> Stretch:
        """Without the pieces that no entry can meet."""
        top = max(self.before, START) + min_delta
        n = int(np.searchsorted(self.key, top, side="right")) + 1
        return Stretch(self.before, *[getattr(self, a)[:n] for a in ARRAYS])

    @staticmethod
    def of(score: np.ndarray, epoch: np.ndarray, before: float, min_delta: float, patience: int) -> Stretch:
        """Of rising scores: every one leads to the next that beats it in time, or to a stop."""
        n = len(score)
        later = np.searchsorted(score, score + min_delta, side="right")
        best, at, stopped = score.copy(), epoch.copy(), np.full(n, RUNNING)
        for i in range(n - 1, -1, -1):
            j = later[i]
            if j < n and epoch[j] - epoch[i] <= patience:
                best[i], at[i], stopped[i] = best[j], at[j], stopped[j]
            elif j < n:
                stopped[i] = epoch[i] + patience
        return Stretch(before, score, epoch, best, at, stopped).within_reach(min_delta)

    def then(self, other: Stretch, min_delta: float, patience: int) -> Stretch:
        """This stretch followed by ``other``."""
        at = np.searchsorted(other.key, self.best + min_delta, side="right")
        met = (self.stopped == RUNNING) & (at < len(other.key))
        at = np.where(met, at, 0)
        late = met & (other.first[at] - self.epoch > patience) if len(other.key) else met
        moved = met & ~late
        pick = lambda mine, theirs: np.where(moved, theirs[at], mine) if len(other.key) else mine
        stopped = np.where(late, self.epoch + patience, pick(self.stopped, other.stopped))
        mine = (self.key, self.first, pick(self.best, other.best), pick(self.epoch, other.epoch), stopped)
        joined = [np.append(m, getattr(other, a)) for m, a in zip(mine, ARRAYS)]
        return Stretch(self.before, *joined).within_reach(min_delta)


def _row(node: int, s: Stretch) -> dict:
    return {"node": node, "before": s.before} | {a: getattr(s, a) for a in ARRAYS}


def stretches(chunks: DataFrame, min_delta: float, patience: int) -> DataFrame:
    """Maps of (run, node, before, climb), a climb being rising (epoch, score) in order."""
    schema = f"run {chunks.schema['run'].dataType.simpleString()}, {PIECES}"

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                epoch = np.array([c["epoch"] for c in r.climb], np.int64)
                score = np.array([c["score"] for c in r.climb], np.float64)
                before = START if r.before is None or np.isnan(r.before) else float(r.before)
                rows.append({"run": r.run} | _row(r.node, Stretch.of(score, epoch, before, min_delta, patience)))
            yield pd.DataFrame(rows, columns=["run", "node", "before", *ARRAYS])

    return with_package(chunks.select("run", "node", "before", "climb")).mapInPandas(run, schema)


def composed(maps: DataFrame, nodes: int, min_delta: float, patience: int) -> DataFrame:
    """One map a run out of those of its nodes 0 to ``nodes`` - 1, which may be missing."""
    schema = maps.schema.simpleString().removeprefix("struct<")[:-1]

    def combine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for r in group.sort_values("node").itertuples(index=False):
            own = Stretch(r.before, *[np.asarray(getattr(r, a)) for a in ARRAYS])
            whole = own if whole is None else whole.then(own, min_delta, patience)
        return pd.DataFrame([{"run": key[0]} | _row(int(key[1]), whole)])

    while nodes > 1:
        up = maps.withColumn("up", F.floor(F.col("node") / FAN_IN))
        maps = up.groupBy("run", "up").applyInPandas(lambda key, group: combine(key, group.drop(columns="up")), schema)
        nodes = -(-nodes // FAN_IN)
    return maps
