"""Stratified percentile bootstrap without shuffling resampled rows.

Every class keeps its row count in every resample. A class is a binary tree over a hash of the
row index, with leaves of about ``LEAF_ROWS`` rows. A resample sends the class's n draws down the
tree: a node's left child gets a binomial share by its size, and a leaf draws its share with
replacement. That has the distribution of n draws over the whole class.

Each number comes from a counter-based generator with 128 bits of key, mixed from (seed, replicate,
class, level, tree node), and all replicates of a node are drawn in one vector pass, so the result is the same however rows are partitioned and grouped into blocks, and a retried task
repeats it. A small class is one leaf of the same tree. One narrow frame is shuffled once, into
blocks of whole leaves; a block knows its way from the root from the sizes along it, and what
leaves it is tallies: per replicate some counts by predicted class and bin.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CONFIDENCE_LEVEL, ECE_BINS, SCALARS
from ..session import with_package
from . import metrics

LEAF_ROWS = 4096
BLOCK_ROWS = 200_000  # how much a task takes; results do not depend on it
TALLY_SCHEMA = (
    "b int, kind string, key int, support bigint, predicted bigint, hit bigint, "
    "conf double, nll double, brier double"
)

# Multipliers of a public 64-bit mixer, the golden step of its counters, and two starts.
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
STEP = 0x9E3779B97F4A7C15
STARTS = (0x243F6A8885A308D3, 0x13198A2E03707344)
MASK = (1 << 64) - 1
CHUNK_DRAWS = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer; ``uint64`` arithmetic wraps around by itself."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def stream_keys(seed: int, replicates: np.ndarray, label: int, level: int, node: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys a stream. They are mixed from different starts, so two streams are the same
    only if 128 bits agree."""
    keys = []
    for start in STARTS:
        key = np.full(len(replicates), start, np.uint64)
        for part in (seed, replicates, label, level, node):
            part = part.astype(np.uint64) if isinstance(part, np.ndarray) else np.uint64(part & MASK)
            key = mix64(key + part + np.uint64(STEP))
        keys.append(key)
    return keys[0], keys[1]


def counter_bits(first: np.ndarray, second: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Bits of a stream at a counter, which a retried task repeats."""
    return mix64(mix64(first + counter.astype(np.uint64) * np.uint64(STEP)) ^ second)


def uniforms(first: np.ndarray, second: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """In (0, 1), with 53 bits."""
    return ((counter_bits(first, second, counter) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def draws(first: np.ndarray, second: np.ndarray, counter: np.ndarray, size: int) -> np.ndarray:
    """Positions in [0, size) of streams at counters."""
    return ((counter_bits(first, second, counter) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def _log_factorial_rest(k: np.ndarray) -> np.ndarray:
    """log k! less its Stirling form (k + 1/2) log(k + 1) - (k + 1) + log(2 pi) / 2."""
    x = k + 1.0
    small = np.array([math.lgamma(i + 1.0) - (i + 0.5) * math.log(i + 1.0) + i + 1 - math.log(2 * math.pi) / 2 for i in range(10)])
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return np.where(k < 10, small[np.minimum(k, 9).astype(np.int64)], series)


def binomial(n: np.ndarray, p: float, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One binomial draw of ``n`` trials per stream, for all streams at once.

    Small means walk up the distribution from 0 by one uniform. Large ones are proposed from a
    hat over the transformed uniform and accepted by the exact ratio of probabilities (transformed
    rejection); a stream goes on to its next counters until one is accepted.
    """
    if p > 0.5:
        return n - binomial(n, 1 - p, first, second)
    n, out = np.asarray(n, np.int64), np.zeros(len(n), np.int64)
    if p <= 0:
        return out
    walk = np.flatnonzero(n * p < 10)
    if len(walk):
        u, trials = uniforms(first[walk], second[walk], np.zeros(len(walk))), n[walk]
        mass = np.exp(trials * math.log1p(-p))
        below, k, going = mass.copy(), np.zeros(len(walk), np.int64), np.ones(len(walk), bool)
        while True:
            going &= (u > below) & (k < trials)
            if not going.any():
                break
            k = k + going
            mass = np.where(going, mass * (trials - k + 1) / np.maximum(k, 1) * (p / (1 - p)), mass)
            below = np.where(going, below + mass, below)
        out[walk] = k
    left, counter = np.flatnonzero(n * p >= 10), 0
    while len(left):
        trials = n[left].astype(np.float64)
        deviation = np.sqrt(trials * p * (1 - p))
        b = 1.15 + 2.53 * deviation
        a = -0.0873 + 0.0248 * b + 0.01 * p
        at = np.full(len(left), counter)
        u = uniforms(first[left], second[left], at) - 0.5
        v = uniforms(first[left], second[left], at + 1)
        counter += 2
        near = 0.5 - np.abs(u)
        k = np.floor((2 * a / near + b) * u + trials * p + 0.5)
        inside = (k >= 0) & (k <= trials)
        k = np.clip(k, 0, trials)
        mode = np.floor((trials + 1) * p)
        odds = p / (1 - p)
        weight = np.log(v * (2.83 + 5.1 / b) * deviation / (a / (near * near) + b))
        ratio = (
            (mode + 0.5) * np.log((mode + 1) / (odds * (trials - mode + 1)))
            + (trials + 1) * np.log((trials - mode + 1) / (trials - k + 1))
            + (k + 0.5) * np.log(odds * (trials - k + 1) / (k + 1))
            + _log_factorial_rest(mode) + _log_factorial_rest(trials - mode)
            - _log_factorial_rest(k) - _log_factorial_rest(trials - k)
        )
        squeeze = (near >= 0.07) & (v <= 0.92 - 4.2 / b)
        taken = inside & (squeeze | (weight <= ratio))
        out[left[taken]] = k[taken].astype(np.int64)
        left = left[~taken]
    return out


def left_share(seed: int, replicates: np.ndarray, label: int, level: int, node: int, n: np.ndarray, left: int, size: int) -> np.ndarray:
    """Per replicate, draws of ``n`` at a node of ``size`` rows that go to its left child of ``left`` rows."""
    if left in (0, size):
        return n if left else np.zeros_like(n)
    return binomial(n, left / size, *stream_keys(seed, replicates, label, level, node))


def tree_depth(n: int, leaf_rows: int) -> int:
    """Levels below the root of a class of ``n`` rows; it depends on the class size alone."""
    return max(0, -(-n // leaf_rows) - 1).bit_length()


def shifted(value: F.Column, bits: F.Column) -> F.Column:
    """Unsigned right shift by a column (0 to 63)."""
    return F.call_function("shiftrightunsigned", value, bits.cast("int"))


def with_leaves(
    frame: DataFrame, leaf_rows: int, block_rows: int
) -> tuple[DataFrame, DataFrame, dict[int, tuple[int, int, int]]]:
    """``frame`` with ``leaf`` and ``block``, the sizes along each block's path, and per class
    (rows, depth of leaves, depth of blocks). Only one row per class reaches the driver."""
    counts = {r["label"]: r["count"] for r in frame.groupBy("label").count().collect()}
    shape = {
        y: (n, tree_depth(n, leaf_rows), min(tree_depth(n, leaf_rows), tree_depth(n, block_rows)))
        for y, n in counts.items()
    }

    def per_class(i: int) -> F.Column:
        pairs = [F.lit(v) for y, facts in shape.items() for v in (y, facts[i])]
        return F.element_at(F.create_map(*pairs), F.col("label")) if pairs else F.lit(0)

    depth, top = per_class(1), per_class(2)
    # The first bits of the hash; a shift by 64 would be one by 0, so one bit goes first.
    leaf = shifted(F.shiftrightunsigned(F.xxhash64("idx"), 1), 63 - depth)
    keyed = frame.withColumn("leaf", leaf)
    keyed = keyed.withColumn("block", shifted(F.col("leaf"), depth - top))
    blocks = keyed.groupBy("label", "block").agg(F.count("*").alias("size")).withColumn("top", top)
    levels = blocks.withColumn("level", F.explode_outer(F.sequence(F.lit(0), F.col("top"))))
    levels = levels.withColumn("node", shifted(F.col("block"), F.col("top") - F.col("level")))
    goes_left = shifted(F.col("block"), F.col("top") - F.col("level") - 1).bitwiseAND(F.lit(1)) == 0
    nodes = levels.filter("level < top").groupBy("label", "level", "node").agg(
        F.sum("size").alias("size"), F.sum(F.when(goes_left, F.col("size")).otherwise(0)).alias("left")
    )
    step = F.struct("level", "node", "size", "left")
    paths = (
        levels.select("label", "block", "level", "node")
        .join(nodes, ["label", "level", "node"], "left")
        .groupBy("label", "block")
        .agg(F.sort_array(F.collect_list(F.when(F.col("size").isNotNull(), step))).alias("path"))
    )
    return keyed, paths, shape


def replicate_tallies(
    frame: DataFrame,
    k: int,
    n_bootstrap: int,
    seed: int,
    block_rows: int = BLOCK_ROWS,
    n_bins: int = ECE_BINS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Tallies of every replicate from a score frame with ``idx``."""
    keyed, paths, shape = with_leaves(frame, leaf_rows, block_rows)

    def resample(rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        label, block = int(rows["label"].iloc[0]), int(rows["block"].iloc[0])
        total, depth, top = shape[label]
        rows = rows.sort_values(["leaf", "idx"])
        leaves, begin, sizes = np.unique(rows["leaf"].to_numpy(np.int64), return_index=True, return_counts=True)
        every = np.arange(n_bootstrap)
        n = np.full(n_bootstrap, total, np.int64)
        for step in way["path"].iloc[0]:
            to_left = left_share(seed, every, label, step["level"], step["node"], n, step["left"], step["size"])
            n = n - to_left if block >> (top - step["level"] - 1) & 1 else to_left
        own = {(top, block): n}
        for level, node, size, left in _inner_nodes(leaves, sizes, top, depth):
            here = own.pop((level, node))
            to_left = left_share(seed, every, label, level, node, here, left, size)
            own[level + 1, 2 * node], own[level + 1, 2 * node + 1] = to_left, here - to_left
        shares = _row_shares(rows, label, k, n_bins)
        tally = np.zeros((n_bootstrap, shares.shape[1]))
        for leaf, at, size in zip(leaves.tolist(), begin.tolist(), sizes.tolist()):
            first, second = stream_keys(seed, every, label, depth, leaf)
            taken = own[depth, leaf]
            chunk = max(1, CHUNK_DRAWS // max(size, int(taken.max()), 1))
            for low in range(0, n_bootstrap, chunk):
                here = taken[low : low + chunk]
                which = np.repeat(np.arange(len(here)), here)
                counter = np.arange(len(which)) - np.repeat(np.cumsum(here) - here, here)
                picks = draws(first[low + which], second[low + which], counter, size)
                weight = np.bincount(which * size + picks, minlength=len(here) * size).reshape(-1, size)
                tally[low : low + chunk] += weight @ shares[at : at + size]
        return _tally_rows(tally, label, k, n_bins, n)

    parts = keyed.select("idx", "label", "leaf", "block", "pred", "bin", "conf", "nll", "brier")
    ways = paths.select(F.col("label").alias("way_label"), F.col("block").alias("way_block"), "path")
    grouped = with_package(parts).groupBy("label", "block").cogroup(ways.groupBy("way_label", "way_block"))
    return metrics.merge_tallies(grouped.applyInPandas(resample, TALLY_SCHEMA), ["b"])


def _inner_nodes(leaves: np.ndarray, sizes: np.ndarray, top: int, depth: int) -> list[tuple[int, int, int, int]]:
    """(level, node, rows, rows of the left child) of a block's nodes above the leaves, top down."""
    out = []
    for level in range(top, depth):
        node, left = leaves >> (depth - level), (leaves >> (depth - level - 1)) & 1 == 0
        for i in np.unique(node).tolist():
            mine = node == i
            out.append((level, i, int(sizes[mine].sum()), int(sizes[mine & left].sum())))
    return out


def _row_shares(rows: pd.DataFrame, label: int, k: int, n_bins: int) -> np.ndarray:
    """What each row adds to a resample: one in its predicted class, and one, its hit and its three
    sums in its bin."""
    pred, bins, at = rows["pred"].to_numpy(np.int64), rows["bin"].to_numpy(np.int64), np.arange(len(rows))
    out = np.zeros((len(rows), k + 5 * n_bins))
    out[at, pred] = 1
    values = (np.ones(len(rows)), pred == label, *(rows[c].to_numpy(np.float64) for c in ("conf", "nll", "brier")))
    for i, value in enumerate(values):
        out[at, k + i * n_bins + bins] = value
    return out


def _tally_rows(tally: np.ndarray, label: int, k: int, n_bins: int, n: np.ndarray) -> pd.DataFrame:
    """Tallies as rows: the class itself, the predicted classes and the bins that occur."""
    by_class = np.rint(tally[:, :k]).astype(np.int64)
    support, hits, *sums = tally[:, k:].reshape(len(tally), 5, n_bins).transpose(1, 0, 2)
    support, hits = np.rint(support).astype(np.int64), np.rint(hits).astype(np.int64)
    b = np.arange(len(tally))
    kinds = [("class", b, label, n, 0, hits.sum(axis=1), 0.0, 0.0, 0.0)]
    at = np.nonzero(by_class)
    kinds.append(("class", at[0], at[1], 0, by_class[at], 0, 0.0, 0.0, 0.0))
    at = np.nonzero(support)
    kinds.append(("bin", at[0], at[1], support[at], 0, hits[at], *(s[at] for s in sums)))
    columns = TALLY_SCHEMA.replace(",", "").split()[0::2]
    frames = [pd.DataFrame(dict(zip(["kind", "b", *columns[2:]], values))) for values in kinds]
    return pd.concat(frames, ignore_index=True)[columns]


def intervals(replicates: DataFrame, estimates: DataFrame, level: float = CONFIDENCE_LEVEL) -> DataFrame:
    """(metric, estimate, lower, upper): linear percentiles over one row per replicate."""
    tail = (1 - level) / 2
    bounds = replicates.agg(
        *[F.percentile(m, F.array(F.lit(tail), F.lit(1 - tail))).alias(m) for m in SCALARS]
    )

    def tall(row: DataFrame, value) -> DataFrame:
        pairs = [F.struct(F.lit(m).alias("metric"), *value(m)) for m in SCALARS]
        return row.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")

    found = tall(
        bounds,
        lambda m: (F.col(m)[0].alias("lower"), F.col(m)[1].alias("upper")),
    )
    point = tall(estimates, lambda m: (F.col(m).alias("estimate"),))
    return point.join(found, "metric").select("metric", "estimate", "lower", "upper")


def bootstrap_ci(
    predictions: DataFrame,
    k: int,
    n_bootstrap: int = 1000,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """95 % intervals of the seven scalars, conditional on the observed class mixture."""
    frame = metrics.score_frame(predictions, k, keep=["idx"])
    return frame_ci(frame, k, n_bootstrap, seed, block_rows, leaf_rows)


def frame_ci(
    frame: DataFrame,
    k: int,
    n_bootstrap: int,
    seed: int,
    block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The same from a score frame, best a staged one: it is read three times."""
    if n_bootstrap < 1:
        raise ValueError("n_bootstrap must be at least one")
    resampled = metrics.scalars(
        replicate_tallies(frame, k, n_bootstrap, seed, block_rows, leaf_rows=leaf_rows), k, ["b"]
    )
    estimates = metrics.scalars(metrics.tallies(metrics.cells(frame)), k)
    return intervals(resampled, estimates)
