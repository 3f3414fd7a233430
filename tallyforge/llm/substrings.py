"""Removal of passages that occur more than once, whatever documents they stand in.

Every window of a fixed number of words gets a Rabin-Karp hash. Windows are counted in runs: the
smallest hash of a window's short n-grams is its anchor, equal windows have equal anchors, and
neighbouring windows mostly share theirs. A run is a stretch of windows with one anchor. Runs are
counted by (anchor, hash of the run's words):

- an anchor seen once, in a run that repeats nothing inside itself, has no repeated window;
- a run seen twice or more is repeated as a whole, and stands for its copies from then on;
- only where one anchor has differing runs, at the edges of repeated passages, are single
  windows sent and counted, each distinct run once.

So a passage in a third of all documents adds one counter per run and task, and unique text adds
about one row per ten words. Repeated windows merge into maximal intervals per document.

Defined results: a null text has no words and its kept text is empty. Texts shorter than a window
are kept. Rows with a repeated or null doc_id are documents of their own. Kept words are joined by
one space. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, with_package
from . import words as W
from .keys import KEY, key_columns, with_key

WINDOW = 35
ANCHOR_WORDS = 6


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Windows:
    """Window hashes and runs of the texts of one slice."""

    def __init__(self, texts: pa.Array, size: int):
        self.words = W.split(texts)
        h = self.words.hashes()
        n = max(0, len(h) - size + 1)
        first = self.words.first
        self.owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
        inside = np.arange(n) + size <= first[1:][self.owner] if n else np.zeros(0, bool)
        short = min(ANCHOR_WORDS, size)
        rolling = W.Rolling(h, W.WORD_BASE)
        at = np.arange(n)
        self.hash = W.mix(rolling.ranges(at, at + size)) if n else np.zeros(0, np.uint64)
        grams = np.arange(len(h) - short + 1) if n else np.zeros(0, np.int64)
        gram = W.mix(rolling.ranges(grams, grams + short)) if n else self.hash
        anchor = sliding_min(gram, size - short + 1) if n else self.hash
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.owner[1:] != self.owner[:-1])
        lead = np.flatnonzero(new & inside)
        edge = np.flatnonzero(np.append(new | ~inside, True))
        stop = edge[np.searchsorted(edge, lead, "right")] if n else lead
        self.lead, self.count = lead, stop - lead
        self.anchor = anchor[lead]
        last = stop + size - 1
        self.run = W.mix(rolling.ranges(lead, last) + (last - lead).astype(np.uint64)) if n else self.hash
        self.inner = self._repeats_inside(inside)

    def _repeats_inside(self, inside: np.ndarray) -> np.ndarray:
        """Runs that hold one window twice."""
        valid = np.flatnonzero(inside)
        order = valid[np.argsort(self.hash[valid], kind="stable")]
        same = np.flatnonzero(self.hash[order[1:]] == self.hash[order[:-1]])
        run_a = np.searchsorted(self.lead, order[same], "right") - 1
        run_b = np.searchsorted(self.lead, order[same + 1], "right") - 1
        flag = np.zeros(len(self.lead), bool)
        flag[run_a[run_a == run_b]] = True
        return flag

    def row(self) -> np.ndarray:
        return self.owner[self.lead]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


RUNS = "_tf_id bigint, _tf_hash bigint, lo int, n int, anchor bigint, run bigint, repeats int"


def _runs(size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                w = Windows(part.column("text"), size)
                row = w.row()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(KEY[0]).take(pa.array(row)),
                        part.column(KEY[1]).take(pa.array(row)),
                        pa.array((w.lead - w.words.first[row]).astype(np.int32)),
                        pa.array(w.count.astype(np.int32)),
                        _signed(w.anchor),
                        _signed(w.run),
                        pa.array(w.inner.astype(np.int32)),
                    ],
                    [*KEY, "lo", "n", "anchor", "run", "repeats"],
                )

    return each


OPEN_WINDOWS = "_tf_id bigint, _tf_hash bigint, anchor bigint, win bigint, start int, whole boolean"


def _windows(size: int):
    """Windows of the open runs of each document; ``marks`` lists (lo, n, anchor, whole)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words = W.split(part.column("text"))
                h = words.hashes()
                rolling = W.Rolling(h, W.WORD_BASE)
                row, lo, n, anchor, whole = [], [], [], [], []
                for i, marks in enumerate(part.column("marks").to_pylist()):
                    for m in marks:
                        row.append(i)
                        lo.append(m["lo"])
                        n.append(m["n"])
                        anchor.append(m["anchor"])
                        whole.append(m["whole"])
                n = np.array(n, np.int64)
                each_row = np.repeat(np.array(row, np.int64), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(np.array(lo, np.int64), n) + step
                at = start + words.first[each_row]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(KEY[0]).take(pa.array(each_row)),
                        part.column(KEY[1]).take(pa.array(each_row)),
                        pa.array(np.repeat(np.array(anchor, np.int64), n)),
                        _signed(W.mix(rolling.ranges(at, at + size))),
                        pa.array(start.astype(np.int32)),
                        pa.array(np.repeat(np.array(whole, bool), n)),
                    ],
                    [*KEY, "anchor", "win", "start", "whole"],
                )

    return each


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Ranges [lo, lo + n) of starts of repeated windows: ``_tf_id, _tf_hash, lo, n``."""
    texts = docs.select(*key_columns(), F.coalesce("text", F.lit("")).alias("text"))
    texts = with_package(texts)
    runs = stage(texts.mapInArrow(_runs(window), RUNS), "runs")
    suspect = (
        runs.groupBy("anchor")
        .agg(F.count("*").alias("seen"), F.max("repeats").alias("inside"))
        .where("seen > 1 or inside > 0")
    )
    runs = runs.join(stage(suspect.select("anchor"), "anchors"), "anchor")
    runs = stage(runs, "suspect-runs")
    ticket = F.xxhash64(*KEY, "lo")
    by_run = stage(
        runs.groupBy("anchor", "run").agg(
            F.count("*").alias("copies"), F.max("repeats").alias("repeats"), F.min(ticket).alias("ticket")
        ),
        "run-counts",
    )
    mixed = by_run.groupBy("anchor").agg(
        ((F.count("*") > 1) | (F.max("repeats") > 0)).alias("mixed")
    )
    facts = stage(by_run.join(mixed, "anchor").where("mixed or copies > 1"), "run-facts")
    marks = runs.join(facts.drop("repeats"), ["anchor", "run"]).select(
        *KEY,
        "lo",
        "n",
        "anchor",
        (F.col("copies") > 1).alias("whole"),
        (F.col("mixed") & (F.col("ticket") == ticket)).alias("open"),
    )
    marks = stage(marks.where("whole or open"), "run-marks")
    opened = (
        marks.where("open")
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct("lo", "n", "anchor", "whole")).alias("marks"))
    )
    single = texts.join(opened, KEY).mapInArrow(_windows(window), OPEN_WINDOWS)
    single = stage(single, "open-windows")
    weight = F.when(F.col("whole"), 2).otherwise(1)
    often = (
        single.groupBy("anchor", "win").agg(F.sum(weight).alias("times")).where("times > 1").drop("times")
    )
    often = stage(often, "repeated-windows")
    found = single.where("not whole").join(often, ["anchor", "win"])
    return (
        marks.where("whole")
        .select(*KEY, "lo", "n")
        .unionByName(found.select(*KEY, F.col("start").alias("lo"), F.lit(1).alias("n")))
    )


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept string"


def _keep(size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words = W.split(part.column("text"))
                out = []
                for i, ranges in enumerate(part.column("ranges").to_pylist()):
                    f, g = words.first[i], words.first[i + 1]
                    gone = np.zeros(g - f + 1, np.int64)
                    if ranges:
                        lo = np.array([r["lo"] for r in ranges])
                        n = np.array([r["n"] for r in ranges])
                        np.add.at(gone, lo, 1)
                        np.add.at(gone, lo + n + size - 1, -1)
                    cut = np.cumsum(gone)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
                    spans = [{"start": s, "stop": t} for s, t in edge.reshape(-1, 2).tolist()]
                    kept = b" ".join(words.word(j) for j in (f + np.flatnonzero(~cut)))
                    out.append((int(g - f), int(cut.sum()), spans, kept.decode()))
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64()]
                kinds += [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    ["doc_id", "n_words", "n_removed", "spans", "kept"],
                )

    return each


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: word counts, removed word spans, and the kept words as ``kept``."""
    ranges = (
        repeated_ranges(docs, window)
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct("lo", "n")).alias("ranges"))
    )
    texts = with_key(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    )
    joined = texts.join(ranges, KEY, "left").select("doc_id", "text", "ranges")
    return with_package(joined).mapInArrow(_keep(window), KEPT)
