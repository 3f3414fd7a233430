"""Ranked lexical search, a term at a time with limited accumulators.

A text's terms are the maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z
lower-cased. The score of a document for an item sums, over the item's terms, the term's weight
times a saturating, length-normalised frequency, all in whole numbers (see :func:`weight`,
:func:`length_norm`, :func:`gains`).

1. One pass cuts whole texts into terms and keeps, per document, its number of terms and the
   frequencies of the terms that items ask for. That index is written; number and total length of
   the documents and document frequencies are sums over it.
2. Each task takes its part of the index in blocks, turns a block into posting lists, and serves
   every item from accumulators, rarest term first. While the gains still to come could lift a new
   document to the k-th best partial score (or to the k-th best score of the task's earlier blocks),
   a posting opens an accumulator. From then on no new ones are opened, and the remaining terms only
   update those there are, exactly. A document that ties with the k-th best is never given up.
3. The tasks' best k of each item meet in two steps, so that no item gathers them all in one task.

Items are worked on in groups of at most ``ITEM_BYTES`` of text: that, the terms' table and a block
bound a task's memory, and each group reads the documents anew.

Defined results: null texts and texts without terms are in no count and never found; items without
terms have no rows. Every row of either table is a document or an item of its own, also with a
repeated or null id; equal scores go by doc_id, nulls last. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage, with_package
from . import words as W

TOP = 10
ITEM_BYTES = 16 << 20
BLOCK_POSTINGS = 1 << 20
BLOCK_DOCS = 1 << 15
BUCKETS = 256
GAIN = 1_000_000_000
LONG = np.iinfo(np.int64)
INDEX = "doc_id bigint, n bigint, terms binary, counts binary"

FOLD = np.arange(256, dtype=np.uint8)
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
FOLD[0x41:0x5B] += 0x20


def cut(texts: pa.Array) -> W.Words:
    """Terms of some texts."""
    data, at = W.utf8(texts)
    folded = pa.py_buffer(np.ascontiguousarray(FOLD[data]))
    offsets = pa.py_buffer(np.ascontiguousarray(at.astype(np.int64)))
    return W.split(pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, offsets, folded]))


def weight(n_docs: int, df: int) -> int:
    """Of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """10 for an empty document, 100 for one of average length."""
    if len(n) and int(n.max()) * 90 * n_docs > LONG.max:
        return np.array([10 + 90 * int(v) * n_docs // total for v in n], np.int64)
    return 10 + 90 * n * n_docs // total


def gains(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth, before the term's weight; below 1,000,000."""
    return GAIN * tf // (1000 * tf + 8 * norm)


@dataclass
class Items:
    """A group of items: their ids, and their terms as numbers into a table sorted by hash."""

    ids: list[int | None]
    hashes: np.ndarray
    checks: np.ndarray
    terms: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Items:
        words = cut(pa.array([t or "" for _, t in rows], pa.string()))
        hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        spans = zip(words.first[:-1], words.first[1:])
        return Items([i for i, _ in rows], hashes, words.heads(first), [np.unique(which[a:b]) for a, b in spans])


def _index(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, checks = items.value.hashes, items.value.checks
        width = max(1, len(hashes))
        for batch in batches:
            for a, b in W.slices(batch.column("text")):
                words = cut(batch.column("text").slice(a, b - a))
                n = np.diff(words.first)
                found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(hashes) and len(words.start):
                    h = words.hashes()
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = np.flatnonzero(hashes[at] == h)
                    hit = hit[words.heads(hit) == checks[at[hit]]]
                    doc = np.searchsorted(words.first, hit, side="right") - 1
                    found, counts = np.unique(doc * width + at[hit], return_counts=True)
                edges = np.searchsorted(found, np.arange(b - a + 1) * width) * 4
                pack = lambda v: pa.Array.from_buffers(
                    pa.large_binary(), b - a, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(v.astype("<i4"))]  # noqa: B023
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n.astype(np.int64)), pack(found % width), pack(counts)],
                    ["doc_id", "n", "terms", "counts"],
                )

    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and how many each row has."""
    data, at = W.utf8(column)
    return np.frombuffer(data.tobytes(), "<i4").astype(np.int64), np.diff(at) // 4


def _frequencies(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(_numbers(batch.column("terms"))[0], minlength=width)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    return run


@dataclass
class Statistics:
    n_docs: int
    total: int
    df: np.ndarray
    weights: np.ndarray


def statistics(index: DataFrame, width: int) -> Statistics:
    """Over all documents; as many rows come back as the items have different terms."""
    row = index.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    df = np.zeros(width, np.int64)
    for r in with_package(index).mapInArrow(_frequencies(width), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([weight(row["n"], int(d)) for d in df], np.int64)
    return Statistics(row["n"], row["total"] or 0, df, weights)


class Postings:
    """A block's documents by term: rows and gains of each term, with the largest gain."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int, width: int):
        order = np.argsort(term, kind="stable")
        self.doc, self.gain, self.n_docs = doc[order], gain[order], n_docs
        self.first = np.searchsorted(term[order], np.arange(width + 1))
        self.most = np.zeros(width, np.int64)
        np.maximum.at(self.most, term, gain)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.first[term], self.first[term + 1])
        return self.doc[at], self.gain[at]


def kth(values: np.ndarray, k: int) -> int:
    """k-th largest, 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def accumulate(block: Postings, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, sums: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents of a block with an accumulator, their final sums being left in ``sums`` (zero
    before and of others), and how many terms could open one.

    ``terms`` come rarest first; ``floor`` is a score that k documents elsewhere are known to reach.
    A document without an accumulator can still gain ``left``; it is given up only if that is less
    than the floor or than the k-th best partial score.
    """
    bounds = weights * block.most[terms]
    left = np.append(np.cumsum(bounds[::-1])[::-1], 0)
    opened: list[np.ndarray] = []
    live, at = np.zeros(block.n_docs, bool), 0
    for at, term in enumerate(terms):  # noqa: B007
        if left[at] < floor:
            break
        doc, gain = block.of(term)
        if len(doc) * 4 >= k and opened:
            partial = sums[np.concatenate(opened)]
            if kth(partial, k) > left[at]:
                break
        sums[doc] += weights[at] * gain
        new = doc[~live[doc]]
        live[new] = True
        opened.append(new)
    else:
        at = len(terms)
    for later in range(at, len(terms)):
        doc, gain = block.of(terms[later])
        there = live[doc]
        sums[doc[there]] += weights[later] * gain[there]
    return np.concatenate(opened) if opened else np.zeros(0, np.int64), at


@dataclass
class Best:
    """The k best documents so far of one item; ids as numbers, nulls last by a flag."""

    k: int
    score: np.ndarray
    null: np.ndarray
    doc: np.ndarray

    def add(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        score, null, doc = np.append(self.score, score), np.append(self.null, null), np.append(self.doc, doc)
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.null, self.doc = score[order], null[order], doc[order]

    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1


FOUND = "item int, doc_id bigint, score bigint"


def _search(items, stats: Statistics, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [Best(k, none, none.astype(bool), none) for _ in items.value.ids]
        width = len(items.value.hashes)
        asked = []
        for terms in items.value.terms:
            terms = terms[stats.df[terms] > 0]
            terms = terms[np.lexsort((terms, stats.df[terms]))]
            asked.append((terms, stats.weights[terms]))
        for batch in _blocks(batches):
            numbers, size = _numbers(batch.column("terms"))
            tf, _ = _numbers(batch.column("counts"))
            norm = length_norm(np.asarray(batch.column("n")), stats.n_docs, stats.total)
            doc = np.repeat(np.arange(batch.num_rows), size)
            block = Postings(doc, numbers, gains(tf, norm[doc]), batch.num_rows, width)
            keys = batch.column("doc_id")
            null = np.asarray(keys.is_null())
            ids = np.asarray(keys.fill_null(0))
            sums = np.zeros(batch.num_rows, np.int64)
            for (terms, weights), top in zip(asked, best):
                own, _ = accumulate(block, terms, weights, k, top.floor(), sums)
                found = own[sums[own] >= top.floor()]
                if len(found) > k:
                    found = found[sums[found] >= kth(sums[found], k)]
                if len(found):
                    top.add(sums[found], null[found], ids[found])
                sums[own] = 0
        rows = [len(b.score) for b in best]
        if sum(rows):
            doc = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.null for b in best]))
            columns = [pa.array(np.repeat(np.arange(len(best), dtype=np.int32), rows)), doc, pa.array(np.concatenate([b.score for b in best]))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows joined and cut to blocks of bounded postings and documents."""
    waiting: list[pa.RecordBatch] = []
    postings = docs = 0
    for batch in batches:
        size = _numbers(batch.column("terms"))[1]
        begin = 0
        while begin < batch.num_rows:
            room = np.cumsum(size[begin:]) + postings
            take = max(1, min(int(np.searchsorted(room, BLOCK_POSTINGS, side="right")), BLOCK_DOCS - docs))
            waiting.append(batch.slice(begin, take))
            docs, postings = docs + len(waiting[-1]), postings + int(size[begin : begin + take].sum())
            begin += take
            if begin < batch.num_rows or docs >= BLOCK_DOCS:
                yield pa.concat_batches(waiting)
                waiting, postings, docs = [], 0, 0
    if waiting:
        yield pa.concat_batches(waiting)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, after k of each bucket of tasks."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["item", "bucket"], ["item"]):
        ranked = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        found = found.withColumn("rank", ranked).where(F.col("rank") <= k)
    return found.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``k`` best documents."""
    spark = docs.sparkSession
    asked = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = asked.agg(F.sum(F.octet_length("text").cast("bigint") + 64).alias("b")).first()["b"] or 0
    groups = -(-size // item_bytes)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    results = []
    for g in range(groups):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g) if groups > 1 else asked
        items = Items.of([tuple(r) for r in own.collect()])  # about item_bytes of text
        sent = spark.sparkContext.broadcast(items)
        index = stage(with_package(texts).mapInArrow(_index(sent), INDEX), "terms")
        stats = statistics(index, len(items.hashes))
        if not stats.total:
            continue
        found = with_package(index.where("length(terms) > 0")).mapInArrow(_search(sent, stats, k), FOUND)
        best = _best(found.withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(BUCKETS))), k)
        ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(items.ids)), pa.int32()), "item_id": pa.array(items.ids, pa.int64())}))
        results.append(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
