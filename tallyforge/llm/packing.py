"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become runs of token ids with an end id; those longer than a sequence are cut into
full pieces and a rest. Pieces are dealt into groups of bounded size, each packed by best-fit
decreasing. Dual feasible functions give a lower bound of a group's bins: a group that reaches
it is certified. Groups with a gap give up their emptiest bins; these are pooled across groups,
dealt anew, and packed again. A pool keeps the old bins if the new ones are not fewer.

Defined results: a null text counts as empty and yields one piece, the end id. A null or repeated
doc_id is carried as it is; every row is a document of its own. Other columns are ignored. An
empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import math
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, with_package
from . import words as W

CAPACITY = 2048
GROUP_PIECES = 20_000
ROUNDS = 2
CACHED_WORDS = 2_000_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint"


class WordTokenizer:
    """Token ids of whole texts from the ids of their words.

    For a tokenizer that splits at white space and drops it, the ids of a text are those of its
    words in a row, so a worker encodes each word once. Words are known by their hash, length
    and first eight bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, words: W.Words, samples: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> None:
        texts = [words.word(i).decode() for i in samples]
        codes = [c.ids for c in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.fromiter(itertools.chain.from_iterable(codes), np.uint32, int(size.sum()))
        begin = len(self.flat) + np.cumsum(size) - size
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.check = np.insert(self.check, at, checks)
        self.begin = np.insert(self.begin, at, begin)
        self.size = np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, flat])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more at the end)."""
        words = W.split(texts)
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(len(words.first), np.int64)
        hashes, samples, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        checks = words.heads(samples)
        if len(self.known) + len(hashes) > CACHED_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)
        if new.any():
            self.learn(words, samples[new], hashes[new], checks[new])
            at = np.searchsorted(self.known, hashes)
        if (self.check[at] != checks).any():  # two words with one hash: start over
            self.forget()
            self.learn(words, samples, hashes, checks)
            at = np.arange(len(hashes))
        count = self.size[at][which]
        after = np.cumsum(count)
        index = np.arange(after[-1]) + np.repeat(self.begin[at][which] - (after - count), count)
        return self.flat[index], np.concatenate([[0], after])[words.first]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that known words outlast a task."""
    return WordTokenizer(path)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, deal = word_tokenizer(path), 0
        for batch in batches:
            for a, b in W.slices(batch.column("text")):
                keys = batch.column("doc_id").slice(a, b - a).to_pylist()
                ids, at = tokenizer.texts(batch.column("text").slice(a, b - a))
                rows = []
                for i, key in enumerate(keys):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for p, begin in enumerate(range(0, len(own), capacity)):
                        part = own[begin : begin + capacity]
                        rows.append((key, p, begin, len(part), zlib.crc32(part.tobytes()), deal))
                        deal += 1
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "deal"],
                )

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and ``deal``, a number
    that spreads the pieces of a task evenly over groups."""
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    cut = with_package(texts).mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES)
    return cut.withColumn("deal", F.xxhash64(F.spark_partition_id(), "deal"))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    The first rounds lengths over ``capacity - e`` up to full and drops those under e; the second
    counts how many shares of 1/(k+1) a length exceeds.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    size = np.arange(capacity + 1)
    some, total = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(capacity // 2 + 1)
    large = some[-1] - some[capacity - e]
    small = np.where(e > 0, total[np.maximum(e - 1, 0)], 0)
    best = int((large * capacity + total[capacity - e] - small).max())
    bound = -(-best // capacity)
    for k in range(1, 25):
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, (scaled // capacity) * capacity)
        bound = max(bound, -(-int((count * value).sum()) // (k * capacity)))
    return bound


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, lengths taken in the given order.

    Open bins are kept by free space; a bit mask of the spaces in use finds the tightest fit.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, n = 0, 0
    for i, length in enumerate(lengths.tolist()):
        fitting = used >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            home = by_space[space].pop()
            if not by_space[space]:
                used ^= 1 << space
        else:
            space, home, n = capacity, n, n + 1
        bins[i], offsets[i] = home, capacity - space
        left = space - length
        if left:
            if not by_space[left]:
                used |= 1 << left
            by_space[left].append(home)
    return bins, offsets


PACKED = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "sequence_id bigint, offset bigint, released boolean"
)


def _pack(capacity: int, base: int, last: bool):
    """Packs a group; ids of new sequences are ``base`` + group * 2**24 + bin."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable"
        ).reset_index(drop=True)
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        n = int(bins.max()) + 1
        if "sequence_id" in group and group["sequence_id"].nunique() <= n:
            return group.assign(released=False)[[c.split()[0] for c in PACKED.split(", ")]]
        gap = n - lower_bound(lengths, capacity)
        released = np.zeros(n, bool)
        if gap > 0 and not last:
            fill = np.bincount(bins, weights=lengths, minlength=n)
            emptiest = np.argsort(fill, kind="stable")[: 16 * gap + 16]
            released[emptiest[fill[emptiest] < capacity]] = True
        group["sequence_id"] = base + (int(key[0]) << 24) + bins
        group["offset"] = offsets
        group["released"] = released[bins]
        return group[[c.split()[0] for c in PACKED.split(", ")]]

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``sequence_id`` and ``offset`` of every piece. Sequences are gapless from offset 0."""
    cut = stage(cut, "pieces")
    n = max(1, math.ceil(cut.count() / group_pieces))
    dealt = cut.withColumn("group", F.pmod("deal", F.lit(n))).drop("deal")
    done = None
    for step in range(ROUNDS + 1):
        last = step == ROUNDS or n == 1
        packed = (
            with_package(dealt)
            .groupBy("group")
            .applyInPandas(_pack(capacity, step << 56, last), PACKED)
        )
        packed = stage(packed, "packed")
        kept = packed.where(~F.col("released")).drop("released")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        released = packed.where("released").drop("released")
        n = math.ceil(released.count() / group_pieces)
        if not n:
            break
        dealt = released.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(n)))
    return done


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """Pieces of whole documents with their places in as few sequences as the rounds reach."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)
