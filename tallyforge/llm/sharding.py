"""Shards of near-equal size by histogram sort.

Documents have a total order: a hash of the text (so that copies adjoin and topics mix), the id,
and a number of the row among repeats. Shards are consecutive stretches of that order. One narrow
table (key and size, no text) is written; every round sends candidate boundaries to its partitions,
which count the exact bytes and rows below each, and the driver narrows each boundary's bracket.
When all are settled, documents are exchanged once, straight to their place.

Where boundary i lies does not depend on the probes: let its share be i / shards of all bytes, in
the middle of some document. If an edge of that document's group (equal texts) is within
``tolerance`` of a shard's bytes, the nearer such edge is taken, so groups stay whole where they can;
else the nearer edge of the document. So a shard's size is off by at most the tolerance or half a
document at each end, and a group of copies larger than that is cut, through its ids and, of one id,
through its rows.

A shard is exchanged as several parts, none with more than its share of bytes or rows; their
boundaries come from the same counts, without being exact. The driver holds counts of a few
thousand probes and of at most ``MAX_PARTS`` parts, whatever the number of documents.

Defined results: a null text counts as an empty one of 0 bytes. Null ids come first among equal
texts; repeated rows are documents of their own, and interchangeable. Fewer documents than shards
leave shards empty; an empty table gives no rows. Whole rows travel in the column ``document``, so
their column names clash with nothing. Rows that are repeated with their id are numbered by their
place in the input, which must therefore read the same each time (files do; stage other frames).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage, with_package

SHARDS = 40
TOLERANCE = 0.005  # of a shard's bytes, for edges between groups
ROW_BYTES = 16  # what a document takes besides its text
PART_BYTES = 64 << 20
MAX_PARTS = 1 << 16
PROBES = 4096  # a round, over all boundaries
LEAST_PROBES = 7  # a round and boundary
KEY_BYTES = 24
HALF = 1 << 63
COUNTS = "at int, bytes bigint, rows bigint, first binary, last binary"


def keyed(docs: DataFrame) -> list[Column]:
    """Key and size of a document: group, order and row as three whole numbers, bytes, CRC."""
    text = F.coalesce("text", F.lit(""))
    return [
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").alias("group"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-HALF)).alias("order"),
        F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()).alias("row"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ]


def key_bytes(group: np.ndarray, order: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys as 24-byte strings whose order is that of the three numbers."""
    columns = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(HALF) for c in (group, order, row)], 1)
    return np.ascontiguousarray(columns.astype(">u8")).view(f"S{KEY_BYTES}").ravel()


def as_probes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(KEY_BYTES, "big") for k in keys], f"S{KEY_BYTES}")


def _counts(probes: np.ndarray):
    """Bytes, rows, first and last key between neighbouring probes, for a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probes) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first, last = [b""] * n, [b""] * n
        for batch in batches:
            keys = key_bytes(*[np.asarray(batch.column(c)) for c in ("group", "order", "row")])
            order = np.argsort(keys, kind="stable")
            keys, upto = keys[order], np.concatenate([[0], np.cumsum(np.asarray(batch.column("size"))[order])])
            raw = keys.view(np.uint8).reshape(-1, KEY_BYTES)
            cut = np.concatenate([[0], np.searchsorted(keys, probes), [len(keys)]])
            for i in np.flatnonzero(cut[1:] > cut[:-1]):
                a, b = cut[i], cut[i + 1]
                low, high = raw[a].tobytes(), raw[b - 1].tobytes()
                first[i] = min(first[i], low) if rows[i] else low
                last[i] = max(last[i], high)
                size[i] += upto[b] - upto[a]
                rows[i] += b - a
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some.astype(np.int32)),
                pa.array(size[some]),
                pa.array(rows[some]),
                pa.array([first[i] for i in some], pa.binary()),
                pa.array([last[i] for i in some], pa.binary()),
            ],
            [c.split()[0] for c in COUNTS.split(", ")],
        )

    return run


def count_between(narrow: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows below each probe, and below each first and past each last key that
    lies between two of them."""
    cells = with_package(narrow).mapInArrow(_counts(as_probes(probes)), COUNTS).groupBy("at").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    found = {r["at"]: r for r in cells.collect()}  # one row a probe at most
    below, size, rows = {}, 0, 0
    for i in range(len(probes) + 1):
        if i:
            below[probes[i - 1]] = (size, rows)
        if i in found:
            below[int.from_bytes(found[i]["first"], "big")] = (size, rows)
            size, rows = size + found[i]["bytes"], rows + found[i]["rows"]
            below[int.from_bytes(found[i]["last"], "big") + 1] = (size, rows)
    return below


@dataclass
class Split:
    """Where shards and parts begin: keys, and how many rows lie below each."""

    shards: list[int]
    parts: list[int]
    rows: list[int]
    rounds: int


def boundaries(narrow: DataFrame, n: int = SHARDS, tolerance: float = TOLERANCE, least_parts: int = 1) -> Split:
    """Boundaries of ``n`` shards of a table of keys and sizes, and of the parts they travel in."""
    if n < 1 or n > MAX_PARTS:
        raise ValueError(f"shards must be from 1 to {MAX_PARTS}")
    top = 1 << (8 * KEY_BYTES)
    begin, step = HALF << 128, (1 << 60 << 128) // PROBES
    known = {0: (0, 0)} | count_between(narrow, [begin + i * step for i in range(PROBES)])
    size, rows = max(known.values())
    known[top - 1] = (size, rows)
    parts = min(max(least_parts, n, -(-size // PART_BYTES)), MAX_PARTS)
    rough = [(0, i * size // parts, size // parts // 4) for i in range(1, parts)]
    rough += [(1, i * rows // parts, rows // parts // 4) for i in range(1, parts)]
    exact, settled, loose, rounds = list(range(1, n)) if size else [], {}, rough if size else [], 1
    cuts: set[int] = set()
    while True:
        keys = sorted(known)
        measures = [[known[k][m] for k in keys] for m in (0, 1)]
        asked: set[int] = set()
        open_brackets = []
        for i in list(exact):
            at = bisect_right(measures[0], i * size // n)  # whole bytes: below <= share iff below <= its floor
            low, high = keys[at - 1], keys[at]
            if known[high][1] - known[low][1] > 1:
                open_brackets.append((low, high))
                continue
            edges = [low >> 128 << 128, ((low >> 128) + 1) << 128]
            if not all(e in known for e in edges):
                asked.update(edges)
                continue
            off = lambda k: abs(n * known[k][0] - i * size)  # noqa: B023, E731
            group = min(edges, key=off)
            settled[i] = group if off(group) <= tolerance * size else min((low, high), key=off)
            exact.remove(i)
        for measure, share, slack in list(loose):
            at = bisect_right(measures[measure], share)
            low, high = keys[at - 1], keys[at]
            if known[high][1] - known[low][1] > 1 and known[high][measure] - known[low][measure] > slack:
                open_brackets.append((low, high))
            else:
                cuts.add(low)
                loose.remove((measure, share, slack))
        if not open_brackets and not asked:
            break
        brackets = set(open_brackets)
        each = max(LEAST_PROBES, PROBES // max(1, len(brackets)))
        for low, high in brackets:
            asked.update((low, high))
            asked.update(low + (high - low) * j // (each + 1) for j in range(1, each + 1))
        known |= count_between(narrow, sorted(asked))
        rounds += 1
    shards = [settled[i] for i in sorted(settled)]
    starts = sorted(cuts | set(shards))
    return Split(shards, starts, [0, *(known[k][1] for k in starts)], rounds)


def _places(split: Split):
    """Part, shard, and rows of the shard in earlier parts, for each key."""
    shards, parts, rows = as_probes(split.shards), as_probes(split.parts), np.array(split.rows, np.int64)
    of_part = np.concatenate([[0], np.searchsorted(shards, parts, side="right")]) if len(parts) else np.zeros(1, np.int64)
    opening = np.full(len(shards) + 1, np.iinfo(np.int64).max)
    np.minimum.at(opening, of_part, rows)
    base = rows - opening[of_part]

    def place(group: pd.Series, order: pd.Series, row: pd.Series) -> pd.DataFrame:
        part = np.searchsorted(parts, key_bytes(group.to_numpy(), order.to_numpy(), row.to_numpy()), side="right")
        return pd.DataFrame({"part": part.astype(np.int32), "shard": of_part[part].astype(np.int32), "base": base[part]})

    return F.pandas_udf(place, "part int, shard int, base bigint")


def shard_documents(docs: DataFrame, n: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row as ``document``, with its size, text_crc32, shard and slot (from 0, in key order)."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), *keyed(docs))
    narrow = stage(whole.select("group", "order", "row", "size"), "shard-keys")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = boundaries(narrow, n, tolerance, least)
    place = _places(split)
    placed = with_package(whole).withColumn("place", place("group", "order", "row"))
    sent = placed.withColumn("part", F.col("place.part")).repartitionById(len(split.parts) + 1, F.col("part"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("group", "order", "row"))
    return sent.withColumn("slot", F.col("place.base") + at - 1).select(
        "document", "size", "text_crc32", F.col("place.shard").alias("shard"), F.col("slot").cast("bigint").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n: int = SHARDS, tolerance: float = TOLERANCE) -> None:
    """Write whole documents below ``path`` as Parquet, one folder ``shard=i`` a shard, each file a
    stretch of it in slot order. ``docs`` has no column named shard."""
    placed = shard_documents(docs, n, tolerance)
    placed.select("document.*", "shard").write.partitionBy("shard").parquet(path)
