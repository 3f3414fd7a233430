"""Nearest neighbours by largest inner product with an inverted multi-index.

Equal vectors form one class that carries its smallest ids. Vectors are cut into halves, each
quantised by its own centroids; a pair of centroids is a cell. A query walks through the cells in
the order of summed centroid products with a heap until the cells hold enough rows, and the rows
of these cells are ranked by the exact inner product in double precision.

How many rows are enough is measured, not assumed: for a bounded sample of queries the true
neighbours are found by a full scan, and the walk's length is set so that ``TARGET`` of them lie
in the cells walked. On vectors without structure this approaches a full scan; on clustered ones
it is a small part.

Cells are gathered into blocks of bounded size and larger cells are split, and the queries of a
block are split into chunks, so no task holds an unbounded group. What reaches the driver is the
sample for the centroids, cell counts and sample neighbours, all bounded by the constants below.

Defined results: rows with a null id, and vectors null, zero, of a length other than the usual
one, or holding null or non-finite numbers take no part, neither as queries nor as candidates.
Repeated rows are candidates once for each id. With fewer candidates all are returned. An empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage, with_package

FIT_ROWS = 20_000
CELL_ROWS = 50
MAX_CENTROIDS = 1024
BLOCK_ROWS = 4096
CHUNK_QUERIES = 4096
SAMPLE_QUERIES = 200
TARGET = 0.95
LEAST_ROWS = 1000


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vec`` (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vec")).where(
        F.col("vec_id").isNotNull()
        & F.col("vec").isNotNull()
        & F.coalesce(fine, F.lit(False))
        & F.exists("vec", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (usual[0]["n"] if usual else 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with a number, and the k + 1 smallest ids of each.

    Only those can be among the k nearest of any query. The rank is limited before the shuffle,
    so a vector in a third of all rows sends a few rows a task."""
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
    grouped = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stage(grouped.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")


def centroids(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    found = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        home = nearest(points, found)
        count = np.bincount(home, minlength=k)
        total = np.zeros_like(found)
        np.add.at(total, home, points)
        found[count > 0] = total[count > 0] / count[count > 0, None]
    return found


def nearest(points: np.ndarray, found: np.ndarray) -> np.ndarray:
    return ((found**2).sum(1) - 2 * points @ found.T).argmin(1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class Codebook:
    def __init__(self, sample: np.ndarray, n: int):
        k = max(1, min(round(math.sqrt(n / CELL_ROWS)), MAX_CENTROIDS, len(sample)))
        self.half = sample.shape[1] // 2
        self.left = centroids(sample[:, : self.half], k, 1)
        self.right = centroids(sample[:, self.half :], k, 2)
        self.k = k

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.left) * self.k + nearest(x[:, self.half :], self.right)

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of the two centroid products."""
        a, b = self.left @ q[: self.half], self.right @ q[self.half :]
        rows, columns = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[rows].tolist(), b[columns].tolist()
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(rows[i]) * self.k + int(columns[j])
            if j + 1 < self.k:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < self.k:
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


def _assign(book: Codebook):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(book.cells(matrix(b.column("vec"))).astype(np.int32))],
                    [*b.schema.names, "cell"],
                )

    return run


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest of each row, unordered."""
    return np.argpartition(-scores, k - 1, 1)[:, :k] if scores.shape[1] > k else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def _scan(queries: np.ndarray, own: np.ndarray, k: int):
    """Best k cells' scores of each sample query among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cls, cell = np.asarray(b.column("cls")), np.asarray(b.column("cell"))
            scores = queries @ matrix(b.column("vec")).T
            scores[own[:, None] == cls[None]] = -np.inf
            top = _top(scores, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(queries)), top.shape[1]).astype(np.int32)),
                    pa.array(cell[top].ravel()),
                    pa.array(np.take_along_axis(scores, top, 1).ravel()),
                ],
                ["q", "cell", "score"],
            )

    return run


def walk_length(book: Codebook, counts: np.ndarray, sample: pd.DataFrame, index: DataFrame, k: int) -> int:
    """Rows to walk over so that ``TARGET`` of the sample's true neighbours are met."""
    queries = np.vstack(sample["vec"])
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cell")
    true = (
        with_package(index)
        .mapInArrow(_scan(queries, sample["cls"].to_numpy(), k), "q int, cell int, score double")
        .withColumn("rank", F.row_number().over(best))
        .where(f"rank <= {k} and score > double('-Infinity')")
        .toPandas()
    )
    needed = []
    for q, group in true.groupby("q"):
        want, seen = dict(group["cell"].value_counts()), 0
        for cell in book.walk(queries[q]):
            needed += [seen + 1] * want.pop(cell, 0)
            seen += counts[cell]
            if not want:
                break
    return int(np.quantile(needed, TARGET)) + 1 if needed else 1


class Blocks:
    """Cells in blocks of at most ``BLOCK_ROWS`` rows; a larger cell has several blocks."""

    def __init__(self, counts: np.ndarray):
        self.first, self.parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        block, used = 0, 0
        for cell, n in enumerate(counts.tolist()):
            if n > BLOCK_ROWS:
                block += used > 0
                self.first[cell], self.parts[cell] = block, -(-n // BLOCK_ROWS)
                block, used = block + self.parts[cell], 0
                continue
            if used + n > BLOCK_ROWS:
                block, used = block + 1, 0
            self.first[cell] = block
            used += n


def _place(blocks: Blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, cls = np.asarray(b.column("cell")), np.asarray(b.column("cls"))
            block = blocks.first[cell] + cls % blocks.parts[cell]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], [*b.schema.names, "block"])

    return run


def _probe(book: Codebook, counts: np.ndarray, blocks: Blocks, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, q in enumerate(matrix(b.column("vec")) if b.num_rows else []):
                by_block: dict[int, list[int]] = {}
                seen = 0
                for cell in book.walk(q):
                    if counts[cell]:
                        for part in range(blocks.parts[cell]):
                            by_block.setdefault(int(blocks.first[cell]) + part, []).append(cell)
                        seen += counts[cell]
                        if seen >= rows:
                            break
                m = len(by_block)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column("cls")[i].as_py()] * m, pa.int64()),
                        pa.array(list(by_block), pa.int64()),
                        pa.array(list(by_block.values()), pa.list_(pa.int32())),
                    ],
                    ["q", "block", "cells"],
                )

    return run


def _rank(k: int):
    def run(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            x, cls, cell = np.vstack(rows["vec"]), rows["cls"].to_numpy(), rows["cell"].to_numpy()
            least = rows["least"].to_numpy()
            local = {c: i for i, c in enumerate(np.unique(cell).tolist())}
            at = np.array([local[c] for c in cell.tolist()])
            for begin in range(0, len(asks), 256):
                part = asks.iloc[begin : begin + 256]
                walked = np.zeros((len(part), len(local)), bool)
                for i, cells in enumerate(part["cells"]):
                    walked[i, [local[c] for c in cells if c in local]] = True
                q = np.vstack(part["vec"])
                scores = np.where(walked[:, at], q @ x.T, -np.inf)
                bar = np.partition(scores, -k, 1)[:, -k] if scores.shape[1] > k else np.full(len(q), -np.inf)
                bar = bar - 1e-9 * (1 + np.where(np.isfinite(bar), np.abs(bar), 0))  # ties are settled below
                who, chosen = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
                exact = (q[who] * x[chosen]).sum(1)
                order = np.lexsort((least[chosen], -exact, who))
                who, chosen, exact = who[order], chosen[order], exact[order]
                first = np.searchsorted(who, np.arange(len(q)))
                best = np.arange(len(who)) - first[who] < k
                out.append(
                    pd.DataFrame(
                        {"q": part["q"].to_numpy()[who], "cls": cls[chosen], "least": least[chosen], "score": exact}
                    )[best]
                )
        return pd.concat(out) if out else pd.DataFrame({"q": [], "cls": [], "least": [], "score": []})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k nearest rows found for
    every row where ``is_query`` holds (over ``vec_id``), ties to the smaller id."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    known = classes(rows, k)
    n = known.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    members = rows.where(is_query).select("vec_id", "vec").distinct().join(known.select("cls", "vec"), "vec")
    members = stage(members.select(F.col("vec_id").alias("query_id"), F.col("cls").alias("q")), "queries")
    fit = known.orderBy(F.xxhash64("cls")).limit(FIT_ROWS).select("vec").toPandas()
    book = Codebook(np.vstack(fit["vec"]), n)
    index = stage(with_package(known.select("cls", F.get("ids", F.lit(0)).alias("least"), "vec")).mapInArrow(
            _assign(book), "cls bigint, least bigint, vec array<double>, cell int"
        ), "index")
    counts = np.zeros(book.k**2, np.int64)
    for r in index.groupBy("cell").count().toLocalIterator():
        counts[r["cell"]] = r["count"]
    asked = members.select("q").distinct().join(known.select(F.col("cls").alias("q"), "vec"), "q")
    sample = asked.orderBy(F.xxhash64("q", F.lit(5))).limit(SAMPLE_QUERIES).toPandas().rename(columns={"q": "cls"})
    length = LEAST_ROWS
    if len(sample):
        length = max(length, walk_length(book, counts, sample, index, k))
    blocks = Blocks(counts)
    placed = with_package(index).mapInArrow(_place(blocks), "cls bigint, least bigint, vec array<double>, cell int, block bigint")
    probes = with_package(asked.select(F.col("q").alias("cls"), "vec")).mapInArrow(
        _probe(book, counts, blocks, length), "q bigint, block bigint, cells array<int>"
    )
    probes = stage(probes, "probes")
    chunks = probes.groupBy("block").agg(F.ceil(F.count("*") / CHUNK_QUERIES).alias("chunks"))
    asks = (
        probes.join(chunks, "block")
        .withColumn("chunk", F.pmod(F.xxhash64("q"), "chunks"))
        .join(asked, "q")
        .select("block", "chunk", "q", "vec", "cells")
    )
    dealt = placed.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    found = (
        with_package(dealt)
        .groupBy("block", "chunk")
        .cogroup(asks.groupBy("block", "chunk"))
        .applyInPandas(_rank(k + 1), "q bigint, cls bigint, least bigint, score double")
    )
    best = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    found = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")
    found = stage(found, "nearest-classes")
    entry = F.struct((-F.col("score")).alias("far"), F.col("id"))
    lists = (
        found.join(known.select("cls", "ids"), "cls")
        .select("q", "score", F.explode("ids").alias("id"))
        .groupBy("q")
        .agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k + 1).alias("near"))
    )
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col("query_id")), 1, k)
    return (
        members.join(lists, "q")
        .select("query_id", F.posexplode(others).alias("at", "e"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.far")).alias("score"))
    )
