"""Quality scores: random-indexing word vectors, pooled per document, and a small network.

Each word gives three tokens: the word, its ending, and its shape (which kinds of characters it
has). Tokens are hashed to rows of a table of fixed size. Every row has a sparse random index
vector; a row's word vector is the sum of the index vectors of the words that stand near it, over
the whole corpus. The sums are whole numbers, so their order does not matter. A document is the
mean of its tokens' vectors, with a few figures on repetition. A two-layer network is fitted in
numpy on a bounded sample of labelled rows, and a temperature fitted on a part held back makes
its outputs probabilities.

Defined results: a null text counts as empty and is scored from its zero vector. Rows with a null
text, label or id train nothing. A document id with several labels trains with each. Without any
usable label every score is 0.5; with one class only, all scores lean to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_package
from . import words as W

WORD_ROWS, ENDING_ROWS, SHAPE_ROWS = 6144, 1536, 512
ROWS = WORD_ROWS + ENDING_ROWS + SHAPE_ROWS
DIM = 24
NONZERO = 6
REACH = 2
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 40
FEATURES = 3 * DIM + 5


def index_vectors() -> np.ndarray:
    """Sparse rows of -1, 0 and 1, the same in every process."""
    rng = np.random.default_rng(20_177)
    table = np.zeros((ROWS, DIM), np.float64)
    at = np.argsort(rng.random((ROWS, DIM)), 1)[:, :NONZERO]
    np.put_along_axis(table, at, rng.choice([-1.0, 1.0], at.shape), 1)
    return table


_KIND = np.zeros(256, np.uint8)  # bits of a word's shape
_KIND[[*range(ord("a"), ord("z") + 1)]] = 1
_KIND[[*range(ord("A"), ord("Z") + 1)]] = 2
_KIND[[*range(ord("0"), ord("9") + 1)]] = 4
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 8
_KIND[[ord(c) for c in ".,;:'\"-"]] = 16
_KIND[[ord(c) for c in "!?"]] = 32
_KIND[128:] = 64


class Tokens:
    """Table rows of the tokens of each word of some texts."""

    def __init__(self, texts: pa.Array):
        words = W.split(texts)
        self.first = words.first
        self.n = len(words.start)
        self.hash = words.hashes()
        if not self.n:
            self.rows = np.zeros((0, 3), np.int64)
            return
        size = words.end - words.start
        kinds = np.bitwise_or.reduceat(np.append(_KIND[words.data], 0), np.ravel(np.column_stack([words.start, words.end])))[::2]
        initial = _KIND[words.data[words.start]]
        last = words.data[words.end - 1].astype(np.uint64)
        before = np.where(size > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.uint64)
        code = W.mix(kinds.astype(np.uint64) << np.uint64(16) | initial.astype(np.uint64) << np.uint64(8) | np.minimum(size, 15).astype(np.uint64) >> np.uint64(2))
        tail = W.mix(last << np.uint64(8) | before)
        self.rows = np.column_stack(
            [
                (self.hash % np.uint64(WORD_ROWS)).astype(np.int64),
                WORD_ROWS + (tail % np.uint64(ENDING_ROWS)).astype(np.int64),
                WORD_ROWS + ENDING_ROWS + (code % np.uint64(SHAPE_ROWS)).astype(np.int64),
            ]
        )

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def neighbour_sums(tokens: Tokens, table: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of the words within reach, added up by token row."""
    own = table[tokens.rows].sum(1)
    owner, near = tokens.owner(), np.zeros_like(own)
    for step in range(1, REACH + 1):
        same = (owner[step:] == owner[:-step])[:, None]
        near[step:] += own[:-step] * same
        near[:-step] += own[step:] * same
    out = np.empty((ROWS, DIM))
    rows = tokens.rows.ravel()
    for d in range(DIM):
        out[:, d] = np.bincount(rows, weights=np.repeat(near[:, d], 3), minlength=ROWS)
    return out


SUMS = "row int, " + ", ".join(f"d{i} bigint" for i in range(DIM))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, total = index_vectors(), None
    for batch in batches:
        for a, b in W.slices(batch.column("text")):
            tokens = Tokens(batch.column("text").slice(a, b - a))
            if tokens.n:
                some = neighbour_sums(tokens, table)
                total = some if total is None else total + some
    if total is not None:
        rows = np.flatnonzero(np.abs(total).any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), *[pa.array(total[rows, d].astype(np.int64)) for d in range(DIM)]],
            [c.split()[0] for c in SUMS.split(", ")],
        )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all table rows, from every document. The table has a fixed size."""
    rows = docs.where("text is not null").select("text")
    sums = (
        with_package(rows)
        .mapInArrow(_contexts, SUMS)
        .groupBy("row")
        .agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(DIM)])
        .toPandas()
    )
    table = np.zeros((ROWS, DIM))
    table[sums["row"].to_numpy(int)] = sums[[f"d{i}" for i in range(DIM)]].to_numpy(float)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(size, 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, texts: pa.Array) -> np.ndarray:
    """One feature row a text."""
    tokens = Tokens(texts)
    count = np.diff(tokens.first)
    out = np.zeros((len(count), FEATURES))
    if not tokens.n:
        return out
    some = np.flatnonzero(count)
    starts, n = tokens.first[:-1][some], count[some][:, None]
    for k in range(3):
        out[some, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[tokens.rows[:, k]], starts) / n
    owner = tokens.owner()
    order = np.lexsort((tokens.hash, owner))
    h, o = tokens.hash[order], owner[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))
    repeat = np.append(False, (tokens.hash[1:] == tokens.hash[:-1]) & (owner[1:] == owner[:-1]))
    at = 3 * DIM
    out[some, at] = np.bincount(o[fresh], minlength=len(count))[some] / n[:, 0]
    out[some, at + 1] = np.bincount(owner[repeat], minlength=len(count))[some] / n[:, 0]
    out[some, at + 2] = np.log1p(n[:, 0]) / 8
    for k in range(2):
        mean = out[some, k * DIM : (k + 1) * DIM]
        out[some, at + 3 + k] = np.linalg.norm(mean, axis=1)
    return out


@dataclass
class Network:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.shift) * self.scale
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -40, 40)))


def fit_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss over four fifths, temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    back, train = order[: len(x) // 5], order[len(x) // 5 :]
    shift, spread = x[train].mean(0), x[train].std(0)
    net = Network(
        vectors, shift, 1 / np.maximum(spread, 1e-3),
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), float(np.log((y[train].mean() * len(train) + 1) / ((1 - y[train].mean()) * len(train) + 1))),
    )
    z = (x[train] - net.shift) * net.scale
    state, step = [[0.0, 0.0] for _ in range(4)], 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(train))
        for i in range(0, len(train), 128):
            own = mixed[i : i + 128]
            a, t = z[own], y[train][own]
            hidden = np.maximum(a @ net.w1 + net.b1, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -40, 40)))
            delta = (p - t) / len(own)
            to_hidden = np.outer(delta, net.w2) * (hidden > 0)
            slopes = [a.T @ to_hidden + 1e-4 * net.w1, to_hidden.sum(0), hidden.T @ delta + 1e-4 * net.w2, delta.sum()]
            step += 1
            for k, (name, g) in enumerate(zip(("w1", "b1", "w2", "b2"), slopes)):
                m = state[k][0] = 0.9 * state[k][0] + 0.1 * g
                v = state[k][1] = 0.999 * state[k][1] + 0.001 * g * g
                move = 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - move)
    if len(back):
        raw, t = net.logits(x[back]), y[back]
        losses = {
            c: np.logaddexp(0, np.where(t > 0, -raw, raw) / c).mean() for c in np.exp(np.linspace(-1.5, 2.5, 81))
        }
        net.temperature = float(min(losses, key=losses.get))
    return net


def _features(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column("text")):
                x = pooled(vectors, batch.column("text").slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))],
                    ["label", "x"],
                )

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Vectors from all of ``docs``; the network from at most ``sample`` rows of ``labels``
    (doc_id, label), those whose ids hash lowest."""
    vectors = word_vectors(docs)
    chosen = (
        labels.where("doc_id is not null and label is not null")
        .select("doc_id", F.col("label").cast("int").alias("label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id", F.lit(3)), "label")
        .limit(sample)
    )
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = with_package(rows.select("label", "text")).mapInArrow(_features(vectors), "label int, x array<double>")
    found = found.limit(4 * sample).toPandas()
    if not len(found):
        zero = np.zeros
        return Network(vectors, zero(FEATURES), zero(FEATURES), zero((FEATURES, HIDDEN)), zero(HIDDEN), zero(HIDDEN), 0.0)
    order = np.lexsort(np.vstack(found["x"]).T)
    return fit_network(vectors, np.vstack(found["x"])[order], found["label"].to_numpy(float)[order])


SCORES = "doc_id bigint, score double"


def _score(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column("text")):
                x = pooled(network.vectors, batch.column("text").slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(network.scores(x))], ["doc_id", "score"]
                )

    return run


def score(docs: DataFrame, network: Network) -> DataFrame:
    """Probability of label 1 for every row of ``docs``: doc_id, score."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_package(rows).mapInArrow(_score(network), SCORES)
