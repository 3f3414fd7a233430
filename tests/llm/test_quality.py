import random

import numpy as np
import pyarrow as pa

from tallyforge.llm import quality

LABELS = "doc_id bigint, label int"


def good(rng):
    return " ".join(rng.choice("the fox over lazy dogs jumps quick brown and of".split()) for _ in range(rng.randint(5, 60))) + "."


def bad(rng):
    return " ".join(rng.choice("BUY NOW!! $$$ 777 click### fox the".split()) for _ in range(rng.randint(5, 60)))


def test_neighbour_sums_against_loops():
    texts = ["a b c a", "", "b", "c a b é É x1"]
    tokens, table = quality.Tokens(pa.array(texts)), quality.index_vectors()
    want = np.zeros((quality.ROWS, quality.DIM))
    for first, last in zip(tokens.first, tokens.first[1:]):
        for i in range(first, last):
            near = [j for j in range(max(first, i - 2), min(last, i + 3)) if j != i]
            for row in tokens.rows[i]:
                want[row] += sum((table[tokens.rows[j]].sum(0) for j in near), np.zeros(quality.DIM))
    assert np.array_equal(quality.neighbour_sums(tokens, table), want)


def test_pooling_repetition():
    x = quality.pooled(np.ones((quality.ROWS, quality.DIM), np.float32), pa.array(["a a a b", "", "a b c d"]))
    at = 3 * quality.DIM
    assert x[0, at] == 0.5 and x[0, at + 1] == 0.5 and not x[1].any() and x[2, at] == 1 and x[2, at + 1] == 0


def test_learns_and_calibrates(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, good(rng) if i % 2 else bad(rng)) for i in range(600)] + [(900, None), (None, "x"), (901, ""), (902, "the " * 90_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400)] + [(None, 1), (900, 0), (401, None)], LABELS)
    network = quality.train(docs_of(rows), labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs_of(rows), network).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in range(400, 600)]) > 0.95
    assert network.temperature > 0


def test_empty(spark, docs_of):
    none = quality.train(docs_of([]), spark.createDataFrame([], LABELS))
    assert [r["score"] for r in quality.score(docs_of([(1, "a b")]), none).collect()] == [0.5]
    net = quality.fit_network(np.zeros((quality.ROWS, quality.DIM), np.float32), np.zeros((3, quality.FEATURES)), np.ones(3))
    assert quality.score(docs_of([]), net).count() == 0
    odd = spark.createDataFrame([(1, "a", 0.5, 2)], "doc_id bigint, text string, score double, label int")
    assert quality.score(odd, net).collect()[0]["score"] > 0.5
