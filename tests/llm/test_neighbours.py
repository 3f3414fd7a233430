import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k):
    good = {}
    for key, v, _ in rows:
        if key is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8:
            good[key] = np.array(v, np.float32).astype(float)
    out = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-float((good[q] * x).sum()), i) for i, x in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def check(spark, rows, k, recall):
    got = collect(neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k))
    want = brute(rows, k)
    assert set(got) == {q for q in want if want[q]}
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in got]
    assert np.mean(hits) >= recall
    for q, near in got.items():
        true = dict(want[q])
        assert all(abs(true[i] - s) < 1e-12 for i, s in near if i in true) and len(near) == len(want[q])
    return got, want


def test_recall_on_many_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 8))
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    check(spark, rows, 20, 0.9)


def test_copies_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, size=(300, 8)).astype(float)
    rows = [(i, row.tolist(), 0) for i, row in enumerate(x)]
    rows += [(1000 + i, x[5].tolist(), 0) for i in range(200)]
    rows += [(2000, None, 0), (2020, [0.0] * 8, 0), (2040, [1.0] * 7 + [None], 0), (2060, [float("nan")] + [1.0] * 7, 0)]
    rows += [(2080, [1.0] * 3, 0), (None, [1.0] * 8, 0), (2100, [float("inf")] * 8, 0), (0, x[0].tolist(), 0)]
    got, want = check(spark, rows, 20, 1.0)
    assert got == want


def test_few_rows(spark):
    rows = [(0, [1.0] + [0.0] * 7, 1), (20, [2.0] + [0.0] * 7, 1), (3, [0.0, 1.0] + [0.0] * 6, 1)]
    got, want = check(spark, rows, 20, 1.0)
    assert got == want
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    odd = spark.createDataFrame([(0, [1.0, 2.0], 3, "x"), (1, [1.0, 0.0], 3, "y")], "vec_id bigint, embedding array<float>, cls int, vec string")
    assert collect(neighbours.search(odd, F.col("vec_id") % 20 == 0)) == {0: [(1, 1.0)]}


def test_blocks_split_large_cells():
    b = neighbours.Blocks(np.array([10, 9000, 4000, 90, 96, 3]))
    assert b.parts.tolist() == [1, 3, 1, 1, 1, 1]
    assert b.first.tolist() == [0, 1, 4, 4, 5, 5]
