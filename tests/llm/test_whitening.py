import numpy as np
import pytest

from tallyforge.llm import whitening
from tallyforge.llm.queries import op12_whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def dense(spectrum):
    return spectrum.basis @ np.diag(spectrum.values) @ spectrum.basis.T


def scatter(block):
    centred = block - block.mean(axis=0)
    return centred.T @ centred


@pytest.mark.parametrize("seed", range(40))
def test_rank_one_update(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 40))
    values = np.sort(rng.choice([0, 1, 1, 1 + 1e-15, 2, rng.random()], d) * rng.choice([1, 1e-9, 1e6]))
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    vector = rng.normal(size=d) * rng.choice([1, 1e-7, 1e4])
    if seed % 4 == 0:
        vector = 3 * basis[:, 0]  # an eigenvector: all but one coordinate deflates
    wanted = basis @ np.diag(values) @ basis.T + np.outer(vector, vector)
    got, vectors = whitening.rank_one(values, basis, vector)
    assert np.abs(vectors @ np.diag(got) @ vectors.T - wanted).max() <= 1e-13 * np.abs(wanted).max()
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
    assert (np.diff(got) >= 0).all()


def test_secular_roots_interlace_and_solve():
    d, z = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-3, 1.0, 2.0, 1e-4])
    pole, x = whitening.secular_roots(d, z)
    wanted = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
    assert np.allclose(d[pole] + x, wanted, rtol=1e-14, atol=1e-15)
    roots = d[pole] + x
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()


def test_zero_vector_changes_nothing():
    values, basis = whitening.rank_one(np.zeros(3), np.eye(3), np.zeros(3))
    assert (values == 0).all() and (basis == np.eye(3)).all()


@pytest.mark.parametrize("cuts", [[], [1], [3, 4, 200], [50, 100, 150, 250]])
def test_blocks_and_merges_give_the_scatter(cuts):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(300, 6)) * [900, 80, 80, 1, 0, 5]).astype(np.int64) + whitening.OFFSET
    spectra = []
    for part in np.split(rows, cuts):
        spectrum = whitening.Spectrum.empty(6)
        for block in np.array_split(part, 3):
            spectrum = spectrum.add(block)
        spectra.append(spectrum)
    whole = spectra[0]
    for s in spectra[1:]:
        whole = whole.merge(s)
    assert whole.n == 300 and whole.sums == [int(v) for v in rows.sum(axis=0)]
    wanted = scatter(rows.astype(float))
    assert np.abs(dense(whole) - wanted).max() <= 1e-11 * np.abs(wanted).max()


def brute(vectors, k=8):
    """Integers, exact centred products in Python's whole numbers, then one eigensolver."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    apart = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[float(sum(a[i] * a[j] for a in apart)) for j in range(d)] for i in range(d)]) / float(n) ** 3
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return (
        [sum(v * v for v in a) for a in apart],
        (np.array(apart, float) / n) @ basis / np.sqrt(values),
        values / np.trace(cov),
    )


def compare(got, ids, vectors, k=8):
    deviations, white, explained = brute(vectors, k)
    assert len(got) == len(ids) * white.shape[1]
    table = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(white.shape[1]):
        mine = np.array([table[(i, j + 1)]["whitened"] for i in ids])
        sign = np.sign(mine @ white[:, j])
        assert np.allclose(mine, sign * white[:, j], atol=1e-8)
        for i, dev in zip(ids, deviations):
            r = table[(i, j + 1)]
            assert (r["n"], r["deviation"]) == (len(ids), dev)
            assert r["explained"] == pytest.approx(explained[j], rel=1e-9)
            assert r["identity_error"] <= 1e-9


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(240, 12)) * np.linspace(0.02, 1.5, 12) + 3
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(120)]  # one vector in a third of the rows
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    compare(got, [r[0] for r in rows], [r[1] for r in rows])


def test_many_partitions_combine_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(90, 3)).astype(np.float32))]
    good, size = whitening.usable(spark.createDataFrame(rows, SCHEMA).repartition(9))
    spectrum = whitening.spectrum_of(good, size)
    x = np.array([np.floor(1024 * np.array(r[1])) + 100_000 for r in rows])
    assert spectrum.n == 90
    assert np.abs(dense(spectrum) - scatter(x)).max() <= 1e-12 * np.abs(scatter(x)).max()


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, -2.0], 0), (None, [0.25, 0.0, 9.0], 0), (1, [3.0, 3.0, 3.5], 0), (4, [0.0, 0.0, 0.0], 0)]
    bad = [(5, None, 0), (6, [nan, 1.0, 1.0], 0), (7, [inf, 1.0, 1.0], 0), (8, [None, 1.0, 1.0], 0), (9, [], 0), (10, [1.0], 0), (11, [1e38, 1.0, 1.0], 0)]
    got = whitening.whitened(spark.createDataFrame(good + bad, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {None, 1, 4} and {r["n"] for r in got} == {4}
    assert len(got) == 4 * 3


def test_no_variance_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(9)], [(1, None, 0)]):
        got = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
        assert got.count() == 0 and got.schema.simpleString().startswith("struct<vec_id:bigint")
    flat = [(i, [float(i % 5), 7.0, 1.0], 0) for i in range(40)]  # one direction only
    assert {r["component"] for r in whitening.whitened(spark.createDataFrame(flat, SCHEMA)).collect()} == {1}


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(i, [float(2**39 * (i % 2)), float(2**38 * (i % 3))], 0) for i in range(6)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int")).collect()
    assert {r["deviation"] for r in got} == {None} and len(got) == 12


def test_registered_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(200, 10)).astype(np.float32))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), [r[0] for r in rows], [r[1] for r in rows])
