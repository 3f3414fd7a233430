import math
import random

import numpy as np
import pytest

from tallyforge.functions.vectors import with_softmax
from tallyforge.operators import bootstrap, calibration, metrics

from helpers import one_hot, predictions


def rows_of(spark, labels, logits):
    return spark.createDataFrame(
        [(y, [float(v) for v in z]) for y, z in zip(labels, logits)], "label int, logits array<double>"
    )


def test_temperature_of_one_margin_by_hand(spark):
    # 12 of 15 rows right at margin 5: the softmax must give 4/5, so 5 / t = ln 4
    rows = rows_of(spark, [2] * 12 + [0] * 3, [[0, -400, 5]] * 15)
    found = calibration.fit_temperature(rows, 3)
    assert found == pytest.approx(5 / math.log(4), rel=1e-6)
    loss = lambda t: metrics.mean_nll(with_softmax(rows, 3, t)).first()["nll"]
    assert loss(found) < min(loss(1.0), loss(found * 1.1), loss(found / 1.1))


def test_temperature_is_the_minimum(spark):
    generator = random.Random(2)
    logits = [[generator.gauss(0, 4) for _ in range(4)] for _ in range(300)]
    labels = [z.index(max(z)) if generator.random() < 0.5 else generator.randrange(4) for z in logits]
    found = calibration.fit_temperature(rows_of(spark, labels, logits), 4)

    def loss(t):
        z = np.array(logits) / t
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(labels)), labels]))

    fine = np.linspace(math.log(0.05), math.log(20), 40001)
    best = math.exp(min(fine, key=lambda u: loss(math.exp(u))))
    assert found == pytest.approx(best, rel=1e-3)
    assert loss(found) <= loss(best) + 1e-12


@pytest.mark.parametrize("scale", [0.11, 0.9, 1.0, 3.0, 15.0])
def test_a_few_scans_find_the_temperature(monkeypatch, scale):
    """The same loss in numpy stands in for the scans, which are counted."""
    generator = np.random.default_rng(5)
    x = generator.normal(0, 3, (4000, 5))
    p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    labels = (p.cumsum(1) > generator.random((4000, 1))).argmax(1)
    logits, asked = x * scale, []

    def moments(_, k, scales):
        asked.append(len(scales))
        out = []
        for s in scales:
            z = logits * s
            top = z.max(1, keepdims=True)
            w = np.exp(z - top)
            q, own = w / w.sum(1, keepdims=True), logits[np.arange(4000), labels]
            mean = (q * logits).sum(1)
            loss = np.log(w.sum(1)) + top[:, 0] - s * own
            out.append((loss.mean(), (mean - own).mean(), ((q * logits**2).sum(1) - mean**2).mean()))
        return out

    monkeypatch.setattr(calibration, "_moments", moments)
    found = calibration.fit_temperature(None, 5)
    assert len(asked) <= 4 and max(asked) <= 7
    slope = moments(None, 5, [1 / found])[0]
    assert abs(slope[1] / slope[2] * found) < 1e-8  # what a Newton step would still change


def test_bounds_and_fallback(spark):
    assert calibration.fit_temperature(rows_of(spark, [0, 1], [[9, 0], [0, 9]]), 2) == pytest.approx(0.05)
    assert calibration.fit_temperature(rows_of(spark, [1, 0], [[9, 0], [0, 9]]), 2) == pytest.approx(20)
    with pytest.raises(ValueError):
        calibration.fit_temperature(rows_of(spark, [0], [[1, 0]]).limit(0), 2)


def test_long_arrays(spark):
    generator = random.Random(2)
    logits = [[generator.gauss(0, 2) for _ in range(30)] for _ in range(60)]
    labels = [z.index(max(z)) if i % 2 else generator.randrange(30) for i, z in enumerate(logits)]
    rows = rows_of(spark, labels, logits)
    short = calibration._moments(rows, 30, [0.7])
    z = np.array(logits) * 0.7
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    x = np.array(logits)
    slope = ((p * x).sum(1) - x[np.arange(60), labels]).mean()
    assert short[0][1] == pytest.approx(slope)


def test_bootstrap_repeats_itself_and_has_no_width_without_errors(spark):
    labels = [i % 3 for i in range(40)]
    rows = predictions(spark, labels, one_hot(labels, 3))
    found = [
        sorted(tuple(r) for r in bootstrap.bootstrap_ci(rows.repartition(n), 3, 25, 13).collect())
        for n in (1, 6)
    ]
    assert found[0] == found[1]
    assert all(estimate == lower == upper for _, estimate, lower, upper in found[0])
    with pytest.raises(ValueError):
        bootstrap.bootstrap_ci(rows, 3, -1, 13)


def noisy(spark, n, k, seed):
    generator = random.Random(seed)
    labels, probs = [], []
    for _ in range(n):
        y = 0 if generator.random() < 0.6 else generator.randrange(1, k)
        p = [generator.random() + (1.0 if c == y else 0) for c in range(k)]
        labels.append(y)
        probs.append([v / sum(p) for v in p])
    return labels, probs, predictions(spark, labels, probs)


def test_blocks_and_partitions_change_nothing(spark):
    labels, _, rows = noisy(spark, 1200, 3, 1)
    frame = metrics.score_frame(rows, 3, keep=["idx"])
    found = []
    for block_rows, parts in ((1, 1), (64, 3), (300, 5), (10**9, 2)):
        tally = bootstrap.replicate_tallies(frame.repartition(parts), 3, 12, 5, block_rows, leaf_rows=40)
        found.append({(r["b"], r["kind"], r["key"]): tuple(r)[3:] for r in tally.collect()})
    for other in found[1:]:
        assert set(other) == set(found[0])
        for key, values in other.items():
            assert values == pytest.approx(found[0][key], abs=1e-9)
    supports = {(b, key): v[0] for (b, kind, key), v in found[0].items() if kind == "class" and v[0]}
    assert supports == {(b, c): labels.count(c) for b in range(12) for c in range(3)}


def test_many_leaves_spread_like_one(spark):
    labels, _, rows = noisy(spark, 1200, 3, 1)
    frame = metrics.score_frame(rows, 3, keep=["idx"])
    spread = []
    for leaf_rows in (10**6, 50):
        tally = bootstrap.replicate_tallies(frame, 3, 200, 5, leaf_rows=leaf_rows)
        values = [r["accuracy"] for r in metrics.scalars(tally, 3, ["b"]).collect()]
        spread.append((np.mean(values), np.std(values)))
    truth = metrics.scalars(metrics.tallies(metrics.cells(frame)), 3).first()["accuracy"]
    for mean, std in spread:
        assert mean == pytest.approx(truth, abs=0.004)
        assert std == pytest.approx(spread[0][1], rel=0.25)


def test_shares_follow_sizes():
    every = np.arange(400)
    shares = bootstrap.left_share(1, every, 2, 0, 0, np.full(400, 1000), 30, 100)
    assert np.mean(shares) == pytest.approx(300, abs=3) and 10 < np.std(shares) < 19
    nine = np.full(1, 9)
    assert bootstrap.left_share(1, every[:1], 2, 0, 0, nine, 0, 5) == [0] and bootstrap.left_share(1, every[:1], 2, 0, 0, nine, 5, 5) == [9]
    assert [bootstrap.tree_depth(n, 10) for n in (0, 1, 10, 11, 20, 21, 40, 41)] == [0, 0, 0, 1, 1, 2, 2, 3]


@pytest.mark.parametrize("n, p", [(1, 0.3), (7, 0.5), (30, 0.9), (40, 0.02), (60, 0.4), (25, 0.5), (3000, 0.01), (100_000, 0.5)])
def test_binomial_is_exact(n, p):
    """Counts of every outcome against its probability, within five standard errors."""
    size = 200_000
    got = bootstrap.binomial(np.full(size, n), p, *bootstrap.stream_keys(3, np.arange(size), 1, 2, n))
    assert got.min() >= 0 and got.max() <= n
    found = np.bincount(got, minlength=n + 1)
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(n + 1)]
    wanted = size * np.exp(logs)
    assert np.all(np.abs(found - wanted) <= 5 * np.sqrt(wanted) + 6)
    common = wanted > 20
    chi = ((found - wanted)[common] ** 2 / wanted[common]).sum()
    assert chi < common.sum() + 5 * math.sqrt(2 * common.sum()) + 5
    assert got.mean() == pytest.approx(n * p, abs=5 * math.sqrt(n * p * (1 - p) / size))


def test_mixed_trial_counts_in_one_call():
    n = np.tile([0, 1, 5, 300, 10**6], 2000)
    first, second = bootstrap.stream_keys(1, np.arange(len(n)), 0, 0, 0)
    got = bootstrap.binomial(n, 0.25, first, second)
    for v in np.unique(n):
        assert got[n == v].mean() == pytest.approx(v / 4, abs=5 * math.sqrt(v * 0.1875 / 2000) + 1e-9)
    assert np.array_equal(got[:50], bootstrap.binomial(n[:50], 0.25, first[:50], second[:50]))  # whatever comes along


def test_streams_do_not_collide():
    """Two million streams of neighbouring replicates, classes, levels and nodes: all first keys and
    all second keys differ, and so do the draws."""
    replicates = np.arange(1000)
    keys = [bootstrap.stream_keys(42, replicates, y, level, node) for y in range(4) for level in (0, 9) for node in range(250)]
    for which in (0, 1):
        assert len(np.unique(np.concatenate([k[which] for k in keys]))) == len(keys) * 1000
    first = [bootstrap.counter_bits(*k, np.zeros(1000)) for k in keys]
    assert len(np.unique(np.concatenate(first))) == len(keys) * 1000


def test_bootstrap_spread_matches_plain_resampling(spark):
    labels, probs, rows = noisy(spark, 400, 2, 3)
    found = {r["metric"]: r for r in bootstrap.bootstrap_ci(rows, 2, 400, 11).collect()}
    generator = np.random.default_rng(0)
    right = np.array([int(np.argmax(p)) == y for p, y in zip(probs, labels)])
    y = np.array(labels)
    plain = []
    for _ in range(400):
        picks = np.concatenate([generator.choice(np.flatnonzero(y == c), (y == c).sum()) for c in (0, 1)])
        plain.append(right[picks].mean())
    low, high = np.quantile(plain, [0.025, 0.975])
    assert found["accuracy"]["lower"] == pytest.approx(low, abs=0.012)
    assert found["accuracy"]["upper"] == pytest.approx(high, abs=0.012)


def test_draws_are_uniform_and_in_range():
    def drawn(replicate, n=200_000):
        first, second = bootstrap.stream_keys(1, np.array([replicate]), 3, 4, 5)
        return bootstrap.draws(first, second, np.arange(n), 50)

    counts = np.bincount(drawn(2), minlength=50)
    assert len(counts) == 50
    assert abs(counts / 4000 - 1).max() < 0.08
    assert not np.array_equal(drawn(2, 99), drawn(3, 99))
