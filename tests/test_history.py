import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import history, stopping


def stop(scores, patience, min_delta):
    """The training loop's rule, one epoch at a time."""
    best, stale, best_epoch = -1.0, 0, None
    for epoch, score in enumerate(scores, 1):
        if score > best + min_delta:
            best, stale, best_epoch = score, 0, epoch
        else:
            stale += 1
        if stale >= patience:
            return best_epoch, best, epoch, True
    return best_epoch, best, len(scores), False


def table(spark, runs):
    rows = [(r, e, float(s)) for r, scores in runs.items() for e, s in enumerate(scores, 1)]
    return spark.createDataFrame(rows, "run string, epoch int, score double").repartition(3)


def test_published_series(spark):
    row = history.early_stop(table(spark, {"r": [0.25, 0.80, 0.60, 0.80]}), 10).first()
    assert (row["best_epoch"], row["best_score"], row["stopped_early"]) == (2, 0.8, False)
    best = history.best_epoch(table(spark, {"r": [0.25, 0.80, 0.60, 0.80]})).first()
    assert (best["best_epoch"], best["best_score"]) == (2, 0.8)


@pytest.mark.parametrize("patience, min_delta", [(1, 0.0), (3, 0.05), (5, 0.2), (50, 0.01)])
def test_fold_equals_the_loop(spark, patience, min_delta):
    generator = random.Random(patience)
    runs = {}
    for i in range(60):
        n = generator.randint(1, 60)
        shape = generator.choice(["walk", "rise", "noise", "below"])
        level, scores = 0.0, []
        for e in range(n):
            level += generator.gauss(0.01, 0.05)
            scores.append(
                {"walk": level, "rise": e / 50, "noise": generator.random(), "below": -2 - e}[shape]
            )
        runs[f"r{i}"] = scores
    found = history.early_stop(table(spark, runs), patience, min_delta).collect()
    assert len(found) == len(runs)
    for r in found:
        wanted = stop(runs[r["run"]], patience, min_delta)
        assert (r["best_epoch"], r["best_score"], r["last_epoch"], r["stopped_early"]) == wanted


@pytest.mark.parametrize("chunk", [1, 3, 16])
@pytest.mark.parametrize("patience, min_delta", [(1, 0.0), (4, 0.05), (40, 0.02), (40, 0.3), (1000, 1e-9)])
def test_long_runs_by_maps_equal_the_loop(spark, patience, min_delta, chunk):
    generator = random.Random(patience * chunk)
    runs = {}
    for i in range(24):
        level, scores = -1.2, []
        for e in range(generator.randint(1, 400)):
            level += generator.gauss(0.02, 0.05)
            scores.append([level, e / 50, (e // 7) / 9 + generator.random(), -2 - e, float("nan")][min(i % 5, 4)])
        runs[f"r{i}"] = scores
    found = history.early_stop(table(spark, runs), patience, min_delta, chunk).collect()
    assert len(found) == len(runs)
    for r in found:
        wanted = stop(runs[r["run"]], patience, min_delta)
        assert (r["best_epoch"], r["best_score"], r["last_epoch"], r["stopped_early"]) == wanted


@pytest.mark.parametrize("min_delta, patience", [(0.0, 10), (0.01, 10), (0.5, 100_000)])
def test_maps_compose_in_any_grouping(min_delta, patience):
    rng = np.random.default_rng(3)
    score = np.unique(rng.random(400)) - 0.5
    epoch = np.sort(rng.choice(5000, len(score), replace=False)) + 1
    cuts = [0, 1, 50, 60, 250, len(score)]
    parts = [
        stopping.Stretch.of(score[a:b], epoch[a:b], score[a - 1] if a else -1.0, min_delta, patience)
        for a, b in zip(cuts, cuts[1:])
    ]
    whole = stopping.Stretch.of(score, epoch, -1.0, min_delta, patience)
    join = lambda a, b: a.then(b, min_delta, patience)
    left = functools.reduce(join, parts)
    right = join(parts[0], join(parts[1], join(join(parts[2], parts[3]), parts[4])))
    for name in stopping.ARRAYS:
        assert getattr(left, name).tolist() == getattr(right, name).tolist() == getattr(whole, name).tolist()


def test_a_million_rising_scores_are_not_gathered(spark):
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit("r").alias("run"), (F.col("id") + 1).alias("epoch"), (F.col("id") / n).alias("score")
    )
    found = history.early_stop(rows, patience=700, min_delta=0.0005)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    row = found.first()
    best, epoch = -1.0, 0
    for e in range(1, n + 1):
        if (e - 1) / n > best + 0.0005:
            best, epoch = (e - 1) / n, e
    assert (row["best_epoch"], row["best_score"], row["last_epoch"], row["stopped_early"]) == (epoch, best, n, False)


def test_early_stop_of_odd_tables(spark):
    assert history.early_stop(table(spark, {}), 3).count() == 0
    rows = [(None, 5, 0.5), (None, 6, 0.4), ("late", 40, 0.1)]
    df = spark.createDataFrame(rows, "run string, epoch int, score double")
    found = {r["run"]: tuple(r)[1:] for r in history.early_stop(df, 3, 0.0, chunk=4).collect()}
    assert found == {None: (None, -1.0, 3, True), "late": (None, -1.0, 3, True)}
    with pytest.raises(ValueError):
        history.early_stop(df, 3, -0.1)


def test_rising_scores_across_chunks(spark):
    generator = random.Random(0)
    scores = [generator.random() for _ in range(500)]
    found = history.rising_scores(table(spark, {"r": scores}), chunk=16).collect()
    wanted, top = [], float("-inf")
    for e, s in enumerate(scores, 1):
        if s > top:
            wanted.append(e)
            top = s
    assert sorted(r["epoch"] for r in found) == wanted


def test_positions(spark):
    generator = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", generator.random() * 30, i) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, t double, id int")
    found = history.with_position(df, "key", ["t", "id"]).collect()
    by_key = {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key.setdefault(key, []).append(i)
    for r in found:
        assert by_key[r["key"]][r["position"] - 1] == r["id"]


def test_a_key_of_one_instant_is_cut(spark):
    rows = [("one", 5.0, i) for i in range(2000)] + [("b", 1.0, 0), (None, 1.0, 3), (None, 0.5, 4)]
    df = spark.createDataFrame(rows, "key string, t double, id int").repartition(7)
    found = history.with_position(df, "key", ["t", "id"]).collect()
    assert len(found) == len(rows)
    assert all(r["position"] == r["id"] + 1 for r in found if r["key"] == "one")
    assert {r["id"]: r["position"] for r in found if r["key"] is None} == {4: 1, 3: 2}


def test_run_status_without_history(spark):
    runs = spark.createDataFrame(
        [("a", "running", None, False), ("b", "complete", True, True)],
        "run string, status string, smoke_test boolean, test_evaluated boolean",
    )
    epochs = spark.createDataFrame([("b", 1, 0.5), ("b", 2, 0.4)], "run string, epoch int, val_macro_f1 double")
    found = {r["run"]: r for r in history.run_status(runs, epochs).collect()}
    assert found["a"]["completed_epochs"] == 0 and found["a"]["best_val_macro_f1"] is None
    assert found["b"]["completed_epochs"] == 2 and found["b"]["best_val_macro_f1"] == 0.5
    assert found["a"]["smoke_test"] is False
