import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import fitting, probe, runs
from tallyforge.plans.search import tune_probe, validation_score


def features(spark, n=240, seed=0):
    generator = random.Random(seed)
    centres = [[3, 0, 0, 1], [0, 3, 0, 1], [0, 0, 3, 1]]
    rows = []
    for i in range(n):
        y = i % 3
        x = [c + generator.gauss(0, 0.6) for c in centres[y]]
        split = ["train", "train", "validation", "test"][generator.randrange(4)]
        rows.append((i, y, x, split))
    return spark.createDataFrame(rows, "idx bigint, label int, features array<float>, split string")


def test_batches_equal_expressions_and_score_every_row_once(spark):
    rows = features(spark).repartition(5)
    head = probe.Head([[0.5, -1, 2, 0.1], [1, 1, 1, 1], [0, 0, 0, 3]], [0.1, 0.0, -0.2])
    a = {r["idx"]: r["logits"] for r in probe.score_linear(rows, head).collect()}
    scored = probe.score_batches(rows, probe.head_scorer(head), "features").collect()
    b = {r["idx"]: r["logits"] for r in scored}
    assert len(scored) == 240 and set(a) == set(b) == set(range(240))
    for i in a:
        assert a[i] == pytest.approx(b[i], abs=1e-9)


def test_normalisation(spark):
    row = probe.normalised(features(spark, 3), "features", "x").first()
    assert np.mean(row["x"]) == pytest.approx(0, abs=1e-9)
    assert np.var(row["x"]) == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("balanced", [False, True])
def test_probe_learns(spark, balanced):
    rows = features(spark)
    head = probe.train_probe(rows.filter("split = 'train'"), 3, balanced=balanced, max_iter=30)
    assert validation_score(rows.filter("split = 'validation'"), head) > 0.9
    named = probe.predict(probe.score_linear(rows, head), ["a", "b", "c"], 2.0).first()
    assert named["prediction"] in "abc"
    assert sum(named["probabilities"].values()) == pytest.approx(1)


def test_class_without_rows_is_never_predicted(spark):
    rows = features(spark).filter("label < 2")
    head = probe.train_probe(rows, 3, max_iter=10)
    assert {r["prediction"] for r in probe.predict(probe.score_linear(rows, head), ["a", "b", "c"]).collect()} == {"a", "b"}


def test_search_skips_finished_recipes(spark):
    done = spark.createDataFrame([(0.5, False, 5, 0.25)], "l2 double, balanced boolean, max_iter int, score double")
    results = tune_probe(features(spark), 3, l2=[0.01, 0.5], max_iter=[5], done=done)
    found = {r["l2"]: r["score"] for r in results.collect()}
    assert found[0.5] == 0.25 and found[0.01] > 0.9
    assert runs.select_recipe(results).first()["l2"] == 0.01


def test_results_are_stored_and_not_computed_again(spark, tmp_path, monkeypatch):
    store, rows = str(tmp_path / "results"), features(spark)
    first = tune_probe(rows, 3, l2=[0.01], max_iter=[5], store=store).collect()
    both = tune_probe(rows, 3, l2=[0.01, 0.5], max_iter=[5], store=store).collect()
    assert both[0] == first[0] and spark.read.parquet(store).count() == 2
    monkeypatch.setattr(fitting, "fit_grid", None)
    assert tune_probe(rows, 3, l2=[0.5, 0.01], max_iter=[5], store=store).count() == 2


def objective(x, y, weights, l2, k):
    """Penalised loss and gradient in plain loops."""

    def at(w):
        loss, gradient = 0.0, np.zeros_like(w)
        for row, label in zip(x, y):
            z = w[:, :-1] @ row + w[:, -1]
            p = np.exp(z - z.max())
            p /= p.sum()
            loss -= weights[label] * np.log(p[label])
            p[label] -= 1
            gradient += weights[label] * np.outer(p, np.append(row, 1))
        mass = sum(weights[v] for v in y)
        gradient /= mass
        gradient[:, :-1] += l2 * w[:, :-1]
        return loss / mass + l2 / 2 * (w[:, :-1] ** 2).sum(), gradient

    return at


def test_grid_reaches_the_optimum_with_certificates(spark):
    rows = features(spark, 90).filter("idx % 7 <> 0")
    table = sorted((r["idx"], r["label"], list(r["features"])) for r in rows.collect())
    x = np.array([f for _, _, f in table])
    x = x - x.mean(1, keepdims=True)
    x /= np.sqrt((x * x).mean(1, keepdims=True) + fitting.LAYER_NORM_EPS)
    y = [label for _, label, _ in table]
    grid = [fitting.Recipe(l2, balanced, 200) for l2 in (0.003, 0.3) for balanced in (False, True)]
    fits = fitting.fit_grid(rows.repartition(3), 3, grid)
    for recipe, fit in zip(grid, fits):
        weights = [len(y) / (3 * y.count(c)) if recipe.balanced else 1.0 for c in range(3)]
        at = objective(x, y, weights, recipe.l2, 3)
        head = np.hstack([fit.weights, fit.bias[:, None]])
        loss, gradient = at(head)
        assert fit.converged and fit.gradient_norm <= fitting.TOLERANCE
        assert loss == pytest.approx(fit.loss, abs=1e-12)
        assert np.linalg.norm(gradient) == pytest.approx(fit.gradient_norm, abs=1e-9)
        rng = np.random.default_rng(0)
        for size in (1e-3, 0.1, 1.0):
            assert at(head + size * rng.normal(size=head.shape))[0] > loss


def test_scans_do_not_grow_with_the_grid(spark, monkeypatch):
    rows, scans = features(spark), []
    plain = fitting.losses
    monkeypatch.setattr(fitting, "losses", lambda *a: scans.append(len(a[1])) or plain(*a))
    one = [fitting.Recipe(0.1, False, 25)]
    fitting.fit_grid(rows, 3, one)
    alone = len(scans)
    scans.clear()
    fitting.fit_grid(rows, 3, one + [fitting.Recipe(0.1, b, 25) for b in (True, False)] + [fitting.Recipe(0.5, True, 25)])
    assert len(scans) <= 1.5 * alone + 2 and scans[0] == 4


def test_fit_of_odd_tables(spark):
    nothing = features(spark).filter("label > 90")
    for rows in (nothing, features(spark).withColumn("features", F.lit(None).cast("array<float>"))):
        with pytest.raises(ValueError, match="nothing to fit"):
            fitting.fit_grid(rows, 3, [fitting.Recipe()])
    uneven = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "label int, features array<float>")
    with pytest.raises(ValueError, match="length"):
        fitting.fit_grid(uneven, 3, [fitting.Recipe()])


def test_first_candidate_wins_ties(spark):
    rows = spark.createDataFrame([(2, 0.5, "x"), (1, 0.5, "y"), (0, 0.4, "z")], "candidate int, score double, name string")
    assert runs.select_recipe(rows).first()["name"] == "y"


def test_run_matrix(spark):
    recipes = spark.createDataFrame([("a",), ("b",)], "recipe string")
    done = spark.createDataFrame([("a", 42)], "recipe string, seed int")
    left = runs.run_matrix(recipes, [42, 100], done).collect()
    assert sorted((r["recipe"], r["seed"]) for r in left) == [("a", 100), ("b", 42), ("b", 100)]
