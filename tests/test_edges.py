"""Inputs that used to give an answer without a word."""

import math

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.vectors import UNROLL_LIMIT, dot, map_over, sum_over, with_softmax
from tallyforge.operators import calibration, checks, history, runs
from tallyforge.sources import headers


@pytest.mark.parametrize("bucket", [10, 100, 3])
def test_offsets_across_missing_edges(spark, bucket):
    rows = spark.createDataFrame([(0, 0), (9, 50), (11, 20), (12, 30), (31, 40), (32, 40)], "pos bigint, o bigint")
    found = {r["rule"]: r["violations"] for r in checks.check_offsets(rows, "pos", "o", 40, bucket).collect()}
    assert found == {"start": 0, "not_increasing": 2, "end": 0, "gap": 8 + 1 + 18}
    assert {r["violations"] for r in checks.check_offsets(rows.limit(0), "pos", "o", 5).collect()} == {0, 1}


@pytest.mark.parametrize("k", [UNROLL_LIMIT - 1, UNROLL_LIMIT + 1])
def test_wrong_lengths_are_never_summed(spark, k):
    rows = spark.createDataFrame(
        [(i, [1.0] * (k + d)) for i, d in enumerate((0, 2, -2))] + [(3, None)], "i int, x array<double>"
    )
    found = rows.select(
        "i",
        sum_over(F.col("x"), k, lambda v: v).alias("sum"),
        dot(F.col("x"), F.array_repeat(F.lit(2.0), k), k).alias("dot"),
        F.array_max(F.transform(map_over(F.col("x"), k, lambda v: v + 1), lambda v: F.nvl(v, F.lit(0.0)))).alias("map"),
    ).collect()
    assert (found[0]["sum"], found[0]["dot"], found[0]["map"]) == (k, 2 * k, 2.0)
    for r in found[1:]:
        assert math.isnan(r["sum"]) and math.isnan(r["dot"]) and math.isnan(r["map"])
    soft = with_softmax(rows.filter("i in (0, 1)"), k, logits="x").orderBy("i").collect()
    assert sum(soft[0]["probs"]) == pytest.approx(1) and all(map(math.isnan, soft[1]["probs"]))


@pytest.mark.parametrize(
    "label, logits", [(2, [1.0, 0.0]), (-1, [1.0, 0.0]), (None, [1.0, 0.0]), (0, [float("nan"), 0.0]),
                      (0, [1.0, float("inf")]), (0, [1.0]), (0, [1.0, 0.0, 0.0]), (0, None)]
)
def test_temperature_refuses_bad_rows(spark, label, logits):
    rows = spark.createDataFrame([(0, [2.0, 1.0]), (label, logits)], "label int, logits array<double>")
    with pytest.raises(ValueError, match="bad labels or logits: 1"):
        calibration.fit_temperature(rows, 2)


def test_nan_never_wins(spark):
    rows = spark.createDataFrame(
        [("a", 1, 0.5), ("a", 2, float("nan")), ("a", 3, 0.7), ("b", 1, float("nan"))],
        "run string, epoch bigint, score double",
    )
    found = {r["run"]: (r["best_epoch"], r["best_score"]) for r in history.best_epoch(rows).collect()}
    assert found == {"a": (3, 0.7), "b": (None, None)}
    stop = {r["run"]: r["best_epoch"] for r in history.early_stop(rows, 5).collect()}
    assert stop == {"a": 3, "b": None}
    grid = spark.createDataFrame([(0, 0.4), (1, float("nan")), (2, 0.9), (3, 0.9)], "candidate int, score double")
    assert runs.select_recipe(grid).first()["candidate"] == 2


def test_profile_of_unmeasured_pictures(spark):
    jpeg = bytes.fromhex("FFD8FFE000104A46494600")
    rows = spark.createDataFrame([(0, jpeg), (1, b"text"), (2, None)], "idx bigint, payload binary")
    found = headers.image_header(rows)
    profile = {(r["kind"], r["value"]): r["n"] for r in headers.image_profile(found).collect()}
    assert profile[("dimensions", "unknown")] == 3 and profile[("format", "JPEG")] == 1
    full = headers.measured(found, lambda b: (40, 30, "RGB") if b.startswith(b"\xff") else None)
    profile = {(r["kind"], r["value"]): r["n"] for r in headers.image_profile(full).collect()}
    assert profile[("dimensions", "40x30")] == 1 and profile[("mode", "unknown")] == 2
