import json
import math
import random
import statistics
from collections import Counter

import pytest

from tallyforge.functions.student import t_975
from tallyforge.operators import runs
from tallyforge.plans.compare import compare, compare_documents
from tallyforge.sources.runs import scan_history, scan_runs


METRICS = ("accuracy", "macro_f1", "balanced_accuracy", "ece")
SEEDS = (7, 19, 52, 530)


def scores_of(seed):
    """Test metrics of a run, irregular in its seed."""
    rng = random.Random(seed)
    return {m: rng.uniform(0.2, 0.95) for m in METRICS}


def write(folder, name, seed=SEEDS[0], drop=(), model=(), training=(), **changes):
    """A run document; ``drop`` names top-level fields to leave out."""
    raw = scores_of(seed) | {"n_examples": 331, "high_risk": {"recall": 0.875}}
    document = {
        "seed": seed, "status": "complete", "smoke_test": False,
        "split_hash": "s0", "protocol_hash": "p0",
        "config": {
            "model": {"image_size": 96, "mode": "head", "name": "net|v2"} | dict(model),
            "training": {"batch_size": 5, "lr_backbone": 3e-4, "workers": 1} | dict(training),
        },
        "evaluation": {"test": {"raw": raw}},
    } | changes
    (folder / name).mkdir(parents=True)
    kept = {k: v for k, v in document.items() if k not in drop}
    (folder / name / "summary.json").write_text(json.dumps(kept, indent=1))


def groups_of(spark, folder, **options):
    return compare_documents(scan_runs(spark, str(folder)), **options).groups.collect()


def test_seeds_are_averaged_and_smoke_runs_left_out(spark, tmp_path):
    folders = []
    for i, seed in enumerate(SEEDS):
        write(tmp_path, f"run{i}", seed, drop=["status"] if i == 2 else [])
        folders.append(str(tmp_path / f"run{i}"))
    write(tmp_path, "trial", 8, smoke_test=True)
    out = str(tmp_path / "report")
    result = compare(spark, [*folders, str(tmp_path / "trial")], out)
    row = result.groups.first()
    cells = []
    for m in METRICS:
        values = [scores_of(s)[m] for s in SEEDS]
        mean, std = statistics.mean(values), statistics.stdev(values)
        assert row[f"{m}_mean"] == pytest.approx(mean)
        cells.append(f"{mean:.4f} ± {std:.4f}")
        if m == "macro_f1":
            half = t_975(len(SEEDS) - 1) * std / math.sqrt(len(SEEDS))
            assert (row["macro_f1_ci_lower"], row["macro_f1_ci_upper"]) == pytest.approx((mean - half, mean + half))
    assert row["n_seeds"] == len(SEEDS)
    assert row["macro_auroc_n"] == 0 and row["macro_auroc_mean"] is None
    assert row["high_risk_recall_mean"] == pytest.approx(0.875)
    assert [r["run"] for r in result.excluded.collect()] == ["trial"]
    lines = [r["value"] for r in spark.read.text(f"{out}/comparison.md").collect()]
    assert len(lines) == 3
    assert lines[2].startswith(f"| net\\|v2 | head | 96 | {len(SEEDS)} | " + " | ".join(cells) + " |")
    assert lines[2].endswith("| no |")
    seeds = spark.read.option("header", True).csv(f"{out}/seeds.csv")
    assert sorted(int(r["seed"]) for r in seeds.collect()) == sorted(SEEDS)


def test_recipes(spark, tmp_path):
    """Throughput settings share a group, every other setting makes its own."""
    settings = [
        ("plain", {}, {}), ("plain", {}, {"workers": 9}), ("plain", {}, {"workers": 0}),
        ("size", {"image_size": 128}, {}), ("batch", {}, {"batch_size": 6}), ("batch", {}, {"batch_size": 6, "workers": 3}),
        ("rate", {}, {"lr_backbone": 3.1e-4}), ("mode", {"mode": "all"}, {}),
    ]
    for i, (_, model, training) in enumerate(settings):
        write(tmp_path, f"r{i}", 60 + i, model=model, training=training)
    found = groups_of(spark, tmp_path)
    assert sorted(g["n_seeds"] for g in found) == sorted(Counter(kind for kind, _, _ in settings).values())
    for g in found:
        assert (g["macro_f1_std"] is None) == (g["macro_f1_ci_lower"] is None) == (g["n_seeds"] == 1)


def test_mixed_protocols(spark, tmp_path):
    for i, protocol in enumerate(("p0", "p1", "p0")):
        write(tmp_path, f"r{i}", SEEDS[i], protocol_hash=protocol)
    with pytest.raises(ValueError, match="mixed_protocol"):
        groups_of(spark, tmp_path)
    assert sorted(g["n_seeds"] for g in groups_of(spark, tmp_path, allow_mixed=True)) == [1, 2]


@pytest.mark.parametrize(
    "rule, options",
    [
        ("missing_hash", {"protocol_hash": None}), ("missing_hash", {"drop": ["split_hash"]}), ("mixed_protocol", {"split_hash": "s1"}),
        ("duplicate_seed", {"seed": SEEDS[0]}), ("no_seed", {"drop": ["seed"]}), ("no_test_metrics", {"drop": ["evaluation"]}),
        ("not_complete", {"status": "stopped"}),
    ],
)
def test_runs_that_cannot_be_compared(spark, tmp_path, rule, options):
    write(tmp_path, "good")
    write(tmp_path, "odd", **({"seed": SEEDS[1]} | options))
    with pytest.raises(ValueError, match=rule):
        groups_of(spark, tmp_path)


def test_only_smoke_runs(spark, tmp_path):
    for i, seed in enumerate(SEEDS[:2]):
        write(tmp_path, f"trial{i}", seed, smoke_test=True)
    with pytest.raises(ValueError, match="no_runs"):
        groups_of(spark, tmp_path)
    assert [g["n_seeds"] for g in groups_of(spark, tmp_path, include_smoke=True)] == [2]


def test_t_quantiles():
    # Published two-sided 95 % quantiles.
    for df, value in {1: 12.7062, 2: 4.3027, 5: 2.5706, 10: 2.2281, 30: 2.0423, 120: 1.9799}.items():
        assert t_975(df) == pytest.approx(value, abs=5e-5)


def test_expansion_meets_the_table(spark):
    df = spark.createDataFrame([(200,), (201,)], "df int")
    from tallyforge.functions.student import expansion, t_quantile_975

    row = df.filter("df = 200").select(expansion(df["df"].cast("double")).alias("e")).first()
    assert row["e"] == pytest.approx(t_975(200), abs=1e-9)
    large = df.filter("df = 201").select(t_quantile_975(df["df"]).alias("t")).first()
    assert large["t"] == pytest.approx(t_975(201), abs=1e-9)


def test_statistics_drop_undefined_values(spark):
    rows = spark.createDataFrame(
        [("g", 1.0), ("g", None), ("g", float("nan")), ("g", float("inf")), ("g", 3.0)], "k string, m double"
    )
    row = runs.seed_statistics(rows, ["k"], ["m"]).first()
    assert (row["n_seeds"], row["n"], row["mean"]) == (5, 2, 2.0)


def test_history_files(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    entries = [{"epoch": i, "train_loss": 1.0, "val_macro_f1": i / 10, "val_accuracy": 0.5, "lr": [0.1]}
               for i in (1, 2, 3)]
    (tmp_path / "r1" / "history.json").write_text(json.dumps(entries, indent=2))
    rows = scan_history(spark, str(tmp_path)).collect()
    assert [(r["run"], r["epoch"]) for r in sorted(rows, key=lambda r: r["epoch"])] == [
        ("r1", 1), ("r1", 2), ("r1", 3)
    ]
