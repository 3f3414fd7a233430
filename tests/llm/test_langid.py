import itertools
import random

import numpy as np
import pytest

from tallyforge.llm import langid

VOWELS = {"aa": "ka ta pa sa na".split(), "bb": "ol um er ix ob".split(), "cc": "че ши до ра".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(VOWELS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, text(rng, l, 40), l) for i, l in enumerate(list(VOWELS) * 30)]
    return langid.train(docs_of(rows + [(900, None, "aa"), (901, "zzz", None), (902, "", "bb")]))


def brute(scores, penalty):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(scores[t, l] for t, l in enumerate(path))
        value -= penalty * sum(a != b for a, b in zip(path, path[1:]))
        best = value if best is None else max(best, value)
    return best


def test_viterbi_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(150):
        scores, penalty = rng.normal(size=(rng.integers(1, 8), 3)) * 2, rng.uniform(0, 4)
        path = langid.best_path(scores, penalty)
        value = scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()
        assert value == pytest.approx(brute(scores, penalty))


def test_labels_and_spans(model):
    rng = random.Random(3)
    a, b, c = (text(rng, l, 12) for l in VOWELS)
    got = langid.label(model, [a, b, c, f"{a}. {b}", None, "", "12 !? 3", "日本"])
    assert [g[0] for g in got[:3]] == ["aa", "bb", "cc"]
    assert [s["lang"] for s in got[3][2]] == ["aa", "bb"]
    s = got[3][2][1]
    assert f"{a}. {b}"[s["start"] : s["stop"]] == b and 0.3 < got[3][1] < 0.8
    assert [g[:2] for g in got[4:7]] == [("und", 0.0)] * 3 and got[7][0] in VOWELS


def test_frame(spark, docs_of, model):
    rng = random.Random(4)
    rows = [(i, text(rng, l, rng.randint(1, 200)), l) for i, l in enumerate(list(VOWELS) * 20)]
    rows += [(None, None), (3, rows[3][1], "aa"), (99, "ka " * 30_000)]
    got = langid.identify(docs_of(rows), model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:60]}
    assert np.mean([truth.get(r["doc_id"], "aa") == r["lang_pred"] for r in got if r["doc_id"] is not None]) > 0.95
    assert langid.identify(docs_of([]), model).count() == 0
    odd = spark.createDataFrame([(1, "ka ta", 5, "x")], "doc_id bigint, text string, score int, spans string")
    assert langid.identify(odd, model).collect()[0]["lang_pred"] == "aa"


def test_nothing_to_learn(docs_of):
    model = langid.train(docs_of([]))
    rows = [(1, "abc"), (2, None), (3, "12")]
    assert [r["lang_pred"] for r in langid.identify(docs_of(rows), model).collect()] == ["und"] * 3
    assert [r["doc_id"] for r in langid.accepted(docs_of(rows), model, 0.3).collect()] == [1]


def test_accepted(spark, model):
    rows = [(1, "ka ta pa", "x", 1.5), (2, None, "x", None), (3, "!!", "x", 1.0), (4, "日本語日本語", None, 1.0), (None, "ol um er", "y", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string, score double")
    kept = langid.accepted(docs, model, 0.3)
    assert kept.schema == docs.schema and [tuple(r) for r in kept.collect()] == [rows[0], rows[4]]
