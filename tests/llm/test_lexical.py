import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import lexical
from tallyforge.llm.queries import op11_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return TERM.findall(low)


def brute(docs, items, k=10):
    """Every document against every item."""
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for doc, bag, n in bags:
            m = 10 + 90 * n * n_docs // total
            s = 0
            for t in set(terms(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if s:
                scores.append((-s, doc is None, doc or 0))
        for rank, (s, null, doc) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if null else doc, -s))
    return sorted(out, key=repr)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)] + ["the", "The", "È", "è", "日本", "x_y", "a-b", "7", "ÇA"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", "\n", "; "]).join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(500)]
    docs += [(1000 + i, "w150 w151 the copy that is everywhere") for i in range(250)]  # ties beyond rank 10
    docs += [(None, "w150 w151 null id"), (None, None), (5, ""), (6, "-- ;; "), (7, "w3 " * 9000), (5, "w199 w199"), (5, "w199 w199")]
    items = [(i, text(rng.randint(1, 25))) for i in range(40)]
    items += [(100, "w150 w151"), (100, "w150 w151"), (None, "w199"), (101, None), (102, "!?"), (103, "unheard of"), (104, "THE w199 the")]
    return docs, items


def test_terms_are_the_maximal_matches():
    texts = ["Aé9_b-C", "", "ÀÉ x\tY\n", " ", "日本_語 z", "a\x00b\x7fc", "ſK"]
    words = lexical.cut(pa.array(texts))
    got = [[words.word(i).decode() for i in range(a, b)] for a, b in zip(words.first, words.first[1:])]
    assert got == [terms(t) for t in texts]


@pytest.mark.parametrize("block_docs,block_postings", [(1 << 15, 1 << 20), (64, 1 << 20), (1 << 15, 100)])
def test_against_brute_force(spark, docs_of, corpus, monkeypatch, block_docs, block_postings):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block_postings)
    docs, items = corpus
    got = lexical.search(docs_of(docs).repartition(3), spark.createDataFrame(items, ITEMS))
    assert rows(got) == brute(docs, items)


def test_items_in_groups(spark, docs_of, corpus):
    docs, items = corpus
    got = lexical.search(docs_of(docs), spark.createDataFrame(items, ITEMS), k=3, item_bytes=1500)
    assert rows(got) == brute(docs, items, 3)


@pytest.mark.parametrize("seed", range(20))
def test_accumulators_are_limited_and_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    n, width, k = 400, 30, 5
    held = rng.random((n, width)) < np.linspace(0.01, 0.9, width)
    doc, term = np.nonzero(held)
    gain = rng.integers(1, 40, len(doc))
    weights = np.linspace(900, 1, width).astype(np.int64)
    full = np.zeros(n, np.int64)
    np.add.at(full, doc, weights[term] * gain)
    block = lexical.Postings(doc, term, gain, n, width)
    sums = np.zeros(n, np.int64)
    floor = 1 if seed % 2 else int(np.sort(full)[-8])
    own, opening = lexical.accumulate(block, np.arange(width), weights, k, floor, sums)
    assert opening < width and len(own) == len(set(own))
    assert (sums[own] == full[own]).all()
    assert sums.sum() == sums[own].sum()
    reach = np.sort(full)[-k] if seed % 2 else max(floor, np.sort(full)[-k])
    assert set(np.flatnonzero(full >= reach)) <= set(own)  # ties included


def test_long_lengths_do_not_overflow():
    n = np.array([3, 10**9])
    got = lexical.length_norm(n, 10**11, 10**13)
    assert got.tolist() == [10 + 90 * int(v) * 10**11 // 10**13 for v in n]


def test_empty_tables(spark, docs_of):
    docs, items = docs_of([(1, "a b")]), spark.createDataFrame([(1, "a")], ITEMS)
    nobody = spark.createDataFrame([], ITEMS)
    for d, i in ((docs_of([]), items), (docs, nobody), (docs_of([(1, None), (2, "?")]), items)):
        got = lexical.search(d, i)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id bigint, text string, rank int, item string")
    items = spark.createDataFrame([(9, "b", "y", 3)], "item_id bigint, text string, doc_id string, score int")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in lexical.search(docs, items).collect()] == [(9, 1, 1)]


def test_registered_query(spark, docs_of, corpus, tmp_path):
    docs, items = corpus
    docs_of(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(op11_lexical_search(spark, str(tmp_path))) == brute(docs, items)
