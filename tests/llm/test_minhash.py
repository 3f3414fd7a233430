import random
import re

import numpy as np

import pyarrow as pa

from tallyforge.llm import minhash


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    some = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(some[i] & some[j])
            if common and 100 * common >= 75 * len(some[i] | some[j]):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        comp = (min(ids) if ids else None) if some[i] else key
        out.append((key, len(some[i]), comp, comp == key))
    return sorted(out, key=repr)


def run(docs):
    got = minhash.near_duplicates(docs).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def many(seed, n_base, copies):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for _ in range(n_base):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 220))]
        if rng.random() < 0.4:
            base[1:1] = passage
        for _ in range(rng.choice(copies)):
            rows.append((len(rows), " ".join(changed(rng, base, rng.choice([0, 0, 1, 2, 4])))))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(docs_of):
    rows = many(3, 60, [1, 1, 2, 3, 12])
    assert run(docs_of(rows)) == brute(rows)


def test_large_group_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_LIST", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "LEADERS", 1)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(changed(rng, base, 3))) for i in range(90)]
    rows += [(100 + i, " ".join(f"x{rng.randrange(9999)}" for _ in range(50))) for i in range(10)]
    assert run(docs_of(rows)) == brute(rows)


def test_large_sets_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_LIST", 2)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(changed(rng, base, rng.choice([5, 20, 40])))) for i in range(40)]
    assert run(docs_of(rows)) == brute(rows)


def test_overlaps_against_sets():
    rng = random.Random(2)
    rows = [np.array(sorted(rng.sample(range(120), rng.randint(1, 60))), np.int32) for _ in range(50)]
    got = minhash.Overlaps(rows)
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in rows] for a in rows]
    whole = np.vstack([got.strip(0, 20), got.strip(20, 50)])
    np.fill_diagonal(whole, 0)
    assert np.array_equal(whole, np.array(want) - np.diag(np.diag(want)))


def test_odd_inputs(docs_of, spark):
    rows = [
        (5, "A b c"), (9, "a B\tc"), (1, "a b c d"), (2, None), (3, ""), (4, " \n"), (None, "a b c"), (None, "z z z z z z z"),
        (7, "z z z z z"), (8, "É é"), (10, "é é"), (11, "x " * 50_000), (12, "x x x x x"), (6, "one two three four five six"), (6, "one two three four five six"),
    ]
    assert run(docs_of(rows)) == brute(rows)
    kept = minhash.keep_one(docs_of(rows)).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(ids) == sorted({r[0] for r in brute(rows) if r[3] and r[0] is not None})
    assert run(docs_of([])) == [] and minhash.keep_one(docs_of([])).count() == 0
    odd = spark.createDataFrame([(1, "a", 3, "s"), (2, "a", 3, "s")], "doc_id bigint, text string, n int, sketch string")
    assert [r["doc_id"] for r in minhash.keep_one(odd).collect()] == [1]


def test_sets_are_shingles():
    texts = ["a b c d e f", "A B C D E F", "a b", "", "a a a a a a a"]
    got = minhash.sets(pa.array(texts))
    assert [len(s) for s in got] == [len(shingle_set(t)) for t in texts] and list(got[0]) == list(got[1])


def test_keep_one_without_ids_and_shared_ids(docs_of):
    long = [f"w{i}" for i in range(60)]
    copy = lambda *extra: " ".join([*long, *extra])
    other = lambda *extra: " ".join([f"v{i}" for i in range(60)] + list(extra))
    rows = [(None, copy()), (None, copy("p")), (None, copy("q")), (7, other()), (7, other("p")), (9, other("q")), (None, None), (None, ""), (None, None)]
    kept = minhash.keep_one(docs_of(rows)).collect()
    assert sum((r["text"] or "").startswith("w0 ") for r in kept) == 1
    assert [r["doc_id"] for r in kept if (r["text"] or "").startswith("v0 ")] == [7]
    assert sum(not r["text"] for r in kept) == 3
