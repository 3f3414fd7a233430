import random
from collections import Counter

from pyspark.sql import functions as F

from tallyforge.llm import decontaminate as D

ITEMS = "item_id bigint, text string"


def grams(text):
    w = (text or "").lower().split()
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def similarity(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


def brute(rows, items):
    out = set()
    for doc, text in rows:
        g = grams(text)
        for item, body in items:
            m = grams(body)
            if item is None or not m or not g:
                continue
            starts = range(max(1, len(g) - len(m) + 1))
            if max(similarity(g[s : s + len(m)], m) for s in starts) >= 0.75:
                out.add((doc, item))
    return out


def test_against_all_windows(spark, docs_of):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 45)))) for i in range(25)]
    items += [(50, "w1 w2 w3"), (51, None), (None, items[0][1]), (52, ""), (53, "a b a b a b a b a b a b a b")]
    rows = []
    for i in range(150):
        body = [word() for _ in range(rng.randint(0, 60))]
        kind = rng.random()
        if kind < 0.6:
            p = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] = word()
            if rng.random() < 0.3:
                p.insert(len(p) // 2, "extra")
            if rng.random() < 0.3:
                p = p[: int(len(p) * rng.choice([0.5, 0.9]))]
            at = rng.randint(0, len(body))
            body[at:at] = [x.upper() if rng.random() < 0.2 else x for x in p]
        rows.append((i, rng.choice(" \n\t").join(body)))
    rows += [(200, None), (201, ""), (None, items[3][1]), (202, "w1 W2 w3"), (203, "w1 w2 w3 w4"), (204, "a b " * 3000), (7, rows[7][1]), (205, items[4][1]), (205, items[4][1])]
    bench = spark.createDataFrame(items, ITEMS)
    got = D.leaked_documents(docs_of(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(rows, items)
    texts = dict(rows)
    for r in got:
        body = dict(items)[r["item_id"]]
        window = grams(texts[r["doc_id"]])[r["start"] : r["start"] + r["n_shingles"]]
        assert abs(similarity(window, grams(body)) - r["common"] / r["total"]) < 1e-12
    clean = D.without_leaks(docs_of(rows), bench)
    bad = {d for d, _ in brute(rows, items)}
    assert sorted(r["doc_id"] for r in clean.collect() if r["doc_id"] is not None) == sorted(d for d, _ in rows if d not in bad and d is not None)


def test_shuffled_items_give_the_same(spark, docs_of, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(f"k{i}" for i in range(20)))], ITEMS)
    docs = docs_of([(1, "x " + " ".join(f"k{i}" for i in range(20))), (2, "none of it is here at all")])
    wanted = D.leaked_documents(docs, items).collect()
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert D.leaked_documents(docs, items).collect() == wanted and len(wanted) == 1


def test_fingerprint_blocks():
    assert sum(n for _, n in D.blocks()) == 64 and len(D.blocks()) == D.RADIUS + 1


def test_simhash(spark):
    rng = random.Random(1)
    sets = [[rng.getrandbits(63) - (1 << 62) for _ in range(rng.randint(1, 40))] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(sets)), "k bigint, a array<bigint>")
    got = {r["k"]: r["_tf_print"] for r in D.fingerprints(df, ["k"], "a").collect()}
    for k, s in enumerate(sets):
        want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in s) > len(s))
        assert got[k] & ((1 << 64) - 1) == want


def test_empty_native_and_clashing(spark, docs_of):
    none = spark.createDataFrame([], ITEMS)
    assert D.leaked_documents(docs_of([(1, "a b c d e f")]), none).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f g")], ITEMS)
    assert D.leaked_documents(docs_of([]), items).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g", 5, 6)], "doc_id bigint, text string, item_id int, total int")
    kept = D.without_leaks(docs.withColumn("x", F.lit(1)), items)
    assert kept.count() == 0 and kept.columns == [*docs.columns, "x"]
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()


def cut_and_stretched(rng, length, inserted):
    """An item, and a document that holds it without its first and last word and with words in its middle."""
    item = [f"k{rng.randrange(10**6)}" for _ in range(length)]
    body = item[1:-1]
    at = len(body) // 2
    body[at:at] = [f"x{i}" for i in range(inserted)]
    around = [[f"o{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2)]
    return " ".join(item), " ".join(around[0] + body + around[1])


def best_window(text, item):
    g, m = grams(text), grams(item)
    starts = range(max(1, len(g) - len(m) + 1))
    return max(similarity(g[s : s + len(m)], m) for s in starts)


def test_best_window_between_two_alignments(spark, docs_of):
    rng = random.Random(11)
    cases = [cut_and_stretched(rng, n, k) for n, k in ((50, 2), (64, 4), (80, 4), (100, 4), (100, 5)) for _ in range(3)]
    cases = [(item, text) for item, text in cases if best_window(text, item) >= 0.75]
    assert len(cases) >= 9
    items = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(cases)], ITEMS)
    got = D.leaked_documents(docs_of([(i, text) for i, (_, text) in enumerate(cases)]), items).collect()
    found = {(r["doc_id"], r["item_id"]): r["common"] / r["total"] for r in got}
    assert set(found) == {(i, i) for i in range(len(cases))}
    for (i, _), share in found.items():
        assert abs(share - best_window(cases[i][1], cases[i][0])) < 1e-12


def test_repeated_shingles_do_not_outvote(spark, docs_of):
    rows, items = [], []
    for i in range(20):
        a, b = f"a{i}", f"b{i}"
        # nine shingles each: five of one and four of the other, so 8 of 10 in common
        items.append((i, " ".join([a, b] * 6 + [a])))
        rows.append((i, " ".join([b, a] * 6 + [b])))
        assert similarity(grams(items[-1][1]), grams(rows[-1][1])) == 0.8
    got = D.leaked_documents(docs_of(rows), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(20)}
