import random
from collections import Counter

from tallyforge.llm import substrings

SPACES = " \t\n\v\f\r"


def words(text):
    return (text or "").encode().split()


def brute(rows, size):
    count = Counter()
    for _, text in rows:
        w = words(text)
        count.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for key, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((key, len(w), len(gone), kept))
    return sorted(out, key=repr)


def run(docs_of, rows, size):
    got = substrings.remove_repeats(docs_of(rows), size).collect()
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr)


def test_against_brute_force(docs_of):
    rng = random.Random(11)
    passages = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 90))] for _ in range(6)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                p = list(rng.choice(passages))
                if rng.random() < 0.5:
                    p[rng.randrange(len(p))] = "changed"
                parts += p[rng.randint(0, 4) :]
            else:
                parts += [f"u{rng.randrange(30)}" for _ in range(rng.randint(0, 40))]
        rows.append((i, "".join(x + rng.choice(SPACES) for x in parts)))
    for size in (3, 8, 35):
        assert run(docs_of, rows, size) == brute(rows, size)


def test_odd_inputs(docs_of):
    period = " ".join(["a", "b", "c"] * 40)
    rows = [
        (1, None), (2, ""), (3, " \n"), (None, "x " * 60), (None, "x y"), (4, period), (5, "Ä ö " * 9),
        (6, " ".join(f"v{i}" for i in range(50))), (6, " ".join(f"v{i}" for i in range(50))),
        (7, " ".join(f"v{i}" for i in range(49)) + " other"), (8, "z" * 9000 + " " + " ".join(map(str, range(20000)))),
        (9, " ".join(map(str, range(300, 9000)))), (10, " ".join(f"q{i}" for i in range(35))),
    ]
    for size in (4, 35):
        assert run(docs_of, rows, size) == brute(rows, size)


def test_empty_and_clashing(spark, docs_of):
    assert substrings.remove_repeats(docs_of([])).count() == 0
    docs = spark.createDataFrame([(1, "a b a b", 7, "g")], "doc_id bigint, text string, lo int, kept string")
    assert [r["kept"] for r in substrings.remove_repeats(docs, 2).collect()] == [""]
