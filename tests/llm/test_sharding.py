import random
import zlib
from collections import Counter

import pytest

from tallyforge.llm import sharding
from tallyforge.llm.queries import op13_sharding


def cut_points(groups, sizes, n, tolerance):
    """Boundaries by walking over all documents in key order."""
    total, below = sum(sizes), [0]
    for s in sizes:
        below.append(below[-1] + s)
    cuts = []
    for i in range(1, n):
        at = next(p for p in range(len(sizes)) if below[p] * n <= i * total < below[p + 1] * n)
        same = [p for p in range(len(sizes)) if groups[p] == groups[at]]
        off = lambda p: abs(below[p] * n - i * total)  # noqa: B023, E731
        edge = min((same[0], same[-1] + 1), key=off)
        cuts.append(edge if off(edge) <= tolerance * total else min((at, at + 1), key=off))
    return cuts


def check(rows, got, n, tolerance=sharding.TOLERANCE):
    """Every row once, slots gapless, sizes and CRCs right, boundaries where the rule puts them."""
    assert Counter((r["document"]["doc_id"], r["document"]["text"]) for r in got) == Counter(rows)
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert all(0 <= r["shard"] < n for r in got)
    counts = Counter(r["shard"] for r in got)
    for s, c in counts.items():
        assert [r["slot"] for r in ordered if r["shard"] == s] == list(range(c))
    for r in got:
        raw = (r["document"]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    texts = [r["document"]["text"] or "" for r in ordered]
    assert len([1 for a, b in zip(texts, texts[1:]) if a != b]) == len(set(texts)) - 1  # copies adjoin
    cuts = cut_points(texts, [r["size"] for r in ordered], n, tolerance)
    assert [r["shard"] for r in ordered] == [sum(c <= p for c in cuts) for p in range(len(ordered))]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(1000 + i, "the same passage in a third of all rows") for i in range(200)]
    rows += [(7, "one id and one text, often")] * 90 + [(None, None)] * 20 + [(None, ""), (-5, "x" * 4000)]
    return rows


@pytest.mark.parametrize("n,tolerance", [(1, 0.005), (7, 0.005), (40, 0.005), (7, 0.3), (5, 0.0)])
def test_rule(spark, docs_of, mixed, n, tolerance):
    docs = docs_of(mixed).select("doc_id", "text").repartition(5)
    docs.write.mode("overwrite").parquet(path := f"{sharding_dir(spark)}/{n}-{tolerance}")
    got = sharding.shard_documents(spark.read.parquet(path), n, tolerance).collect()
    check(mixed, got, n, tolerance)


def sharding_dir(spark):
    from tallyforge.session import new_path

    return new_path(spark, "sharding-test")


def test_sizes_are_near_equal_with_hot_groups(spark, docs_of):
    rows = [(i, "hot " * 20) for i in range(700)] + [(None, "no id " * 9)] * 600 + [(i, f"own text {i} " * 7) for i in range(800)]
    got = sharding.shard_documents(docs_of(rows).select("doc_id", "text"), 10).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 10
    assert max(abs(s - mean) for s in sizes.values()) <= 2 * sharding.TOLERANCE * mean + 112
    check(rows, got, 10)


def test_probes_count_exactly(spark):
    rows = [(g, o, r, 3 + r) for g in (0, 5, 2**60 - 1) for o in (-(2**63), -1, 4) for r in (-9, 0, 7)]
    narrow = spark.createDataFrame(rows, "`group` bigint, `order` bigint, row bigint, size bigint").repartition(3)
    key = lambda g, o, r: (g + 2**63 << 128) + (o + 2**63 << 64) + r + 2**63
    probes = sorted([0, key(5, -1, 0), key(5, -1, 1), key(6, 0, 0), key(2**60 - 1, 4, 7)])
    below = sharding.count_between(narrow, probes)
    for k, (size, n) in below.items():
        under = [r[3] for r in rows if key(*r[:3]) < k]
        assert (size, n) == (sum(under), len(under))
    assert set(probes) <= set(below)


def test_one_exchange_for_the_documents(spark, docs_of, mixed):
    plan = sharding.shard_documents(docs_of(mixed), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_odd_tables(spark, docs_of):
    assert sharding.shard_documents(docs_of([])).count() == 0
    one = sharding.shard_documents(docs_of([(1, None)])).first()
    assert (one["size"], one["text_crc32"], one["slot"]) == (16, 0, 0)
    clashing = spark.createDataFrame(
        [(1, "a b", 7, "g", "p"), (2, "c", 8, None, "q")],
        "doc_id int, text string, size int, `group` string, `a.b` string",
    )
    got = sharding.shard_documents(clashing, 2).collect()
    assert sorted(r["document"]["size"] for r in got) == [7, 8]
    assert {r["document"]["a.b"] for r in got} == {"p", "q"}
    for n in (0, -1):
        with pytest.raises(ValueError):
            sharding.shard_documents(clashing, n)


def test_files_hold_whole_documents(spark, docs_of, mixed, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs_of(mixed), path, 6)
    back = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(mixed)
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == set(range(6))


def test_registered_query(spark, docs_of, mixed, tmp_path):
    docs_of(mixed).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_sharding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    assert len(rows) == len(mixed) and {r["law"] for r in rows} == {"bytes"}
    assert {r["grown_shard"] for r in rows} == {None}
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in mixed)
