"""The pipeline against plain loops over the same texts."""

import random

import corpus_pipeline
from test_decontaminate import brute as leaked
from test_lines import brute as cleaned
from test_minhash import brute as grouped

from tallyforge.llm import lines

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ka ta pa sa na mo ru".split()) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    rows, boiler = [], "read more on this page now"
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(4, 30))) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            parts.insert(0, boiler)
        if i % 17 == 5:
            parts.append(items[i % 5][1])
        rows.append((i, "\n".join(parts), "aa", f"s{i % 20}", 0))
    for i in range(120, 150):
        base = rows[i - 120][1].split(" ")
        base[rng.randrange(len(base))] = "edit"
        rows.append((i, " ".join(base) if i % 2 else rows[i - 120][1], "aa", f"s{i % 20}", 0))
    rows += [(200, None, "aa", "s1", 0), (201, "", "aa", "s1", 0), (202, "12 34 !", "aa", "s2", 6), (203, "日本語 日本", None, "s2", 0)]
    rows += [(204, boiler, "aa", "s3", 0), (None, "ka ta pa sa na mo", None, None, None)]
    return rows, items


def expected(rows, items):
    rows = [r for r in rows if r[1] and any(c.isascii() and c.isalpha() for c in r[1])]
    after = cleaned([(r[0], r[1], r[2], r[3]) for r in rows], lines.MIN_SITES)
    rows = [(k, t) for k, _, gone, t in after if not gone or t.split()]
    keep = {k for k, _, _, kept in grouped(rows) if kept}
    rows = [r for r in rows if r[0] in keep]
    bad = {d for d, _ in leaked(rows, items)}
    return {r[0]: r[1] for r in rows if r[0] not in bad}


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == seen and docs.schema["n_chars"].dataType.typeName() == "long"
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == expected(rows, items)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(got)
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
