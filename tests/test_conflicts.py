"""Texts that occur in several languages: splits that resolve them equal their SQL twins."""

import duckdb
import pytest

from test_queries import normalised

from tallyforge.operators import splits
from tallyforge.workload import dataset_queries  # noqa: F401
from tallyforge.workload.registry import ORACLES, QUERIES

SHORT = ("De.", "La.", "En.", "A.", "In der.", "On.")
LANGS = ("fr", "es", "en", "de", "en")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """157 documents, of which every third is one of six texts in all four languages."""
    path = tmp_path_factory.mktemp("conflicts")
    rows = [
        (i, SHORT[i // 3 % 6] if i % 3 == 0 else f"text {i - i % 2}", LANGS[i % 5] if i % 3 == 0 else LANGS[i // 2 % 5])
        for i in range(157)
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    table.coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize(
    "name",
    [
        "attach_split", "class_counts", "manifest_sink", "split_cover", "split_fractions", "splits_io",
        "stratified_split", "group_split_facts", "prepare", "prepare_grown",
        "dedup_first",
    ],
)
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cursor = duck.execute(ORACLES[name])
    wanted = normalised([d[0] for d in cursor.description], cursor.fetchall())
    assert normalised(df.columns, [tuple(r) for r in df.collect()]) == wanted


def test_quota_beyond_the_contents_that_a_class_keeps(spark):
    """Class 1 has 3 contents of its own and 37 beside them: its 28 for training take all three."""
    rows = [(i, 0, f"c{i}") for i in range(37)] + [(37 + i, 1, f"c{i}") for i in range(40)]
    table = spark.createDataFrame(rows, "idx bigint, label int, fp string")
    found = splits.stratified_split(table, conflicts="lowest").collect()
    assert len(found) == 40
    assert [r["split"] for r in found if r["label"] == 1] == ["train"] * 3
    with pytest.raises(ValueError, match="conflicts must be"):
        splits.stratified_split(table, conflicts="first")


def test_groups_of_several_labels_move_whole_and_classes_meet_their_targets(spark):
    """One text in 40 rows of either class, and 40 texts of three rows of class 1 besides."""
    rows = [(i, i % 2, "both") for i in range(80)]
    rows += [(80 + i, 1, f"c{i // 3}") for i in range(120)] + [(200 + i, 0, f"d{i}") for i in range(100)]
    table = spark.createDataFrame(rows, "idx bigint, label int, fp string")
    with pytest.raises(ValueError, match="conflicting"):
        splits.stratified_group_split(table)
    found = splits.stratified_group_split(table, conflicts="lowest").collect()
    assert sorted((r["idx"], r["label"], r["fp"]) for r in found) == rows
    assert len({(r["fp"], r["split"]) for r in found}) == 141
    for label, total in ((0, 140), (1, 160)):
        for split, share in (("train", 0.7), ("validation", 0.15), ("test", 0.15)):
            n = sum(r["label"] == label and r["split"] == split for r in found)
            assert abs(n - share * total) <= 3
