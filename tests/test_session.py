from types import SimpleNamespace

import pytest

from tallyforge.operators.classes import attach_class, class_table
from tallyforge.session import broadcast_if, literal_table, shared_dir, stage

from helpers import CLASSES


def fake(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_shared_folder():
    assert shared_dir(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_dir(fake("local[2]")) == shared_dir(fake("local[2]"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(fake("yarn"))


def test_staged_tables_prune_columns(spark):
    df = stage(spark.range(10).selectExpr("id", "id * 2 as twice"), "t")
    plan = df.select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<twice:bigint>" in plan
    assert df.count() == 10


def test_broadcast_hint_depends_on_the_size(spark):
    df = spark.range(10)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if(df, 10, 10)) and not hinted(broadcast_if(df, 11, 10))


def test_literal_tables(spark):
    df = literal_table(spark, [(1, "a", None), (2, "b", 0.5)], "i int, s string, d double")
    assert [tuple(r) for r in df.collect()] == [(1, "a", None), (2, "b", 0.5)]
    assert [t for _, t in df.dtypes] == ["int", "string", "double"]
    assert literal_table(spark, [], "i int").count() == 0


def test_class_dimension(spark):
    rows = spark.createDataFrame([(0,), (3,), (5,)], "label int")
    found = {r["label"]: tuple(r)[1:] for r in attach_class(rows, class_table(spark, CLASSES)).collect()}
    assert found == {0: ("high", 3, True), 3: ("non-burnable", None, False), 5: ("very_low", 0, False)}
    with pytest.raises(ValueError):
        class_table(spark, ["a", "a"])


def test_release_deletes_what_was_staged_since_a_mark(spark):
    import os

    from tallyforge.session import release, staged_since, staged_so_far

    first = stage(spark.range(3), "kept")
    mark = staged_so_far(spark)
    second, other = stage(spark.range(4), "gone"), stage(spark.range(5), "not-owned", owned=False)
    places = [df.inputFiles()[0].removeprefix("file://") for df in (first, second, other)]
    release(spark, staged_since(spark, mark))
    assert [os.path.exists(p) for p in places] == [True, False, True] and first.count() == 3
