"""Every registered query against its SQL twin on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as contract

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare_engines import TABLES, normalised  # noqa: E402

from tallyforge.workload.registry import ORACLES, QUERIES  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
ROWS_ONLY = {"stratified_group_split", "train_probe", "tune_probe"}


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return base


def test_only_known_queries_lack_a_twin():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for costly in ("NestedLoop", "Cartesian", "isnotnull(sha2", "isnotnull(array_position"):
        assert costly not in plan
    rows = [tuple(r) for r in df.collect()]
    if name in ROWS_ONLY:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    wanted = normalised([d[0] for d in cursor.description], cursor.fetchall())
    assert normalised(df.columns, rows) == wanted
