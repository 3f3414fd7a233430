"""What queries over run documents write on their way."""

import os

import pytest

from tallyforge.plans.compare import compare_documents, write_report
from tallyforge.workload import run_queries, views  # noqa: F401
from tallyforge.workload.registry import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_documents_reach_their_readers_without_files(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("run documents were written")

    monkeypatch.setattr(views, "fixture", refuse)
    record = QUERIES["run_record"](spark, FOLDER)
    assert record.count() == 1500


def test_scanned_documents_are_compressed(spark):
    files = views.run_document_files(spark, FOLDER).select("path").distinct().collect()
    assert files and all(r["path"].endswith(".gz") for r in files)


def test_report_tables_of_one_row_a_run_are_gzipped(spark, tmp_path):
    out = str(tmp_path / "report")
    write_report(compare_documents(views.run_documents(spark, FOLDER)), out)
    for name in ("runs.csv", "seeds.csv", "excluded"):
        parts = [f for f in os.listdir(f"{out}/{name}") if f.startswith("part-")]
        assert parts and all(f.endswith(".gz") for f in parts)
    assert spark.read.option("header", True).csv(f"{out}/runs.csv").count() == 1350
    assert spark.read.text(f"{out}/excluded").count() == 150
