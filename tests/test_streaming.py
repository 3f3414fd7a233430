import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import metrics
from tallyforge.sources.documents import read_document, write_document
from tallyforge.sources.predictions import write_predictions
from tallyforge.streaming import metrics as streaming

from test_calibration import noisy


def test_stream_adds_up_and_resumes(spark, tmp_path):
    _, _, rows = noisy(spark, 300, 3, 4)
    rows = rows.selectExpr("run", "split", "idx", "label", "probs as logits", "probs")
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    write_predictions(rows.filter("idx < 100").repartition(3), source)
    streaming.stream_metrics(spark, source, state, 3, max_files=1).awaitTermination()
    rows.filter("idx >= 100").write.partitionBy("run", "split").mode("append").parquet(source)
    streaming.stream_metrics(spark, source, state, 3, max_files=1).awaitTermination()
    found = streaming.current_metrics(spark, state, 3).first()
    wanted = metrics.scalars(metrics.tallies(metrics.cells(metrics.score_frame(rows, 3))), 3).first()
    assert found.asDict() == pytest.approx(wanted.asDict())
    streaming.stream_metrics(spark, source, state, 3).awaitTermination()
    assert streaming.current_metrics(spark, state, 3).first()["n_examples"] == 300


def test_a_row_written_again_later_counts_once(spark, tmp_path):
    _, _, rows = noisy(spark, 120, 3, 6)
    rows = rows.selectExpr("run", "split", "idx", "label", "probs as logits", "probs")
    found = []
    for name, horizon, files in (("a", None, 1), ("b", None, 100), ("c", "7 days", 1)):
        source, state = str(tmp_path / name / "in"), str(tmp_path / name / "state")
        write_predictions(rows.repartition(2), source)
        rows.filter("idx < 50").write.partitionBy("run", "split").mode("append").parquet(source)
        streaming.stream_metrics(spark, source, state, 3, max_files=files, horizon=horizon).awaitTermination()
        found.append(streaming.current_metrics(spark, state, 3).first().asDict())
    assert [f["n_examples"] for f in found] == [120] * 3
    assert found[1] == pytest.approx(found[0]) and found[2] == pytest.approx(found[0])


def put(rows, source, at):
    """One more file of ``rows``, dated ``at`` seconds."""
    before = set(glob.glob(f"{source}/*/*/*.parquet"))
    rows.coalesce(1).write.partitionBy("run", "split").mode("append").parquet(source)
    for name in set(glob.glob(f"{source}/*/*/*.parquet")) - before:
        os.utime(name, (at, at))


def whole(rows, k=3):
    return metrics.scalars(metrics.tallies(metrics.cells(metrics.score_frame(rows, k))), k).first().asDict()


def turned(rows):
    """The same rows with their probabilities the other way round."""
    return rows.withColumn("probs", F.reverse("probs"))


@pytest.mark.parametrize("later_first", [False, True])
def test_rewritten_rows_replace_earlier_ones(spark, tmp_path, later_first):
    _, _, rows = noisy(spark, 200, 3, 8)
    rows = rows.selectExpr("run", "split", "idx", "label", "probs as logits", "probs")
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    parts = [(rows, 1_700_000), (turned(rows.filter("idx between 50 and 149")), 2_000_000)]
    for part, at in reversed(parts) if later_first else parts:
        put(part, source, at)
        streaming.stream_metrics(spark, source, state, 3, horizon="30 days").awaitTermination()
    wanted = rows.filter("idx not between 50 and 149").unionByName(turned(rows.filter("idx between 50 and 149")))
    assert streaming.current_metrics(spark, state, 3).first().asDict() == pytest.approx(whole(wanted))
    put(rows.filter("idx between 0 and 99"), source, 3_000_000)
    streaming.stream_metrics(spark, source, state, 3, horizon="30 days").awaitTermination()
    wanted = rows.filter("idx not between 100 and 149").unionByName(turned(rows.filter("idx between 100 and 149")))
    assert streaming.current_metrics(spark, state, 3).first().asDict() == pytest.approx(whole(wanted))


def test_fifty_batches_leave_few_folders_and_one_state_row_a_block(spark, tmp_path):
    _, _, rows = noisy(spark, 60, 3, 9)
    rows = rows.selectExpr("run", "split", "idx", "label", "probs as logits", "probs").persist()
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    put(rows, source, 1_000)
    first = glob.glob(f"{source}/*/*/*.parquet")[0]
    put(turned(rows), source, 1_001)
    second = (set(glob.glob(f"{source}/*/*/*.parquet")) - {first}).pop()
    for i in range(2, 50):  # the same indices written again and again, in turn one way and the other
        copy = os.path.join(os.path.dirname(first), f"part-{i:05d}.parquet")
        with open([first, second][i % 2], "rb") as old, open(copy, "wb") as new:
            new.write(old.read())
        os.utime(copy, (1_000 + i, 1_000 + i))
    rows.unpersist()
    query = streaming.stream_metrics(spark, source, state, 3, max_files=1, compact_every=8)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 49
    operator = [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]
    assert operator["numRowsTotal"] == 1  # 60 indices of one run and split
    folders = [n for n in os.listdir(f"{state}/sums") if not n.startswith((".", "current"))]
    assert len(folders) <= 2 * 8 + 2
    assert sum(n.startswith("base=") for n in folders) <= 2
    assert streaming.current_metrics(spark, state, 3).first().asDict() == pytest.approx(whole(turned(rows)))


def test_latest_rows_of_a_block():
    def row(slot, label, written, tie=0, conf=0.5):
        return (slot, label, 0, 0, written, tie, conf, 0.0, 0.0)

    old = np.array([row(1, 0, 5), row(2, 0, 5), row(3, 1, 9)], streaming.ROW)
    new = np.array([row(2, 1, 6), row(3, 0, 8), row(4, 1, 1), row(4, 0, 1, 7), row(1, 0, 5)], streaming.ROW)
    kept, out, added = streaming.latest(old, new)
    assert [(r["slot"], r["label"], r["written"]) for r in kept] == [(1, 0, 5), (2, 1, 6), (3, 1, 9), (4, 0, 1)]
    assert [(r["slot"], r["label"]) for r in out if r["slot"] != 1] == [(2, 0)]
    assert sorted(r["slot"] for r in added if r["slot"] != 1) == [2, 4]
    net = streaming.differences(out, added)
    assert net["n"].sum() == 1
    assert streaming.latest(old, new[::-1])[0].tobytes() == kept.tobytes()


def test_a_document_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "d.json")
    for i in range(3):
        write_document(spark, path, {"i": i})
        assert read_document(spark, path) == {"i": i}
        assert not os.path.exists(path + ".part")
    with pytest.raises(FileExistsError):
        write_document(spark, path, {"i": 9}, replace=False)
