import base64
import hashlib

from tallyforge.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def brute(rows, least=0):
    size = lambda h: len((h or "").encode())
    best = {}
    for page, _, html in rows:
        if page is not None:
            best[html or ""] = max(page, best.get(html or "", page))
    out = []
    for page, _, html in rows:
        first = best.get(html or "")
        revisit = size(html) >= least and first is not None and page != first
        digest = base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
        out.append((page, size(html), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a", "<p>é日本</p>"), (2, "http://b", "<p>é日本</p>"), (9, None, "<p>é日本</p>"), (3, "x\r\ny", None),
    (4, "u", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\r\n\r\n"), (6, "u", "\r\n\r\n"),
    (6, "u", "\r\n\r\n"), (None, "n", "only"), (None, "n", "<p>é日本</p>"), (7, "big", "z" * 300_000), (8, "c", "z\n\0end"),
]


def names(rows):
    return sorted(
        ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows),
        key=repr,
    )


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    assert names(warc.round_trip(pages).collect()) == brute(ROWS)
    assert names(warc.round_trip(pages, 5).collect()) == brute(ROWS, 5)


def test_payloads_and_rolling(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<b>{i % 40}</b>" * 50) for i in range(200)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, archive_bytes=9000)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert names(got) == brute(rows)
    assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {r[2] for r in rows}
    assert len(list((tmp_path / "w").glob("archive=*"))) > 3


def test_empty_and_clashing(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "u", "h", 5, "t")], SCHEMA + ", size int, sha string")
    assert names(warc.round_trip(odd).collect()) == brute([(1, "u", "h")])
