"""Deduplicated WARC archives: equal payloads are stored once and revisited elsewhere.

Only headers (digest, length, page id, address) are shuffled to choose the original of each
payload, the record with the largest page id. Pages are then joined to their original by digest
and written as ``response`` or ``revisit`` records with fresh headers. Spark's text writer makes
the files: a record ends with two line ends, which is the line separator given to the writer.
Archives roll over at a size in bytes, so a reader holds one bounded file at a time (a single
record above it has a file of its own). They are gzip files of one member.

Defined results: a null html is an empty payload. Payloads shorter than ``least_bytes`` are always
responses. Rows that repeat the page id of their payload's original are responses too. A null page
id revisits the original if its payload has one with an id, else it is a response. A null url has
no target header; line ends in a url are percent-encoded. Other columns are ignored. An empty
table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, with_package

END = "\r\n"
ARCHIVE_BYTES = 16 << 20
HTTP_HEAD = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with their SHA-1, payload length, and the page and address of the original they
    revisit (null for responses)."""
    payload = F.coalesce("html", F.lit(""))
    facts = [F.sha1(payload).alias("sha"), F.octet_length(payload).cast("bigint").alias("size")]
    page_id = F.col("page_id").cast("bigint").alias("page_id")
    headers = pages.select(page_id, F.col("url").cast("string").alias("url"), *facts)
    originals = (
        headers.where(F.col("size") >= least_bytes)
        .groupBy("sha", "size")
        .agg(
            F.count("*").alias("seen"),
            F.max("page_id").alias("original"),
            F.max_by("url", "page_id").alias("original_url"),
        )
        .where("seen > 1 and original is not null")
        .drop("seen")
    )
    rows = pages.select(page_id, F.col("url").cast("string").alias("url"), payload.alias("html"), *facts)
    joined = rows.join(originals, ["sha", "size"], "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("original")) & F.col("original").isNotNull()
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("html")).alias("html"),
        "sha",
        "size",
        F.when(revisit, F.col("original")).alias("refers_to"),
        F.when(revisit, F.col("original_url")).alias("refers_to_url"),
    )


def _address(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict, date: str, serial: str) -> str:
    """Headers and block of one record, without the two line ends that close it."""
    digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
    revisit = row["refers_to"] is not None
    block = HTTP_HEAD + (row["html"] or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row["page_id"]} {digest} {serial}')}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {row['size']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_address(row['url'])}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
        if row["refers_to_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_address(row['refers_to_url'])}")
    lines.append(f"Content-Length: {len(block.encode())}")
    return END.join(lines) + END + END + block


def _records(date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, archive, count = 0, 0, 0
        for batch in batches:
            values, homes = [], []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                text = record(row, date, f"{row['task']}-{count}")
                count += 1
                size = row["size"] + 1024
                if used and used + size > archive_bytes:
                    archive, used = archive + 1, 0
                used += size
                values.append(text)
                homes.append(f"{row['task']:06d}-{archive:05d}")
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(homes, pa.string())], ["value", "archive"])

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = 0,
    date: str | None = None,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write the records of ``pages`` below ``path``, one folder an archive."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = resolved(pages, least_bytes).withColumn("task", F.spark_partition_id())
    text = with_package(rows).mapInArrow(_records(date, archive_bytes), "value string, archive string")
    text.write.option("lineSep", END + END).option("compression", "gzip").partitionBy("archive").text(path)


def parse(data: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record of an archive, by its stated lengths."""
    at, raw = 0, bytes(data)
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:stop].decode().split(END)
        if first != "WARC/1.1":
            raise ValueError(f"not a WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        begin = stop + 4
        end = begin + int(headers["Content-Length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it should")
        yield headers, memoryview(raw)[begin:end]
        at = end + 4


ROWS = (
    "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, "
    "refers_to bigint, payload binary"
)


def _read(with_payload: bool):
    names = [c.split()[0] for c in ROWS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def whole(value: str | None) -> int | None:
        return None if value is None else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in parse(zlib.decompress(content.as_buffer(), 31)):
                    payload = bytes(block[len(HTTP_HEAD) :])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                    rows.append((
                        whole(headers.get("X-Page-ID")), headers.get("WARC-Target-URI"), headers["WARC-Type"],
                        digest, int(headers["X-Payload-Length"]), whole(headers.get("X-Refers-To-Page-ID")),
                        payload if with_payload and headers["WARC-Type"] == "response" else None,
                    ))
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record; every response's payload is checked against its digest."""
    files = (
        spark.read.schema("path string, modificationTime timestamp, length bigint, content binary")
        .format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.gz")
        .load(path)
        .select("content")
    )
    return with_package(files).mapInArrow(_read(with_payload), ROWS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their headers back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
