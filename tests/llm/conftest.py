"""Helpers of the text operators' tests."""

import zlib

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table from (doc_id, text[, lang, source]) tuples."""

    def build(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""))
            for r in rows
        ]
        return spark.createDataFrame(full, DOCS)

    return build


def crc(value):
    return zlib.crc32(str(value).encode())
