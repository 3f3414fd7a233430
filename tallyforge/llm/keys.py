"""Keys that join rows derived from documents back to them.

A key is (doc_id or -1, hash of the text). Rows with one key hold the same text, so decisions
that depend on the text alone are right for repeated rows and for null ids too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["_tf_id", "_tf_hash"]


def key_columns(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-1)).alias(KEY[0]),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(KEY[1]),
    ]


def with_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select("*", *key_columns(doc_id, text))
