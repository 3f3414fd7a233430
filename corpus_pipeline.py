"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's
``docs``. All but the last return the columns of documents.

- language: drops documents without letters, and those in which no known language reaches
  ``LEAST_SHARE`` of the letters.
- lines: takes boilerplate lines out of the texts, with ``n_chars`` brought up to date, and drops
  documents of which nothing is left.
- near_duplicates: keeps one document of each group of near copies.
- decontaminate: drops documents that hold a benchmark item.
- pack: places the tokens of what is left in sequences.

Null ids, sources and languages and repeated rows pass through as the operators define it.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, langid, lines, minhash, packing
from tallyforge.session import release, stage, staged_since, staged_so_far

LEAST_SHARE = 0.3
TOKENIZER = "word_bpe_49k.json"


_used: dict[str, list[str]] = {}


def step(function):
    """A stage that first deletes what its predecessor staged: by then its result is written."""

    @wraps(function)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app, mark = spark.sparkContext.applicationId, staged_so_far(spark)
        release(spark, _used.pop(app, []))
        result = function(spark, docs, sf_dir)
        _used[app] = staged_since(spark, mark)
        return result

    return run_step


@step
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs), LEAST_SHARE)


@step
def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(docs)
    touched = F.col("_tf_removed") > 0
    some = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cleaned.where(~touched | some).select(
        *[
            F.when(touched, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


@step
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


@step
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@step
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("lines", boilerplate),
    ("near_duplicates", near_duplicates),
    ("decontaminate", clean),
    ("pack", pack),
]

# Language models and best-fit packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_function in STAGES:
        docs = stage(stage_function(spark, docs, sf_dir), name, owned=False)
    return docs
