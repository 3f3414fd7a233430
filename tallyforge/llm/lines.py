"""Removal of boilerplate lines that spread over many sites.

A line counts by its text without outer blanks; empty lines never count. One aggregation by line
hash (128 bits) builds a HyperLogLog sketch of the sites each line stands on; partial sketches
merge in the shuffle, so a line on every page costs one small row a task. Lines whose estimate is
within the sketch's error of the threshold get an exact count of their sites. A boilerplate line
stays in the document with the smallest id that has it and goes everywhere else.

Defined results: a null text has no lines and stays null. A null site is a site of its own. A null
id sorts first. Repeated rows are treated alike. Kept lines keep their form and order. Columns
other than the text are unchanged. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .keys import KEY, with_key

MIN_SITES = 12
LOG_REGISTERS = 11
BAND = 4 * 1.04 / 2 ** (LOG_REGISTERS / 2)  # four standard errors of the estimate
LINE = ["_tf_line", "_tf_line2"]


def split_lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n")


def line_rows(docs: DataFrame, site: str) -> DataFrame:
    """Lines of all documents: key, site, position, line hashes (null for an empty line)."""
    exploded = with_key(docs.select("doc_id", "text", F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("_tf_site"))).select(
        *KEY, "_tf_site", F.posexplode(split_lines()).alias("_tf_pos", "_tf_text")
    )
    trimmed = F.btrim("_tf_text", F.lit(" \t\r"))
    blank = trimmed == ""
    return exploded.select(
        *KEY,
        "_tf_site",
        "_tf_pos",
        F.when(~blank, F.xxhash64(trimmed)).alias(LINE[0]),
        F.when(~blank, F.xxhash64(trimmed, F.lit(1))).alias(LINE[1]),
    )


def spread_lines(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines that stand on at least ``min_sites`` sites, and the first document."""
    spread = (
        rows.where(F.col(LINE[0]).isNotNull())
        .groupBy(*LINE)
        .agg(
            F.hll_sketch_agg("_tf_site", F.lit(LOG_REGISTERS)).alias("sketch"),
            F.min(KEY[0]).alias("_tf_first"),
        )
        .withColumn("sites", F.hll_sketch_estimate("sketch"))
        .where(F.col("sites") >= F.floor(F.lit(min_sites * (1 - BAND))))
        .drop("sketch")
    )
    spread = stage(spread, "line-spread")
    close = F.col("sites") <= F.ceil(F.lit(min_sites * (1 + BAND)))
    exact = (
        rows.join(spread.where(close).select(*LINE), LINE)
        .select(*LINE, "_tf_site")
        .distinct()
        .groupBy(*LINE)
        .agg(F.count("*").alias("exact"))
        .where(F.col("exact") >= min_sites)
        .select(*LINE)
    )
    near = spread.where(close).join(exact, LINE).select(*LINE, "_tf_first")
    return stage(spread.where(~close).select(*LINE, "_tf_first").unionByName(near), "spread-lines")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and the two counts ``_tf_lines``
    and ``_tf_removed``."""
    rows = line_rows(docs, site)
    known = spread_lines(rows, min_sites)
    keep = F.col("_tf_first").isNull() | (F.col("_tf_first") == F.col(KEY[0]))
    flags = (
        rows.join(known, LINE, "left")
        .groupBy(*KEY)
        .agg(
            F.min(keep).alias("_tf_clean"),
            F.sort_array(F.collect_set(F.struct("_tf_pos", keep.alias("keep")))).alias("_tf_flags"),
        )
        .where(~F.col("_tf_clean"))
        .select(*KEY, F.col("_tf_flags.keep").alias("_tf_keep"))
    )
    lines = split_lines()
    kept = F.filter(lines, lambda _, i: F.get("_tf_keep", i))
    joined = with_key(docs).join(flags, KEY, "left")
    touched = F.col("_tf_keep").isNotNull()
    return joined.select(
        *[
            F.when(touched, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")
            for c in docs.columns
        ],
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("_tf_lines"),
        F.when(touched, F.size(F.filter("_tf_keep", lambda k: ~k))).otherwise(0).cast("bigint").alias("_tf_removed"),
    )
