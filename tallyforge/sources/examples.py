"""Sharded example tables: scan, inventory, global index, class list."""

from __future__ import annotations

import os
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_CLASSES
from ..functions.hashing import multiset_hash, multiset_lanes
from ..session import broadcast_if

EXAMPLE_SCHEMA = "image STRUCT<bytes: BINARY, path: STRING>, label BIGINT"


def shard_paths(spark: SparkSession, path: str, max_shards: int | None = None) -> list[str]:
    """Shard files in name order; a subset is chosen here so other files are never opened."""
    # The listing gives URLs; readers take plain paths.
    files = sorted(map(unquote, spark.read.schema(EXAMPLE_SCHEMA).parquet(path).inputFiles()))
    if not files:
        raise ValueError(f"no Parquet shards in {path}")
    if max_shards is None:
        return files
    if max_shards < 1:
        raise ValueError("max_shards must be positive")
    return files[:max_shards]


def payload_bytes(payload: str = "image") -> F.Column:
    """Embedded bytes of an image struct; a path without bytes is an error."""
    return F.coalesce(
        F.col(f"{payload}.bytes"),
        F.raise_error(F.lit("a row holds no bytes of its picture")).cast(
            "binary"
        ),
    )


def scan_examples(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Examples with provenance. Selecting only some columns prunes the others from the scan."""
    sources = [paths] if isinstance(paths, str) else list(paths)
    return (
        spark.read.schema(EXAMPLE_SCHEMA)
        .parquet(*sources)
        .select(
            payload_bytes().alias("payload"),
            F.col("label").cast("int").alias("label"),
            F.col("_metadata.file_path").alias("shard"),
            F.col("_metadata.file_size").alias("shard_bytes"),
            F.col("_metadata.file_modification_time").alias("shard_time"),
            F.col("_metadata.row_index").alias("row_in_shard"),
        )
    )


def scan_labels(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    sources = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(EXAMPLE_SCHEMA).parquet(*sources).select(
        F.col("label").cast("int").alias("label")
    )


def shard_inventory(examples: DataFrame) -> DataFrame:
    """Rows, bytes, time and first global index of every shard.

    The count reads no data column. The running sum is over one row per file, a list the
    driver already holds for planning the scan.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        examples.groupBy("shard", "shard_bytes", "shard_time")
        .agg(F.count("*").alias("num_rows"))
        .withColumn("row_offset", F.coalesce(F.sum("num_rows").over(before), F.lit(0)))
    )


def global_index(
    examples: DataFrame, inventory: DataFrame, n_shards: int, broadcast_limit: int = 200_000
) -> DataFrame:
    """``idx`` = shard offset + row in shard: stable under any partitioning of the scan.

    ``n_shards`` is the length of the driver's own file listing, so it bounds the broadcast.
    """
    offsets = broadcast_if(inventory.select("shard", "row_offset"), n_shards, broadcast_limit)
    return examples.join(offsets, "shard").withColumn(
        "idx", F.col("row_offset") + F.col("row_in_shard")
    )


def inventory_hash(inventory: DataFrame) -> str:
    """Digest of a source's shards (path below their common folder, bytes, rows): it changes when
    the source grows, and not when the folder moves. Sums of hashes, so no list of shards is made."""
    ends = inventory.agg(F.min("shard").alias("low"), F.max("shard").alias("high")).first()
    # What the first and the last path in order share, all paths share.
    root = os.path.commonprefix([ends["low"] or "", ends["high"] or ""]).rpartition("/")[0]
    name = F.substr("shard", F.lit(len(root) + 1))
    lanes = multiset_lanes(F.concat_ws(":", name, "shard_bytes", "num_rows"))
    return inventory.agg(*lanes).select(multiset_hash().alias("h")).first()["h"]


def class_schema(cards: DataFrame, key: Sequence[str], card: str = "card") -> DataFrame:
    """(key, class_id, name) from dataset-card JSON.

    Names come as a list or as a ``{"0": ...}`` map; ``dataset_info`` as one document or a
    list of which the first counts; the default list applies where a card declares none.
    """
    info = F.parse_json(card)
    features = F.coalesce(
        F.try_variant_get(info, "$.dataset_info.features", "array<variant>"),
        F.try_variant_get(info, "$.dataset_info[0].features", "array<variant>"),
    )
    label = F.get(
        F.filter(
            features, lambda f: F.try_variant_get(f, "$.name", "string") == F.lit("label")
        ),
        F.lit(0),
    )
    listed = F.try_variant_get(label, "$.dtype.class_label.names", "array<string>")
    mapped = F.try_variant_get(label, "$.dtype.class_label.names", "map<string,string>")
    ordered = F.transform(
        F.array_sort(
            F.transform(
                F.map_entries(mapped),
                lambda e: F.struct(e["key"].cast("int").alias("id"), e["value"].alias("name")),
            )
        ),
        lambda e: e["name"],
    )
    default = F.array(*[F.lit(name) for name in DEFAULT_CLASSES])

    def non_empty(names: F.Column) -> F.Column:
        return F.when(F.size(names) > 0, names)

    names = F.coalesce(non_empty(listed), non_empty(ordered), default)
    return cards.select(*key, F.posexplode(names).alias("class_id", "name"))
