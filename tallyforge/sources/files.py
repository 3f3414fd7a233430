"""Directories of files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint_canonical

def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content")
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; a file that does not decode is an error that names it."""
    images = (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .load(path)
        .select("image.origin", "image.width", "image.height", "image.nChannels", "image.mode",
                "image.data")
    )
    broken = F.raise_error(F.concat(F.lit("not a readable image: "), "origin")).cast("binary")
    valid = (F.col("width") > 0) & (F.col("height") > 0)
    return images.withColumn("data", F.when(valid, F.col("data")).otherwise(broken))


def image_fingerprint(images: DataFrame) -> DataFrame:
    """Hash of decoded pixels under a size header: two encodings of one picture collide."""
    header = F.format_string("BGR:%d:%d:", F.col("width"), F.col("height"))
    return images.select("origin", fingerprint_canonical(F.col("data"), header).alias("fp"))


def checksum_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 of each file (binary source: files below 2 GB)."""
    return read_files(spark, path, glob).select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.col("length"),
        F.sha2("content", 256).alias("sha256"),
    )
