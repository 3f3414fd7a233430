"""Single small documents in the file system that Spark itself uses."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is missing."""
    system, target = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(target)) if system.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def write_document(spark: SparkSession, path: str, document: dict, replace: bool = True) -> None:
    """Key-sorted JSON, written beside its target and renamed over it in one step: readers see the
    document before or the one after, never a part or none."""
    text = json.dumps(document, indent=2, sort_keys=True, allow_nan=False) + "\n"
    system, target = _file_system(spark, path)
    if system.exists(target) and not replace:
        raise FileExistsError(path)
    _, part = _file_system(spark, path + ".part")
    stream = system.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(part), system.makeQualified(target), options)


def read_document(spark: SparkSession, path: str) -> dict:
    """One JSON document of a run, as small as its metrics."""
    row = spark.read.text(path, wholetext=True).first()
    return json.loads(row["value"])
