"""Session set-up, staged tables and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "tallyforge", cores: str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a machine-local folder: on a cluster that would
    lose staged rows together with the machine that wrote them.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"tallyforge-{application}-")


def new_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tallyforge/{app}/{tag}-{uuid.uuid4().hex}"


_staged: dict[tuple[str, int], list[str]] = {}


def _staged_here(spark: SparkSession) -> list[str]:
    return _staged.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def staged_so_far(spark: SparkSession) -> int:
    """How many tables this thread has staged: a mark for :func:`staged_since`."""
    return len(_staged_here(spark))


def staged_since(spark: SparkSession, mark: int) -> list[str]:
    return _staged_here(spark)[mark:]


def release(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete staged tables that nothing will read any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, tag: str, owned: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The readers see a short lineage, prune columns and push filters, and a lost executor
    costs a re-read rather than a recomputation. Tables not ``owned`` are left out of
    :func:`staged_since`.
    """
    path = new_path(df.sparkSession, tag)
    if owned:
        _staged_here(df.sparkSession).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_package(df: DataFrame) -> DataFrame:
    """``df``, once this package is on the path of the Python workers that will read it.

    Workers import it by name. A package that came as a zip file was shipped already.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    context = df.sparkSession.sparkContext
    if os.path.isdir(package):
        archive = _package_archive(context.applicationId, package)
        if archive not in _shipped:
            context.addPyFile(archive)
            _shipped.add(archive)
    return df


_shipped: set[str] = set()


@cache
def _package_archive(application: str, package: str) -> str:
    target = os.path.join(tempfile.mkdtemp(prefix="tallyforge-"), "tallyforge")
    parent, name = os.path.split(package)
    return shutil.make_archive(target, "zip", root_dir=parent, base_dir=name)


BROADCAST_BYTES = 64 << 20


def row_bytes(schema: T.StructType) -> int:
    """Generous width of a row in a broadcast relation: texts count as hashes or paths."""
    wide = {"string": 128, "binary": 128, "array": 512, "map": 512, "struct": 256, "variant": 512}
    return 48 + sum(wide.get(f.dataType.typeName(), 16) for f in schema.fields)


def broadcast_if(small: DataFrame, n_rows: int, limit: int | None = None) -> DataFrame:
    """Broadcast hint when a known row count makes at most ``BROADCAST_BYTES``.

    Beyond it (or beyond ``limit`` rows) the plain join stays, and adaptive execution chooses
    the strategy and splits skewed partitions.
    """
    fits = n_rows * row_bytes(small.schema) <= BROADCAST_BYTES
    return F.broadcast(small) if fits and (limit is None or n_rows <= limit) else small


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A short driver-side list as a table of literals: no Python worker reads it back."""
    fields = T.StructType.fromDDL(schema).fields
    if not rows:
        return spark.createDataFrame([], schema)
    records = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*records)))
