"""Scan, fingerprint, audit, split, count, record."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FORMAT_VERSION, SPLITS
from ..functions.hashing import identity_hash
from ..functions.scalars import pinned_revision
from ..operators import checks, fingerprints, splits
from ..operators.classes import check_names
from ..session import broadcast_if, literal_table, stage
from ..sources import documents
from ..sources import examples as source
from ..sources.predictions import SPLIT_SCHEMA, write_splits


AUDITS = ("encoded", "decoded", "none")
MANIFEST = "preparation_hash string, split_hash string, document string, folder string, previous string"
MANIFEST_FILE = "manifest.json"
# What tells that a shard is the one fingerprinted before, and where its rows lie in it.
SHARD_KEY = ("shard", "shard_bytes", "shard_time", "num_rows")
ROW_KEY = ("shard", "row_in_shard")
NARROW = ("idx", "label", "fp")


@dataclass
class Prepared:
    """Handles to the tables of one preparation."""

    folder: str
    manifest: DataFrame
    shards: DataFrame
    fingerprints: DataFrame
    groups: DataFrame
    splits: DataFrame


def preparation_identity(spark: SparkSession, settings: dict) -> tuple[str, str]:
    """Canonical settings and their hash; equal settings give equal hashes in any key order."""
    text = json.dumps({"format_version": FORMAT_VERSION, **settings})
    row = (
        literal_table(spark, [(text,)], "j string")
        .select(F.to_json(F.parse_json("j")).alias("j"), identity_hash(F.col("j")).alias("h"))
        .first()
    )
    return row["j"], row["h"]


def prepare_splits(
    labelled: DataFrame,
    names: Sequence[str],
    seed: int,
    val_fraction: float,
    test_fraction: float,
    deduplicate: bool,
    conflicts: str = "error",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fingerprints, groups, splits) from (idx, label, fp) rows, each a staged table.

    The payload is read once, to be hashed; every later step reads the narrow tables. Further
    columns of ``labelled`` stay in the first table.
    """
    kept = stage(labelled, "fingerprints")
    rows = kept.select(*NARROW)
    checks.enforce(checks.check_labels(rows, len(names)), "labels do not match the class list")
    groups = stage(fingerprints.groups(rows), "groups")
    method = splits.stratified_split if deduplicate else splits.stratified_group_split
    assigned = method(
        rows, seed, val_fraction, test_fraction, group_rows=groups, conflicts=conflicts
    )
    return kept, groups, stage(assigned, "splits")


def fingerprint_source(
    spark: SparkSession,
    scanned: DataFrame,
    shards: DataFrame,
    n_shards: int,
    hashed: Callable[[DataFrame], DataFrame],
    earlier: tuple[DataFrame, DataFrame] | None,
) -> tuple[DataFrame, int]:
    """(idx, label, fp, shard, row_in_shard) of a source, and how many shards were not read.

    ``earlier`` is a (fingerprints, shards) pair of a former preparation. Rows of shards that are
    still there with the same path, bytes, time and row count are carried over, under the index that
    the shard's present offset gives them; only files of other shards are opened. ``hashed`` turns
    indexed examples into rows. The list of shards to read is part of the listing that the driver
    holds to plan any scan of the source.
    """
    if earlier is None:
        return hashed(source.global_index(scanned, shards, n_shards)), 0
    old_rows, old_shards = earlier
    known = stage(shards.join(old_shards.select(*SHARD_KEY), list(SHARD_KEY), "left_semi"), "known")
    n_known = known.count()
    if not n_known:
        return hashed(source.global_index(scanned, shards, n_shards)), 0
    offsets = broadcast_if(known.select("shard", "row_offset"), n_known)
    idx = (F.col("row_offset") + F.col("row_in_shard")).alias("idx")
    carried = old_rows.join(offsets, "shard").select(idx, "label", "fp", *ROW_KEY)
    new = [r["shard"] for r in shards.join(known, "shard", "left_anti").select("shard").collect()]
    if not new:
        return carried, n_known
    fresh = source.scan_examples(spark, sorted(map(unquote, new)))
    return carried.unionByName(hashed(source.global_index(fresh, shards, n_shards))), n_known


def prepare(
    spark: SparkSession,
    path: str,
    out: str,
    names: Sequence[str],
    seed: int = 42,
    val_fraction: float = 0.15,
    test_fraction: float = 0.15,
    deduplicate: bool = True,
    max_shards: int | None = None,
    source_id: str = "",
    revision: str = "",
    audit: str = "encoded",
    decode: Callable[[bytes], bytes] | None = None,
    decoder: str = "",
    conflicts: str = "error",
) -> Prepared:
    """Prepare a sharded example table and record it under ``out``.

    ``audit`` says what makes two examples copies: their stored bytes (``encoded``), what the
    caller's ``decode`` makes of these (``decoded``, so re-encoded copies cannot cross splits),
    or nothing (``none``, which needs ``deduplicate=False``). ``conflicts`` says what becomes of copies
    with different labels: an ``error``, or the ``lowest`` label takes the group, which the record tells.

    An existing record of the same identity is reused once its split table matches its hash.
    The identity of a source without a pinned revision includes its shards, so a source that
    has grown is prepared anew. A new preparation opens only shards that the record does not know:
    fingerprints of shards with unchanged path, bytes, time and rows are carried over if they are of
    the same audit, for a decoded one under the same ``decoder``, a name (with version) of ``decode``.
    Groups and splits are computed from the narrow tables of all rows. Tables go to a folder of their own and the manifest, one file that
    is replaced in one step at the end, names it: a job that dies midway leaves the earlier record as
    it was. The record's tables before this one stay for whoever still reads them; those before them
    are deleted.
    """
    check_names(names)
    if audit not in AUDITS:
        raise ValueError(f"audit must be one of {', '.join(AUDITS)}")
    if audit == "none" and deduplicate:
        raise ValueError("deduplicate needs an audit")
    if (audit == "decoded") != (decode is not None):
        raise ValueError("a decoder belongs to the decoded audit, and only to it")
    if conflicts not in splits.CONFLICTS:
        raise ValueError(f"conflicts must be one of {', '.join(splits.CONFLICTS)}")
    paths = path if max_shards is None else source.shard_paths(spark, path, max_shards)
    scanned = source.scan_examples(spark, paths)
    shards = stage(source.shard_inventory(scanned), "shards")
    n_shards = shards.count()
    if not n_shards:
        raise ValueError(f"no examples in {path}")
    fixed = bool(revision) and literal_table(spark, [(revision,)], "r string").select(
        pinned_revision(F.col("r")).alias("p")
    ).first()["p"]
    settings = {
        "audit": audit, "inventory": None if fixed else source.inventory_hash(shards),
        "source": source_id or path, "revision": revision, "seed": seed,
        "val_fraction": val_fraction, "test_fraction": test_fraction,
        "deduplicate": deduplicate, "max_shards": max_shards, "class_names": list(names),
    }
    if decoder:
        settings["decoder"] = decoder
    if conflicts != "error":
        settings["conflicts"] = conflicts
    canonical, identity = preparation_identity(spark, settings)
    reused = _reuse(spark, out, identity)
    if reused is not None:
        return reused

    def hashed(indexed: DataFrame) -> DataFrame:
        if audit == "decoded":
            return fingerprints.fingerprint_decoded(indexed, decode, keep=ROW_KEY)
        if audit == "encoded":
            return fingerprints.fingerprint_rows(indexed, keep=ROW_KEY)
        unique = F.sha2(F.col("idx").cast("string"), 256).alias("fp")
        return indexed.select("idx", "label", unique, *ROW_KEY)

    earlier = _record(spark, out) or {}
    labelled, n_known = fingerprint_source(
        spark, scanned, shards, n_shards, hashed, _known(spark, out, earlier, audit, decoder)
    )
    rows, groups, assigned = prepare_splits(
        labelled, names, seed, val_fraction, test_fraction, deduplicate, conflicts
    )
    overlap = splits.split_overlap(assigned).count()
    if overlap:
        raise ValueError(f"fingerprints leaked across splits: {overlap}")
    folder = f"tables-{uuid.uuid4().hex}"
    facts = {
        "audit_method": audit, "cross_split_group_overlap": overlap,
        "duplicate_audit_performed": audit != "none",
        "num_rows": shards.agg(F.sum("num_rows")).first()[0], "resolved_revision": revision or None,
        "reused_shards": n_known, "source_num_shards": n_shards, "split_method": "stratified" if deduplicate else "stratified_group",
    }
    if conflicts != "error":
        facts["label_conflicts"] = fingerprints.conflict_count(groups).first()["conflicts"]
    record = manifest(
        spark, canonical, identity, groups, assigned, names, deduplicate,
        splits.split_fractions_for(val_fraction, test_fraction), max_shards is not None, facts,
    ).first().asDict()
    record |= {"folder": folder, "previous": earlier.get("folder")}
    write_splits(assigned, f"{out}/{folder}/splits")
    shards.write.parquet(f"{out}/{folder}/shards")
    rows.write.parquet(f"{out}/{folder}/fingerprints")
    documents.write_document(spark, f"{out}/{MANIFEST_FILE}", record)
    if earlier.get("previous"):
        documents.delete(spark, f"{out}/{earlier['previous']}")
    return _open(spark, out, groups)


def manifest(
    spark: SparkSession,
    settings: str,
    identity: str,
    groups: DataFrame,
    assigned: DataFrame,
    names: Sequence[str],
    deduplicate: bool,
    fractions: Sequence[float],
    smoke: bool,
    facts: dict | None = None,
) -> DataFrame:
    """One-row document with fields in name order. Its parts are one aggregate row each, or
    one row per split and class; the document is assembled from those few numbers."""
    audit = fingerprints.duplicate_audit(groups, deduplicate).first()
    counts = {
        (r["split"], r["label"]): r["n"] for r in splits.class_counts(assigned, len(names)).collect()
    }
    sizes = {s: sum(counts[s, i] for i in range(len(names))) for s in SPLITS}
    total = max(1, sum(sizes.values()))
    document = {
        **(facts or {}),
        "actual_fractions": {s: sizes[s] / total for s in SPLITS},
        "audit": audit.asDict(),
        "class_names": list(names),
        "preparation_hash": identity,
        "requested_fractions": dict(zip(SPLITS, map(float, fractions))),
        "settings": json.loads(settings),
        "split_class_counts": {s: [counts[s, i] for i in range(len(names))] for s in SPLITS},
        "split_hash": splits.split_hash(assigned).first()["split_hash"],
        "split_sizes": sizes,
        "subset_is_smoke_only": smoke,
    }
    text = json.dumps(document, sort_keys=True)
    return literal_table(
        spark,
        [(identity, document["split_hash"], text)],
        "preparation_hash string, split_hash string, document string",
    )


def _record(spark: SparkSession, out: str) -> dict | None:
    path = f"{out}/{MANIFEST_FILE}"
    return documents.read_document(spark, path) if documents.exists(spark, path) else None


def _known(
    spark: SparkSession, out: str, record: dict, audit: str, decoder: str
) -> tuple[DataFrame, DataFrame] | None:
    """Fingerprints and shards of an earlier record, if they can stand for those of ``audit``.

    Without an audit they are made from the index, which a grown source shifts.
    """
    if not record or audit == "none" or (audit == "decoded" and not decoder):
        return None
    settings = json.loads(record["document"])["settings"]
    if settings["audit"] != audit or settings.get("decoder", "") != decoder:
        return None
    tables = [spark.read.parquet(f"{out}/{record['folder']}/{t}") for t in ("fingerprints", "shards")]
    if not set(ROW_KEY) <= set(tables[0].columns) or not set(SHARD_KEY) <= set(tables[1].columns):
        return None
    return tables[0], tables[1]


def _reuse(spark: SparkSession, out: str, identity: str) -> Prepared | None:
    record = _record(spark, out)
    if record is None or record["preparation_hash"] != identity:
        return None
    found = _open(spark, out, None)
    if splits.split_hash(found.splits).first()["split_hash"] != record["split_hash"]:
        raise ValueError(f"split table under {out} does not match its manifest")
    return found


def _open(spark: SparkSession, out: str, groups: DataFrame | None) -> Prepared:
    record = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{out}/{MANIFEST_FILE}")
    folder = f"{out}/{record.first()['folder']}"
    rows = spark.read.parquet(f"{folder}/fingerprints")
    return Prepared(
        folder=folder,
        manifest=record,
        shards=spark.read.parquet(f"{folder}/shards"),
        fingerprints=rows.select(*NARROW),
        groups=groups if groups is not None else fingerprints.groups(rows),
        splits=spark.read.schema(SPLIT_SCHEMA).parquet(f"{folder}/splits"),
    )
