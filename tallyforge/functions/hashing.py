"""Content identities.

Documents are parsed to VARIANT, whose object fields are stored in name order, so the text
written back is key-sorted whatever the order of the source.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint_encoded(payload: Column) -> Column:
    return F.sha2(payload, 256)


def fingerprint_canonical(payload: Column, header: Column | None = None) -> Column:
    """SHA-256 of canonical content, with an optional shape header in front."""
    content = payload.cast("binary")
    if header is not None:
        content = F.concat(header.cast("binary"), content)
    return F.sha2(content, 256)


def canonical_json(document: Column) -> Column:
    """Key-sorted, space-free JSON text of a JSON string."""
    return F.to_json(F.parse_json(document))


def identity_hash(document: Column) -> Column:
    return F.sha2(canonical_json(document), 256)


LANES = 10  # of 24 bits each: 240 bits of a SHA-256; sums stay in 64 bits below 2**39 entries


def multiset_lanes(entry: Column) -> list[Column]:
    """Aggregates whose values identify a multiset of texts: how many there are, and per lane the sum
    of a slice of their hashes modulo 2**24. Sums merge on the map side and in any order, repeats
    count, and nothing is gathered. A null text is an entry of its own."""
    digest = F.sha2(F.coalesce(F.concat(F.lit("="), entry), F.lit("")), 256)
    slices = [F.conv(F.substring(digest, 6 * i + 1, 6), 16, 10).cast("bigint") for i in range(LANES)]
    sums = [(F.sum(s) % (1 << 24)).alias(f"lane{i}") for i, s in enumerate(slices)]
    return [F.count("*").alias("n_entries"), *sums]


def multiset_hash() -> Column:
    """Identity of the multiset that :func:`multiset_lanes` has summed."""
    lanes = [F.col(f"lane{i}").cast("string") for i in range(LANES)]
    return F.sha2(F.concat_ws(",", F.col("n_entries").cast("string"), *lanes), 256)


def struct_hash(*fields: Column) -> Column:
    """Hash of a flat record whose fields are given in name order."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def protocol_hash(data_revision: Column, split_hash: Column, class_names: Column) -> Column:
    return struct_hash(
        class_names.alias("class_names"),
        data_revision.alias("data_revision"),
        split_hash.alias("split_hash"),
    )


def recipe_json(summary: Column, with_smoke: bool = True) -> Column:
    """Experimental condition of a run document (VARIANT) as canonical JSON.

    The worker count is a throughput setting and is left out; with ``with_smoke`` the smoke
    flag separates subset runs from research runs.
    """
    training = F.try_variant_get(summary, "$.config.training", "map<string,variant>")
    training = F.map_filter(training, lambda key, _: key != "workers")
    model = F.to_json(F.try_variant_get(summary, "$.config.model", "variant"))
    batch = F.to_json(F.try_variant_get(summary, "$.effective_batch_size", "variant"))
    world = F.try_variant_get(summary, "$.world_size", "bigint")
    smoke = F.coalesce(F.try_variant_get(summary, "$.smoke_test", "boolean"), F.lit(False))
    parts = [
        F.lit('{"effective_batch_size":'),
        F.coalesce(batch, F.lit("null")),
        F.lit(',"model":'),
        F.coalesce(model, F.lit("{}")),
    ]
    if with_smoke:
        parts += [F.lit(',"smoke_test":'), smoke.cast("string")]
    parts += [
        F.lit(',"training":'),
        F.coalesce(F.to_json(training), F.lit("{}")),
        F.lit(',"world_size":'),
        F.coalesce(world, F.lit(1)).cast("string"),
        F.lit("}"),
    ]
    return F.concat(*parts)


def recipe_hash(summary: Column) -> Column:
    return F.sha2(recipe_json(summary), 256)
