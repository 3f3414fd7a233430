import hashlib
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from tallyforge.constants import DEFAULT_CLASSES
from tallyforge.functions import hashing
from tallyforge.operators import checks, fingerprints
from tallyforge.plans import prepare as prepare_plan
from tallyforge.plans.prepare import prepare
from tallyforge.sources import examples, files, headers, predictions

from helpers import png


SHARD_ROWS = (3, 7, 2)


def label_of(n):
    """Label of the n-th example of all shards."""
    return (5 * n + 2) % 4


@pytest.fixture
def shards(spark, tmp_path):
    """Files of unequal length; an example's payload is its place among all of them."""
    folder, n = str(tmp_path / "shards"), 0
    for shard, size in enumerate(SHARD_ROWS):
        rows = [((bytearray([i]), None), label_of(i)) for i in range(n, n + size)]
        spark.createDataFrame(rows, examples.EXAMPLE_SCHEMA).coalesce(1).write.parquet(f"{folder}/part-{shard}")
        n += size
    return f"{folder}/*"


def test_global_index_follows_file_order(spark, shards):
    scanned = examples.scan_examples(spark, examples.shard_paths(spark, shards))
    inventory = examples.shard_inventory(scanned)
    offsets = [r["row_offset"] for r in inventory.orderBy("shard").collect()]
    assert offsets == [sum(SHARD_ROWS[:i]) for i in range(len(SHARD_ROWS))]
    for limit in (0, 10):
        rows = examples.global_index(scanned.repartition(5), inventory, len(SHARD_ROWS), limit).collect()
        found = {r["idx"]: (r["label"], r["payload"][0]) for r in rows}
        assert found == {i: (label_of(i), i) for i in range(sum(SHARD_ROWS))}


@pytest.mark.parametrize("n", [1, 2])
def test_shard_subset_reads_the_first_files(spark, shards, n):
    paths = examples.shard_paths(spark, shards, n)
    assert len(paths) == n
    rows = examples.scan_labels(spark, paths).collect()
    assert sorted(r["label"] for r in rows) == sorted(label_of(i) for i in range(sum(SHARD_ROWS[:n])))
    with pytest.raises(ValueError):
        examples.shard_paths(spark, shards, 0)


def test_label_scan_reads_one_column(spark, shards):
    plan = examples.scan_labels(spark, shards)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<label:bigint>" in plan


def test_path_only_rows_are_rejected(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([((None, "a.png"), 0)], examples.EXAMPLE_SCHEMA).write.parquet(path)
    with pytest.raises(Exception, match="no bytes of its picture"):
        examples.scan_examples(spark, path).select("payload").collect()


def test_class_schema_forms(spark):
    def card(names):
        return {"features": [{"name": "label", "dtype": {"class_label": {"names": names}}}]}

    cards = [
        (1, json.dumps({"dataset_info": card(["x", "y"])})),
        (2, json.dumps({"dataset_info": [card({str(i): f"c{i}" for i in range(11)})]})),
        (3, json.dumps({"license": "other"})),
        (4, json.dumps({"dataset_info": {"features": [{"name": "label", "dtype": "int64"}]}})),
    ]
    rows = examples.class_schema(spark.createDataFrame(cards, "id int, card string"), ["id"]).collect()
    names = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["class_id"])):
        names.setdefault(r["id"], []).append(r["name"])
    assert names[1] == ["x", "y"]
    assert names[2] == [f"c{i}" for i in range(11)]
    assert names[3] == names[4] == list(DEFAULT_CLASSES)


def test_prepare_records_and_reuses(spark, tmp_path):
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [((bytearray(f"text {i % 90}".encode()), None), i % 90 % 3) for i in range(120)]
    spark.createDataFrame(rows, examples.EXAMPLE_SCHEMA).repartition(4).write.parquet(source)
    done = prepare(spark, source, out, ["a", "b", "c"], seed=5)
    record = done.manifest.first()
    document = json.loads(record["document"])
    assert document["audit"] == {
        "duplicate_groups": 30, "duplicate_rows": 30, "removed_duplicate_rows": 30, "unique_groups": 90
    }
    assert document["split_sizes"] == {"train": 63, "validation": 15, "test": 12}
    assert document["split_class_counts"]["validation"] == [5, 5, 5]
    assert predictions.read_splits(spark, f"{done.folder}/splits", record["split_hash"]).count() == 90
    again = prepare(spark, source, out, ["a", "b", "c"], seed=5)
    assert again.manifest.first() == record
    with pytest.raises(ValueError, match="recorded hash"):
        predictions.read_splits(spark, f"{done.folder}/splits", "0" * 64)
    done.splits.limit(50).write.parquet(f"{out}/other")
    spark.read.parquet(f"{out}/other").write.mode("overwrite").parquet(f"{done.folder}/splits")
    with pytest.raises(ValueError, match="manifest"):
        prepare(spark, source, out, ["a", "b", "c"], seed=5)


def test_encodings_of_one_picture_collide_on_pixels_only(spark, tmp_path):
    pixels = bytes(range(192))
    for level in (0, 9):
        (tmp_path / f"p{level}.png").write_bytes(png(pixels, 8, 8, level))
    (tmp_path / "other.png").write_bytes(png(bytes(reversed(pixels)), 8, 8, 9))
    folder = str(tmp_path)
    decoded = {
        r["origin"].rsplit("/")[-1]: r["fp"]
        for r in files.image_fingerprint(files.read_images(spark, folder)).collect()
    }
    assert decoded["p0.png"] == decoded["p9.png"] != decoded["other.png"]
    sums = {r["file"]: r["sha256"] for r in files.checksum_manifest(spark, folder, "*.png").collect()}
    assert len(set(sums.values())) == 3
    assert sums["p0.png"] == hashlib.sha256((tmp_path / "p0.png").read_bytes()).hexdigest()


def test_image_headers(spark):
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (7).to_bytes(2, "little")
    rows = [(bytearray(png(bytes(192), 8, 8, 9)),), (bytearray(gif),), (bytearray(b"\xff\xd8\xff\xe0"),)]
    profile = headers.image_profile(
        headers.image_header(spark.createDataFrame(rows, "payload binary"))
    )
    found = {(r["kind"], r["value"]): r["n"] for r in profile.collect()}
    assert found["dimensions", "8x8"] == found["dimensions", "300x7"] == 1
    assert found["mode", "RGB"] == 1
    assert {k[1] for k in found if k[0] == "format"} == {"PNG", "GIF", "JPEG"}


def jpeg(*segments, frame=(0xC0, 7, 300, 3), tail=b"\xff\xda"):
    body = b"".join(b"\xff" + bytes([m]) + (len(b) + 2).to_bytes(2, "big") + b for m, b in segments)
    if frame:
        marker, tall, wide, parts = frame
        size = struct.pack(">HBHHB", 8 + 3 * parts, 8, tall, wide, parts)
        body += b"\xff" + bytes([marker]) + size + bytes(3 * parts)
    return b"\xff\xd8" + body + tail


def exif(order, turn, before=0, tag=274):
    entries = [(256 + i, 9) for i in range(before)] + [(tag, turn)]
    body = b"".join(struct.pack(order + "HHIHH", t, 3, 1, v, 0) for t, v in entries)
    mark = b"II" if order == "<" else b"MM"
    return b"Exif\0\0" + mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries)) + body + bytes(4)


def test_jpeg_sizes(spark):
    thumbnail = jpeg(frame=(0xC0, 5, 5, 3))
    cases = [
        (jpeg(), (300, 7, "RGB")),
        (jpeg((0xE0, b"JFIF"), (0xFE, b"x" * 65000), (0xE1, exif("<", 6))), (7, 300, "RGB")),
        (jpeg((0xE1, exif(">", 8, before=5))), (7, 300, "RGB")),
        (jpeg((0xE1, exif(">", 3)), frame=(0xC2, 9, 4, 1)), (4, 9, "L")),
        (jpeg((0xE1, exif("<", 6, tag=275))), (300, 7, "RGB")),
        (jpeg((0xE1, exif("<", 5) + thumbnail), (0xE1, exif("<", 1))), (7, 300, "RGB")),
        (jpeg((0xE1, b"http://ns.adobe.com/xap/1.0/"), frame=(0xCF, 2, 3, 4)), (3, 2, "CMYK")),
        (jpeg((0xC4, bytes(40)), *[(0xE2, bytes(20))] * 300), (300, 7, "RGB")),
        (jpeg((0xE1, exif("<", 6)[:20])), (300, 7, "RGB")),  # a directory that ends early
        (b"\xff\xd8\xff\xff\xff\x01\xff\xd0" + jpeg()[2:], (300, 7, "RGB")),  # fill bytes, bare markers
        (jpeg(frame=(0xC0, 0, 8, 3)), (8, None, "RGB")),
        (jpeg(frame=None), (None, None, None)),
        (jpeg((0xE0, b"a"), frame=None, tail=b"\xff\xe0\xff\xff"), (None, None, None)),
        (jpeg(frame=None, tail=b"\xff\xe0\0\0"), (None, None, None)),
        (jpeg(frame=None, tail=b"\0\0\xff\xc0"), (None, None, None)),
        (b"\xff\xd8\xff", (None, None, None)), (b"", (None, None, None)), (None, (None, None, None)),
    ]
    rows = [(i, None if p is None else bytearray(p)) for i, (p, _) in enumerate(cases)]
    found = headers.image_header(spark.createDataFrame(rows, "i int, payload binary")).orderBy("i").collect()
    assert [(r["width"], r["height"], r["mode"]) for r in found] == [w for _, w in cases]
    assert [r["format"] for r in found[-3:]] == ["JPEG", "unknown", "unknown"]


def test_decoder_fingerprints(spark):
    rows = spark.createDataFrame(
        [(0, 0, bytearray(b"AbC")), (1, 0, bytearray(b"aBc"))], "idx bigint, label int, payload binary"
    )
    found = fingerprints.fingerprint_decoded(rows, bytes.lower).collect()
    assert found[0]["fp"] == found[1]["fp"] == hashlib.sha256(b"abc").hexdigest()


def test_recipe_ignores_workers_and_key_order(spark):
    one = {"config": {"model": {"name": "m", "mode": "full"}, "training": {"lr": 0.1, "workers": 2}}}
    two = {"config": {"training": {"workers": 8, "lr": 0.1}, "model": {"mode": "full", "name": "m"}}}
    three = {"config": {"model": {"name": "m", "mode": "full"}, "training": {"lr": 0.2}}}
    rows = spark.createDataFrame([(json.dumps(d),) for d in (one, two, three)], "j string")
    hashes = [
        r[0] for r in rows.select(hashing.recipe_hash(F.parse_json("j"))).collect()
    ]
    assert hashes[0] == hashes[1] != hashes[2]


@pytest.mark.parametrize("bucket", [3, 100])
def test_offsets(spark, bucket):
    def violations(values, total):
        df = spark.createDataFrame(list(enumerate(values)), "i bigint, o bigint").repartition(3)
        return [r["violations"] for r in checks.check_offsets(df, "i", "o", total, bucket).collect()]

    assert violations([0, 2, 5, 9, 11, 12, 20], 20) == [0, 0, 0, 0]
    assert violations([1, 2, 5, 5, 11, 12, 13], 20) == [1, 1, 1, 0]
    assert violations([0, 2, 5, 5, 4, 4, 20], 20) == [0, 3, 0, 0]


def prepared(spark, source, out, **options):
    return prepare(spark, source, out, ["a", "b", "c"], seed=5, **options)


def write_shards(spark, rows, path, mode="error"):
    spark.createDataFrame(rows, examples.EXAMPLE_SCHEMA).repartition(3).write.mode(mode).parquet(path)


def test_a_grown_source_is_prepared_anew(spark, tmp_path):
    source, out = str(tmp_path / "a b%20c"), str(tmp_path / "out")
    rows = [((bytearray(f"t{i}".encode()), None), i % 3) for i in range(60)]
    write_shards(spark, rows[:30], source)
    first = prepared(spark, source, out)
    assert first.splits.count() == 30
    assert prepared(spark, source, out).folder == first.folder
    write_shards(spark, rows[30:], source, "append")
    grown = prepared(spark, source, out)
    assert grown.splits.count() == 60 and first.splits.count() == 30
    pinned = prepared(spark, source, out, revision="a" * 40)
    write_shards(spark, rows[:30], source, "append")
    assert prepared(spark, source, out, revision="a" * 40).folder == pinned.folder
    assert examples.shard_paths(spark, source, 2) == sorted(examples.shard_paths(spark, source))[:2]
    assert prepared(spark, source, str(tmp_path / "few"), max_shards=3).splits.count() > 0


def test_known_shards_are_not_read_again(spark, tmp_path, monkeypatch):
    """Shards with names that sort before the known ones shift every index; the result is that of a
    preparation in one go, and known files, whose payloads are then damaged unnoticed, stay unread."""
    source, out = str(tmp_path / "a b%20c"), str(tmp_path / "out")
    data = [((bytearray(f"t{i % 50}".encode()), None), i % 50 % 3) for i in range(80)]

    def shard(name, rows):
        part = str(tmp_path / f"w-{name}")
        frame = spark.createDataFrame(rows, examples.EXAMPLE_SCHEMA).coalesce(1)
        frame.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(part)
        file = next(f for f in os.listdir(part) if f.startswith("part-"))
        os.makedirs(source, exist_ok=True)
        os.replace(f"{part}/{file}", f"{source}/{name}.parquet")
        return f"{source}/{name}.parquet"

    path = shard("m", data[:30])
    shard("q", data[30:45])
    first = prepared(spark, source, out)
    assert json.loads(first.manifest.first()["document"])["reused_shards"] == 0
    shard("b", data[45:])
    whole = prepared(spark, source, str(tmp_path / "whole"))
    with open(path, "rb") as f:
        content = f.read()
    times = os.stat(path)
    with open(path, "wb") as f:
        f.write(content.replace(b"t1", b"x1"))
    os.utime(path, ns=(times.st_atime_ns, times.st_mtime_ns))
    opened = []
    scan = examples.scan_examples
    monkeypatch.setattr(examples, "scan_examples", lambda s, p: opened.append(p) or scan(s, p))
    grown = prepared(spark, source, out)
    assert [len(p) for p in opened if isinstance(p, list)] == [1] and opened[1][0].endswith("/b.parquet")
    assert json.loads(grown.manifest.first()["document"])["reused_shards"] == 2
    for table in ("fingerprints", "splits"):
        assert sorted(map(tuple, getattr(grown, table).collect())) == sorted(map(tuple, getattr(whole, table).collect()))
    os.utime(path, ns=(times.st_atime_ns, times.st_mtime_ns + 10**10))
    changed = prepared(spark, source, out, val_fraction=0.25)
    assert json.loads(changed.manifest.first()["document"])["reused_shards"] == 2
    assert changed.splits.count() > grown.splits.count()  # the damage shows


def test_known_rows_need_the_same_audit(spark, tmp_path):
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [((bytearray(f"{i % 2}text {i // 2}".encode()), None), i // 2 % 3) for i in range(60)]
    write_shards(spark, rows, source)

    def reused(**options):
        done = prepared(spark, source, out, **options)
        return json.loads(done.manifest.first()["document"])["reused_shards"], done.splits.count()

    def cut(payload):
        return payload[1:]

    assert reused() == (0, 60)
    assert reused(audit="decoded", decode=cut) == (0, 30)
    assert reused(audit="decoded", decode=cut, val_fraction=0.2) == (0, 30)  # an unnamed decoder
    assert reused(audit="decoded", decode=cut, decoder="cut 1") == (0, 30)
    assert reused(audit="decoded", decode=cut, decoder="cut 1", val_fraction=0.2) == (3, 30)
    assert reused(audit="decoded", decode=bytes, decoder="as is") == (0, 60)
    assert reused(audit="none", deduplicate=False) == (0, 60)
    assert reused(audit="none", deduplicate=False, val_fraction=0.2) == (0, 60)


def test_inventory_names_folders(spark, tmp_path):
    def digest(rows):
        return examples.inventory_hash(spark.createDataFrame(rows, "shard string, shard_bytes bigint, num_rows bigint"))

    base = [("f:/r/a/part-0", 5, 1), ("f:/r/b/part-0", 5, 2)]
    assert digest(base) == digest(base[::-1]) == digest([("s3:/x/a/part-0", 5, 1), ("s3:/x/b/part-0", 5, 2)])
    assert digest(base) != digest([("f:/r/a/part-0", 5, 2), ("f:/r/b/part-0", 5, 1)])
    assert digest([]) != digest(base[:1])


def test_a_job_that_dies_leaves_the_record_and_old_tables_go(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "src"), tmp_path / "out"
    rows = [((bytearray(f"t{i}".encode()), None), i % 3) for i in range(36)]
    write_shards(spark, rows, source)
    first = prepared(spark, source, str(out))

    def dies(*_):
        raise OSError("no space left")

    with monkeypatch.context() as patch:
        patch.setattr(prepare_plan.documents, "write_document", dies)
        with pytest.raises(OSError):
            prepared(spark, source, str(out), val_fraction=0.2)
    assert prepared(spark, source, str(out)).folder == first.folder
    later = [prepared(spark, source, str(out), val_fraction=v).folder for v in (0.2, 0.25, 0.3)]
    assert first.splits.schema and not os.path.exists(first.folder)
    assert [os.path.exists(f) for f in later] == [False, True, True]
    assert prepared(spark, source, str(out), val_fraction=0.3).folder == later[-1]


def test_audit_modes(spark, tmp_path):
    def strip_encoding(payload):
        return payload[1:]

    source = str(tmp_path / "src")
    rows = [((bytearray(f"{i % 2}text {i // 2}".encode()), None), i // 2 % 3) for i in range(120)]
    write_shards(spark, rows, source)
    counts = {
        "encoded": prepared(spark, source, str(tmp_path / "e")).splits.count(),
        "decoded": prepared(spark, source, str(tmp_path / "d"), audit="decoded", decode=strip_encoding).splits.count(),
        "none": prepared(spark, source, str(tmp_path / "n"), audit="none", deduplicate=False).splits.count(),
    }
    assert counts == {"encoded": 120, "decoded": 60, "none": 120}
    kept = prepared(spark, source, str(tmp_path / "k"), audit="decoded", decode=strip_encoding, deduplicate=False)
    sides = kept.splits.join(kept.fingerprints.select("idx", "fp"), "idx").select("fp", "split").distinct()
    assert kept.splits.count() == 120 and sides.count() == 60
    document = json.loads(kept.manifest.first()["document"])
    assert (document["num_rows"], document["source_num_shards"], document["cross_split_group_overlap"]) == (120, 3, 0)
    for options in ({"audit": "none"}, {"audit": "pixels"}, {"audit": "decoded"}, {"decode": strip_encoding}):
        with pytest.raises(ValueError):
            prepared(spark, source, str(tmp_path / "x"), **options)
