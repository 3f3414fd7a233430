"""Queries over examples, fingerprints and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing, scalars
from ..operators import checks, fingerprints, history, splits, verify
from ..plans import prepare as prepare_plan
from ..session import new_path
from ..sources import examples as source
from ..sources import files, headers
from ..sources import predictions as prediction_io
from . import sql, views
from .registry import query, rounded
from .views import table

FRACTIONS = (0.7, 0.15, 0.15)


def _scan(spark, sf):
    return source.scan_examples(spark, source.shard_paths(spark, views.shard_folder(spark, sf)))


def _groups(spark, sf):
    return views.staged(
        spark, sf, "groups", lambda: fingerprints.groups(views.fingerprints(spark, sf))
    )


def _splits(spark, sf):
    """A text that occurs in two languages counts as its first: short ones do in larger tables."""
    return splits.stratified_split(
        views.fingerprints(spark, sf), 42, 0.15, 0.15, group_rows=_groups(spark, sf), conflicts="lowest"
    )


POSITION = "row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1"
INDEX = "row_number() OVER (ORDER BY doc_id % 8, doc_id) - 1"


@query(
    "scan_examples",
    f"SELECT doc_id % 8 AS shard, {POSITION} AS row_in_shard, {sql.LABEL}::BIGINT AS label, "
    "octet_length(encode(text))::BIGINT AS n_bytes FROM documents",
)
def scan_examples(spark, sf):
    return rounded(
        _scan(spark, sf).select(
            views.shard_number().alias("shard"), "row_in_shard", "label",
            F.octet_length("payload").alias("n_bytes"),
        )
    )


@query("scan_labels", f"SELECT {sql.LABEL}::BIGINT AS label, count(*) AS n FROM documents GROUP BY 1")
def scan_labels(spark, sf):
    rows = source.scan_labels(spark, views.shard_folder(spark, sf))
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n")))


@query(
    "shard_inventory",
    "SELECT shard, n AS num_rows, (coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING), 0))::BIGINT AS row_offset FROM (SELECT doc_id % 8 AS shard, count(*) AS n "
    "FROM documents GROUP BY 1)",
)
def shard_inventory(spark, sf):
    inventory = source.shard_inventory(_scan(spark, sf))
    return inventory.select(views.shard_number().alias("shard"), "num_rows", "row_offset")


@query(
    "global_index",
    f"SELECT {INDEX} AS idx, {sql.LABEL}::BIGINT AS label, sha256(text) AS fp FROM documents",
)
def global_index(spark, sf):
    scanned = _scan(spark, sf)
    indexed = source.global_index(scanned, source.shard_inventory(scanned), views.SHARDS)
    return rounded(fingerprints.fingerprint_rows(indexed))


@query(
    "shard_subset",
    f"SELECT {sql.LABEL}::BIGINT AS label, count(*) AS n, true AS smoke_test FROM documents "
    "WHERE doc_id % 8 < 3 GROUP BY 1",
)
def shard_subset(spark, sf):
    paths = source.shard_paths(spark, views.shard_folder(spark, sf), max_shards=3)
    rows = source.scan_labels(spark, paths).groupBy("label").agg(F.count("*").alias("n"))
    return rounded(rows.withColumn("smoke_test", F.lit(True)))


@query(
    "class_schema",
    "SELECT p_partkey, c.class_id::BIGINT AS class_id, c.name FROM (SELECT *, unnest(CASE p_partkey % 3 "
    "WHEN 0 THEN [{'class_id': 0, 'name': p_brand}, {'class_id': 1, 'name': p_type}, "
    "{'class_id': 2, 'name': p_name}] WHEN 1 THEN [{'class_id': 0, 'name': p_name}, "
    "{'class_id': 1, 'name': p_brand}] ELSE ["
    + ", ".join(f"{{'class_id': {i}, 'name': '{n}'}}" for i, n in enumerate(sql.CLASSES))
    + "] END) AS c FROM part)",
)
def class_schema(spark, sf):
    third = F.col("p_partkey") % 3
    names = F.when(
        third == 0, F.format_string('["%s","%s","%s"]', "p_brand", "p_type", "p_name")
    ).otherwise(F.format_string('{"1":"%s","0":"%s"}', "p_brand", "p_name"))
    card = F.when(third == 2, F.lit('{"license":"other"}')).otherwise(
        F.concat(
            F.lit('{"dataset_info":{"features":[{"name":"image","dtype":"image"},'
                  '{"name":"label","dtype":{"class_label":{"names":'),
            names,
            F.lit("}}}]}}"),
        )
    )
    cards = table(spark, sf, "part").select("p_partkey", card.alias("card"))
    return rounded(source.class_schema(cards, ["p_partkey"]))


@query("read_files", "SELECT DISTINCT doc_id % 8 AS shard, true AS has_bytes FROM documents")
def read_files(spark, sf):
    found = files.read_files(spark, views.shard_folder(spark, sf), "*.parquet")
    return found.select(
        views.shard_number("path").alias("shard"),
        (F.octet_length("content") == F.col("length")).alias("has_bytes"),
    )


@query(
    "predictions_io",
    sql.ctes(p=sql.members())
    + "SELECT run, split, count(*) AS n, sum(idx)::BIGINT AS idx_sum, "
    "round(sum(probs[1]), 6) AS p_sum FROM p GROUP BY run, split",
)
def predictions_io(spark, sf):
    path = new_path(spark, "predictions")
    prediction_io.write_predictions(views.members(spark, sf), path)
    return rounded(
        prediction_io.read_predictions(spark, path)
        .groupBy("run", "split")
        .agg(
            F.count("*").alias("n"),
            F.sum("idx").alias("idx_sum"),
            F.sum(F.get("probs", F.lit(0))).alias("p_sum"),
        )
    )


@query("splits_io", sql.ctes(s=sql.split_rows()) + "SELECT split, label::BIGINT AS label, count(*) AS n "
       "FROM s GROUP BY 1, 2")
def splits_io(spark, sf):
    path = new_path(spark, "splits")
    prediction_io.write_splits(_splits(spark, sf), path)
    written = prediction_io.read_splits(spark, path)
    digest = splits.split_hash(written).first()["split_hash"]
    verified = prediction_io.read_splits(spark, path, digest)
    return rounded(verified.groupBy("split", "label").agg(F.count("*").alias("n")))


@query(
    "manifest_sink",
    sql.ctes(s=sql.split_rows())
    + "SELECT split, count(*) AS n, (SELECT count(*) - count(DISTINCT text) FROM documents) AS removed "
    "FROM s GROUP BY split",
)
def manifest_sink(spark, sf):
    assigned = views.staged(spark, sf, "splits", lambda: _splits(spark, sf))
    canonical, identity = prepare_plan.preparation_identity(spark, {"seed": 42, "source": "documents"})
    record = prepare_plan.manifest(
        spark, canonical, identity, _groups(spark, sf), assigned, views.LANGS, True, FRACTIONS, False
    )
    path = new_path(spark, "manifest")
    record.write.json(path)
    document = spark.read.schema(record.schema).json(path).select(F.parse_json("document").alias("d"))
    return document.select(
        F.explode(F.variant_get("d", "$.split_sizes", "map<string,bigint>")).alias("split", "n"),
        F.variant_get("d", "$.audit.removed_duplicate_rows", "bigint").alias("removed"),
    )


@query(
    "checksum_manifest",
    "SELECT sum(octet_length(encode(text)) + 1)::BIGINT AS length, "
    "sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY doc_id % 8",
)
def checksum_manifest(spark, sf):
    def write(path):
        (
            table(spark, sf, "documents")
            .select("text", (F.col("doc_id") % 8).alias("shard"), "doc_id")
            .repartition("shard")
            .sortWithinPartitions("shard", "doc_id")
            .select("text", "shard")
            .write.partitionBy("shard")
            .text(path)
        )

    path = views.fixture(spark, sf, "text-files", write)
    return files.checksum_manifest(spark, path, "*.txt").select("length", "sha256")


@query(
    "payload_bytes",
    f"SELECT {sql.LABEL}::BIGINT AS label, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents "
    "GROUP BY 1",
)
def payload_bytes(spark, sf):
    return rounded(
        _scan(spark, sf).groupBy("label").agg(F.sum(F.octet_length("payload")).alias("n_bytes"))
    )


@query("fingerprint_encoded", "SELECT doc_id, sha256(text) AS fp FROM documents")
def fingerprint_encoded(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", hashing.fingerprint_encoded(F.col("text")).alias("fp")
    )


@query(
    "fingerprint_canonical",
    "SELECT doc_id, sha256('TEXT:' || length(lower(trim(text))) || ':' || lower(trim(text))) AS fp "
    "FROM documents",
)
def fingerprint_canonical(spark, sf):
    content = F.lower(F.trim("text"))
    header = F.concat(F.lit("TEXT:"), F.length(content), F.lit(":"))
    return table(spark, sf, "documents").select(
        "doc_id", hashing.fingerprint_canonical(content, header).alias("fp")
    )


def _plain(payload: bytes) -> bytes:
    """Undo the hex form that every text's second copy has."""
    return bytes.fromhex(payload[1:].decode()) if payload[:1] == b"x" else payload[1:]


@query(
    "fingerprint_decoded",
    f"SELECT sha256(text) AS fp, min(doc_id) * 2 AS idx, 2 * count(*) AS size, min({sql.LABEL})::BIGINT AS label, "
    f"max({sql.LABEL})::BIGINT AS max_label FROM documents GROUP BY 1",
)
def fingerprint_decoded(spark, sf):
    """Every text in two encodings, plain and hex: the decoded audit sees the copies."""
    docs = views.examples(spark, sf)
    forms = F.array(F.concat(F.lit("t"), "payload"), F.concat(F.lit("x"), F.hex(F.encode("payload", "UTF-8"))))
    both = docs.select("idx", "label", F.posexplode(forms).alias("form", "payload")).select(
        (F.col("idx") * 2 + F.col("form")).alias("idx"), "label", F.encode("payload", "UTF-8").alias("payload")
    )
    return rounded(fingerprints.groups(fingerprints.fingerprint_decoded(both, _plain)))


@query(
    "check_offsets",
    sql.ctes(
        o="SELECT p, o, lag(o) OVER (ORDER BY p) AS before FROM (SELECT event_id + event_id // 1500 AS p, event_id * 3 "
        "- CASE WHEN user_id = 7 THEN 10 ELSE 0 END AS o FROM events)",
    )
    + "SELECT 'start' AS rule, (min(o) FILTER (p = 0) <> 0)::BIGINT AS violations FROM o UNION ALL "
    "SELECT 'not_increasing', count(*) FILTER (o <= before) FROM o UNION ALL "
    "SELECT 'end', (max_by(o, p) <> count(*) * 3)::BIGINT FROM o UNION ALL "
    "SELECT 'gap', max(p) + 1 - count(DISTINCT p) FROM o",
)
def check_offsets(spark, sf):
    """All events, at positions that skip one after every 1500: of the edges between buckets of 1000,
    some are whole and some lie in a gap."""
    events = table(spark, sf, "events")
    total = events.agg((F.count("*") * 3).alias("t")).scalar()
    position = F.col("event_id") + F.floor(F.col("event_id") / 1500)
    offset = F.col("event_id") * 3 - F.when(F.col("user_id") == 7, 10).otherwise(0)
    rows = events.select(position.alias("p"), offset.alias("o"))
    return checks.check_offsets(rows, "p", "o", total, bucket=1000)


@query(
    "check_inventory",
    "SELECT d.doc_id::VARCHAR AS file, CASE WHEN l.doc_id IS NULL THEN 'missing' "
    "WHEN octet_length(encode(text)) <> n_chars THEN 'size_mismatch' ELSE 'ok' END AS status, "
    "CASE WHEN l.doc_id IS NULL OR octet_length(encode(text)) <> n_chars THEN n_chars ELSE 0 END "
    "AS missing_bytes FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
)
def check_inventory(spark, sf):
    documents = table(spark, sf, "documents")
    required = documents.select(
        F.col("doc_id").cast("string").alias("file"), F.col("n_chars").alias("expected_bytes")
    )
    present = (
        documents.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id")
        .select(
            F.col("doc_id").cast("string").alias("file"),
            F.octet_length("text").cast("bigint").alias("present_bytes"),
        )
    )
    return rounded(checks.check_inventory(required, present))


@query(
    "check_class_set",
    "SELECT l_returnflag, l_linestatus, l_returnflag || l_linestatus IN ('NO', 'ON') AS matches, "
    "count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
)
def check_class_set(spark, sf):
    declared = F.array("l_returnflag", "l_linestatus")
    matches = checks.check_class_set(declared, F.array(F.lit("O"), F.lit("N")))
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag", "l_linestatus", matches.alias("matches"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "select_split",
    sql.ctes(p=sql.members()) + "SELECT run, count(*) AS n FROM p WHERE split = 'validation' GROUP BY run",
)
def select_split(spark, sf):
    chosen = prediction_io.select_split(views.members(spark, sf), "val")
    return chosen.groupBy("run").agg(F.count("*").alias("n"))


@query(
    "split_overlap",
    sql.ctes(s=sql.leaky())
    + "SELECT fp, min(split) AS first_split, max(split) AS last_split FROM s GROUP BY fp "
    "HAVING count(DISTINCT split) > 1",
)
def split_overlap(spark, sf):
    return splits.split_overlap(views.leaky_splits(spark, sf))


@query(
    "split_intersect",
    sql.ctes(s=sql.leaky())
    + "SELECT fp FROM s WHERE split = 'train' INTERSECT SELECT fp FROM s WHERE split = 'test'",
)
def split_intersect(spark, sf):
    rows = views.leaky_splits(spark, sf)
    return splits.split_intersect(
        rows.filter("split = 'train'").select("fp"), rows.filter("split = 'test'").select("fp")
    )


@query(
    "split_cover",
    sql.ctes(s=sql.split_rows(), e=sql.examples())
    + "SELECT idx, count(s.idx) AS in_splits, 1::BIGINT AS in_kept FROM e LEFT JOIN s USING (idx) "
    "GROUP BY idx HAVING count(s.idx) <> 1",
)
def split_cover(spark, sf):
    """Copies dropped by the deduplicating split are the rows it does not cover."""
    return splits.split_cover(_splits(spark, sf), views.fingerprints(spark, sf))


@query(
    "attach_split",
    sql.ctes(s=sql.split_rows(), e=sql.examples())
    + "SELECT split, e.label::BIGINT AS label, count(*) AS n, min(e.fp) AS low_fp FROM e JOIN s USING (idx) "
    "GROUP BY 1, 2",
)
def attach_split(spark, sf):
    joined = splits.attach_split(views.fingerprints(spark, sf), _splits(spark, sf))
    return rounded(
        joined.groupBy("split", "label").agg(F.count("*").alias("n"), F.min("fp").alias("low_fp"))
    )


@query(
    "verify_counts",
    sql.ctes(s=sql.leaky())
    + "SELECT split, ['de','en','es','fr'][label + 1] AS name, count(*) AS recomputed, "
    "count(*) FILTER (n_chars > 200) AS recorded FROM s JOIN documents ON doc_id = idx GROUP BY 1, 2 "
    "HAVING count(*) <> count(*) FILTER (n_chars > 200)",
)
def verify_counts(spark, sf):
    rows = views.leaky_splits(spark, sf).join(
        table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "n_chars"), "idx"
    )
    name = F.get(F.array(*[F.lit(v) for v in views.LANGS]), F.col("label"))
    counted = rows.withColumn("name", name).groupBy("split", "name")
    return verify.verify_counts(
        counted.agg(F.count("*").alias("n")),
        counted.agg(F.count_if(F.col("n_chars") > 200).alias("n")),
    )


@query(
    "verify_fingerprints",
    "SELECT doc_id AS idx, sha256(text) AS recomputed, sha256(trim(text)) AS cached FROM documents "
    "WHERE doc_id IN (SELECT doc_id FROM labels) AND text <> trim(text) UNION ALL "
    "SELECT doc_id, sha256(text), NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def verify_fingerprints(spark, sf):
    """The cache hashed trimmed text, and of labelled documents only."""
    cached = (
        table(spark, sf, "documents")
        .join(table(spark, sf, "labels"), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("idx"), F.sha2(F.trim("text"), 256).alias("fp"))
    )
    return verify.verify_fingerprints(views.fingerprints(spark, sf), cached)


@query(
    "class_counts",
    sql.ctes(s=sql.split_rows())
    + "SELECT v.split, c::BIGINT AS label, count(s.idx) AS n FROM (VALUES ('train'), ('validation'), "
    "('test')) v(split), range(5) r(c) LEFT JOIN s ON s.split = v.split AND s.label = c GROUP BY 1, 2",
)
def class_counts(spark, sf):
    """Five declared classes, of which one never occurs."""
    return rounded(splits.class_counts(_splits(spark, sf), 5))


@query(
    "split_fractions",
    sql.ctes(s=sql.split_rows())
    + "SELECT split, count(*) AS n, CASE split WHEN 'train' THEN 0.7::DOUBLE ELSE 0.15::DOUBLE END AS requested, "
    "round(count(*) / (SELECT count(*) FROM s), 6) AS actual FROM s GROUP BY split",
)
def split_fractions(spark, sf):
    return rounded(splits.split_fractions(_splits(spark, sf), FRACTIONS))


@query(
    "duplicate_audit",
    "SELECT count(*) FILTER (n > 1) AS duplicate_groups, (sum(n - 1))::BIGINT AS duplicate_rows, "
    "(sum(n - 1))::BIGINT AS removed_duplicate_rows, count(*) AS unique_groups "
    "FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)",
)
def duplicate_audit(spark, sf):
    return rounded(fingerprints.duplicate_audit(fingerprints.groups(views.fingerprints(spark, sf))))


@query(
    "label_conflicts",
    "SELECT fp, list_sort(list(DISTINCT label))::VARCHAR AS labels, "
    "(list_sort(list(idx))[1:10])::VARCHAR AS first_rows FROM (SELECT sha256(text) AS fp, doc_id % 2 AS label, "
    "doc_id AS idx FROM documents) GROUP BY fp HAVING min(label) <> max(label)",
)
def label_conflicts(spark, sf):
    """Odd and even copies of a text disagree."""
    rows = views.staged(
        spark, sf, "odd-even",
        lambda: views.fingerprints(spark, sf).withColumn("label", (F.col("idx") % 2).cast("int")),
    )
    found = fingerprints.label_conflicts(rows)
    return found.select(
        "fp", F.col("labels").cast("string").alias("labels"),
        F.col("first_rows").cast("string").alias("first_rows"),
    )


@query(
    "dedup_first",
    sql.ctes(e=sql.examples()) + "SELECT min(idx) AS idx, min(label)::BIGINT AS label, fp FROM e GROUP BY fp",
)
def dedup_first(spark, sf):
    return rounded(fingerprints.dedup_first(views.fingerprints(spark, sf)))


@query(
    "stratified_split",
    sql.ctes(s=sql.split_rows()) + "SELECT idx, label::BIGINT AS label, fp, split FROM s",
)
def stratified_split(spark, sf):
    return rounded(
        splits.stratified_split(views.fingerprints(spark, sf), 42, 0.15, 0.15, conflicts="lowest")
    )


@query(
    "group_split_facts",
    sql.ctes(e=sql.examples(), g="SELECT label, fp, count(*) AS size FROM e GROUP BY label, fp")
    + "SELECT label::BIGINT AS label, sum(size)::BIGINT AS n_rows, count(*) AS n_groups, 0::BIGINT AS crossing, "
    "true AS near_targets, 3::BIGINT AS n_splits FROM g GROUP BY label",
)
def group_split_facts(spark, sf):
    """What any right group split has: every row once, no group on two sides, every split within
    one largest group of its target in each class."""
    rows = splits.stratified_group_split(
        views.fingerprints(spark, sf), 42, 0.15, 0.15, conflicts="lowest"
    )
    groups = rows.groupBy("label", "fp").agg(
        F.count("*").alias("size"), F.count_distinct("split").alias("sides"), F.min("split").alias("split")
    )
    sizes = groups.groupBy("label", "split").agg(
        F.sum("size").alias("n"), F.count("*").alias("g"), F.max("size").alias("largest"),
        F.sum(F.col("sides") - 1).alias("crossing"),
    )
    total = Window.partitionBy("label")
    share = F.when(F.col("split") == "train", 0.7).otherwise(0.15)
    near = F.abs(F.col("n") - share * F.sum("n").over(total)) <= F.max("largest").over(total) + 1
    return (
        sizes.withColumn("near", near)
        .groupBy(F.col("label").cast("bigint").alias("label"))
        .agg(
            F.sum("n").alias("n_rows"), F.sum("g").alias("n_groups"), F.sum("crossing").alias("crossing"),
            F.bool_and("near").alias("near_targets"), F.count("*").alias("n_splits"),
        )
    )


@query("stratified_group_split")
def stratified_group_split(spark, sf):
    return rounded(
        splits.stratified_group_split(views.fingerprints(spark, sf), 42, 0.15, 0.15, conflicts="lowest")
    )


@query(
    "sample_per_class",
    sql.ctes(e=sql.examples())
    + "SELECT label::BIGINT AS label, arg_min(idx, md5('7:' || idx)) AS idx FROM e WHERE idx % 3 = 0 GROUP BY label",
)
def sample_per_class(spark, sf):
    return rounded(splits.sample_per_class(views.leaky_splits(spark, sf), 7, "train"))


@query(
    "limit_batches",
    sql.ctes(e=sql.examples()) + "SELECT idx, label::BIGINT AS label, fp FROM e ORDER BY idx LIMIT 96",
)
def limit_batches(spark, sf):
    return rounded(splits.limit_batches(views.fingerprints(spark, sf), 3, 32))


def _tree_sql() -> str:
    return sql.ctes(
        s=sql.leaky(),
        leaves="SELECT idx >> 16 AS leaf, sha256(string_agg(idx || ':' || label || ':' || split, ',' "
        "ORDER BY idx)) AS hash FROM s GROUP BY 1",
        middle="SELECT leaf >> 16 AS branch, sha256(string_agg(hash, '' ORDER BY leaf)) AS hash "
        "FROM leaves GROUP BY 1",
    ) + "SELECT sha256(string_agg(hash, '' ORDER BY branch)) AS split_hash FROM middle"


@query("split_hash", _tree_sql())
def split_hash(spark, sf):
    return splits.split_hash(views.leaky_splits(spark, sf))


@query(
    "image_profile",
    "WITH l AS (SELECT *, 8 + l_linenumber AS w, l_quantity::INT AS h, l_orderkey % 9 AS turn, "
    "l_linenumber = 7 AS cut FROM lineitem) "
    "SELECT kind, value, count(*) AS n FROM (SELECT 'dimensions' AS kind, CASE WHEN cut THEN 'unknown' "
    "WHEN l_linenumber % 2 = 0 AND turn BETWEEN 5 AND 8 THEN h || 'x' || w ELSE w || 'x' || h END AS value FROM l "
    "UNION ALL SELECT 'mode', CASE WHEN cut THEN 'unknown' WHEN l_returnflag = 'A' THEN 'RGB' "
    "WHEN l_returnflag = 'N' THEN 'L' WHEN l_linenumber % 2 = 0 THEN 'CMYK' ELSE 'RGBA' END FROM l "
    "UNION ALL SELECT 'format', CASE WHEN cut OR l_linenumber % 2 = 0 THEN 'JPEG' ELSE 'PNG' END FROM l) GROUP BY 1, 2",
)
def image_profile(spark, sf):
    """Each line item as the header of a picture of its own size and colour type: odd lines as PNG,
    even ones as JPEG with a comment of its own length and an orientation of either byte order before
    the frame; line 7 as a JPEG that ends before its frame."""

    def number(c, digits):
        return F.lpad(F.hex(c.cast("bigint")), digits, "0")

    width, height, flag = F.col("l_linenumber") + 8, F.col("l_quantity"), F.col("l_returnflag")
    colour = F.when(flag == "A", 2).when(flag == "N", 0).otherwise(6)
    png = F.concat(
        F.lit(headers.PNG_MAGIC + "0000000D49484452"), number(width, 8), number(height, 8),
        F.lit("08"), number(colour, 2), F.lit("000000"),
    )
    note = F.repeat(F.lit("6E"), (F.col("l_partkey") % 200).cast("int"))
    turn = F.col("l_orderkey") % 9
    tiff = F.when(
        F.col("l_orderkey") % 2 == 0,
        F.concat(F.lit("4D4D002A0000000800010112000300000001"), number(turn, 4), F.lit("000000000000")),
    ).otherwise(
        F.concat(F.lit("49492A000800000001001201030001000000"), number(turn, 2), F.lit("00000000000000"))
    )
    parts = F.when(flag == "A", 3).when(flag == "N", 1).otherwise(4)
    begin = F.concat(
        F.lit("FFD8FFE000104A46494600010100000100010000FFFE"), number(F.length(note) / 2 + 2, 4), note,
        F.lit("FFE10022" + headers.EXIF_HEAD), tiff,
    )
    frame = F.concat(F.lit("FFFFC2000B08"), number(height, 4), number(width, 4), number(parts, 2), F.lit("011100FFDA"))
    payload = F.when(F.col("l_linenumber") == 7, begin).when(
        F.col("l_linenumber") % 2 == 0, F.concat(begin, frame)
    ).otherwise(png)
    rows = table(spark, sf, "lineitem").select(F.unhex(payload).alias("payload"))
    return headers.image_profile(headers.image_header(rows))


@query(
    "identity_hash",
    "SELECT o_orderkey, sha256('{\"customer\":' || o_custkey || ',\"key\":' || o_orderkey || "
    "',\"state\":{\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}}') "
    "AS identity FROM orders",
)
def identity_hash(spark, sf):
    """Documents with shuffled key order hash as their key-sorted form."""
    document = F.format_string(
        '{"state": {"status":"%s", "priority":"%s"}, "key": %d, "customer": %d}',
        "o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey",
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", hashing.identity_hash(document).alias("identity")
    )


@query(
    "protocol_hash",
    "SELECT o_orderkey, sha256('{\"class_names\":[\"' || o_orderpriority || '\",\"' || o_orderstatus || "
    "'\"],\"data_revision\":\"rev-' || o_custkey || '\",\"split_hash\":\"' || md5(o_orderkey::VARCHAR) || "
    "'\"}') AS protocol_hash FROM orders",
)
def protocol_hash(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        hashing.protocol_hash(
            F.concat(F.lit("rev-"), F.col("o_custkey")),
            F.md5(F.col("o_orderkey").cast("string")),
            F.array("o_orderpriority", "o_orderstatus"),
        ).alias("protocol_hash"),
    )


@query(
    "pinned_revision",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN true ELSE false END AS pinned FROM part",
)
def pinned_revision(spark, sf):
    digest = F.md5(F.col("p_partkey").cast("string"))
    revision = F.when(F.col("p_size") % 2 == 0, F.concat(digest, F.substring(digest, 1, 8))).when(
        F.col("p_size") % 3 == 0, F.concat(digest, F.lit("zzzzzzzz"))
    ).otherwise(digest)
    return table(spark, sf, "part").select(
        "p_partkey", scalars.pinned_revision(revision).alias("pinned")
    )


@query(
    "canonical_name",
    "SELECT p_partkey, replace(replace(lower(trim(' ' || p_name || '-' || p_type || '  ')), '-', '_'), ' ', '_') "
    "AS name FROM part",
)
def canonical_name(spark, sf):
    raw = F.concat(F.lit(" "), "p_name", F.lit("-"), "p_type", F.lit("  "))
    return table(spark, sf, "part").select("p_partkey", scalars.canonical_name(raw).alias("name"))


PREPARED = (
    sql.ctes(
        d=f"SELECT {INDEX} AS idx, {sql.LABEL} AS label, sha256(text) AS fp FROM documents",
        s=sql.split_rows(),
    )
    + "SELECT split, s.label::BIGINT AS label, count(*) AS n, sum(first)::BIGINT AS idx_sum FROM s "
    "JOIN (SELECT fp, min(idx) AS first FROM d GROUP BY fp) g USING (fp) GROUP BY 1, 2"
)


def _split_sums(done):
    return rounded(
        done.splits.groupBy("split", "label").agg(
            F.count("*").alias("n"), F.sum("idx").alias("idx_sum")
        )
    )


@query("prepare", PREPARED)
def prepare(spark, sf):
    folder = views.shard_folder(spark, sf)
    done = prepare_plan.prepare(
        spark, folder, new_path(spark, "prepared"), views.LANGS, source_id="documents",
        conflicts="lowest",
    )
    return _split_sums(done)


@query("prepare_grown", PREPARED)
def prepare_grown(spark, sf):
    """A source prepared when it had half of its shards, and again with all of them: the second
    time only new shards are hashed, and the splits are those of a preparation in one go."""
    folder, out = views.shard_folder(spark, sf), new_path(spark, "prepared")
    options = {"names": views.LANGS, "source_id": "documents", "conflicts": "lowest"}
    prepare_plan.prepare(spark, folder, out, max_shards=views.SHARDS // 2, **options)
    done = prepare_plan.prepare(spark, folder, out, **options)
    if f'"reused_shards": {views.SHARDS // 2},' not in done.manifest.first()["document"]:
        raise ValueError("known shards were read again")
    return _split_sums(done)


# --- histories -----------------------------------------------------------------------------

STATE = "{'best': -1.0::DOUBLE, 'best_epoch': 0::BIGINT, 'stopped': NULL::BIGINT}"


@query(
    "early_stop",
    sql.ctes(
        h=sql.history(),
        l="SELECT run, max(epoch) AS epochs, list({'e': epoch::BIGINT, 's': score::DOUBLE} ORDER BY epoch) AS xs "
        "FROM h GROUP BY run",
        f="SELECT run, epochs, list_reduce(list_transform(xs, lambda x: {'best': x.s, 'best_epoch': x.e, "
        "'stopped': NULL::BIGINT}), lambda a, x: CASE WHEN a.stopped IS NOT NULL THEN a "
        "WHEN x.best > a.best + 0.5 THEN {'best': x.best, 'best_epoch': x.best_epoch, 'stopped': NULL::BIGINT} "
        "WHEN x.best_epoch - a.best_epoch >= 7 THEN {'best': a.best, 'best_epoch': a.best_epoch, "
        "'stopped': x.best_epoch} ELSE a END, " + STATE + ") AS s FROM l",
    )
    + "SELECT run, s.best_epoch AS best_epoch, round(s.best, 6) AS best_score, "
    "coalesce(s.stopped, epochs) AS last_epoch, s.stopped IS NOT NULL AS stopped_early FROM f",
)
def early_stop(spark, sf):
    return rounded(history.early_stop(views.history(spark, sf), patience=7, min_delta=0.5))


@query(
    "early_stop_long",
    sql.ctes(
        r="SELECT user_id % 3 AS run, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) "
        "AS epoch FROM events",
        l="SELECT run, max(epoch) AS epochs, list({'e': epoch::BIGINT, 's': (epoch / 400 + value / 50)::DOUBLE} "
        "ORDER BY epoch) AS xs FROM r GROUP BY run",
        f="SELECT run, epochs, list_reduce(list_transform(xs, lambda x: {'best': x.s, 'best_epoch': x.e, "
        "'stopped': NULL::BIGINT}), lambda a, x: CASE WHEN a.stopped IS NOT NULL THEN a "
        "WHEN x.best > a.best + 0.25 THEN {'best': x.best, 'best_epoch': x.best_epoch, 'stopped': NULL::BIGINT} "
        "WHEN x.best_epoch - a.best_epoch >= 300 + 3000 * (run > 0)::INT THEN {'best': a.best, 'best_epoch': a.best_epoch, "
        "'stopped': x.best_epoch} ELSE a END, " + STATE + ") AS s FROM l",
    )
    + "SELECT run, s.best_epoch AS best_epoch, round(s.best, 6) AS best_score, "
    "coalesce(s.stopped, epochs) AS last_epoch, s.stopped IS NOT NULL AS stopped_early FROM f",
)
def early_stop_long(spark, sf):
    """All events as the epochs of three long runs that keep climbing: chunks meet in a tree."""
    rows = table(spark, sf, "events").select((F.col("user_id") % 3).alias("run"), "value", "ts", "event_id")
    climbing = history.with_position(rows, "run", ["ts", "event_id"], "epoch").withColumn(
        "score", F.col("epoch") / 400 + F.col("value") / 50
    )
    short = history.early_stop(climbing.where("run = 0"), patience=300, min_delta=0.25, chunk=64)
    patient = history.early_stop(climbing.where("run > 0"), patience=3300, min_delta=0.25, chunk=64)
    return rounded(short.unionByName(patient))


@query(
    "best_epoch",
    sql.ctes(h=sql.history())
    + "SELECT run, min(epoch) AS best_epoch, round(max(score), 6) AS best_score FROM h "
    "WHERE (run, score) IN (SELECT (run, max(score)) FROM h GROUP BY run) GROUP BY run",
)
def best_epoch(spark, sf):
    return rounded(history.best_epoch(views.history(spark, sf)))


@query(
    "learning_curves",
    sql.ctes(h=sql.history())
    + "SELECT run, epoch, 'val_macro_f1' AS series, round(score, 6) AS value FROM h UNION ALL "
    "SELECT run, epoch, 'val_accuracy', round(score / 2, 6) FROM h WHERE event_type = 'click'",
)
def learning_curves(spark, sf):
    rows = views.history(spark, sf).select(
        "run", "epoch", F.col("score").alias("val_macro_f1"),
        F.when(F.col("event_type") == "click", F.col("score") / 2).alias("val_accuracy"),
    )
    return rounded(history.learning_curves(rows, ["val_macro_f1", "val_accuracy"]))


@query(
    "run_status",
    "SELECT c_custkey AS run, c_mktsegment AS status, coalesce(max(epoch), 0) AS completed_epochs, "
    "round(max(score), 6) AS best_val_macro_f1, c_custkey % 5 = 0 AS smoke_test, "
    "c_acctbal > 0 AS test_evaluated FROM customer LEFT JOIN (" + sql.history() + ") h ON run = c_custkey "
    "GROUP BY c_custkey, c_mktsegment, c_acctbal",
)
def run_status(spark, sf):
    """Customers as runs; only some have events, their history."""
    runs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("status"),
        (F.col("c_custkey") % 5 == 0).alias("smoke_test"),
        (F.col("c_acctbal") > 0).alias("test_evaluated"),
    )
    epochs = views.history(spark, sf).select(
        "run", "epoch", F.col("score").alias("val_macro_f1")
    )
    return rounded(history.run_status(runs, epochs))


