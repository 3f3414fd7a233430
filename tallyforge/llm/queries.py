"""The operators on their whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workload.registry import Query
from ..workload.views import table
from . import chat, decontaminate, langid, lexical, lines, minhash, neighbours, packing, quality, sharding, substrings, warc, whitening

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


TOKENIZER = "word_bpe_49k.json"


OP1 = """
WITH b AS (
  SELECT row_number() OVER () AS it, item_id,
         list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bs AS (
  SELECT it, item_id, len(s) AS m, s FROM (
    SELECT it, item_id, list_transform(range(1, greatest(len(w) - 4, 1) + 1),
           lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) AS s
    FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), ds AS (
  SELECT r, doc_id, list_transform(range(1, greatest(len(w) - 4, 1) + 1),
         lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) AS s
  FROM d WHERE len(w) > 0
), bp AS (
  SELECT it, m, unnest(s) AS h, unnest(range(len(s))) AS off FROM bs
), dp AS (
  SELECT r, len(s) AS n, unnest(s) AS h, unnest(range(len(s))) AS pos FROM ds
), hits AS (
  SELECT r, it, m, n, h, pos, greatest(0, least(pos - off, n - m)) AS st FROM dp JOIN bp USING (h)
), near AS (
  SELECT r, it FROM hits GROUP BY r, it, m HAVING count(DISTINCT pos) * 100 >= m * 75
), hit AS (
  SELECT DISTINCT r, it, m, n, h, pos FROM hits SEMI JOIN near USING (r, it)
), aligned AS (
  SELECT DISTINCT r, it, st, 0 AS a FROM hits
), ending AS (
  SELECT DISTINCT r, it, greatest(0, least(pos - m + 1, n - m)) AS st, 1 AS e FROM hit
), held AS (  -- by every window over a hit, wherever it starts
  SELECT r, it, m, n, h, unnest(range(greatest(0, pos - m + 1), least(pos, greatest(0, n - m)) + 1)) AS st FROM hit
), have AS (
  SELECT r, it, m, n, st, h, count(*) AS c FROM held GROUP BY ALL
), want AS (
  SELECT it, h, count(*) AS k FROM bp GROUP BY it, h
), sim AS (
  SELECT r, it, st, least(m, n - st) AS wide, sum(least(c, k)) AS common, m + least(m, n - st) - sum(least(c, k)) AS total
  FROM have JOIN want USING (it, h) GROUP BY r, it, m, n, st
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY common / total DESC, coalesce(a, e, 2), st) AS o
  FROM sim JOIN bs USING (it) LEFT JOIN aligned USING (r, it, st) LEFT JOIN ending USING (r, it, st)
  WHERE common * 100 >= total * 75
)
SELECT doc_id, item_id, st::BIGINT AS start, wide::BIGINT AS n_shingles, common::BIGINT AS common, total::BIGINT AS total
FROM best JOIN d USING (r) WHERE o = 1
"""


@query("op1_decontaminate", OP1)
def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaked_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


OP2 = """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS p, w FROM t WHERE len(w) >= 35
), h AS (
  SELECT r, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS k FROM s
), rep AS (
  SELECT r, p FROM h SEMI JOIN (SELECT k FROM h GROUP BY k HAVING count(*) > 1) d USING (k)
), cut AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM rep
), word AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM word ANTI JOIN cut USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""


@query("op2_substring_dedup", OP2)
def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf, "documents"))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )


def remainder(divisor: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.train(docs.where(remainder(4) != 2))
    return langid.identify(docs, model).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query("op4_quality")
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").where(remainder(5) != 0)
    network = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.score(docs, network).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query("op5_nearest")
def op5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_near_duplicates")
def op6_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP7 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM d
), k AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l
), s AS (
  SELECT k, min(coalesce(doc_id, -1)) AS first FROM k WHERE k <> ''
  GROUP BY k HAVING count(DISTINCT coalesce(source, chr(0))) >= {lines.MIN_SITES}
), g AS (
  SELECT r, p, line, s.k IS NOT NULL AND first <> coalesce(doc_id, -1) AS gone FROM k LEFT JOIN s USING (k)
), t AS (
  SELECT r, sum(gone::INT) AS n_removed, string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone) AS text
  FROM g GROUP BY r
)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t.text, '')) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""


@query("op7_line_dedup", OP7)
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = lines.remove_boilerplate(table(spark, sf, "documents"))
    return kept.select(
        "doc_id",
        F.col("_tf_lines").alias("n_lines"),
        F.col("_tf_removed").alias("n_removed"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


SCHEMAS = {
    "search": {
        "type": "object",
        "additionalProperties": False,
        "required": ["limit", "query"],
        "properties": {
            "limit": {"type": "integer", "minimum": 1, "maximum": 50},
            "query": {"type": "string", "minLength": 1, "maxLength": 300},
        },
    }
}


OP8 = """
WITH RECURSIVE call AS (
  SELECT conv_id, turn, 't' || turn AS call_id, text, 1 + length(text) % 60 AS lim,
         CASE role WHEN 'user' THEN 'search' ELSE 'setup' END AS tool
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS o
        FROM conversations WHERE role IN ('user', 'system') AND conv_id IS NOT NULL AND turn IS NOT NULL) WHERE o = 1
), result AS (
  SELECT conv_id, turn AS result_turn, 't' || (turn - 1) AS call_id, text AS result
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS o
        FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL) WHERE o = 1
), j AS (
  SELECT * FROM call FULL JOIN result USING (conv_id, call_id)
), need AS (
  SELECT DISTINCT conv_id, call_id, 't' || need AS need
  FROM (SELECT conv_id, call_id, unnest(CASE WHEN turn = 0 THEN [] WHEN turn < 2 THEN [0] ELSE [0, turn - 2] END) AS need FROM call)
), reach AS (
  SELECT conv_id, call_id, 0 AS level FROM call WHERE turn = 0
  UNION
  SELECT n.conv_id, n.call_id, level + 1 FROM reach r JOIN need n ON n.conv_id = r.conv_id AND n.need = r.call_id
), good AS (
  SELECT conv_id, call_id, 0 AS depth FROM call WHERE turn = 0
  UNION
  SELECT c.conv_id, c.call_id, g.depth + 1 FROM call c JOIN good g
    ON g.conv_id = c.conv_id AND g.call_id = 't' || (CASE WHEN c.turn < 2 THEN 0 ELSE c.turn - 2 END) AND c.turn > 0
  WHERE EXISTS (SELECT 1 FROM call o WHERE o.conv_id = c.conv_id AND o.turn = 0)
), l AS (
  SELECT j.*, level FROM j LEFT JOIN (
    SELECT conv_id, call_id, max(level) AS level FROM reach SEMI JOIN good USING (conv_id, call_id) GROUP BY conv_id, call_id
  ) USING (conv_id, call_id)
), v AS (
  SELECT *, CASE WHEN turn IS NULL THEN 'call' WHEN tool <> 'search' THEN 'tool'
      WHEN lim > 50 THEN '$.limit: range'
      WHEN length(text) < 1 OR length(text) > 300 THEN '$.query: length'
      WHEN level IS NULL THEN 'order' END AS reason
  FROM l
)
SELECT conv_id, call_id, turn, tool, level::BIGINT AS level, result_turn, reason IS NULL AS valid, reason,
  '{"arguments":' || CASE WHEN turn IS NULL THEN 'null' ELSE '{"limit":' || lim || ',"query":' || to_json(text) || '}' END
  || ',"call":' || to_json(call_id) || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null')
  || ',"tool":' || coalesce(to_json(tool)::VARCHAR, 'null') || ',"valid":' || (reason IS NULL)::VARCHAR || '}' AS line
FROM v
"""


@query("op8_tool_calls", OP8)
def op8_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """User and system turns are calls that need the conversation's opening turn and the turn two
    before; an assistant's turn is the result of the call before it."""
    turns = table(spark, sf, "conversations")
    call_id = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    calls = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id",
        "turn",
        call_id(F.col("turn")).alias("call_id"),
        F.when(F.col("role") == "user", "search").otherwise("setup").alias("tool"),
        F.to_json(F.struct((1 + F.length("text") % 60).alias("limit"), F.col("text").alias("query"))).alias("arguments"),
        F.when(F.col("turn") == 0, F.array().cast("array<string>"))
        .when(F.col("turn") < 2, F.array(F.lit("t0")))
        .otherwise(F.array(F.lit("t0"), call_id(F.col("turn") - 2)))
        .alias("needs"),
    )
    results = turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), "text"
    )
    return chat.format_calls(calls, results, SCHEMAS, unlinked=True).withColumn("level", F.col("level").cast("bigint"))


@query("op9_warc")
def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op10_pack")
def op10_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER))


OP13 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, coalesce(doc_id, -9223372036854775808) AS o FROM documents
), crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS rest
), u AS (
  SELECT x, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: ('0x' || b)::BIGINT),
         lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT x FROM d), crc
), k AS (
  SELECT doc_id, o, strlen(x) + {sharding.ROW_BYTES} AS size, substr(md5(x), 1, 15) AS g, text_crc32 FROM d JOIN u USING (x)
), c AS (
  SELECT *, row_number() OVER w AS r, (sum(size) OVER w)::HUGEINT AS upto FROM k
  WINDOW w AS (ORDER BY g, o ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT sum(size)::HUGEINT AS total FROM k
), e AS (
  SELECT g, min(r) - 1 AS r0, min(upto - size) AS b0, max(r) AS r1, max(upto) AS b1 FROM c GROUP BY g
), s AS (
  SELECT r, r0, r1, total, abs({sharding.SHARDS} * (upto - size) - i * total) AS low, abs({sharding.SHARDS} * upto - i * total) AS high,
         abs({sharding.SHARDS} * b0 - i * total) AS before, abs({sharding.SHARDS} * b1 - i * total) AS after
  FROM range(1, {sharding.SHARDS}) AS n(i), t, c JOIN e USING (g)
  WHERE (upto - size) * {sharding.SHARDS} <= i * total AND upto * {sharding.SHARDS} > i * total
), cut AS (
  SELECT list(CASE WHEN least(before, after) * {round(1 / sharding.TOLERANCE)} <= total THEN CASE WHEN before <= after THEN r0 ELSE r1 END
              WHEN low <= high THEN r - 1 ELSE r END) AS cuts FROM s
), p AS (
  SELECT *, len(list_filter(cuts, lambda q: q < r))::INTEGER AS shard FROM c, cut
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM p
"""


@query("op13_sharding", OP13)
def op13_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf, "documents"))
    return placed.select(
        F.col("document.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


OP11 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT row_number() OVER () AS it, item_id,
    list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w
  FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT count(*)::HUGEINT AS docs, sum(len(w))::HUGEINT AS total FROM d WHERE len(w) > 0
), p AS (
  SELECT r, doc_id, t, count(*)::HUGEINT AS tf, any_value(n)::HUGEINT AS n
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY r, doc_id, t
), q AS (
  SELECT it, item_id, unnest(w) AS t FROM b
), df AS (
  SELECT t, count(*) AS df FROM p SEMI JOIN q USING (t) GROUP BY t
), k AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::HUGEINT AS wt, docs, total FROM df, s
), g AS (
  SELECT it, item_id, r, doc_id,
         sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS score
  FROM q JOIN k USING (t) JOIN p USING (t) GROUP BY it, item_id, r, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY it ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM g WHERE score > 0
) WHERE rank <= 10
"""


@query("op11_lexical_search", OP11)
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
