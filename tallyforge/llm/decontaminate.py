"""Benchmark decontamination: documents that hold a passage close to a benchmark item.

Texts are lower-cased and cut into words; a text's shingles are its runs of five words (the whole
sequence, where it has fewer). A passage is a window with as many shingles as the item, or a
shorter document as a whole. It leaks the item if the weighted shingle similarity, the sum of the
smaller multiplicities over the sum of the larger, is at least 0.75.

1. Shingles that stand in a benchmark item are found in all documents. Similarity 0.75 needs three
   quarters of the item's shingles, so documents with fewer hits of it drop out without loss.
2. The windows are those of all alignments of a hit, and those that end at a hit and hold enough
   hits for the similarity. The first window of the greatest similarity among all starts ends at a
   hit or begins the text: else the window before it has as many common shingles. So the best of all
   windows is among these. Windows and items get a 64-bit SimHash of their (shingle, occurrence
   number) pairs, so that a repeated shingle does not outvote the rest.
3. The fingerprint is cut into one block more than the radius: fingerprints within the radius
   agree in a block at least. Windows meet their item by (item, block, bits).
4. Pairs within the radius are verified by the exact similarity.

All of it is DataFrame operations. The only table that may be broadcast is the item shingles, and
only within ``BROADCAST_BYTES``; beyond it the join is a shuffle.

Defined results: null texts and texts without words match nothing, on either side. Null item ids
match nothing. Rows with one id and text share their matches. Other columns are ignored here and
kept by the filter. Empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .keys import KEY, with_key

SHINGLE = 5
PERCENT = 75
RADIUS = 24
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), "")


def shingles(words: str) -> Column:
    """Hashes of the shingles of an array of words, in order."""
    w = F.col(words)
    count = F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))
    every = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(w, i, F.lit(SHINGLE))))
    return F.when(F.size(w) > 0, every)


def with_shingles(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("_tf_words", words())
        .withColumn("_tf_shingles", shingles("_tf_words"))
        .drop("_tf_words", "text")
        .withColumn("_tf_n", F.size("_tf_shingles"))
    )


def blocks() -> list[tuple[int, int]]:
    """First bit and width of each of radius + 1 blocks of a fingerprint."""
    edges = [round(i * 64 / (RADIUS + 1)) for i in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def fingerprints(rows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """SimHash of ``array`` for each row of distinct ``keys``: a bit is set if most pairs of an element
    and its occurrence number have it, so that equal pairs are as many as common elements counted
    with multiplicity. First occurrences stand for themselves. Two counters of 32 bits share each sum."""
    pair = (1 << 32) | 1
    h = F.col("_tf_h")
    nth = F.when(F.col("_tf_nth") == 1, h).otherwise(F.xxhash64("_tf_h", "_tf_nth"))
    summed = (
        rows.select(*keys, array)
        .repartition(*keys)
        .select(*keys, F.explode(array).alias("_tf_h"))
        .groupBy(*keys, "_tf_h")
        .agg(F.count("*").alias("_tf_c"))
        .withColumn("_tf_nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "_tf_c")))
        .select(*keys, nth.alias("_tf_h"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("_tf_size"),
            *[F.sum(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(pair))).alias(f"_tf_s{b}") for b in range(32)],
        )
    )
    bits = []
    for b in range(32):
        low = F.col(f"_tf_s{b}").bitwiseAND(F.lit((1 << 32) - 1))
        high = F.shiftrightunsigned(F.col(f"_tf_s{b}"), 32)
        bits.append(F.when(2 * low > F.col("_tf_size"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(0))
        bits.append(F.when(2 * high > F.col("_tf_size"), F.shiftleft(F.lit(1).cast("bigint"), b + 32)).otherwise(0))
    print_ = bits[0]
    for bit in bits[1:]:
        print_ = print_.bitwiseOR(bit)
    return summed.select(*keys, print_.alias("_tf_print"))


def block_codes(fingerprint: str) -> Column:
    """Array of (block number, bits) codes of a fingerprint."""
    return F.array(
        *[
            F.shiftrightunsigned(F.col(fingerprint), a).bitwiseAND(F.lit((1 << n) - 1)) * 64 + i
            for i, (a, n) in enumerate(blocks())
        ]
    )


def window_ends(percent: int) -> Column:
    """Starts of the windows that end at a position of the sorted array ``hit``, moved into the text;
    inside it only of those whose hits suffice for the similarity."""
    last = F.greatest(F.lit(0), F.col("_tf_n") - F.col("_tf_m"))
    need = F.ceil(2 * percent * F.col("_tf_m") / (100 + percent)).cast("int")

    def enough(end: Column, i: Column) -> Column:
        first = F.get("hit", i - need + 1)
        return (end < F.col("_tf_m")) | (F.coalesce(first, F.lit(-1)) > end - F.col("_tf_m"))

    ends = F.filter("hit", enough)
    return F.array_distinct(F.transform(ends, lambda end: F.least(last, F.greatest(F.lit(0), end - F.col("_tf_m") + 1))))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Leaked items: document key, item_id, start (in words), n_shingles, common, total; the best
    window of each pair among all starts, of equals an aligned one, then the first."""
    items = with_shingles(
        benchmark.where(F.col("item_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
            F.col("item_id").cast("bigint").alias("item_id"), "text"
        )
    )
    items = items.select("item_id", "_tf_shingles", F.col("_tf_n").alias("_tf_m")).dropDuplicates(["item_id", "_tf_shingles"])
    # items may repeat an id with other texts, so they are told apart by their own number
    items = stage(items.withColumn("_tf_item", F.xxhash64("item_id", "_tf_shingles")), "items")
    places = items.select("_tf_item", "_tf_m", F.posexplode("_tf_shingles").alias("_tf_off", "_tf_h"))
    places = stage(places, "item-shingles")
    small = places.count() * ROW_BYTES <= BROADCAST_BYTES
    texts = with_key(docs.select("doc_id", "text")).drop("doc_id")
    # the outer form: from the plain one the optimizer infers a filter that cuts the text per shingle
    found = with_shingles(texts).select(*KEY, "_tf_n", F.posexplode_outer("_tf_shingles").alias("_tf_pos", "_tf_h"))
    hits = found.join(F.broadcast(places) if small else places, "_tf_h")
    start = F.greatest(F.lit(0), F.least(F.col("_tf_pos") - F.col("_tf_off"), F.col("_tf_n") - F.col("_tf_m")))
    near = (
        hits.groupBy(*KEY, "_tf_item", "_tf_m", "_tf_n")
        .agg(F.array_sort(F.collect_set("_tf_pos")).alias("hit"), F.collect_set(start).alias("_tf_aligned"))
        .where(F.size("hit") * 100 >= F.col("_tf_m") * percent)
        .withColumn("_tf_ends", window_ends(percent))
        .select(*KEY, "_tf_item", "_tf_m", "_tf_aligned", F.array_except("_tf_ends", "_tf_aligned").alias("_tf_ends"))
    )
    near = stage(near, "near-items")
    starts = F.concat(
        F.transform("_tf_aligned", lambda s: F.struct(s.alias("start"), F.lit(0).alias("late"))),
        F.transform("_tf_ends", lambda s: F.struct(s.alias("start"), F.lit(1).alias("late"))),
    )
    windows = (
        with_shingles(texts)
        .join(near, KEY)
        .select(*KEY, "_tf_item", "_tf_m", "_tf_shingles", F.explode(starts).alias("w"))
        .select(*KEY, "_tf_item", "_tf_m", "_tf_shingles", F.col("w.start").alias("_tf_start"), F.col("w.late").alias("_tf_late"))
        .withColumn("_tf_window", F.slice("_tf_shingles", F.col("_tf_start") + 1, F.col("_tf_m")))
        .drop("_tf_shingles")
    )
    place = [*KEY, "_tf_item", "_tf_start"]
    windows = stage(windows.dropDuplicates(place), "windows")
    window_prints = fingerprints(windows, place, "_tf_window")
    item_prints = fingerprints(items, ["_tf_item"], "_tf_shingles").withColumnRenamed("_tf_print", "_tf_own")
    met = (
        window_prints.withColumn("_tf_code", F.explode(block_codes("_tf_print")))
        .join(item_prints.withColumn("_tf_code", F.explode(block_codes("_tf_own"))), ["_tf_item", "_tf_code"])
        .where(F.bit_count(F.col("_tf_print").bitwiseXOR(F.col("_tf_own"))) <= RADIUS)
        .select(*place)
        .distinct()
    )
    have = (
        windows.join(met, place)
        .select(*place, "_tf_late", "_tf_m", F.size("_tf_window").alias("_tf_w"), F.explode("_tf_window").alias("_tf_h"))
        .groupBy(*place, "_tf_late", "_tf_m", "_tf_w", "_tf_h")
        .agg(F.count("*").alias("_tf_c"))
    )
    want = places.groupBy("_tf_item", "_tf_h").agg(F.count("*").alias("_tf_k"))
    common = (
        have.join(want, ["_tf_item", "_tf_h"])
        .groupBy(*place, "_tf_late", "_tf_m", "_tf_w")
        .agg(F.sum(F.least("_tf_c", "_tf_k")).alias("common"))
        .withColumn("total", F.col("_tf_m") + F.col("_tf_w") - F.col("common"))
        .where(F.col("common") * 100 >= F.col("total") * percent)
    )
    best = F.struct(
        (F.col("common") / F.col("total")).alias("s"), (-F.col("_tf_late")).alias("a"), (-F.col("_tf_start")).alias("p")
    )
    return (
        common.join(items.select("_tf_item", "item_id"), "_tf_item")
        .groupBy(*KEY, "item_id")
        .agg(F.max_by(F.struct("_tf_start", "_tf_w", "common", "total"), best).alias("b"))
        .select(
            *KEY, "item_id", F.col("b._tf_start").cast("bigint").alias("start"), F.col("b._tf_w").cast("bigint").alias("n_shingles"),
            F.col("b.common").alias("common"), F.col("b.total").alias("total"),
        )
    )


def leaked_documents(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row a document and leaked item: doc_id, item_id, start, n_shingles, common, total."""
    rows = with_key(docs.select("doc_id", "text")).select("doc_id", *KEY)
    return rows.join(leaks(docs, benchmark, percent), KEY).drop(*KEY)


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    bad = leaks(docs, benchmark, percent).select(*KEY).distinct()
    return with_key(docs).join(bad, KEY, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
