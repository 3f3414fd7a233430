"""Near-duplicate documents by bottom-k sketches and exact Jaccard similarity of word shingles.

A document's set holds the hashes of its 5-word shingles (the whole sequence where it is shorter),
letters A-Z lower-cased. Documents with equal sets form one class, so copies travel as one row.
The sketch of a class is its k smallest hashes: all sketches use one hash function, and the k
smallest of two sketches' union are a uniform sample of the union of the sets.

Sets with similarity 0.75 share many sketch values, so the pairs to look at come from inverted
lists of retained values:

1. *Stars.* In the lists of the first few values each member is paired with a few leaders, those
   whose values are the most common, which settles small lists and ties large groups together
   without forming all their pairs.
2. *Rest.* Values are ordered by how rare they are. Two sketches with ``OVERLAP`` of their values
   in common share one among the rarest ``1 - OVERLAP`` of each (prefix filtering), so these
   lists hold every pair left; a passage in many documents is common, and mostly outside them.
   Only members of different components are paired. Longer lists are compared in blocks with
   wider sketches, whole sets up to 256 shingles; a block gives out a spanning forest of the sure
   links and the pairs that remain open.

Pairs whose union sketch falls short by five standard errors are dropped; the others are verified
on the full sets, the most promising first, and components (large star, small star) make further
pairs needless. A pair at exactly 0.75 is missed with a chance of a few in a million; those above
are surer, and in a group a document has many ways to be reached.

Defined results: null texts and texts without words have an empty set and link with nothing. A
component's id is the smallest doc_id in it (nulls aside). Rows with repeated ids are documents
of their own. Other columns are ignored here and kept by the filter. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage, with_package
from . import words as W
from .keys import KEY, key_columns, with_key

SHINGLE = 5
PERCENT = 75
SKETCH = 64
OVERLAP = 0.42
ERRORS = 5
WIDE = 256
STAR_VALUES = 4
LEADERS = 3
STAR_ROUNDS = 1
SMALL_LIST = 32
BLOCK = 4096
CLOSEST = 4
COMMON = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (63 bits) of the shingles of some texts, and where each text's begin."""
    words = W.split(texts)
    words.data = _LOWER[words.data]
    h = words.hashes()
    count = np.diff(words.first)
    n = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    after = np.cumsum(n)
    start = np.arange(after[-1] if len(n) else 0) - np.repeat(after - n, n) + np.repeat(words.first[:-1], n)
    stop = np.minimum(start + SHINGLE, np.repeat(words.first[1:], n))
    if not len(start):
        return np.zeros(0, np.uint64), np.concatenate([[0], after]).astype(np.int64)
    rolling = W.Rolling(h, W.WORD_BASE)
    value = W.mix(rolling.ranges(start, stop) + (stop - start).astype(np.uint64))
    return value >> np.uint64(1), np.concatenate([[0], after])


def sets(texts: pa.Array) -> list[np.ndarray]:
    values, at = shingle_hashes(texts)
    return [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]


SETS = "doc_id bigint, _tf_id bigint, _tf_hash bigint, n bigint, sum1 bigint, sum2 bigint, sketch array<bigint>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in W.slices(batch.column("text")):
            part = batch.slice(a, b - a)
            some = sets(part.column("text"))
            total = np.array([[s.sum(dtype=np.uint64), W.mix(s).sum(dtype=np.uint64)] for s in some], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in ("doc_id", *KEY)],
                    pa.array([len(s) for s in some], pa.int64()),
                    pa.array(total[:, 0].view(np.int64)),
                    pa.array(total[:, 1].view(np.int64)),
                    pa.array([s[:SKETCH].astype(np.int64) for s in some], pa.list_(pa.int64())),
                ],
                [c.split()[0] for c in SETS.split(", ")],
            )


SIG = ["n", "sum1", "sum2"]


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        left, right = batch.column("text_a"), batch.column("text_b")
        for a, b in W.slices(left, W.SLICE_BYTES // 2):
            for c, d in W.slices(right.slice(a, b - a), W.SLICE_BYTES // 2):
                xs, ys = sets(left.slice(a + c, d - c)), sets(right.slice(a + c, d - c))
                keep = []
                for x, y in zip(xs, ys):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= PERCENT * (len(x) + len(y) - common) and common > 0)
                mask = pa.array(keep, pa.bool_())
                part = batch.slice(a + c, d - c)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(mask), part.column("b").filter(mask)], ["a", "b"]
                )


def least_estimate(n: int) -> float:
    """What a sample of ``n`` of the union may show at similarity 0.75, less some errors."""
    return 0.75 - ERRORS * (0.1875 / n) ** 0.5


def estimate(left: str = "sketch_a", right: str = "sketch_b") -> Column:
    """Share of the union's sketch that lies in both sets."""
    union = F.array_sort(F.array_union(left, right))
    # a set smaller than a sketch is whole, and so is the union of two of them
    whole = F.greatest("n_a", "n_b") <= SKETCH
    size = F.when(whole, F.size(union)).otherwise(F.least(F.lit(SKETCH), F.size(union)))
    both = F.array_intersect(F.slice(union, F.lit(1), size), F.array_intersect(left, right))
    return F.size(both) / size


def fitting(n_a: str = "n_a", n_b: str = "n_b") -> Column:
    """Sizes that allow the similarity."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that are similar; ``texts`` has cls and text."""
    one = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b")
    return stage(with_package(joined).mapInArrow(_similar, "a bigint, b bigint"), "links")


def components(links: DataFrame) -> DataFrame:
    """``cls, comp`` of all linked classes, comp the smallest class reached: large-star and
    small-star steps until the links are stars, each from a root that is no other's member."""
    parts = max(8, links.count() // 250_000)  # few links need few tasks, whatever the shuffle's width

    def kept(rows: DataFrame) -> DataFrame:
        return stage(rows.coalesce(parts), "edges")

    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = kept(small)
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("member")).unionByName(
            edges.select(F.col("v").alias("x"), F.lit(0).alias("member"))
        )
        sides = ends.groupBy("x").agg(F.sum("member").alias("as_member"), F.min("member").alias("least"))
        if sides.where("as_member > 1 or (as_member = 1 and least = 0)").coalesce(parts).isEmpty():
            break
    roots = edges.select(F.col("v").alias("cls"), F.col("v").alias("comp")).distinct()
    return kept(edges.select(F.col("u").alias("cls"), F.col("v").alias("comp")).unionByName(roots))


def labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Adds ``comp``, the class itself where it has no link."""
    if comps is None:
        return rows.withColumn("comp", F.col("cls"))
    return rows.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper halves of the ``WIDE`` smallest hashes of each class, in order."""
    for batch in batches:
        for a, b in W.slices(batch.column("text")):
            part = batch.slice(a, b - a)
            some = [(s[:WIDE] >> np.uint64(32)).astype(np.int32) for s in sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("cls"), pa.array(some, pa.list_(pa.int32()))], ["cls", "wide"]
            )


class Overlaps:
    """Counts of values that two rows of a block share, strip by strip.

    Values of many rows become bits, whose intersections are counted a machine word at a time;
    values of fewer rows add their few pairs one by one.
    """

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        owner = np.repeat(np.arange(self.n), [len(r) for r in rows])
        _, column, df = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        common = np.flatnonzero(df >= COMMON)
        place = np.full(len(df), -1)
        place[common] = np.arange(len(common))
        words = max(1, -(-len(common) // 64))
        self.bits = np.zeros((words, self.n), np.uint64)
        bit = place[column]
        some = bit >= 0
        np.bitwise_or.at(self.bits, (bit[some] // 64, owner[some]), np.uint64(1) << (bit[some] % 64).astype(np.uint64))
        rare = (df[column] > 1) & ~some
        order = np.argsort(column[rare], kind="stable")
        who, value = owner[rare][order], column[rare][order]
        pairs = []
        for step in range(1, COMMON):
            same = value[step:] == value[:-step]
            pairs += [np.stack([who[:-step][same], who[step:][same]]), np.stack([who[step:][same], who[:-step][same]])]
        left, right = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        order = np.argsort(left, kind="stable")
        self.left, self.right = left[order], right[order]

    def strip(self, a: int, b: int) -> np.ndarray:
        """Shared values of rows a..b with every row."""
        out = np.zeros((b - a, self.n), np.int32)
        for word in self.bits:
            out += np.bitwise_count(word[a:b, None] & word[None])
        f, t = np.searchsorted(self.left, [a, b])
        np.add.at(out, (self.left[f:t] - a, self.right[f:t]), 1)
        return out


def closest(i: np.ndarray, j: np.ndarray, share: np.ndarray, top: int) -> np.ndarray:
    """Which pairs are among the ``top`` largest shares of one of their rows."""
    row, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((-share[pair], row))
    row = row[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = np.zeros(len(i), bool)
    keep[pair[order][rank < top]] = True
    return keep


def earlier_bits(lists: list[np.ndarray], v: int) -> np.ndarray:
    """Bits, a word to a line, for the lists before ``v`` that each row is in too."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values = np.concatenate(lists)
    owner, values = owner[values < v], values[values < v]
    known, column = np.unique(values, return_inverse=True)
    bits = np.zeros((max(1, -(-len(known) // 64)), len(lists)), np.uint64)
    np.bitwise_or.at(bits, (column // 64, owner), np.uint64(1) << (column % 64).astype(np.uint64))
    return bits


def _blocks(v: int, rows: pd.DataFrame, top: int | None) -> pd.DataFrame:
    """Links of one block of a long list: a spanning forest of the sure ones over the known
    components, and the pairs of different components that only the full sets can decide, all of
    them or the ``top`` closest of each row. A pair that shares an earlier list is left to it."""
    rows = rows.sort_values("cls", ignore_index=True)
    wide = rows["wide"].to_list()
    size = np.array([len(w) for w in wide])
    n, cls = rows["n"].to_numpy(), rows["cls"].to_numpy()
    whole = n <= WIDE
    highest = np.where(whole, np.iinfo(np.int32).max, [w[-1] for w in wide]).astype(np.int64)
    values = np.concatenate(wide).astype(np.int64) + np.repeat(np.arange(len(rows)) << 33, size)
    first = np.cumsum(size) - size
    _, label = np.unique(rows["comp"].to_numpy(), return_inverse=True)
    label = label.astype(np.int64)
    shared, earlier = Overlaps(wide), earlier_bits(rows["lists"].to_list(), v)
    links, open_pairs, shares = [], [], []
    for a in range(0, len(rows), 256):
        b = min(a + 256, len(rows))
        common = shared.strip(a, b)
        fit = common * 8 >= 0.6 * 8 * np.minimum(size[a:b, None], size[None])
        fit &= 100 * np.minimum(n[a:b, None], n[None]) >= PERCENT * np.maximum(n[a:b, None], n[None])
        fit &= label[a:b, None] != label[None]
        i, j = np.nonzero(fit)
        i += a
        up = i < j
        i, j = i[up], j[up]
        own = np.ones(len(i), bool)
        for word in earlier:
            own &= (word[i] & word[j]) == 0
        i, j = i[own], j[own]
        both = common[i - a, j]
        lower = np.where(highest[i] <= highest[j], i, j)
        other = i + j - lower
        below = np.searchsorted(values, (other << 33) + highest[lower], "right") - first[other]
        union = size[lower] + below - both
        exact = whole[i] & whole[j]
        share = both / union
        slack = np.where(exact, 1 / union, ERRORS * np.sqrt(0.1875 / union))
        sure = np.where(exact, (both - 1) * 100 >= PERCENT * (union + 1), share >= 0.75 + slack)
        maybe = ~sure & (share >= 0.75 - slack - 1e-9)
        for x, y in zip(i[sure].tolist(), j[sure].tolist()):
            if label[x] != label[y]:
                links.append((x, y))
                label[label == label[y]] = label[x]
        open_pairs.append(np.stack([i[maybe], j[maybe]]))
        shares.append(share[maybe])
    left = np.concatenate(open_pairs, axis=1) if open_pairs else np.zeros((2, 0), np.int64)
    apart = label[left[0]] != label[left[1]]
    left = left[:, apart]
    if top is not None:
        left = left[:, closest(*left, np.concatenate([*shares, []])[apart], top)]
    a = np.concatenate([np.array([x for x, _ in links], np.int64), left[0]])
    b = np.concatenate([np.array([y for _, y in links], np.int64), left[1]])
    return pd.DataFrame({"a": cls[a], "b": cls[b]})


class Linker:
    """Links between the classes of a table, found in rounds over shared staged tables."""

    def __init__(self, docs: DataFrame):
        texts = docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), *key_columns(), F.coalesce("text", F.lit("")).alias("text")
        )
        self.rows = stage(with_package(texts).mapInArrow(_sets, SETS), "sets")
        grouped = (
            self.rows.where("n > 0")
            .groupBy(*SIG)
            .agg(F.min("doc_id").alias("least"), F.min(F.struct(*KEY, "sketch")).alias("r"))
            .select(*SIG, "least", *[F.col(f"r.{c}").alias(c) for c in (*KEY, "sketch")])
        )
        self.classes = stage(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
        listed = self.classes.select("cls", F.posexplode("sketch").alias("at", "v"))
        common = listed.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
        self.lists = stage(listed.join(common, "v"), "lists")
        involved = self.lists.select("cls").distinct()
        chosen = self.classes.join(involved, "cls").select("cls", *KEY)
        self.texts = stage(texts.drop("doc_id").join(chosen, KEY).dropDuplicates(["cls"]).select("cls", "text"), "texts")
        self.central = stage(self.lists.groupBy("cls").agg(F.sum("df").alias("central")), "central")
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None

    def add(self, found: DataFrame) -> None:
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.unionByName(found)
            self.comps = components(self.links)

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b`` with the estimate of their similarity, those that fall short left out."""
        side = self.classes.select("cls", "n", "sketch")
        one = side.select(*[F.col(c).alias(f"{t}") for c, t in (("cls", "a"), ("n", "n_a"), ("sketch", "sketch_a"))])
        two = side.select(*[F.col(c).alias(f"{t}") for c, t in (("cls", "b"), ("n", "n_b"), ("sketch", "sketch_b"))])
        joined = pairs.join(one, "a").join(two, "b").where(fitting())
        whole = F.greatest("n_a", "n_b") <= SKETCH
        least = F.when(whole, 0.75).otherwise(least_estimate(SKETCH)) - 1e-9
        joined = joined.withColumn("least", least)
        return joined.select("a", "b", "least", estimate().alias("est")).where("est >= least").drop("least")

    def stars(self, step: int) -> bool:
        """Pair members of the first values' lists with leaders ``step * LEADERS`` and on."""
        rows = labelled(self.lists.where(F.col("at") < STAR_VALUES).select("v", "cls"), self.comps)
        mixed = rows.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("v")
        rows = (rows.join(mixed, "v") if step else rows).join(self.central, "cls")
        order = Window.partitionBy("v").orderBy(F.desc("central"), F.xxhash64("cls"))
        leaders = (
            rows.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= (step + 1) * LEADERS)
            .where(F.col("rank") > step * LEADERS)
            .select("v", F.col("cls").alias("leader"), F.col("comp").alias("leader_comp"))
        )
        pairs = (
            rows.join(leaders, "v")
            .where("cls <> leader and comp <> leader_comp")
            .select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))
            .distinct()
        )
        pairs = stage(self.sketched(pairs), "star-pairs")
        if pairs.isEmpty():
            return False
        self.add(verified(pairs, self.texts))
        return True

    def rest(self) -> None:
        """All pairs of different components that share a value among their rarest.

        A first pass takes two long lists of each class and the closest pairs of each member: the
        links it finds join most of a large group, whose lists then hold one component and need
        no comparison. The second pass takes all pairs that are left."""
        order = Window.partitionBy("cls").orderBy("df", "v")
        size = F.least("n", F.lit(SKETCH))
        prefix = size - F.ceil(size * OVERLAP) + 1
        own = self.lists.join(self.classes.select("cls", "n"), "cls")
        ranked = own.withColumn("rank", F.row_number().over(order)).withColumn("have", F.count("*").over(Window.partitionBy("cls")))
        # values of no other class come before those of the lists
        index = ranked.where(F.col("rank") + (size - F.col("have")) <= prefix).select("v", "cls", "n")
        index = stage(index, "index")
        long_lists = index.groupBy("v").agg(F.count("*").alias("members")).where(F.col("members") > SMALL_LIST).select("v")
        first = Window.partitionBy("cls").orderBy("v")
        some = index.join(long_lists, "v").withColumn("rank", F.row_number().over(first)).where("rank <= 2").drop("rank")
        self.compare(stage(some, "first-lists"), CLOSEST)
        self.compare(index)

    def compare(self, index: DataFrame, top: int | None = None) -> None:
        """Link the members of lists (v, cls, n) that hold several components; ``top`` bounds the
        pairs that a row of a long list puts forward."""
        index = labelled(index, self.comps)
        facts = index.groupBy("v").agg(F.count("*").alias("members"), F.min("comp").alias("x"), F.max("comp").alias("y"))
        facts = facts.where("x <> y").select("v", "members")
        rows = stage(index.join(facts, "v"), "mixed-lists")
        if rows.isEmpty():
            return
        few = rows.where(F.col("members") <= SMALL_LIST)
        other = few.select("v", *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "comp")])
        pairs = (
            few.join(other, "v")
            .where(F.col("cls") < F.col("cls_b"))
            .where("comp <> comp_b")
            .where(fitting("n", "n_b"))
            .select(F.col("cls").alias("a"), F.col("cls_b").alias("b"))
        )
        chunks = F.ceil(F.col("members") / BLOCK)
        many = rows.where(F.col("members") > SMALL_LIST).withColumn("chunk", F.pmod(F.xxhash64("cls"), chunks))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
        blocks = many.select(
            "v", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "cls", "n", "comp"
        )
        wide = self.texts.join(many.select("cls").distinct(), "cls")
        wide = stage(with_package(wide.select("cls", "text")).mapInArrow(_wide, "cls bigint, wide array<int>"), "wide")
        member = rows.groupBy("cls").agg(F.collect_list("v").alias("lists"))
        blocks = blocks.join(wide, "cls").join(member, "cls")
        long_pairs = with_package(blocks).groupBy("v", "i", "j").applyInPandas(
            lambda key, rows: _blocks(key[0], rows, top), "a bigint, b bigint"
        )
        left = stage(self.sketched(pairs.unionByName(long_pairs).distinct()), "pairs")
        quota = 2
        while not left.isEmpty():
            one = labelled(left.withColumnRenamed("a", "cls"), self.comps).withColumnsRenamed({"cls": "a", "comp": "comp_a"})
            two = labelled(one.withColumnRenamed("b", "cls"), self.comps).withColumnsRenamed({"cls": "b", "comp": "comp_b"})
            open_ = two.where("comp_a <> comp_b")
            best = Window.partitionBy("a", "comp_b").orderBy(F.desc("est"), "b")
            ranked = stage(open_.withColumn("rank", F.row_number().over(best)).select("a", "b", "est", "rank"), "ranked-pairs")
            self.add(verified(ranked.where(F.col("rank") <= quota), self.texts))
            left = ranked.where(F.col("rank") > quota).drop("rank")
            quota *= 8

    def run(self) -> DataFrame:
        for step in range(STAR_ROUNDS):
            if not self.stars(step):
                break
        self.rest()
        members = labelled(self.classes.select("cls", *SIG, "least"), self.comps)
        least = members.groupBy("comp").agg(F.min("least").alias("component_id"))
        return members.join(least, "comp").select(*SIG, "component_id", F.col("comp").alias("_tf_comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, its key, n_shingles, component_id, kept."""
    linker = Linker(docs)
    joined = linker.rows.select("doc_id", *KEY, *SIG).join(linker.run(), SIG, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", *KEY, F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id, nulls last, and of one
    id the smallest text hash; repeated rows of it are dropped too. Documents with an empty set stay,
    one row for each."""
    linker = Linker(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *KEY)
    members = linker.rows.where("n > 0").join(linker.run(), SIG)
    kept = members.groupBy("_tf_comp").agg(F.min(rank).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in KEY])
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = with_key(docs.where(worded)).join(kept, KEY, "left_semi").dropDuplicates(KEY)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~worded))
