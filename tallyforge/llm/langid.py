"""Language identification of mixed texts by per-word scores and a switching penalty.

A model holds, per language, the log-probabilities of hashed letter trigrams and the scripts its
letters come from, both counted over all training rows. A word (a run of letters) is scored for
each language whose scripts include the word's; a Viterbi pass with a penalty for every change
labels each word, and runs of one label are spans. Most texts need no pass: where no stretch of
words gains more than the penalty by leaving the best single language, that language is the
optimal path.

Defined results: a null text, and one without letters, is ``und`` with score 0 and no spans. Ties
go to the language that sorts first. Letters of a script that no language uses count against the
score. Rows with null text or language train nothing. A model without any training row labels
every text ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_package
from . import words as W

BUCKETS = 1 << 15
PENALTY = 20.0
SCRIPT_SHARE = 0.02
UNKNOWN = "und"

# First code points of script ranges; letters outside them count as "other". Fixed values (Unicode).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS])
_CODES = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, and its lower case."""
    every = [chr(i) for i in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in every), bool, len(every))
    lower = np.arange(0x110000, dtype=np.uint32)
    cased = [i for i in np.flatnonzero(letter) if every[i].lower() != every[i]]
    lower[cased] = [ord(every[i].lower()[0]) for i in cased]
    return letter, lower


@dataclass
class Letters:
    """Letters of some texts: text, word and hashed trigram of each, with word starts."""

    bucket: np.ndarray
    script: np.ndarray
    word_start: np.ndarray
    word_text: np.ndarray
    word_at: np.ndarray
    word_end: np.ndarray


def letters(texts: list[str]) -> Letters:
    is_letter, lower = _letters()
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.zeros(len(points) + 2, np.uint64)
    mask = np.zeros(len(points) + 2, bool)
    mask[1:-1] = is_letter[points]
    padded[1:-1] = np.where(mask[1:-1], lower[points], 0)
    at = np.flatnonzero(mask)
    code = (padded[at - 1] << np.uint64(42)) ^ (padded[at] << np.uint64(21)) ^ padded[at + 1]
    bucket = (W.mix(code) % np.uint64(BUCKETS)).astype(np.int64)
    script = _CODES[np.searchsorted(_STARTS, padded[at].astype(np.int64), "right") - 1]
    first = ~mask[at - 1]
    word_start = np.flatnonzero(first)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    place = at[word_start] - 1
    end = at[np.flatnonzero(~mask[at + 1])]
    word_text = np.searchsorted(begin, place, "right") - 1
    return Letters(bucket, script, word_start, word_text, place - begin[word_text], end - begin[word_text])


COUNTS = "lang string, bucket int, n bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text")
        for a, b in W.slices(texts):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs[a:b], texts.slice(a, b - a).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, some in by_lang.items():
                found = letters(some)
                n = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                n += np.bincount(
                    np.concatenate([found.bucket, BUCKETS + found.script]), minlength=len(n)
                )
    for lang, n in totals.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])],
            ["lang", "bucket", "n"],
        )


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # bucket, language
    allowed: np.ndarray  # script, language
    penalty: float


def train(docs: DataFrame, penalty: float = PENALTY) -> Model:
    """Model of the ``lang`` values of ``docs``: counts of letter trigrams over every row.

    The table that reaches the driver has at most languages x (buckets + scripts) rows.
    """
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = (
        with_package(rows).mapInArrow(_count, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    ).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    n[counts["bucket"], [langs.index(v) for v in counts["lang"]]] = counts["n"]
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    log_p = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * BUCKETS)).astype(np.float32)
    return Model(langs, log_p, scripts >= SCRIPT_SHARE * scripts.sum(0), penalty)


def word_scores(model: Model, found: Letters) -> np.ndarray:
    """Log-probability of each word in each language; impossible scripts cost a fixed sum."""
    scores = np.add.reduceat(model.log_p[found.bucket], found.word_start).astype(np.float64)
    size = np.diff(np.append(found.word_start, len(found.bucket)))
    allowed = model.allowed[found.script[found.word_start]]
    allowed[~allowed.any(1)] = True
    return np.where(allowed, scores, scores.min(1, keepdims=True) - 20.0 * size[:, None])


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of one text's words with the largest sum of scores minus penalties."""
    lead = int(np.argmax(scores.sum(0)))
    sums = np.vstack([np.zeros(scores.shape[1]), np.cumsum(scores - scores[:, [lead]], 0)])
    gain = (sums - np.minimum.accumulate(sums, 0)).max()
    if gain < penalty:
        return np.full(len(scores), lead)
    back = np.empty(scores.shape, np.int64)
    stay = np.arange(scores.shape[1])
    total = scores[0]
    for t in range(1, len(scores)):
        top = int(total.argmax())
        switch = total[top] - penalty > total
        back[t] = np.where(switch, top, stay)
        total = np.maximum(total, total[top] - penalty) + scores[t]
    path = np.empty(len(scores), np.int64)
    path[-1] = int(total.argmax())
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
    """Language, share of the letters in it, and spans (from, to, language) of each text."""
    out: list[tuple[str, float, list[dict]]] = [(UNKNOWN, 0.0, [])] * len(texts)
    found = letters([t or "" for t in texts])
    if not len(found.word_start) or not model.langs:
        return out
    scores = word_scores(model, found)
    size = np.diff(np.append(found.word_start, len(found.bucket)))
    known = model.allowed[found.script[found.word_start]].any(1)
    first = np.searchsorted(found.word_text, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        path = best_path(scores[a:b], model.penalty)
        share = np.bincount(path, weights=size[a:b], minlength=len(model.langs))
        top = int(share.argmax())
        sure = share[top] - size[a:b][(path == top) & ~known[a:b]].sum()
        turn = np.flatnonzero(np.diff(path)) + 1
        starts, stops = np.append(0, turn), np.append(turn, b - a)
        spans = [
            {"start": int(found.word_at[a + s]), "stop": int(found.word_end[a + e - 1]), "lang": model.langs[path[s]]}
            for s, e in zip(starts, stops)
        ]
        out[i] = (model.langs[top], float(sure / share.sum()), spans)
    return out


LABELS = "doc_id bigint, lang_pred string, score double, spans array<struct<start:bigint,stop:bigint,lang:string>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))


def _label(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                found = list(zip(*label(model, part.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in batch.schema.names if c != "text"],
                        pa.array(found[0], pa.string()),
                        pa.array(found[1], pa.float64()),
                        pa.array(found[2], SPANS),
                    ],
                    [*[c for c in batch.schema.names if c != "text"], "lang_pred", "score", "spans"],
                )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``lang_pred``, ``score`` (share of letters in it) and ``spans`` (code points from, to) of
    every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return with_package(rows).mapInArrow(_label(model), LABELS)


def _accept(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                if model.langs:
                    fine = [lang != UNKNOWN and score >= least for lang, score, _ in label(model, texts)]
                else:
                    has = np.bincount(letters([t or "" for t in texts]).word_text, minlength=len(texts))
                    fine = (has > 0).tolist()
                yield part.filter(pa.array(fine, pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model, least_share: float) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text has letters and is in one language by
    ``least_share`` at least. A model without languages only asks for letters."""
    return with_package(docs).mapInArrow(_accept(model, least_share), docs.schema)
