import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyforge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_pieces(rows, capacity):
    encoder, out = Tokenizer.from_file(PATH), []
    for key, text in rows:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out.append((key, p, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_places(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_places(spark, docs_of):
    rng = random.Random(5)
    words = ["don't", "Éàü", "x1y22", "<|endoftext|>", "a<|startoftext|>B", " ", "ΣΑΣ", "日本", "é", "!?"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, "no key"), (5, "again"), (5, "again"), (203, "long " * 3000)]
    got = packing.pack_documents(docs_of(rows), PATH, capacity=64).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_pieces(rows, 64)
    used = check_places(got, 64)
    assert used <= 1.05 * -(-sum(r["length"] for r in got) // 64) + 1


def test_exchange_between_groups(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(250, 1900, 4000)
    cut = spark.createDataFrame(
        [(i, 0, 0, int(n), 0, i) for i, n in enumerate(lengths)], packing.PIECES
    )
    got = packing.pack(cut, group_pieces=150).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(4000))
    used = check_places(got, packing.CAPACITY)
    whole = packing.best_fit(-np.sort(-lengths))[0].max() + 1
    assert packing.lower_bound(lengths) <= used <= 1.03 * whole


def test_lower_bound_is_valid_and_sharp():
    assert packing.lower_bound(np.array([], int)) == 0
    assert packing.lower_bound(np.full(7, 1025)) == 7
    assert packing.lower_bound(np.full(9, 700)) == 5
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = rng.integers(1, 101, rng.integers(1, 40))
        bins, _ = packing.best_fit(-np.sort(-lengths), 100)
        assert -(-lengths.sum() // 100) <= packing.lower_bound(lengths, 100) <= bins.max() + 1


def test_empty_table(docs_of):
    assert packing.pack_documents(docs_of([]), PATH).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "g")], "doc_id bigint, text string, length int, `group` string")
    assert [tuple(r)[:4] for r in packing.pack_documents(docs, PATH).collect()] == [(1, 0, 0, 3)]
