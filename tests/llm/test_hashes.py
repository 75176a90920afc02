"""Texts made so that linear hashes of them meet must not be taken for each other."""

import random

import numpy as np

from cadentia.llm import common, decontam, minhash, suffix

#: Equal under any polynomial hash whose base is the one that words were once hashed with.
FIRST, SECOND = "m" * 20, "kigrspmkompmnlmkhkmm"


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_that_met_under_a_linear_hash():
    even, odd = thue_morse(2048), thue_morse(2048, "b", "a")  # these meet modulo 2^64 whatever the base
    texts = [FIRST, SECOND, even, odd, FIRST.upper()]
    data = " ".join(texts).encode()
    _, h = common.words(np.array([0, len(data)]), np.frombuffer(data, np.uint8))
    assert len(set(h.tolist())) == 4 and h[0] == h[4]


def test_hashes_of_stretches_see_every_byte():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 16, 100, 255, 256, 257, 1_000):
        data = rng.integers(0, 256, n, dtype=np.uint8)
        seen = {int(common.stretches(data, np.array([0]), np.array([n]))[0])}
        for k in range(n):
            for bit in (1, 128):
                other = data.copy()
                other[k] ^= bit
                seen.add(int(common.stretches(other, np.array([0]), np.array([n]))[0]))
        assert len(seen) == 1 + 2 * n
    data = np.zeros(40, np.uint8)
    assert len({int(common.stretches(data, np.array([0]), np.array([n]))[0]) for n in range(41)}) == 41


def test_near_dedup_of_texts_that_met(spark):
    rows = [(1, f"alpha {FIRST} beta gamma delta epsilon"), (2, f"alpha {SECOND} beta gamma delta epsilon")]
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}


def test_bytes_of_texts_that_met_stay(spark):
    rng = random.Random(5)
    for _ in range(3):
        head, tail = ("".join(rng.choice("abcdefghijklmnop ") for _ in range(300)) for _ in range(2))
        rows = [(1, head + FIRST + tail), (2, head + SECOND + tail)]
        got = {r.doc_id: r.n_removed for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        own, other = rows[1][1], rows[0][1]
        gone = {i + k for i in range(len(own) - 99) if own[i : i + 100] in other for k in range(100)}
        assert got == {1: 0, 2: len(gone)} and len(gone) < len(own)


def test_test_items_that_met_are_not_found(spark):
    bench = spark.createDataFrame([(1, " ".join([FIRST] * 12))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([SECOND] * 12)), (2, " ".join([FIRST.upper()] * 12))], "doc_id long, text string")
    assert {r.doc_id for r in decontam.leaks(docs, bench).collect()} == {2}
