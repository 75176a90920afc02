"""The suffix order and common prefixes of induced.py against plain sorting."""

from itertools import product

import numpy as np
import pytest

from cadentia.llm import induced


def check(text, symbols, cap, in_memory):
    order, common = induced.sort_suffixes(text, symbols, cap, in_memory)
    plain = text.tolist()
    expected = sorted(range(len(plain)), key=lambda i: plain[i:])
    assert order.tolist() == expected
    for k in range(1, len(plain)):
        a, b = plain[expected[k - 1] :], plain[expected[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert min(int(common[k]), cap) == min(n, cap)


def test_every_short_text():
    for n in range(1, 8):
        for text in product(range(3), repeat=n):
            check(np.array(text, np.int16), 3, 100, 2)


def test_random_repeated_and_run_texts():
    rng = np.random.default_rng(0)
    for turn in range(300):
        text = rng.integers(0, 1 + turn % 6, int(rng.integers(1, 90)))
        text = np.tile(text, 3) if turn % 3 == 0 else np.repeat(text, rng.integers(1, 5, len(text))) if turn % 7 == 0 else text
        check(text.astype(np.int16), 6 + turn % 3, int(rng.choice([3, 100])), int(rng.choice([1, 2, 3, 7, 50, 10**6])))


@pytest.mark.parametrize("in_memory", [700, 10**6])
def test_recursion_with_many_names(monkeypatch, in_memory):
    """Over 4,096 names on the first level, and files for all that is longer than `in_memory`."""
    seen, own = [], induced.sort_suffixes
    monkeypatch.setattr(induced, "sort_suffixes", lambda text, symbols, *more: seen.append(symbols) or own(text, symbols, *more))
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 40_000).astype(np.int16)
    text[20_000:30_000] = text[5_000:15_000]
    order, common = own(text, 4, 100, in_memory)
    raw = text.astype(np.uint8).tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:]) and seen and 500 < max(seen)
    text = rng.integers(0, 200, 60_000).astype(np.int16)
    text[30_000:] = text[:30_000]
    seen.clear()
    order, common = own(text, 200, 100, in_memory)
    raw = text.astype(np.uint8).tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:]) and max(seen) > 4_096
    a, b = order[:-1].astype(int), order[1:].astype(int)
    for k in rng.integers(0, len(a), 2_000):
        n = int(common[k + 1])
        assert n >= 100 or (raw[a[k] : a[k] + n] == raw[b[k] : b[k] + n] and raw[a[k] + n : a[k] + n + 1] != raw[b[k] + n : b[k] + n + 1])


def test_queue_spills():
    queue = induced.BlockQueue(np.array([0, 1, 40, 50, *range(51, 120)]), 5)
    rng, sent = np.random.default_rng(2), []
    for _ in range(30):
        symbol = np.sort(rng.integers(0, 119, 20))
        part = (symbol, rng.integers(0, 99, 20), np.arange(20, dtype=np.int32), symbol)
        sent += list(zip(*(x.tolist() for x in part)))
        queue.push(part)
    assert queue.file is not None
    got = []
    for b in range(len(queue.cuts) - 1):
        queue.enter(b)
        while (part := queue.take(b)) is not None:
            got += list(zip(*(x.tolist() for x in part)))
    assert got == sorted(sent, key=lambda e: e[0])


def test_least_between():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 77).astype(np.int32)
    low = rng.integers(0, 77, 300)
    high = np.minimum(low + rng.integers(-1, 77, 300), 76)
    got = induced.Least(values, induced.Room(5)).between(low, high)
    assert [int(v) for v in got] == [int(values[a : b + 1].min()) if a <= b else int(induced.FAR) for a, b in zip(low, high)]


def test_seeds_by_symbol():
    rng = np.random.default_rng(4)
    for n, symbols in ((0, 3), (1, 1), (50, 3), (3_000, 400)):
        text = np.minimum(rng.integers(0, symbols, n), rng.integers(0, symbols, n)).astype(np.int16)
        seeds = np.sort(rng.choice(n, n // 2, replace=False)).astype(np.int32)
        room = induced.Room(7)
        got = induced.by_symbol(text, seeds, induced.blocks_of(text, symbols, room), room)
        assert got.tolist() == seeds[np.argsort(text[seeds], kind="stable")].tolist()


def test_memory_besides_the_files_grows_as_the_root_of_the_shard():
    """What numpy holds at once, for shards of two sizes, with files for all that is longer than 20,000 entries."""
    import tracemalloc

    rng, peaks = np.random.default_rng(5), []
    for n in (100_000, 400_000):
        text = rng.integers(1, 250, n).astype(np.int16)
        text[n // 2 :] = text[: n - n // 2]
        tracemalloc.start()
        order, _ = induced.sort_suffixes(text, 251, 100, 20_000)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(order) == n
    assert peaks[1] < 2.5 * peaks[0]  # blocks of symbols grow as the root
