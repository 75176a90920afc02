"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment on words.

A seed is three words within five places, in order: any of six shapes, the same or another in item and document.  So words that were
changed, put in or left out between them do not hide a copy: where words are changed, an alignment that reaches the threshold
keeps more than 8 words of 15, and so three within some five places.  The seeds of the test items are counted over the whole corpus.  Those are used that occur, except
the ones far more frequent than the median of the item and of each stretch about them that could be found
alone: stock phrases go, while a passage that is copied very often, be it a part of the item, keeps its seeds.  Documents are joined with the seeds' table; around each group of hits
document and item are aligned locally, so edits, insertions and gaps cost little.  The table of seeds
is sent to the tasks in blocks of a fixed number of benchmark words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import WORD_PATTERN, keyed, slices, texts, utf8, without, words, written

N = 3
#: Places of a seed's second and third word, counted from its first.
SHAPES = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
#: A seed that occurs more often than this many times the median of its item and of its stretches is no seed.
RATIO = 16
#: Words of a stretch at most.
STRETCH = 50
#: Score of an alignment: 2 for each equal word, -1 for each other or missing one.
MATCH, OTHER = 2, -1
#: A document is contaminated if an alignment has this share of the item's full score, and eight words net.
SHARE, LEAST = 0.3, 16
#: Benchmark words in one block; a block's table takes about 200 bytes a word.
BLOCK_WORDS = 200_000


class Seeds:
    """Sorted seed hashes with the places (item, position) of each; and a table of bits before the search.

    Broadcast are the three arrays, from which a task makes its own."""

    def __init__(self, hashes: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.keys, self.first = np.unique(hashes[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.item, self.place = item[order], place[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(self.keys, np.diff(self.first)), self.item, self.place

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are keys, and which key each is."""
        at = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), max(len(self.keys) - 1, 0))
        fit = self.keys[key] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[fit], key[fit]


def align(items: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    """Best local score of each item against its part, all pairs at once, row by row."""
    n, height, width = len(items), max(map(len, items)), max(map(len, parts))
    a, b = np.zeros((n, height), np.uint64), np.full((n, width), 1, np.uint64)
    for k, (x, y) in enumerate(zip(items, parts, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x | np.uint64(2), y | np.uint64(2)
    slope = np.arange(width, dtype=np.int32)
    score, best = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32)
    for i in range(height):
        step = np.where(a[:, i : i + 1] == b, MATCH, OTHER)
        now = np.maximum(np.maximum(score[:, :-1] + step, score[:, 1:] + OTHER), 0)
        score[:, 1:] = np.maximum.accumulate(now - OTHER * slope, axis=1) + OTHER * slope
        np.maximum(best, score.max(1), out=best)
    return best


def threshold(length: int, share: float = SHARE, least: int = LEAST) -> float:
    """Score from which an item of so many words counts as found; short ones need 4 words in 5, and a run of STRETCH words
    is enough however long the item is."""
    return min(max(share * MATCH * length, min(least, 0.8 * MATCH * length)), MATCH * STRETCH)


def _table(items: list[tuple[int, str]]) -> tuple[np.ndarray, list[np.ndarray]]:
    encoded = [t.encode() for _, t in items]
    at = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
    row, word = words(at, np.frombuffer(b"".join(encoded), np.uint8))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(items)))])
    return np.array([i for i, _ in items]), [word[ends[k] : ends[k + 1]] for k in range(len(items))]


def _triples(row: np.ndarray, word: np.ndarray, second: int, third: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of the words at 0, second and third from each place, all in one row."""
    at = np.flatnonzero(row[: len(row) - third] == row[third:]) if len(row) > third else np.zeros(0, np.int64)
    return at, keyed(keyed(keyed(word[at]) ^ word[at + second]) ^ word[at + third], 1)


def _hits(seeds: Seeds, row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and keys of the seeds that a document's words hold, in order of place."""
    found = [(at[hit], key) for at, (hit, key) in ((at, seeds.find(h)) for at, h in (_triples(row, word, *shape) for shape in SHAPES))]
    place, key = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place, kind="stable")
    return place[order], key[order]


def _count(docs: DataFrame, seeds: Seeds) -> np.ndarray:
    """Occurrences of every key in the corpus; a task sends one number for each key it has seen."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(*shared.value)
        total = np.zeros(len(seeds.keys), np.int64)
        for batch in batches:
            at, data = utf8(batch.column("text"))
            for low, high in slices(at):
                total += np.bincount(_hits(seeds, *words(at[low : high + 1], data))[1], minlength=len(total))
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], ["key", "n"])

    got = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(seeds.keys), np.int64)
    counts[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return counts


def _median(counts: np.ndarray, size: int) -> np.ndarray:
    """For each n-gram of an item the greatest median of a run of so many n-grams with it; of those that occur."""
    size = min(size, len(counts))
    runs = np.sort(np.lib.stride_tricks.sliding_window_view(counts, size), axis=1)
    none = (runs == 0).sum(1)
    median = runs[np.arange(len(runs)), np.minimum(none + (size - none) // 2, size - 1)]
    out = np.zeros(len(counts), np.int64)
    for k in range(size):
        np.maximum(out[k : k + len(median)], median, out=out[k : k + len(median)])
    return out


def _rare(seeds: Seeds, counts: np.ndarray, ratio: float, lengths: list[int], share: float, least: int) -> Seeds:
    """The keys that occur, except those over `ratio` times as often as the median one, of their shape, of the item and of each
    stretch with them that reaches the threshold alone.  `seeds` has item * len(SHAPES) + shape for its items."""
    order = np.lexsort((seeds.place, seeds.item))
    own = np.repeat(counts, np.diff(seeds.first))[order]
    item, key = seeds.item[order], np.repeat(seeds.keys, np.diff(seeds.first))[order]
    keep = np.zeros(len(own), bool)
    cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True]) if len(item) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        of, shape = divmod(int(item[a]), len(SHAPES))
        stretch = min(STRETCH, math.ceil(threshold(lengths[of], share, least) / MATCH))
        most = np.maximum(_median(own[a:b], b - a), _median(own[a:b], max(1, stretch - SHAPES[shape][1])))
        keep[a:b] = (own[a:b] > 0) & (own[a:b] <= ratio * most)
    return Seeds(key[keep], item[keep] // len(SHAPES), seeds.place[order][keep])


def leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, share: float = SHARE, least: int = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs doc_id, item_id with score (of the best alignment) and similarity (score over the item's full score).

    Words are runs without white space, A-Z lower-cased.  Null or empty texts and items give no pair;
    items with fewer than N words have no seed; they are found in documents that have just the same words.  Each pair comes once for each row of docs
    that has it.  Items that repeat are found each.  Extra columns are not read; with no document or no item the
    result is empty."""
    spark, docs = docs.sparkSession, texts(docs)
    every = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("length", F.regexp_count("text", F.lit(WORD_PATTERN)))
    every = written(every.filter("length > 0"), "leaks-items")
    items, short = every.filter(F.col("length") >= N), every.filter(F.col("length") < N)
    size = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD_PATTERN))), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_words))
    found = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        part = _search(docs, [(r.item_id, r.text) for r in rows], ratio, share, least)
        found = part if found is None else found.unionByName(part)
    if not short.head(1):
        return found
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    same = F.concat_ws(" ", F.regexp_extract_all(low, F.lit(WORD_PATTERN), F.lit(0)))
    own = docs.filter(F.regexp_count("text", F.lit(WORD_PATTERN)).between(1, N - 1)).select("doc_id", same.alias("words"))
    score = F.col("length").cast("long") * MATCH
    return found.unionByName(own.join(short.select("item_id", "length", same.alias("words")).hint("merge"), "words").select("doc_id", "item_id", score.alias("score"), F.lit(1.0).alias("similarity")))


def _search(docs: DataFrame, items: list[tuple[int, str]], ratio: float, share: float, least: int) -> DataFrame:
    ids, word_lists = _table(items)
    places = [(k * len(SHAPES) + j, *_triples(np.zeros(len(w), np.int64), w, *shape)) for k, w in enumerate(word_lists) for j, shape in enumerate(SHAPES)]
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    every = Seeds(join([h for *_, h in places], np.uint64), join([np.full(len(p), k) for k, p, _ in places], np.int64), join([p for _, p, _ in places], np.int64))
    rare = _rare(every, _count(docs, every), ratio, [len(w) for w in word_lists], share, least)
    shared = docs.sparkSession.sparkContext.broadcast((rare.arrays(), ids, word_lists))

    def candidates(item: np.ndarray, diagonal: np.ndarray, word: np.ndarray, low: int, high: int, word_lists) -> Iterator[tuple[int, np.ndarray]]:
        """Item and the stretch of the document's words around hits on near diagonals."""
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        start = 0
        for k in range(1, len(item) + 1):
            length = len(word_lists[item[start]])
            if k == len(item) or item[k] != item[start] or diagonal[k] - diagonal[start] > length // 2 + 2:
                margin = length // 4 + 2
                part = word[max(low, diagonal[start] - margin) : min(high, diagonal[k - 1] + length + margin)]
                # Words that also occur in the item bound the score.
                if MATCH * int(np.isin(part, word_lists[item[start]]).sum()) >= threshold(length, share, least):
                    yield int(item[start]), part
                start = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, ids, word_lists = shared.value
        seeds = Seeds(*arrays)
        for batch in batches:
            doc = batch.column("doc_id")
            at, data = utf8(batch.column("text"))
            best: dict[tuple[int, int], int] = {}

            def settle(waiting):
                waiting.sort(key=lambda x: len(x[2]))
                while waiting:
                    # The longest last; together about two million words at most, or one pair.
                    size = max(1, min(64, 2_000_000 // max(1, len(waiting[-1][2]))))
                    group = waiting[-size:]
                    del waiting[-size:]
                    for (r, i, _), s in zip(group, align([word_lists[i] for _, i, _ in group], [p for _, _, p in group]), strict=True):
                        if s >= threshold(len(word_lists[i]), share, least):
                            best[r, i] = max(best.get((r, i), 0), int(s))

            waiting: list[tuple[int, int, np.ndarray]] = []
            for low, high in slices(at):
                row, word = words(at[low : high + 1], data)
                where, key = _hits(seeds, row, word)
                if not len(where):
                    continue
                many = seeds.first[key + 1] - seeds.first[key]
                place = np.repeat(seeds.first[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                position = np.repeat(where, many)
                item, diagonal, of = seeds.item[place], position - seeds.place[place], row[position]
                cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    r = of[a]
                    begin, end = np.searchsorted(row, [r, r + 1])
                    waiting += [(low + int(r), i, p) for i, p in candidates(item[a:b], diagonal[a:b], word, begin, end, word_lists)]
                if len(waiting) >= 512:
                    settle(waiting)
            settle(waiting)
            if best:
                rows, hits = zip(*best, strict=True)
                scores = np.array(list(best.values()))
                full = np.array([MATCH * len(word_lists[i]) for i in hits])
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(rows)), pa.array(ids[list(hits)]), pa.array(scores), pa.array(scores / full)], ["doc_id", "item_id", "score", "similarity"])

    return docs.mapInArrow(run, "doc_id long, item_id long, score long, similarity double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a test item; columns as they are.  Rows with a null or repeated doc_id are judged
    one by one."""
    return without(docs, lambda rows: leaks(rows, benchmark, **options), "leaks-documents")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
