"""Removal of repeated passages by suffix arrays, sharded by content.

1. Anchors (anchors.py) prove most windows unique without sorting anything.  Rows are dealt by the
   anchor's q-gram, after each task has merged its own equal regions, so a copied text costs a task one row.
2. Where regions with one q-gram differ, their bytes are cut out and dealt by q-gram again: equal windows
   have equal q-grams and so meet in one shard.  A q-gram with too many of them is dealt further by the bytes
   beside it that its windows hold, until each group fits a task or its windows are equal.  Each shard is
   ordered by external induced sorting (induced.py); a run of suffixes with common prefixes of WIDTH or more
   holds one string, whose least start stays.
3. The repeated windows are merged by document and cut from the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.anchors import GRAM, regions
from cadentia.llm.common import slices, texts, utf8, written
from cadentia.llm.induced import sort_suffixes

WIDTH = 100
#: Bytes that a shard is sorted with at once; a larger group comes whole.
SHARD_BYTES = 4_000_000
#: Bytes of a text that are read for anchors at once.
PART_BYTES = 4_000_000
#: A key with more regions than this is dealt further.
HOT_ROWS = 2_000
NO_ID = -(1 << 63)

FOUND = "gram long, content long, doc_id long, low int, windows int, anchor int"
REPEAT = "doc_id long, low int, windows int, gram long, anchor int"
#: The key of a piece is its `size` bytes from `at` on, which all of its windows hold; gram is the key's hash.
PIECES = "gram long, doc_id long, low int, at int, size int, piece binary"
#: Split pieces; a repeat is equal to an earlier one with its key and has no bytes.
SPLIT = PIECES + ", windows int, repeat boolean"


def _first_of_equal(keys: list[np.ndarray], doc: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, document and start; and whether each is another place than the first with its keys."""
    order = np.lexsort((low, doc, *keys[::-1]))
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = same & ((doc[order] != doc[order][head]) | (low[order] != low[order][head]))
    return order, later


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    kinds = {"low": np.int32, "windows": np.int32, "anchor": np.int32}
    return pa.RecordBatch.from_arrays([pa.array(c.astype(kinds.get(n, np.int64), copy=False)) for c, n in zip(columns, names, strict=True)], names)


def _find(width: int):
    names = ["gram", "content", "doc_id", "low", "windows", "anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            parts = []
            for lo, hi in slices(at):
                for begin in range(int(at[lo]), int(at[hi]), PART_BYTES) if hi == lo + 1 else [int(at[lo])]:
                    # A long text in parts that overlap by a window less a byte, so each window is in one of them.
                    own = at[lo : hi + 1] if hi > lo + 1 else np.array([begin, min(begin + PART_BYTES + width - 1, at[hi])])
                    row, anchor, low, high, gram, content = regions(own, data, width)
                    moved = begin - int(at[lo])
                    parts.append((gram.view(np.int64), content.view(np.int64), ids[lo + row], low + moved, high - low + 1, anchor + moved))
            if not parts:
                continue
            gram, content, doc, low, n, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, later = _first_of_equal([gram, content], doc, low)
            gram = np.where(later, 0, gram[order])
            # gram 0 marks a region that is known to repeat; dealt by document.
            yield _batch([gram, np.where(later, doc[order], content[order]), doc[order], low[order], n[order], anchor[order]], names)

    return run


def _in_groups(batches: Iterator[pa.RecordBatch], key: str, most: int, size) -> Iterator[pa.Table]:
    """Tables of whole groups of a sorted key, of about `most` in all."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += size(batch)
        if total >= most:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                total = sum(size(b) for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats that are certain (gram 0), and the regions that must be sorted (their gram).

    Rows come sorted by gram, content, doc_id and low; of a group only its last content's first row is kept in
    memory."""
    names = ["doc_id", "low", "windows", "gram", "anchor"]
    carried, told = None, False
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("gram", "content", "doc_id", "low", "windows", "anchor")]
        sure = columns[0] == 0
        if sure.any():
            gram, _, doc, low, n, anchor = (x[sure] for x in columns)
            yield _batch([doc, low, n, gram, anchor], names)
            columns = [x[~sure] for x in columns]
        if not len(columns[0]):
            continue
        if carried is not None:
            columns = [np.append(c, x) for c, x in zip(carried, columns, strict=True)]
        gram, content, doc, low, n, anchor = columns
        kinds = np.r_[True, (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])]
        head = np.maximum.accumulate(np.where(kinds, np.arange(len(gram)), 0))
        # A place that repeats itself through a repeated doc_id is one region.
        later = ~kinds & ((doc != doc[head]) | (low != low[head]))
        if later.any():
            yield _batch([doc[later], low[later], n[later], np.zeros(later.sum(), np.int64), anchor[later]], names)
        heads = np.flatnonzero(kinds)
        same = gram[heads][1:] == gram[heads][:-1]
        several = np.append(False, same) | np.append(same, False)
        carried = [x[heads[-1]] for x in columns]
        fresh = several.copy()
        fresh[0] &= not told
        told = bool(several[-1]) or (len(heads) == 1 and told)
        use = heads[fresh]
        if len(use):
            yield _batch([doc[use], low[use], n[use], gram[use], anchor[use]], names)


def _cut(width: int):
    size = min(GRAM, max(1, width // 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column("text"))
            wanted = batch.column("wanted")
            offsets, rows = wanted.offsets.to_numpy(), wanted.values
            low, n, gram, anchor = (rows.field(c).to_numpy() for c in ("low", "windows", "gram", "anchor"))
            hot = rows.field("hot").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_numpy()
            for i in range(batch.num_rows):
                own = data[at[i] : at[i + 1]]
                use = [k for k in range(offsets[i], offsets[i + 1]) if low[k] + n[k] + width - 1 <= len(own)]
                if use:
                    pieces = [own[low[k] : low[k] + n[k] + width - 1].tobytes() for k in use]
                    yield _pieces(gram[use], np.full(len(use), ids[i]), low[use], anchor[use] - low[use], np.full(len(use), size), pieces).append_column("hot", pa.array(hot[use]))

    return run


def _pieces(gram, doc, low, at, size, pieces: list[bytes]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((gram, doc, low, at, size, pieces), kinds, strict=True)], ["gram", "doc_id", "low", "at", "size", "piece"])


def split_piece(piece: bytes, at: int, size: int, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Hash of a longer key, first window, the key's place and the bytes of either part of a piece.

    The windows with the more bytes behind the key get those as well, the others the bytes before it.  Equal
    windows have the key at the same place, so they go the same way, to the same key."""
    more = (width - size + 1) // 2
    n = len(piece) - width + 1
    turn = min(max(at + size + more - width, 0), n)
    if turn < n:
        yield _named(b">" + piece[at : at + size + more]), turn, at - turn, piece[turn:]
    if turn:
        yield _named(b"<" + piece[at - more : at + size]), 0, at - more, piece[: turn + width - 1]


def _named(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    """Split pieces (gram, doc_id, low, at, size, piece, windows, repeat) as a batch."""
    columns = [list(c) for c in zip(*rows, strict=True)]
    pieces = _pieces(*columns[:6])
    return pa.RecordBatch.from_arrays([*pieces.columns, pa.array(columns[6], pa.int32()), pa.array(columns[7], pa.bool_())], [*pieces.schema.names, "windows", "repeat"])


def _split(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "low", "at", "size", "piece")), strict=True)
            parts = [(gram, place, own, doc, low + first, size + (width - size + 1) // 2) for doc, low, at, size, piece in rows for gram, first, place, own in split_piece(piece, at, size, width)]
            if parts:
                # A task merges its own equal parts, so a common one costs it one row with bytes.
                yield _parts(list(_merged(sorted(parts), width, [None, None])))

    return run


def _merged(parts, width: int, first: list) -> Iterator[tuple]:
    """Sorted (gram, at, piece, doc_id, low, size) as split pieces, all but the first place of equal ones as repeats.

    `first` holds the last piece and its first place, from one call to the next."""
    for gram, at, piece, doc, low, size in parts:
        if first[0] != (gram, at, piece):
            first[:] = (gram, at, piece), (doc, low)
            yield gram, doc, low, at, size, piece, len(piece) - width + 1, False
        elif first[1] != (doc, low):
            yield gram, doc, low, at, size, None, len(piece) - width + 1, True


def _merge(width: int):
    """As _split, over the parts of all tasks."""
    names = ["gram", "at", "piece", "doc_id", "low", "size", "windows", "repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [None, None]
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            out = [(gram, doc, low, at, size, None, n, True) for gram, at, _, doc, low, size, n, repeat in rows if repeat]
            out += _merged((r[:6] for r in rows if not r[7]), width, first)
            if out:
                yield _parts(out)

    return run


def _hot(rows: DataFrame, most: int) -> DataFrame | None:
    """Keys of more rows than `most`; None if there are none."""
    hot = written(rows.groupBy("gram").count().filter(F.col("count") > most).select("gram"), "repeats-hot")
    return hot if hot.head(1) else None


def marked(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows plus hot: whether their key is one of the hot ones.  Tables are merged, as the hot keys grow with the input; there, adaptive
    execution splits what one key has."""
    if not hot:
        return rows.withColumn("hot", F.lit(False))
    return rows.join(hot.withColumn("hot", F.lit(True)).hint("merge"), "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def deal(pieces: DataFrame, hot: DataFrame | None, width: int, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The pieces (PIECES and hot), split until no key has more than hot_rows of them, and the repeats that this shows.

    A split adds at least half of what a window has beside its key, and equal parts are merged, so at the last one
    each piece is one window and no two are equal."""
    if not hot:
        return pieces.drop("hot"), None
    pieces, levels, repeats = written(pieces, "repeats-pieces"), [], []
    while hot:
        levels.append(pieces.filter("NOT hot").drop("hot"))
        parts = pieces.filter("hot").drop("hot").mapInArrow(_split(width), SPLIT)
        dealt = F.when(F.col("repeat"), F.xxhash64("doc_id", "low")).otherwise(F.xxhash64("gram", "at", "piece"))
        dealt = parts.withColumn("deal", dealt).repartition("deal").drop("deal").sortWithinPartitions("gram", "at", "piece", "doc_id", "low")
        parts = written(dealt.mapInArrow(_merge(width), SPLIT), "repeats-split")
        repeats.append(parts.filter("repeat").select("doc_id", "low", "windows", F.lit(0).cast("long").alias("gram"), F.lit(0).alias("anchor")))
        pieces = parts.filter((~F.col("repeat")) & (F.col("size") < width)).drop("windows", "repeat")
        hot = _hot(pieces, hot_rows)
        pieces = written(marked(pieces, hot), "repeats-pieces") if hot else pieces
    return reduce(DataFrame.unionByName, [*levels, pieces]), reduce(DataFrame.unionByName, repeats)


def repeats_in_shard(data: np.ndarray, at: np.ndarray, doc: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece (between the offsets `at` of the bytes) and place in it of each window that also starts earlier, by the
    shard's suffix array."""
    # Like pieces come one after the other; mixed, neighbours in text and order differ, so the queue's batches are large.
    mixed = np.random.default_rng(0).permutation(len(doc))
    sizes = np.diff(at)[mixed]
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(begin[-1], np.int16)  # 0 between pieces, less than every byte
    begin, inside = begin[:-1], np.ones(len(text), bool)
    inside[begin + sizes] = False
    text[inside] = data[np.repeat(at[:-1][mixed] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())].astype(np.int16) + 1
    del inside
    order, common = sort_suffixes(text, 257, width)
    head = common < width
    head[:1] = True
    group = np.cumsum(head) - 1
    piece = np.searchsorted(begin, order, "right") - 1
    place = order - begin[piece]
    fits = place + width <= sizes[piece]
    many = np.bincount(group[fits], minlength=int(group[-1]) + 1 if len(group) else 0) > 1
    use = fits & many[group]
    piece, place, group = mixed[piece[use]], place[use], group[use]
    start = low[piece] + place
    ranked = np.lexsort((start, doc[piece], group))
    piece, place, group, start = piece[ranked], place[ranked], group[ranked], start[ranked]
    heads = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(group)), 0)) if len(group) else np.zeros(0, np.int64)
    later = (doc[piece] != doc[piece][heads]) | (start != start[heads])
    return piece[later], place[later]


def _sort(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_groups(batches, "gram", SHARD_BYTES, lambda b: b.num_rows * width):
            doc, low = table.column("doc_id").to_numpy(), table.column("low").to_numpy()
            at, data = utf8(table.column("piece"))
            piece, place = repeats_in_shard(data, at, doc, low, width)
            if not len(piece):
                continue
            order = np.lexsort((place, piece))
            piece, place = piece[order], place[order]
            new = np.r_[True, (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(piece)))
            begin = low[piece[first]] + place[first]
            yield _batch([doc[piece[first]], begin, count, np.zeros(len(first), np.int64), begin], ["doc_id", "low", "windows", "gram", "anchor"])

    return run


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column("text"))
            wanted = batch.column("wanted")
            offsets, rows = wanted.offsets.to_numpy(), wanted.values
            low, n = (rows.field(c).to_numpy().astype(np.int64) for c in ("low", "windows"))
            removed, spans, digests, kept = [], [], [], []
            for i in range(batch.num_rows):
                own = data[at[i] : at[i + 1]]
                a, b = low[offsets[i] : offsets[i + 1]], low[offsets[i] : offsets[i + 1]] + n[offsets[i] : offsets[i + 1]] + width - 1
                edge = np.zeros(len(own) + 1, np.int32)
                np.add.at(edge, np.minimum(a, len(own)), 1)
                np.add.at(edge, np.minimum(b, len(own)), -1)
                gone = np.cumsum(edge[:-1]) > 0 if len(a) else np.zeros(len(own), bool)
                rest = own[~gone].tobytes() if len(a) else own.tobytes()
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes for each row.

    Removes each byte covered by a string of `width` bytes that also starts earlier: in a smaller doc_id, or
    earlier in the same document.  Null texts are empty; texts shorter than width lose nothing.  A doc_id
    names a document: rows that repeat it with its text are the same places and get the same result; if
    their texts differ, each loses what either would, as far as it reaches.  A null doc_id sorts first.  Other
    columns are not read; an empty table gives an empty result."""
    named = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    found = named.mapInArrow(_find(width), FOUND)
    dealt = F.when(F.col("gram") == 0, F.xxhash64("doc_id", "low")).otherwise(F.col("gram"))
    dealt = found.withColumn("deal", dealt).repartition("deal").drop("deal").sortWithinPartitions("gram", "content", "doc_id", "low")
    grouped = written(dealt.mapInArrow(_group, REPEAT), "repeats-grouped")
    hot = _hot(grouped.filter("gram != 0"), hot_rows)
    lists = marked(grouped.filter("gram != 0"), hot).groupBy("doc_id").agg(F.collect_list(F.struct("low", "windows", "gram", "anchor", "hot")).alias("wanted"))
    pieces = named.join(lists, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_cut(width), PIECES + ", hot boolean")
    several, repeats = deal(pieces, hot, width, hot_rows)
    every = grouped.filter("gram = 0").unionByName(several.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort(width), REPEAT))
    if repeats is not None:
        every = every.unionByName(repeats)
    spans = every.groupBy("doc_id").agg(F.collect_set(F.struct("low", "windows")).alias("wanted"))
    none = F.array().cast("array<struct<low:int,windows:int>>")
    whole = named.join(spans, "doc_id", "left").select("doc_id", "text", F.coalesce("wanted", none).alias("wanted"))
    out = whole.mapInArrow(_remove(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_bytes")
