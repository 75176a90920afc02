"""Small helpers shared by the operators: scratch tables, Arrow access and vectorised word hashing."""

from __future__ import annotations

import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space: space and the ASCII controls tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is missing and all runs on one machine is a temporary folder used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cadentia-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: lineage ends there, and a lost executor
    costs one task, not the steps before."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, find: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows of docs but those that find(doc_id, text) names by doc_id.

    Each row is judged by itself: rows without a doc_id, or with one that other rows have too, are written once with a number of
    their own, below all ids, which stands for the doc_id.  Columns are as in docs."""
    ids = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"), f"{name}-ids")
    if not ids.head(1):
        gone = written(find(docs.select("doc_id", "text")).select("doc_id").distinct(), name)
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    named, own = ids.filter("doc_id IS NOT NULL").hint("merge"), next(c for c in map("row{}".format, range(len(docs.columns) + 1)) if c not in docs.columns)
    odd = docs.filter("doc_id IS NULL").unionByName(docs.join(named, "doc_id", "left_semi").select(docs.columns))
    odd = written(odd.withColumn(own, F.lit(-(1 << 63)) + F.monotonically_increasing_id()), f"{name}-rows")
    plain = docs.filter("doc_id IS NOT NULL").join(named, "doc_id", "left_anti")
    both = plain.select("doc_id", "text").union(odd.select(own, "text"))
    gone = written(find(both).select("doc_id").distinct(), name)
    rest = odd.join(gone.withColumnRenamed("doc_id", own).hint("merge"), own, "left_anti")
    return plain.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns).unionByName(rest.select(docs.columns))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of a table of documents, whatever other columns it has."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of an Arrow string column without nulls, without copying the text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(at: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row comes alone."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
#: Drawn anew by each driver, and sent to the tasks with the functions that use it: nobody can prepare texts whose hashes meet.
_KEYS = tuple(np.uint64(secrets.randbits(64) | 1) for _ in range(4))
#: Bytes from which a word is hashed by BLAKE2b.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keyed(x: np.ndarray, key: int = 0) -> np.ndarray:
    """mix() between secret keys; a bijection, too."""
    with np.errstate(over="ignore"):
        return mix((mix(x ^ _KEYS[key]) + _KEYS[key + 1]) * _KEYS[key])


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keyed 64-bit hash of the bytes from each start to its end.

    Eight bytes at a time go through a keyed bijection each, so equal hashes of unequal bytes are a matter of chance (2^-64 a pair);
    long stretches go through BLAKE2b with the key."""
    lengths = ends - starts
    lanes = np.ndarray((len(data) + 1,), np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    h = keyed(lengths.astype(np.uint64), 2)
    at = np.flatnonzero(lengths <= _LONG)
    for step in range(0, _LONG, 8):
        at = at[lengths[at] > step]
        if not len(at):
            break
        left = np.minimum(lengths[at] - step, 8).astype(np.uint64)
        lane = lanes[starts[at] + step] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        h[at] = keyed(h[at] ^ lane)
    key = b"".join(int(k).to_bytes(8, "big") for k in _KEYS)
    for i in np.flatnonzero(lengths > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "big")
    return h


def words(at: np.ndarray, data: np.ndarray, most: int = 8_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word and its keyed 64-bit hash, A-Z lower-cased, for the rows between the offsets `at`.

    A text of more than `most` bytes is hashed part by part, cut at white space, so memory besides the result is bounded by
    that and the longest word."""
    base, end = int(at[0]), int(at[-1])
    if end == base:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if end - base > most and len(at) == 2:
        parts = [words(np.array([low, high]), data, high - low) for low, high in pieces(data, base, end, most)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    part = data[base:end]
    solid = ~_SPACE[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[(at - base)] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(at - base, starts, "right") - 1, stretches(_LOWER[part], starts, ends)


def pieces(data: np.ndarray, base: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of about `most` bytes that end where a word does."""
    low = base
    while low < end:
        high = min(low + most, end)
        while high < end and not _SPACE[data[high]]:
            ahead = np.flatnonzero(_SPACE[data[high : high + most]])
            high = min(high + (int(ahead[0]) if len(ahead) else most), end)
        yield low, high
        low = high


def shingles(row: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of n words within a row; a row with fewer words gives all of them as one."""
    if not len(row):
        return row, word
    counts = np.bincount(row)
    out_row, out_hash = [], []
    with np.errstate(over="ignore"):
        for k in range(1, n + 1):
            if len(row) < k:
                break
            keep = row[: len(row) - k + 1] == row[k - 1 :]
            if k < n:
                keep &= counts[row[: len(row) - k + 1]] == k
            i = np.flatnonzero(keep)
            h = np.full(len(i), k, np.uint64)
            for j in range(k):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + word[i + j])
            out_row.append(row[i])
            out_hash.append(h)
    return np.concatenate(out_row), np.concatenate(out_hash)


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of a text, with its table made from the polynomial."""
    table = "[list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR b IN range(256)]"
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda k: ('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c // 256, {table}[xor(c, b) % 256 + 1])), 4294967295)"
