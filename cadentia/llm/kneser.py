"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model.

Counting: each task sums its own n-grams and deals them, packed in arrays, by their hash into shards of about SHARD_BYTES of
text; a shard's task merges them and writes one file of sorted hashes and counts.  Of the n-grams of each order a shard hands on
the shorter ones they end in (for the continuation counts) and their contexts (total and number of followers by count), dealt by
hash as well, so a frequent word or pair never meets in one task more often than there are tasks.
Scoring: a task memory-maps the files and looks the sorted hashes of its batch up in one sweep over each.

The files lie in spark.checkpoint.dir, which all machines share.  Where that is no file system of the machine, a
task fetches a file to an unnamed one of its own before it maps it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import keyed, pieces, shared_folder, slices, texts, utf8, words

#: Words of an n-gram.
ORDER = 2
#: Bytes of text that fill a shard, that a task counts before it deals, and that it reads or scores at once.
SHARD_BYTES, COUNT_BYTES, PART_BYTES = 16_000_000, 16_000_000, 2_000_000
BEGIN, END = np.uint64(0x6265_6769_6E00_0001), np.uint64(0x656E_6400_0000_0001)
#: Discounts where a corpus is too small to tell them.
DISCOUNTS = (0.5, 1.0, 1.5)

DEALT = "kind string, level int, shard long, n long, data binary, totals array<long>"
TOTALS = ["n", "sum", "raw", "t1", "t2", "t3", "t4"]


def runs(at: np.ndarray, data: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, token and number of tokens before it in its text (BEGIN, the words, END), in parts of about PART_BYTES.

    A longer text comes in parts that begin with the last order - 1 tokens of the one before, with row -1."""
    for low, high in slices(at, PART_BYTES):
        if high > low + 1 or at[high] - at[low] <= PART_BYTES:
            row, word = words(at[low : high + 1], data)
            many = np.bincount(row, minlength=high - low)
            begin = np.concatenate([[0], np.cumsum(many + 2)])
            token = np.full(begin[-1], END)
            token[begin[:-1]] = BEGIN
            token[np.arange(len(word)) + 2 * row + 1] = word
            of = np.repeat(np.arange(high - low), many + 2)
            yield of + low, token, np.arange(len(token)) - begin[of]
            continue
        carried, before, more = np.full(1, BEGIN), 0, False
        for part in [*pieces(data, int(at[low]), int(at[high]), PART_BYTES), None]:
            own = np.full(1, END) if part is None else words(np.array(part), data, part[1] - part[0])[1]
            token, row = np.concatenate([carried, own]), np.full(len(carried) + len(own), low)
            row[: len(carried)] = -1 if more else low
            yield row, token, np.arange(len(token)) + before
            more, carried = True, token[-(order - 1) :]
            before += len(token) - len(carried)


def hashed(grams: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given by their words' columns; of n - 1 columns, of their contexts."""
    h = keyed(grams[0])
    for word in grams[1:]:
        with np.errstate(over="ignore"):
            h = keyed(h * np.uint64(0xD6E8FEB86659FD93) + word, 1)
    return h


def summed(key: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct keys, the columns' values at each, and the sums of the counts."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[order][first], [c[order][first] for c in columns], [np.add.reduceat(c[order], first) if len(first) else c for c in counts]


def dealt(kind: str, level: int, columns: list[np.ndarray], counts: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """Rows of DEALT: equal n-grams (or contexts) summed, by the first bits of their hash; within one by the first word, as equal
    words then lie together and take little room in a shuffle."""
    key, columns, counts = summed(hashed(columns), columns, counts)
    shard = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
    order = np.lexsort((columns[0], shard))
    shard, columns, counts = shard[order], [c[order] for c in columns], [c[order] for c in counts]
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield kind, level, int(shard[a]), int(b - a), b"".join(x[a:b].astype("<u8").tobytes() for x in [*columns, *counts]), None


def batches_of(rows: Iterator[tuple], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    names, kinds = ["kind", "level", "shard", "n", "data", "totals"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size > most:
            yield pack(held)
            held, size = [], 0
    if held:
        yield pack(held)


def _count(order: int, bits: int):
    """n-grams of the highest order, and shorter ones that begin a text, of each COUNT_BYTES of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: dict[int, list[list[np.ndarray]]] = {k: [] for k in range(1, order + 1)}
            size = 0

            def flush():
                for level, parts in held.items():
                    if parts:
                        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                        parts.clear()
                        one = np.ones(len(columns[0]), np.uint64)
                        yield from dealt("gram", level, columns, [one] if level == order else [one, one], bits)

            for batch in batches:
                at, data = utf8(batch.column("text"))
                for row, token, before in runs(at, data, order):
                    scored = (row >= 0) & (before > 0)
                    for level in range(1, order + 1):
                        end = np.flatnonzero(scored & ((before >= level - 1) if level == order else (before == level - 1)))
                        if len(end):
                            held[level].append([token[end - level + 1 + j] for j in range(level)])
                    size += 8 * len(token)
                    if size >= COUNT_BYTES:
                        yield from flush()
                        size = 0
            yield from flush()

        return batches_of(rows())

    return run


class Store:
    """Files of sorted hashes and their columns in a folder that all machines share: 16 bytes (rows, bytes of a number), the hashes,
    then each column."""

    def __init__(self, uri: str):
        self.uri = uri

    def _at(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.uri)

    def write(self, name: str, key: np.ndarray, columns: list[np.ndarray]) -> None:
        """Written under another name and then moved, so a task that is run again, or twice, leaves one whole file."""
        fs, folder = self._at()
        fs.create_dir(folder, recursive=True)
        most = max((int(c.max()) for c in columns if len(c)), default=0)
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        own = f"{folder}/{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(np.array([len(key), width], "<u8").tobytes())
            for x in (key.astype("<u8"), *(c.astype(f"<u{width}") for c in columns)):
                out.write(x.tobytes())
        fs.move(own, f"{folder}/{name}")

    def find(self, name: str, wanted: np.ndarray, columns: int) -> np.ndarray:
        """The columns (as int64) at the sorted hashes `wanted`, 0 where there is none."""
        from pyarrow.fs import FileType, LocalFileSystem

        out = np.zeros((columns, len(wanted)), np.int64)
        fs, folder = self._at()
        path = f"{folder}/{name}"
        if fs.get_file_info(path).type != FileType.File:
            return out
        if isinstance(fs, LocalFileSystem):
            mapped = np.memmap(path, np.uint8, "r")
        else:
            with tempfile.TemporaryFile() as own, fs.open_input_stream(path) as source:
                while part := source.read(8_000_000):
                    own.write(part)
                own.flush()
                mapped = np.memmap(own, np.uint8, "r")
        n, width = (int(x) for x in mapped[:16].view("<u8"))
        key = mapped[16 : 16 + 8 * n].view("<u8")
        place = np.minimum(np.searchsorted(key, wanted), n - 1)
        hit = np.flatnonzero(key[place] == wanted)
        for k in range(columns):
            begin = 16 + 8 * n + k * width * n
            out[k, hit] = mapped[begin : begin + width * n].view(f"<u{width}")[place[hit]]
        return out


def _unpack(columns: int, parts: list[tuple[int, pa.Buffer]]) -> list[np.ndarray]:
    arrays = [np.frombuffer(data, "<u8").reshape(columns, n) for n, data in parts]
    return [np.concatenate([a[k] for a in arrays]) for k in range(columns)]


def _merge(store: Store, order: int, bits: int, now: int):
    """Files of the n-grams of `now` words in each shard and of the contexts that the level above has handed on; what these n-grams
    hand on themselves; totals of the shard.  Shorter n-grams pass."""

    def finish(kind, level, shard, parts):
        if level < now:
            yield from ((kind, level, shard, n, bytes(data), None) for n, data in parts)
            return
        given = level + (4 if kind == "context" else 1 if level == order else 2)
        columns = _unpack(given, parts)
        parts.clear()
        key, grams, counts = summed(hashed(columns[:level]), columns[:level], columns[level:])
        store.write(f"{kind}-{level}-{shard}", key, counts)
        if kind == "context":
            return
        count = counts[0]
        by = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        yield "total", level, shard, len(key), b"", [len(key), int(count.sum()), int(counts[-1].sum()), *by]
        if level > 1:
            one = np.ones(len(key), np.uint64)
            yield from dealt("gram", level - 1, grams[1:], [one, counts[-1]], bits)
            followers = [(count == 1).astype(np.uint64), (count == 2).astype(np.uint64), (count >= 3).astype(np.uint64)]
            yield from dealt("context", level - 1, grams[:-1], [count, *followers], bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, parts = None, []
            for batch in batches:
                data = batch.column("data")
                for k, (kind, level, shard, n, totals) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "level", "shard", "n", "totals")), strict=True)):
                    if kind == "total":
                        yield kind, level, shard, n, b"", totals
                        continue
                    if parts and (kind, level, shard) != held:
                        yield from finish(*held, parts)
                        parts = []
                    held = kind, level, shard
                    parts.append((n, data[k].as_buffer()))
            if parts:
                yield from finish(*held, parts)

        return batches_of(rows())

    return run


@dataclass
class Model:
    """What a task needs besides the files: a few numbers for each order."""

    store: Store
    order: int
    bits: int
    #: level -> TOTALS over all shards
    totals: dict[int, list[int]]

    def discounts(self, level: int) -> np.ndarray:
        """For counts 0, 1, 2 and more."""
        t = self.totals[level][3:]
        if min(t) == 0:
            return np.array([0.0, *DISCOUNTS])
        y = t[0] / (t[0] + 2 * t[1])
        return np.array([0.0, *(min(max(k + 1 - (k + 1) * y * t[k + 1] / t[k], 0.0), k + 1.0) for k in range(3))])

    def look(self, kind: str, level: int, grams: list[np.ndarray], columns: int) -> np.ndarray:
        """Columns at each n-gram: the distinct hashes, sorted, in one sweep over the files they can be in."""
        key, back = np.unique(hashed(grams), return_inverse=True)
        out = np.zeros((columns, len(key)), np.int64)
        bounds = np.searchsorted(key, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.zeros(1, np.int64)
        for shard, (a, b) in enumerate(zip(bounds, [*bounds[1:], len(key)], strict=True)):
            if b > a:
                out[:, a:b] = self.store.find(f"{kind}-{level}-{shard}", key[a:b], columns)
        return out[:, back]

    def score(self, row: np.ndarray, token: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of the scored tokens, log10 probability of each, that of the base, and whether it is known."""
        at = np.flatnonzero((row >= 0) & (before > 0))
        n, total, raw = self.totals[1][:3]
        many, count = self.look("gram", 1, [token[at]], 2)
        d = self.discounts(1)
        left = float(np.dot(d[1:], [self.totals[1][3], self.totals[1][4], n - self.totals[1][3] - self.totals[1][4]]))
        p = ((many - d[np.minimum(many, 3)]) + left / (n + 1)) / total if total else np.full(len(at), 1 / (n + 1))
        for level in range(2, self.order + 1):
            use = np.flatnonzero(before[at] >= level - 1)
            grams = [token[at[use] - level + 1 + j] for j in range(level)]
            sums, *followers = self.look("context", level - 1, grams[:-1], 4)
            known = np.flatnonzero(sums)
            use, sums = use[known], sums[known]
            d = self.discounts(level)
            back = sum(d[k + 1] * followers[k][known] for k in range(3))
            (own,) = self.look("gram", level, [g[known] for g in grams], 1 if level == self.order else 2)[:1]
            p[use] = (own - d[np.minimum(own, 3)] + back * p[use]) / sums
        base = np.log10((count + 0.5) / (raw + 0.5 * (n + 1)))
        return at, np.log10(p), base, count > 0


def train(docs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> Model:
    """The model of all texts of docs (null: empty).  One without any text knows no token, and all are equally likely."""
    if order < 2:
        raise ValueError("an n-gram needs two words or more")
    docs = texts(docs)
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(0, int(size // shard_bytes)).bit_length()
    store = Store(shared_folder(docs.sparkSession, "ngrams"))
    left = docs.select("text").mapInArrow(_count(order, bits), DEALT)
    key = ["kind", "level", "shard"]
    # One job: what a level hands on goes through a shuffle to the next; the totals, a row per shard and level, pass to the end.
    for level in range(order, 0, -1):
        left = left.repartition(4 << bits, *key).sortWithinPartitions(*key).mapInArrow(_merge(store, order, bits, level), DEALT)
    found = {level: [0] * len(TOTALS) for level in range(1, order + 1)}
    sums = left.filter("kind = 'total'").groupBy("level").agg(*(F.sum(F.col("totals")[k]).alias(c) for k, c in enumerate(TOTALS)))
    for r in sums.collect():
        found[r.level] = [r[c] for c in TOTALS]
    return Model(store, order, bits, found)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens (its words and one end), n_known (tokens of the training texts), base_score (add-half
    unigrams), score (log10 probability by the model), perplexity (of a token).

    A null or empty text is one end.  Rows with a null or repeated doc_id have a row each.  Extra columns are not read; an
    empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column("text"))
            out = np.zeros((4, batch.num_rows))
            for row, token, before in runs(at, data, model.order):
                place, own, base, known = model.score(row, token, before)
                of = row[place]
                for k, weight in enumerate((np.ones(len(of)), known, base, own)):
                    out[k] += np.bincount(of, weight, batch.num_rows)
            many, known = (pa.array(x.astype(np.int64)) for x in out[:2])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), many, known, pa.array(out[2]), pa.array(out[3]), pa.array(10.0 ** np.minimum(-out[3] / out[0], 300))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that the model does not see; one without an id is seen."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def op13_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out()))
    scored = score(docs, model).withColumn("train_tokens", F.lit(model.totals[1][2]).cast("long")).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
