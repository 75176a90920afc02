"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts of (language, bucket) are summed by Spark; the matrix of log probabilities is broadcast in blocks of
MOST_LANGUAGES languages: a block has MOST_LANGUAGES x buckets x 4 bytes, whatever the corpus.  Scoring gathers the matrix at the
hashed n-grams of a batch and sums by document, all in numpy; further blocks only go on from the best and the sum so far.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadentia.llm.common import mix, slices, utf8, written

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Languages scored at once; this bounds a broadcast matrix at 16 MB.
MOST_LANGUAGES = 64
#: Bytes of text hashed at once.
MOST_BYTES = 500_000


def ngrams(at: np.ndarray, data: np.ndarray, buckets: int = BUCKETS, orders=ORDERS, before: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: B008
    """Row and bucket of each character n-gram, for rows of lower-cased text between the offsets `at`; and the last characters.

    Characters are read from the UTF-8 bytes; digits and ASCII punctuation count as one space.  A single row may go on
    from the last characters `before` of its part before."""
    part = data[at[0] : at[-1]]
    heads = np.flatnonzero((part & 0xC0) != 0x80)
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), before
    padded = np.concatenate([part, np.zeros(4, np.uint8)]).astype(np.uint32)
    lead = padded[heads]
    code = lead.copy()
    for floor, shift in ((0xC0, 1), (0xE0, 2), (0xF0, 3)):
        more = lead >= floor
        code[more] = (code[more] << np.uint32(8)) | padded[heads[more] + shift]
    letter = (lead >= 0xC0) | ((lead >= 97) & (lead <= 122))
    code[~letter] = 32
    row = np.searchsorted(at - at[0], heads, "right") - 1
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    if len(before):
        keep[0] = letter[0] or before[-1] != 32
    code = np.concatenate([before, code[keep].astype(np.uint64)])
    row = np.concatenate([np.zeros(len(before), np.int64), row[keep]])
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for n in orders:
            if len(code) < n:
                continue
            old = max(len(before) - n + 1, 0)  # those that lie in `before` are counted already
            m = len(code) - n + 1
            h = np.full(m - old, n, np.uint64)
            for k in range(n):
                h = (h ^ code[old + k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            same = row[old:m] == row[old + n - 1 :]
            rows.append(row[old:m][same])
            out.append((mix(h[same]) % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(out), code[max(0, len(code) - max(1, max(orders) - 1)) :]


def pieces(at: np.ndarray, data: np.ndarray, buckets: int, orders, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of the n-grams of the rows between `at`; a single row of more than `most` bytes comes part by part."""
    if len(at) > 2 or at[-1] - at[0] <= most:
        yield ngrams(at, data, buckets, orders)[:2]
        return
    low, end, before = int(at[0]), int(at[-1]), np.zeros(0, np.uint64)
    while low < end:
        high = min(low + most, end)
        while high < end and data[high] & 0xC0 == 0x80:
            high += 1
        row, bucket, before = ngrams(np.array([low, high]), data, buckets, orders, before)
        yield row, bucket
        low = high


def models(labelled: DataFrame, buckets: int = BUCKETS, orders=ORDERS, alpha: float = 0.5) -> Iterator[tuple[list[str], np.ndarray]]:
    """Blocks of languages, in order of name, and their log probabilities (languages x buckets), from all rows with text and lang.

    Each task sums its own counts, so a task sends at most languages x buckets numbers; the driver holds a block at a time."""
    most = MOST_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            at, data = utf8(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for low, high in slices(at, most):
                names = langs[low:high]
                for row, bucket in pieces(at[low : high + 1], data, buckets, orders, most):
                    for name in set(names):
                        own = bucket[(names == name)[row]]
                        sums[name] = sums.get(name, 0) + np.bincount(own, minlength=buckets)
                if len(sums) > MOST_LANGUAGES:
                    yield from packed(sums)
                    sums = {}
        yield from packed(sums)

    def packed(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select(F.lower("text").alias("text"), "lang")
    parts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    learned = written(parts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")), "languages")
    rest = learned
    while True:
        got = rest.orderBy("lang").limit(MOST_LANGUAGES).toArrow()
        names = got.column("lang").to_pylist()
        if not names:
            return
        table = np.zeros((len(names), buckets))
        for k, counts in enumerate(got.column("counts")):
            table[k, counts.values.field("bucket").to_numpy()] = counts.values.field("n").to_numpy()
        yield names, np.log((table + alpha) / (table.sum(1, keepdims=True) + alpha * buckets)).astype(np.float32)
        if len(names) < MOST_LANGUAGES:
            return
        rest = learned.filter(F.col("lang") > names[-1])


def predict(docs: DataFrame, blocks: Iterable[tuple[list[str], np.ndarray]], buckets: int = BUCKETS, orders=ORDERS, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns `keep`) plus lang_pred and score, the posterior of lang_pred under equal priors.

    A null text, or one without a letter, is `und` with score 0; so is everything if no language was
    learned.  Ties go to the first name.  Repeated rows are scored each; clashing columns are
    replaced; an empty table gives an empty result.  Between blocks of languages the rows are written."""
    docs = docs.drop("lang_pred", "score")
    columns = docs.columns if keep is None else keep
    context, most = docs.sparkSession.sparkContext, MOST_BYTES
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*columns, F.lower(text).alias("__lowered"), text.rlike(r"\p{L}").alias("__wordy"), F.lit(None).cast("string").alias("__best"), F.lit(float("-inf")).alias("__top"), F.lit(float("-inf")).alias("__sum"))

    def scored(rows: DataFrame, names: list[str], table: np.ndarray, last: bool) -> DataFrame:
        shared = context.broadcast((names, np.ascontiguousarray(table.T)))
        carried = [c for c in rows.columns if c not in ("__best", "__top", "__sum") and not (last and c == "__lowered")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            for batch in batches:
                at, data = utf8(batch.column("__lowered"))
                best, top, total = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1), np.zeros(len(at) - 1)
                for low, high in slices(at, most):
                    odds = np.zeros((high - low, len(names)))
                    for row, bucket in pieces(at[low : high + 1], data, buckets, orders, most):
                        for k in range(len(names)):
                            odds[:, k] += np.bincount(row, matrix[bucket, k].astype(np.float64), high - low)
                    best[low:high], top[low:high] = odds.argmax(1), odds.max(1)
                    total[low:high] = odds.max(1) + np.log(np.exp(odds - odds.max(1, keepdims=True)).sum(1))
                before = batch.column("__top").to_numpy()
                label = np.where(top > before, np.array(names, dtype=object)[best], np.array(batch.column("__best").to_pylist(), dtype=object))
                state = [pa.array(label, pa.string()), pa.array(np.maximum(top, before)), pa.array(np.logaddexp(total, batch.column("__sum").to_numpy()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *state], [*carried, "__best", "__top", "__sum"])

        return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in carried), *(rows.schema[c] for c in ("__best", "__top", "__sum"))]))

    blocks = iter(blocks)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        rows = scored(rows, *block, following is None)
        block, rows = following, rows if following is None else written(rows, "languages-scored")
    known = F.col("__wordy") & F.col("__best").isNotNull()
    score = F.least(F.exp(F.col("__top") - F.col("__sum")), F.lit(1.0))
    return rows.select(*columns, F.when(known, F.col("__best")).otherwise("und").alias("lang_pred"), F.when(known, score).otherwise(0.0).alias("score"))


def held_out(doc_id: str = "doc_id"):
    """Whether a document teaches nothing; one without an id may teach."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, training: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns `keep`) plus lang_pred and score, learned from the rows of `training` (or docs) with a language that
    are not held out."""
    blocks = models((docs if training is None else training).filter(~held_out()))
    return predict(docs, blocks, keep=keep)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
