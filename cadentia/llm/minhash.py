"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash (Ertl 2017): element d offers, in step j, the value j + r_j(d) to the slot that a random
permutation of its own names j-th; a slot keeps its least offer.  All offers of step j exceed those of
step j-1, so a document stops as soon as no slot is above the current step.  Here all elements of a
batch of documents take a step together; documents that have stopped leave the batch.

Documents with equal shingle sets (by the SHA-256 of the sorted set) form a class and one of them stands for it, so large groups
of copies never meet in a bucket.  Of each bucket first all members are verified against its least one, on full sets; so
the groups of near copies are found in linear time.  Buckets whose members are then still in several components are
verified pair by pair, large ones in blocks; no pair becomes a row, and no pair of a bucket is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import mix, shingles, slices, texts, utf8, words, written

SLOTS = 125
#: 25 bands of 5 slots miss a pair of similarity 0.85 (0.8) with probability 4e-7 (5e-5), and let one of 0.3 meet with 0.06.
BAND_ROWS = 5
#: A block of a bucket holds about so many documents, and so many shingles, at most.
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 1_000, 1_000_000
#: Elements of up to so many sets of a block are counted pair by pair.
FEW = 24


def superminhash(row: np.ndarray, element: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots, step in the upper and the offer in the lower 32 bits)."""
    signature = np.full((rows, slots), np.iinfo(np.uint64).max, np.uint64)
    flat, places, half = signature.reshape(-1), None, np.uint64(32)
    for step in range(slots):
        if not len(row):
            break
        with np.errstate(over="ignore"):
            draw = mix(element + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) & (2**64 - 1)))
        pick = step + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step)) >> half).astype(np.int64)
        if places is None:
            slot = pick
        else:
            own = np.arange(len(row))
            slot = places[own, pick].astype(np.int64)
            places[own, pick] = places[:, step]
        np.minimum.at(flat, row * slots + slot, (draw >> half) | np.uint64(step << 32))
        going = (signature.max(1) >> half) > np.uint64(step)
        keep = going[row]
        row, element = row[keep], element[keep]
        if places is None:
            first = slot[keep]
            places = np.tile(np.arange(slots, dtype=np.uint16), (len(row), 1))
            places[np.arange(len(row)), first] = 0
        else:
            places = places[keep]
    return signature


def distinct(row: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, element) once, in order of both; row must be sorted or nearly so."""
    order = np.lexsort((element, row))
    row, element = row[order], element[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (element[1:] != element[:-1])
    return row[new], element[new]


def shingle_sets(at: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingles(*words(at, data), n))


def signatures(docs: DataFrame, n: int, slots: int = SLOTS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (SHA-256 of the sorted set) and bands (one hash per band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column("text"))
            for low, high in slices(at, 400_000):
                k = high - low
                row, element = shingle_sets(at[low : high + 1], data, n)
                counts = np.bincount(row, minlength=k)
                ends = np.concatenate([[0], np.cumsum(counts)]) * 8
                raw = memoryview(element.astype("<u8").tobytes())
                keys = [hashlib.sha256(raw[x:y]).digest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                with np.errstate(over="ignore"):
                    signature = superminhash(row, element, k, slots)
                    band = np.full((k, slots // band_rows), 7, np.uint64)
                    for j in range(band_rows):
                        band = mix(band * np.uint64(0xD6E8FEB86659FD93) + signature[:, j::band_rows][:, : slots // band_rows])
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band.reshape(-1).view(np.int64)), slots // band_rows).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, k), pa.array(counts.astype(np.int64)), pa.array(keys, pa.binary()), bands],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def forest(sizes: np.ndarray, row: np.ndarray, element: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among `len(sizes)` sets, from exact intersections of all of them.

    Elements of few sets add to their pairs; elements of many go through a matrix product."""
    n = len(sizes)
    order = np.lexsort((row, element))
    row, element = row[order], element[order]
    heads = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
    many = np.diff(np.append(heads, len(element)))
    both = np.zeros(n * n, np.int64)
    for d in np.unique(many[(many > 1) & (many <= FEW)]).tolist():
        own = row[heads[many == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        both += np.bincount((own[:, i] * n + own[:, j]).reshape(-1), minlength=n * n)
    both = both.reshape(n, n)
    wide = np.flatnonzero(many > FEW)
    for k in range(0, len(wide), 2_048):
        part = wide[k : k + 2_048]
        held = np.zeros((n, len(part)), np.float32)
        for c, h in enumerate(part):
            held[row[heads[h] : heads[h] + many[h]], c] = 1
        both += np.rint(held @ held.T).astype(np.int64)
    both = np.triu(both, 1)
    both += both.T
    linked = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
    free, out = np.ones(n, bool), []
    for first in range(n):
        if not free[first]:
            continue
        free[first], waiting = False, [first]
        while waiting:
            near = np.flatnonzero(linked[waiting.pop()] & free)
            free[near] = False
            waiting += near.tolist()
            out += [(first, x) for x in near.tolist()]
    return out


def star(sizes: np.ndarray, row: np.ndarray, element: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The links of the first set with the others."""
    own = np.isin(element, element[: sizes[0]], kind="sort")
    both = np.bincount(row[own], minlength=len(sizes))
    linked = (both > 0) & (100 * both >= percent * (sizes + sizes[0] - both))
    return [(0, x) for x in np.flatnonzero(linked[1:]) + 1]


def _linked(percent: int, rule: Callable[..., list[tuple[int, int]]]):
    """Links in each group of rows with one task number, by `forest` or `star`; groups come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: pa.Table) -> pa.RecordBatch:
            ids = rows.column("doc_id").to_numpy()
            sets = rows.column("elements").combine_chunks()
            sizes = np.diff(sets.offsets.to_numpy()).astype(np.int64)
            found = rule(sizes, np.repeat(np.arange(len(ids)), sizes), sets.flatten().to_numpy().view(np.uint64), percent)
            a, b = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            tasks = batch.column("task").to_numpy()
            cuts = np.flatnonzero(np.r_[True, tasks[1:] != tasks[:-1], True]) if len(tasks) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tasks[low] != last:
                    yield settle(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low, high - low))
                last = tasks[low]
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, its other columns, and its sorted shingle hashes instead of the text."""
    more = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column("text"))
            for low, high in slices(at):
                row, element = shingle_sets(at[low : high + 1], data, n)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=high - low))]).astype(np.int32)
                own = [batch.column(c).slice(low, high - low) for c in more]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(ends), pa.array(element.view(np.int64)))], [*more, "elements"])

    schema = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in more) + ", elements array<long>"
    return docs.mapInArrow(run, schema)


def local_roots(edges: DataFrame) -> DataFrame:
    """Union-find over the edges of each task: (node, root), the root being the least node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        out = [(x, find(x)) for x in list(parent)]
        yield pd.DataFrame(out, columns=["a", "b"])

    return edges.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (least node) for the nodes of the edges (a, b).

    Edges are dealt by b and tasks first contract their own by union-find, so about one link for each node
    is left.  Then every node takes the least label
    among its neighbours' and its label's label, until nothing changes: logarithmically many rounds."""
    links = local_roots(edges.repartition("b")).filter("a != b").distinct()
    links = written(links.union(links.select("b", "a")), "minhash-links")
    labels = written(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "minhash-labels")
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        stepped = written(stepped, "minhash-labels")
        up = stepped.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = written(stepped.join(up, "label", "left").select("node", "before", F.coalesce("above", "label").alias("label")), "minhash-labels")
        labels = jumped.select("node", "label")
        if not jumped.filter("before != label").take(1):
            return labels.withColumnRenamed("label", "component")


def _blocks(sizes: DataFrame, *keys: str) -> DataFrame:
    """keys and the number of blocks for groups of rows with n_shingles."""
    return sizes.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCUMENTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def link_components(points: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """node and component for the class representatives (doc_id, n_shingles, bands) that are linked with another.

    First each member of a bucket is verified against the bucket's least one, its centre; a pair that meets in several bands
    once, and the members of a common centre in blocks, each with a copy of the centre.  What a bucket's other members are
    linked among themselves matters only where they lie in different components; such buckets, once for each set of
    members, are verified in blocks, and each pair of blocks is a task of its own, so no task holds more than two."""
    buckets = points.select("doc_id", F.posexplode("bands").alias("band", "hash"))
    full = buckets.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("centre")).filter("n > 1").drop("n")
    full = written(full, "minhash-buckets")
    members = written(buckets.join(full, ["band", "hash"]), "minhash-members")
    sizes = points.select("doc_id", "n_shingles")
    met = members.filter("doc_id != centre").select("centre", "doc_id").distinct().join(sizes.hint("merge"), "doc_id")
    met = written(met, "minhash-met")
    ends = met.select("doc_id").union(met.select("centre")).distinct()
    # Members grow with the input: no broadcast.
    held = written(sets_of(texts(docs).join(ends.hint("merge"), "doc_id"), n), "minhash-sets")

    blocks = written(_blocks(met, "centre"), "minhash-blocks")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    others = met.join(blocks.hint("merge"), "centre").select("doc_id", F.xxhash64("centre", own).alias("task"), F.lit(1).alias("side"))
    centres = blocks.select(F.col("centre").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    centres = centres.select("doc_id", F.xxhash64("doc_id", "own").alias("task"), F.lit(0).alias("side"))
    dealt = held.join(centres.union(others).hint("merge"), "doc_id").repartition("task").sortWithinPartitions("task", "side", "doc_id")
    links = written(dealt.select("doc_id", "task", "elements").mapInArrow(_linked(percent, star), "a long, b long"), "minhash-stars")

    found = components(links)
    rest = members.filter("doc_id != centre").join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("doc_id", "band", "hash", F.coalesce("component", "doc_id").alias("part"))
    mark = [F.sum(F.xxhash64(F.lit(k), "doc_id").cast("decimal(38,0)")).alias(f"mark_{k}") for k in (1, 2)]
    open_ = rest.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), *mark).filter("n > 1 AND low != high")
    once = open_.groupBy("n", "mark_1", "mark_2").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.band", "b.hash")
    pairs = rest.drop("part").join(once.hint("merge"), ["band", "hash"]).join(sizes.hint("merge"), "doc_id")
    pairs = written(pairs, "minhash-open")
    pairs = pairs.join(_blocks(pairs, "band", "hash").hint("merge"), ["band", "hash"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = pairs.withColumn("own", own).withColumn("other", other).select("doc_id", F.xxhash64("band", "hash", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    dealt = held.join(pairs.hint("merge"), "doc_id").select("doc_id", "task", "elements").repartition("task").sortWithinPartitions("task")
    more = written(dealt.mapInArrow(_linked(percent, forest), "a long, b long"), "minhash-edges")
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_dedup(docs: DataFrame, n: int = 5, percent: int = 80, slots: int = SLOTS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Words are runs without white space, A-Z lower-cased; a document with fewer than n words has all
    of them as its one shingle; one without words, or with a null text, is linked with nothing.  Links
    have 100 * intersection >= percent * union of the full sets; component_id is the least doc_id
    reachable.  Rows that repeat a doc_id are one document and get one component_id.  Documents whose sets
    are equal share a class, whatever their texts.  A null doc_id gets a null component.  Other columns are not
    read; an empty table gives an empty result."""
    signed = written(signatures(docs, n, slots, band_rows), "minhash-signed")
    key = ["n_shingles", "set_key"]
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min(F.struct("doc_id", "bands")).alias("least"))
    classes = written(classes.select(*key, F.col("least.doc_id").alias("class_id"), F.col("least.bands").alias("bands")), "minhash-classes")
    found = link_components(classes.select(F.col("class_id").alias("doc_id"), "n_shingles", "bands"), docs, n, percent)
    named = classes.drop("bands").join(found, F.col("class_id") == F.col("node"), "left").select(*key, F.coalesce("component", "class_id").alias("component"))
    named = written(named, "minhash-named")
    out = signed.drop("bands").join(named, key, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=85)


#: All pairs that share a shingle, and components by the transitive closure: for small tables only.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.sh) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id
"""
