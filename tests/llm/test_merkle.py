import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cadentia.llm import merkle
from cadentia.llm.ranking import ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, part string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def plain_tree(leaves):
    """Root and, for each leaf, its (left, right) siblings from below."""
    paths, at, level = [[] for _ in leaves], [[k] for k in range(len(leaves))], list(leaves)
    while len(level) > 1:
        runs = [range(i, min(i + 8, len(level))) for i in range(0, len(level), 8)]
        for run in runs:
            for k in run:
                for x in at[k]:
                    paths[x].append(("".join(level[j] for j in run if j < k), "".join(level[j] for j in run if j > k)))
        at = [[x for k in run for x in at[k]] for run in runs]
        level = [sha("".join(level[k] for k in run)) for run in runs]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rows in groups.values():
        rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    trees = {x: plain_tree([plain_leaf(r) for r in groups[x]]) for x in langs}
    root, over = plain_tree([trees[x][0] for x in langs])
    for lang, above in zip(langs, over):
        for row, below in zip(groups[lang], trees[lang][1]):
            path, text = below + above, row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = plain_leaf(row | {"text": text})
            for left, right in path:
                folded = sha(left + folded + right)
            yield row["doc_id"], plain_leaf(row), trees[lang][0], root, sha("".join(a + b for a, b in path)), folded, folded == root


def rows_of(n, langs, seed=0):
    rng = random.Random(seed)
    return [dict(doc_id=i, text=rng.choice(["Some Text É", "no capital", "", None, "X" * 3000]), lang=langs[rng.randrange(len(langs))], source=rng.choice([None, "s", "é"]), n_chars=rng.choice([None, 7, -12])) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        rows_of(700, ["en", "de", None, "zz", "é", "Z"]),
        rows_of(600, ["en"]),
        rows_of(90, [f"l{k}" for k in range(80)]),
        rows_of(1, [None]),
        rows_of(8, ["a"]) + rows_of(9, ["b"]) + rows_of(65, ["c"]) + rows_of(20, ["a"], 3) + [dict(doc_id=None, text=t, lang="b", source=None, n_chars=None) for t in ("A", "A", "b", None)],
    ],
)
def test_manifest_against_plain_trees(spark, rows):
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", "y") for r in rows], DOCS)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.when(chosen, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle.manifest(docs, lowered).drop("path").collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows), key=key)
    if len(rows) == 600:  # checked against itself
        assert all(r.verified for r in merkle.manifest(docs).collect())


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_ranks_of_a_hot_group_over_many_parts(spark):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([1, 2, 3, None])) for _ in range(3000)]
    got = ranked(spark.createDataFrame(data, "g string, x long").repartition(7), "g", ["x"], "test").collect()
    for g in ("hot", "b", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        xs = [-1 if r.x is None else r.x for r in own]
        assert xs == sorted(xs) and len(own) == sum(a == g for a, _ in data)
