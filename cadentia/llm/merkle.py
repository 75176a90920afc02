"""Merkle manifest of a dataset: a tree of digests per language, one above them, and a proof for every row.

A level is made by a slot pivot: nodes are grouped by (tree, number div 8), and conditional aggregates spread the children of a
parent into eight columns.  Their concatenation hashes the parent; the columns left of a child's own and those right of it are
its siblings.  Going down, each parent hands its path to its children, so the table of rows is joined nowhere: the rows
come out of the lowest pivot.  Groups have eight rows at most, whatever a language holds, and numbers come from `ranking`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import crc32_sql, written
from cadentia.llm.ranking import ranked

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SLOTS = [f"c{k}" for k in range(FANOUT)]


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else byte count, `:`, value."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The digest of a row of documents, or of that row with another text."""
    return digest(*(field(F.col(c) if c != "text" or text is None else text) for c in FIELDS))


def joined(slots: list[str]) -> Column:
    return F.concat_ws("", *(F.col(c)["digest"] for c in slots))


def grow(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of each level, lowest first, and the roots (tree, level, node) of a table (tree, rank, n, node), where node is a
    struct with digest and what else a row carries.  A tree of one row has that row as its root and no pivot."""
    nodes, pivots, roots = written(nodes, f"{name}-nodes"), [], None
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        tops = nodes.filter("n = 1").select("tree", F.lit(len(pivots)).alias("level"), F.struct("node.digest").alias("node"))
        roots = tops if roots is None else roots.unionByName(tops)
        if most <= 1:
            return pivots, roots
        slot = F.col("rank") % FANOUT
        pivot = nodes.filter("n > 1").groupBy("tree", F.expr(f"rank div {FANOUT}").alias("parent")).agg(F.max("n").alias("n"), *(F.max(F.when(slot == k, F.col("node"))).alias(c) for k, c in enumerate(_SLOTS)))
        pivots.append(written(pivot, f"{name}-{len(pivots)}"))
        nodes = pivots[-1].select("tree", F.col("parent").alias("rank"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), F.struct(F.sha2(joined(_SLOTS), 256).alias("digest")).alias("node"))
        most = -(-most // FANOUT)


def paths(nodes: DataFrame, pivots: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(node, subroot, path) of each lowest node.  A path is an array of (left, right), the siblings' digests on each side from
    the node's own level up; tops (tree, level, subroot, path) says with what the path of a root begins."""
    steps = [
        F.struct(F.lit(k).alias("slot"), F.col(c).alias("node"), F.struct(joined(_SLOTS[:k]).alias("left"), joined(_SLOTS[k + 1 :]).alias("right")).alias("step"))
        for k, c in enumerate(_SLOTS)
    ]
    above = tops.filter(F.col("level") == len(pivots)).select("tree", F.lit(0).cast("long").alias("parent"), "subroot", "path")
    for level in range(len(pivots) - 1, -1, -1):
        down = pivots[level].join(above, ["tree", "parent"]).select("tree", "parent", "subroot", "path", F.inline(F.array(*steps))).filter("node IS NOT NULL")
        down = down.withColumn("path", F.concat(F.array("step"), "path"))
        if level == 0:
            above = down.select("node", "subroot", "path")
            break
        lone = tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("parent"), "subroot", "path")
        above = written(down.select("tree", (F.col("parent") * FANOUT + F.col("slot")).alias("parent"), "subroot", "path").unionByName(lone), "merkle-paths")
    alone = nodes.filter("n = 1").join(tops.filter("level = 0"), "tree").select("node", "subroot", "path")
    return above.unionByName(alone) if pivots else alone


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path (its siblings, left and right).

    `tampered` is the text that is checked against the manifest (the own text if missing): its leaf is folded along the path.
    Nulls are `-` in a leaf; a null lang is a language of its own, before all others; rows with a null doc_id come first in their
    language; rows with equal ids go by their leaf, and wholly equal rows have a leaf each.  An empty table gives an
    empty result.  Columns besides the five are not read.  A text is hashed where it is read and never moved."""
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), F.col("doc_id"), leaf().alias("digest"), (leaf() if tampered is None else leaf(tampered)).alias("now")
    )
    placed = ranked(written(rows, "merkle-rows"), "tree", ["doc_id", "digest"], "merkle")
    nodes = placed.select("tree", "rank", "n", F.struct("digest", "doc_id", "now").alias("node"))
    nodes = written(nodes, "merkle-leaves")
    pivots, roots = grow(nodes, "merkle")
    roots = written(roots, "merkle-roots")
    upper = ranked(roots.withColumn("one", F.lit(0)), "one", ["tree"], "merkle-subroots")
    upper = written(upper.select(F.lit("").alias("tree"), "rank", "n", F.struct("node.digest", F.col("tree").alias("name"), "level").alias("node")), "merkle-upper")
    higher, summit = grow(upper, "merkle-top")
    summit = summit.select("tree", "level", F.col("node.digest").alias("subroot"), F.expr("CAST(array() AS array<struct<left:string,right:string>>)").alias("path"))
    root = summit.first()
    tops = paths(upper, higher, summit).select(F.col("node.name").alias("tree"), F.col("node.level").alias("level"), F.col("node.digest").alias("subroot"), "path")
    proven = paths(nodes, pivots, written(tops, "merkle-tops"))
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    folded = F.aggregate("path", F.col("node.now"), lambda acc, s: digest(s["left"], acc, s["right"]))
    whole = F.lit(root["subroot"] if root else None).cast("string")
    out = proven.select(F.col("node.doc_id").alias("doc_id"), F.col("node.digest").alias("leaf"), "subroot", whole.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"), "path")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.when(chosen, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return manifest(docs, lowered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_FIELDS_SQL = " || ".join(f"coalesce(octet_length(encode({{{c}}}::VARCHAR)) || ':' || {{{c}}}::VARCHAR, '-')" for c in FIELDS)
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH RECURSIVE d AS (
  SELECT coalesce('=' || lang, '') AS tree, doc_id, sha256({_FIELDS_SQL.format(**{c: c for c in FIELDS})}) AS h,
    sha256({_FIELDS_SQL.format(**{c: c for c in FIELDS} | {"text": f"CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {_LOWER_SQL} ELSE text END"})}) AS now FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS k, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (
  SELECT tree, 0 AS lvl, k, n, h FROM leaves
  UNION ALL SELECT tree, lvl + 1, k // 8, max(n + 7) // 8, sha256(string_agg(h, '' ORDER BY k)) FROM up WHERE n > 1 GROUP BY tree, lvl, k // 8),
subroots AS (SELECT tree, lvl AS top, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS k, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (
  SELECT 0 AS lvl, k, n, h FROM subroots
  UNION ALL SELECT lvl + 1, k // 8, max(n + 7) // 8, sha256(string_agg(h, '' ORDER BY k)) FROM over WHERE n > 1 GROUP BY lvl, k // 8),
steps AS (
  SELECT b.tree, b.lvl, b.k, coalesce(string_agg(a.h, '' ORDER BY a.k) FILTER (a.k < b.k), '') AS l, coalesce(string_agg(a.h, '' ORDER BY a.k) FILTER (a.k > b.k), '') AS r
  FROM up b JOIN up a ON a.tree = b.tree AND a.lvl = b.lvl AND a.k // 8 = b.k // 8 WHERE b.n > 1 GROUP BY ALL),
top_steps AS (
  SELECT b.lvl, b.k, coalesce(string_agg(a.h, '' ORDER BY a.k) FILTER (a.k < b.k), '') AS l, coalesce(string_agg(a.h, '' ORDER BY a.k) FILTER (a.k > b.k), '') AS r
  FROM over b JOIN over a ON a.lvl = b.lvl AND a.k // 8 = b.k // 8 WHERE b.n > 1 GROUP BY ALL),
walk AS (
  SELECT p.tree, p.k, p.doc_id, p.h AS leaf, p.k AS at, 0 AS lvl, p.now AS folded, '' AS proof, false AS above FROM leaves p
  UNION ALL
  SELECT w.tree, w.k, w.doc_id, w.leaf,
    CASE WHEN NOT w.above AND w.lvl = s.top THEN s.k WHEN w.above THEN w.at // 8 ELSE w.at // 8 END,
    CASE WHEN NOT w.above AND w.lvl = s.top THEN 0 ELSE w.lvl + 1 END,
    CASE WHEN NOT w.above AND w.lvl = s.top THEN w.folded ELSE sha256(coalesce(a.l, t.l) || w.folded || coalesce(a.r, t.r)) END,
    w.proof || coalesce(a.l, t.l, '') || coalesce(a.r, t.r, ''),
    w.above OR w.lvl = s.top
  FROM walk w JOIN subroots s ON s.tree = w.tree
  LEFT JOIN steps a ON NOT w.above AND a.tree = w.tree AND a.lvl = w.lvl AND a.k = w.at
  LEFT JOIN top_steps t ON w.above AND t.lvl = w.lvl AND t.k = w.at
  WHERE NOT w.above OR t.k IS NOT NULL),
ends AS (SELECT * FROM walk WHERE above AND lvl = (SELECT max(lvl) FROM over))
SELECT e.doc_id, e.leaf, s.h AS subroot, o.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = o.h AS verified
FROM ends e JOIN subroots s ON s.tree = e.tree CROSS JOIN (SELECT h FROM over WHERE n = 1) o
"""
