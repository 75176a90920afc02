"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

The targets are a water-filling over the table of sources (one row per source).  The documents of a
source are laid out by size class, then by a salt, then by document; the expected copies of each
document (target / size of its source) are summed along that order, one random offset per source is
added, and a document comes out once per integer crossed.  The running sum never needs a whole source
in one task: rows are ranked inside a block (source, size class, salt), and the blocks' starts come from
running sums over their counts: over a source's size classes, over a class's groups of GROUP salts, and over the salts of a
group.  The number of salts follows the source's row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadentia.llm.common import WORD_PATTERN, written

#: Weights of the sources in code-point order, null last, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: A source's target stops at this multiple of its size; so no document exceeds that many copies.
MOST_COPIES = 3
#: Documents that a block of the prefix sum holds on average at most.
BLOCK_ROWS = 2_000
#: Salts that are summed in a row.
GROUP = 1_000


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source_size -> target and random offset for a table (source, n_docs, source_size).

    A source is capped if its cap per weight is at most the level reached when all sources with a smaller
    cap per weight are capped; the rest shares what is left by weight."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per_weight = F.col("cap") / F.col("weight")
    filled = named.withColumn("level", level).withColumn("place", F.row_number().over(ranked))
    first = F.min(F.when(per_weight > F.col("level"), F.struct("place", "level"))).over(whole)["level"]
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce("source", F.lit("")))), 1, 4), 16, 10).cast("double") / 65536
    return filled.withColumn("water", first).select(
        "source", "n_docs", "source_size", F.when(per_weight > F.col("water"), F.col("water") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"), offset.alias("offset")
    )


def block_starts(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """no_source, s, band, salt and start of blocks with n rows each: the rows of the source's blocks before, by band and salt.

    No window orders more than the bands of a source (a size doubles in four), the groups of a band, or the salts of a group."""
    own, band = ["no_source", "s"], ["no_source", "s", "band"]
    blocks = written(blocks.withColumn("group", F.floor(F.col("salt") / group)), "mix-blocks")
    groups = blocks.groupBy(*band, "group").agg(F.sum("n").alias("n"))
    bands = groups.groupBy(*band).agg(F.sum("n").alias("n"))
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_bands = bands.select(*band, before(own, "band").alias("of_band"))
    of_groups = groups.select(*band, "group", before(band, "group").alias("of_group"))
    of_salts = blocks.select(*band, "group", "salt", before([*band, "group"], "salt").alias("of_salt"))
    whole = of_salts.join(of_groups, [*band, "group"]).join(of_bands, band)
    return whole.select(*band, "salt", (F.col("of_band") + F.col("of_group") + F.col("of_salt")).alias("start"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, block_rows: int = BLOCK_ROWS, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken; if `whole`, also document, all of
    its columns, so that nothing has to be joined to it by doc_id.

    Null texts and texts without words have size 0 and never add words.  A null source is a source of its
    own.  A source of size 0 has target 0.  Repeated rows are ranked one after the other, so each gets
    its share; rows that tie in every key are equal, and so is the result whichever comes first.  An empty
    table gives an empty result.  Other columns are not read."""
    document = [F.struct(*docs.columns).alias("document")] if whole else []
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("document.text") if whole else F.lit(""), F.lit(""))
    salt_bits = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    sized = docs.select("doc_id", "source", *document, F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized, "mix-sizes")
    goal = written(targets(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), weights, most), "mix-targets")
    salts = F.ceil(F.col("n_docs") / block_rows).cast("long")
    rows = sized.join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")), "inner").drop("goal_source")
    rows = rows.withColumn("band", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")) * 4) + 1).otherwise(0).cast("int")).withColumn("salt", salt_bits % salts)
    rows = rows.select("*", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_source"))
    key = ["no_source", "s", "band", "salt"]
    starts = written(block_starts(rows.groupBy(*key).agg(F.count("*").alias("n"))), "mix-starts")
    inside = Window.partitionBy(*key).orderBy("size", "doc_id", *(["document"] if whole else []))
    ranked = rows.join(starts, key).withColumn("rank", F.col("start") + F.row_number().over(inside))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("offset") + expected * F.col("rank")) - F.floor(F.col("offset") + expected * (F.col("rank") - 1))
    return ranked.withColumn("copies", F.least(crossed, F.lit(most)).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["document"] if whole else [])
    )


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight, {MOST_COPIES} * source_size AS cap FROM sizes),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER w, 0))::DOUBLE / ((SELECT sum(weight) FROM named) - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM named WINDOW w AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (
  SELECT level AS water FROM levels WHERE cap::DOUBLE / weight::DOUBLE > level ORDER BY cap::DOUBLE / weight::DOUBLE, source IS NULL, source LIMIT 1),
goal AS (
  SELECT source, n_docs, source_size,
    CASE WHEN cap::DOUBLE / weight::DOUBLE > (SELECT water FROM water) THEN (SELECT water FROM water) * weight::DOUBLE ELSE cap::DOUBLE END AS target,
    ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 4))::BIGINT / 65536.0::DOUBLE AS o FROM levels),
ranked AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.o,
    row_number() OVER (PARTITION BY s.source ORDER BY CASE WHEN s.size > 0 THEN floor(log2(s.size::DOUBLE) * 4)::INT + 1 ELSE 0 END,
      ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT % ceil(g.n_docs / {BLOCK_ROWS}.0)::BIGINT, s.size, s.doc_id NULLS FIRST) AS r
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS x FROM ranked)
SELECT doc_id, size, source_size, target, least(floor(o + x * r)::BIGINT - floor(o + x * (r - 1))::BIGINT, {MOST_COPIES}) * size AS taken FROM e
"""
