"""Exact dedup by skew-safe combining.

Equal texts have equal digests.  Each task first deduplicates its own rows (Spark's partial aggregation, keyed by digest,
salt and the full text), the salted groups are merged, and the salts' winners are combined; each of the three
steps groups by the full text, not the digest alone.  Only digests with more than one row in HOT_SHARE have
salts: they are at most HOT_SHARE, whatever the input, and so are broadcast.  The salt is the task's number, so a task gives a hot
text one row, however many copies it holds, and no step deals rows by a hot digest alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import written

#: Salts of a hot digest: the most tasks that share the merging of its group.
SALTS = 64
#: A digest is hot if it has more than one row in so many; there are less than that many of them.
HOT_SHARE = 1_000


def exact_dedup(docs: DataFrame, salts: int = SALTS, hot_share: int = HOT_SHARE, digits: int = 64) -> DataFrame:
    """Columns of docs plus keep_id, group_size, kept, text_sha256.

    Null texts count as empty, so all null and empty texts are one group.  The largest doc_id stays; a
    null doc_id stays only where its group has no other.  Rows that repeat a doc_id and a text are all in the
    group and all marked kept (they are one document, written twice).  An empty table gives an empty
    result; clashing columns of docs are replaced.  `digits` of the digest are the key that rows are dealt by; fewer than all
    make different texts meet, which is for tests: then, too, texts are told apart."""
    own = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*own)
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text, 256)
    key = digest if digits == 64 else F.substring(digest, 1, digits)
    counts = written(docs.select(key.alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "exact-repeated")
    total = docs.count()
    hot = F.broadcast(counts.filter(F.col("n") * hot_share > total).select("digest", F.lit(True).alias("hot")))

    def salted(docs: DataFrame) -> DataFrame:
        rows = docs.select("doc_id", text.alias("content"), key.alias("digest")).join(hot, "digest", "left")
        salt = F.when(F.col("hot"), F.spark_partition_id() % salts).otherwise(0)
        return rows.groupBy("digest", "hot", salt.alias("salt"), "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))

    merged = written(salted(docs).filter("hot OR group_size > 1"), "exact-salted")
    combine = [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    combined = merged.filter("hot").groupBy("digest", "content").agg(*combine)
    classes = merged.filter("hot IS NULL").select(*combined.columns).unionByName(combined)
    by_digest = classes.groupBy("digest").agg(F.count("*").alias("contents"), *combine)
    # A digest with other texts as well (a collision) has rows outside its class, or several classes.
    by_digest = written(counts.join(by_digest, "digest", "left").withColumn("clash", (F.col("contents") != 1) | ~F.col("n").eqNullSafe(F.col("group_size"))), "exact-winners")
    clash = by_digest.filter(F.coalesce("clash", F.lit(True))).select("digest")
    clean = by_digest.filter("NOT clash").select("digest", "keep_id", "group_size")

    # A row of a hot digest finds it in the broadcast; its key for the other join is its own, so that none is hot there.
    n = F.col("n") * hot_share > total
    often = by_digest.filter(n).filter("NOT clash").select("digest", F.col("keep_id").alias("often_id"), F.col("group_size").alias("often"))
    out = docs.withColumn("text_sha256", digest).withColumn("digest", key).join(F.broadcast(often), "digest", "left")
    alone = F.when(F.col("often").isNotNull(), F.concat(F.lit("-"), F.coalesce(F.col("doc_id"), F.spark_partition_id()).cast("string"))).otherwise(F.col("digest"))
    clean = clean.withColumnRenamed("digest", "join_key")
    out = out.withColumn("join_key", alone).join(clean.hint("merge"), "join_key", "left").drop("join_key")
    out = out.withColumn("keep_id", F.when(F.col("often").isNotNull(), F.col("often_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("often", "group_size"))
    if clash.take(1):
        groups = docs.select("doc_id", text.alias("content"), key.alias("digest")).join(clash, "digest", "left_semi").groupBy("digest", "content")
        groups = groups.agg(F.max("doc_id").alias("keep_2"), F.count("*").alias("size_2"))
        out = out.withColumn("content", text).join(groups, ["digest", "content"], "left").drop("content")
        out = out.withColumn("keep_id", F.coalesce("keep_2", "keep_id")).withColumn("group_size", F.coalesce("size_2", "group_size")).drop("keep_2", "size_2")
    single = F.coalesce("group_size", F.lit(1)) == 1
    return out.select(
        *docs.columns,
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of docs for each text; columns as they are.

    Of rows that repeat doc_id and text, the least by its columns stays, in the order of the table's columns (nulls first)."""
    kept = exact_dedup(docs).filter("kept")
    if kept.groupBy("text_sha256").agg(F.count("*").alias("n")).filter("n > 1").head(1):
        # Every text is its digest's only one here, unless two collide: so texts are told apart as well.
        first = kept.groupBy("text_sha256", F.coalesce("text", F.lit("")).alias("content")).agg(F.min(F.struct(*docs.columns)).alias("row"))
        return first.select("row.*")
    return kept.select(docs.columns)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
