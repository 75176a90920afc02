"""The driver's tables seen as signals, anchors, intervals, cameras and curves; each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions are users, sensors are event types, aux is k where it is odd."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("sensor_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", F.col("event_id").alias("ord"), k.alias("k"), F.when((k % 2 == 1) & F.col("event_type").isin("view", "click"), k).alias("aux")
    )


def anchors(s: DataFrame) -> DataFrame:
    """A session's anchor is a day after its first sample; it lasts twenty days."""
    return s.groupBy("session_id").agg((F.min("us") + DAY).alias("anchor_us"), F.lit(20 * DAY).alias("duration_us"))


def intervals(s: DataFrame) -> DataFrame:
    """From one signup to the next, labelled by k."""
    order = Window.partitionBy("session_id").orderBy("us", "ord")
    rows = s.filter("sensor_id = 'signup'").withColumn("high_us", F.lead("us").over(order)).withColumn("idx", F.row_number().over(order).cast("long"))
    rows = rows.filter("high_us IS NOT NULL").join(anchors(s), "session_id")
    return rows.select("session_id", "idx", F.concat(F.lit("L"), (F.col("k") % 5).cast("string")).alias("label"), F.col("us").alias("low_us"), "high_us", ((F.col("us") - F.col("anchor_us")) / 1e6).alias("start_sec"), ((F.col("high_us") - F.col("anchor_us")) / 1e6).alias("end_sec"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as its cameras."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    price, start = F.col("o_totalprice"), F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session_id"), (F.row_number().over(order) - 1).alias("camera_index"), start.alias("start_us"), F.floor(price / 100).cast("double").alias("duration_sec"), (F.col("o_orderstatus") == "F").alias("limits"),
        F.when(F.col("o_orderpriority").startswith("1"), "true").when(F.col("o_orderpriority").startswith("2"), "reference").when(F.col("o_orderpriority").startswith("3"), "offset").otherwise("none").alias("mode"),
        (start + F.floor(price).cast("long") * 1000).alias("true_us"), (F.floor(price) % 60).cast("double").alias("reference_sec"), (F.floor(price) % 7 - 3).cast("double").alias("offset_sec"), (F.floor(price) % 11).cast("double").alias("sync_sec"),
    )


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as windows of lag curves: orders modulo 500 are sessions, quantities are lags."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 500).alias("session_id"), F.col("l_quantity").cast("int").alias("lag_idx"), F.col("l_discount").alias("corr"), (1 - F.col("l_tax")).alias("face_coverage"), (60 + F.col("l_linenumber")).cast("double").alias("video_hr"), F.lit(62.0).alias("reference_hr"))


SIGNALS = """signals AS (
  SELECT user_id AS session_id, event_type AS sensor_id, epoch_us(ts) AS us, value, event_id AS ord, (props->>'k')::BIGINT AS k,
    CASE WHEN (props->>'k')::BIGINT % 2 = 1 AND event_type IN ('view', 'click') THEN (props->>'k')::BIGINT END AS aux FROM events)"""
ANCHORS = f"anchors AS (SELECT session_id, min(us) + {DAY} AS anchor_us, {20 * DAY} AS duration_us FROM signals GROUP BY session_id)"
INTERVALS = """intervals AS (
  SELECT i.session_id, idx, 'L' || (k % 5) AS label, us AS low_us, high_us, (us - anchor_us) / 1e6 AS start_sec, (high_us - anchor_us) / 1e6 AS end_sec
  FROM (SELECT *, lead(us) OVER w AS high_us, row_number() OVER w AS idx FROM signals WHERE sensor_id = 'signup' WINDOW w AS (PARTITION BY session_id ORDER BY us, ord)) i
  JOIN anchors a ON a.session_id = i.session_id WHERE high_us IS NOT NULL)"""
CAMERAS = """cameras AS (
  SELECT o_custkey AS session_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS camera_index, epoch_us(o_orderdate) AS start_us, floor(o_totalprice / 100)::DOUBLE AS duration_sec,
    o_orderstatus = 'F' AS limits, CASE left(o_orderpriority, 1) WHEN '1' THEN 'true' WHEN '2' THEN 'reference' WHEN '3' THEN 'offset' ELSE 'none' END AS mode,
    epoch_us(o_orderdate) + floor(o_totalprice)::BIGINT * 1000 AS true_us, (floor(o_totalprice)::BIGINT % 60)::DOUBLE AS reference_sec, (floor(o_totalprice)::BIGINT % 7 - 3)::DOUBLE AS offset_sec, (floor(o_totalprice)::BIGINT % 11)::DOUBLE AS sync_sec FROM orders),
corrected AS (
  SELECT *, CASE mode WHEN 'true' THEN true_us WHEN 'reference' THEN true_us - (reference_sec * 1000000)::BIGINT WHEN 'offset' THEN start_us + (offset_sec * 1000000)::BIGINT END AS corrected_us FROM cameras)"""
CURVES = """curves AS (
  SELECT l_orderkey % 500 AS session_id, l_quantity::INT AS lag_idx, l_discount AS corr, 1 - l_tax AS face_coverage, (60 + l_linenumber)::DOUBLE AS video_hr, 62.0::DOUBLE AS reference_hr FROM lineitem)"""


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of a text, with its table made from the polynomial."""
    table = "[list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR b IN range(256)]"
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda k: ('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c // 256, {table}[xor(c, b) % 256 + 1])), 4294967295)"
