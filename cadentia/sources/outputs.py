"""What a session's segments leave on disk: their metadata, signal slices, and the offsets they were cut with.

All of it is one Parquet dataset, partitioned by session_id, with rows of four kinds:

session: us is the anchor, value the offset, text its note; one for each session, also one without segments;
offset: ord and value are the place and the offset of an entry of its history;
meta: text is a segment's metadata as JSON;
any other: a row of the slice of that signal, with us, ord and value.

So one dynamic overwrite replaces all that a session has, in one commit: slices that are no longer there go with the rest,
and sessions that are not written stay.  An aborted job leaves what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadentia.functions.scalars import segment_folder
from cadentia.operators.applied import apply_to_sessions
from cadentia.operators.storage import stored

SCHEMA = "session_id long, idx long, kind string, us long, ord long, value double, text string"
OWN = ("session", "offset", "meta")
#: Fields of the metadata that later runs read.
TIMES = "label string, start_sec double, end_sec double, anchor_us long, start_us long, end_us long, offset_sec double"


def _rows(df: DataFrame, **columns) -> DataFrame:
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    given = {"session_id": F.col("session_id"), **columns}
    return df.select(*(given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def _utc(us: str):
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def segment_meta(segments: DataFrame, timing: DataFrame) -> DataFrame:
    """session_id, idx and text: the metadata of segments (session_id, idx, label, start_sec, end_sec) with their timing
    (session_id, idx, anchor_us, start_us, end_us, offset_sec, note), number and folder, as JSON.  A segment without timing has the rest."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("start_sec", "idx")).cast("long")
    numbered = segments.select("session_id", "idx", "label", "start_sec", "end_sec", place.alias("number"))
    named = numbered.withColumns({"duration_sec": F.col("end_sec") - F.col("start_sec"), "folder": segment_folder(F.col("number"), F.col("label"))})
    whole = named.join(timing, ["session_id", "idx"], "left")
    fields = F.struct(
        F.col("number").alias("index"), "label", "start_sec", "end_sec", "duration_sec", "folder", "anchor_us", "start_us", "end_us", "offset_sec",
        _utc("anchor_us").alias("signal_anchor_datetime_utc"), _utc("start_us").alias("segment_start_datetime_utc"), _utc("end_us").alias("segment_end_datetime_utc"),
        F.col("offset_sec").alias("video_signal_offset_sec"), F.col("note").alias("video_signal_offset_note"),
    )
    return whole.select("session_id", "idx", F.to_json(fields).alias("text"))


def write_outputs(path: str, sessions: DataFrame, history: DataFrame, meta: DataFrame, slices: DataFrame) -> None:
    """Replaces all that the sessions (session_id, anchor_us, offset_sec, note) have under path by their history (session_id, place,
    offset_sec), meta (session_id, idx, text) and slices (session_id, idx, kind, us, ord, value).

    A slice of a kind that the dataset uses itself fails the job.  Rows of sessions that are not named are not written."""
    rows = _rows(sessions, kind=F.lit("session"), us=F.col("anchor_us"), value=F.col("offset_sec"), text=F.col("note"))
    rows = rows.unionByName(_rows(history, kind=F.lit("offset"), ord=F.col("place"), value=F.col("offset_sec")))
    rows = rows.unionByName(_rows(meta, kind=F.lit("meta"), idx=F.col("idx"), text=F.col("text")))
    kind = F.when(F.col("kind").isin(*OWN), F.raise_error(F.lit("a signal cannot have this kind"))).otherwise(F.col("kind"))
    cut = _rows(slices, kind=kind, idx=F.col("idx"), us=F.col("us"), ord=F.col("ord"), value=F.col("value"))
    named = sessions.select("session_id").distinct()
    every = rows.unionByName(cut).join(named, "session_id", "left_semi")
    # Dealt by session, segment and kind, so a long session is written by many tasks, and sorted as slices are read.
    sorted_ = every.repartition("session_id", "idx", "kind").sortWithinPartitions("session_id", "idx", "kind", "us", "ord")
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def read_outputs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """sessions, history, meta (with the fields of TIMES read from its text) and slices of write_outputs()."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    of = lambda kind: rows.filter(F.col("kind") == kind)
    return {
        "sessions": of("session").select("session_id", F.col("us").alias("anchor_us"), F.col("value").alias("offset_sec"), F.col("text").alias("note")),
        "history": of("offset").select("session_id", F.col("ord").alias("place"), F.col("value").alias("offset_sec")),
        "meta": of("meta").select("session_id", "idx", "text", F.from_json("text", TIMES).alias("m")).select("session_id", "idx", "text", "m.*"),
        "slices": rows.filter(~F.col("kind").isin(*OWN)).select("session_id", "idx", "kind", "us", "ord", "value"),
    }


def export_segments(path: str, segments: DataFrame, sessions: DataFrame, signals: dict[str, DataFrame], offset_sec: float = 0.0, note: str = "") -> DataFrame:
    """Cuts segments (session_id, idx, label, start_sec, end_sec) from the signals (session_id, us, ord, value) for the first time, and writes
    them; sessions (session_id, anchor_us) tell where video second 0 lies without an offset.  Returns the report."""
    fresh = segments.join(sessions.select("session_id", F.col("anchor_us").alias("session_anchor_us")), "session_id")
    none = {"start_us": "long", "anchor_us": "long", "offset_sec": "double"}
    fresh = fresh.withColumns({c: F.lit(None).cast(k) for c, k in none.items()} | {"has_offset": F.lit(False), "session_offset_sec": F.lit(0.0)})
    history = sessions.select("session_id", F.lit(0).cast("long").alias("place"), F.lit(0.0).alias("offset_sec")).limit(0)
    return _apply(path, fresh, sessions.select("session_id", "anchor_us", F.lit(0.0).alias("offset_sec")), history, signals, offset_sec, note)


def apply_offset_to_outputs(spark: SparkSession, path: str, signals: dict[str, DataFrame], offset_sec: float, note: str = "") -> DataFrame:
    """Cuts every segment under path anew from the whole signals with an offset, and replaces what is there.  Returns the report
    (session_id, updated, warnings, resliced).  Nothing depends on offsets applied before: 0 restores the first slices."""
    old = read_outputs(spark, path)
    segments = old["meta"].withColumn("has_offset", F.col("offset_sec").isNotNull())
    own = old["sessions"].select("session_id", F.col("anchor_us").alias("session_anchor_us"), F.coalesce("offset_sec", F.lit(0.0)).alias("session_offset_sec"))
    segments = segments.join(own, "session_id").drop("text")
    return _apply(path, segments, old["sessions"].select("session_id", "anchor_us", "offset_sec"), old["history"], signals, offset_sec, note)


def _apply(path, segments, anchors, history, signals, offset_sec, note) -> DataFrame:
    # What is read from the path is kept elsewhere before it is replaced.
    segments, anchors, history = (stored(x, n) for x, n in ((segments, "outputs-segments"), (anchors, "outputs-anchors"), (history, "outputs-history")))
    made = apply_to_sessions(segments, anchors, history, signals, offset_sec, note)
    meta = segment_meta(segments.select("session_id", "idx", "label", "start_sec", "end_sec"), made["timing"])
    none = segments.select("session_id", "idx", F.lit("").alias("kind"), F.lit(0).cast("long").alias("us"), F.lit(0).cast("long").alias("ord"), F.lit(0.0).alias("value")).limit(0)
    write_outputs(path, made["anchors"].withColumn("note", F.lit(note)), made["history"], meta, made.get("slices", none))
    return made["report"]
