"""Editing labelled intervals as table transforms (seconds of video time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadentia.operators.joins import _meet, overlap

LEAST_SEC = 0.5


def neighbour_limits(intervals: DataFrame, durations: DataFrame) -> DataFrame:
    """How far each interval may grow: the greatest end before it and the least start after it."""
    order = Window.partitionBy("session_id").orderBy("start_sec", "idx")
    low = F.max("end_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("session_id").orderBy(F.desc("start_sec"), F.desc("idx"))
    high = F.min("start_sec").over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.join(durations, "session_id", "left")
    return rows.select("session_id", "idx", F.coalesce(low, F.lit(0.0)).alias("low_sec"), F.coalesce(high, "duration_sec").alias("high_sec"))


def subdivide(intervals: DataFrame, count: int | None = None, seconds: float | None = None) -> DataFrame:
    """Parts `{label}_part{i}` by count (2 or more) or by duration (LEAST_SEC or more; the last is clipped, pieces
    under 0.01 s are left out); an interval of fewer than two parts stays."""
    length = F.col("end_sec") - F.col("start_sec")
    if count is not None:
        parts, step = F.lit(count), length / count
    else:
        parts, step = F.ceil(length / seconds).cast("int"), F.lit(seconds)
    rows = intervals.withColumn("step", step).withColumn("parts", F.greatest(parts, F.lit(1)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1), "parts")))
    start = F.col("start_sec") + (F.col("part") - 1) * F.col("step")
    end = F.least(F.col("end_sec"), F.col("start_sec") + F.col("part") * F.col("step"))
    whole = F.col("parts") < 2
    out = rows.select("session_id", "idx", "part", F.when(whole, F.col("label")).otherwise(F.concat("label", F.lit("_part"), F.col("part").cast("string"))).alias("label"), F.when(whole, F.col("start_sec")).otherwise(start).alias("start_sec"), F.when(whole, F.col("end_sec")).otherwise(end).alias("end_sec"), whole.alias("whole"))
    return out.filter("whole OR end_sec - start_sec >= 0.01").drop("whole")


def split_at(intervals: DataFrame, cuts: DataFrame) -> DataFrame:
    """Intervals cut at cuts (session_id, at_sec), at most one cut an interval, if both parts last LEAST_SEC."""
    points = cuts.select("session_id", "at_sec", F.col("at_sec").alias("same_sec"))
    met = overlap(intervals.select("session_id", "idx", "start_sec", "end_sec"), points, ["session_id"], ("start_sec", "at_sec"), ("end_sec", "same_sec"))
    hit = met.filter((F.col("at_sec") - F.col("start_sec") >= LEAST_SEC) & (F.col("end_sec") - F.col("at_sec") >= LEAST_SEC))
    one = hit.groupBy("session_id", "idx").agg(F.min("at_sec").alias("at_sec"))
    rows = intervals.join(one, ["session_id", "idx"], "left")
    cut = F.col("at_sec").isNotNull()
    part = lambda k, a, b: F.struct(F.lit(k).alias("part"), a.alias("start_sec"), b.alias("end_sec"))
    parts = F.when(cut, F.array(part(0, F.col("start_sec"), F.col("at_sec")), part(1, F.col("at_sec"), F.col("end_sec")))).otherwise(F.array(part(0, F.col("start_sec"), F.col("end_sec"))))
    return rows.select("session_id", "idx", "label", F.inline(parts))


def validate_new(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates with ordered ends, rounded to 3 decimals, of LEAST_SEC or more and without a strict overlap."""
    ordered = candidates.select("session_id", "cand", F.round(F.least("a_sec", "b_sec"), 3).alias("start_sec"), F.round(F.greatest("a_sec", "b_sec"), 3).alias("end_sec")).filter(F.col("end_sec") - F.col("start_sec") >= LEAST_SEC)
    met = overlap(ordered, existing.select("session_id", F.col("start_sec").alias("a"), F.col("end_sec").alias("b")), ["session_id"], ("start_sec", "a"), ("end_sec", "b"))
    clash = met.filter("start_sec < b AND end_sec > a").select("session_id", "cand", "start_sec", "end_sec").distinct()
    return ordered.join(clash, ["session_id", "cand", "start_sec", "end_sec"], "left_anti")


def resize(intervals: DataFrame, edits: DataFrame) -> DataFrame:
    """Applies edits (session_id, idx, new_start, new_end; one an interval) that keep LEAST_SEC, meet no other interval, and meet no
    edit of an interval with a smaller idx that keeps to these two rules itself (whether that is applied or not)."""
    mine = ("new_start", "new_end")

    def free(rows, others, rule):
        met = overlap(rows.select("session_id", "idx", *mine), others, ["session_id"], (mine[0], "a"), (mine[1], "b"))
        clash = met.filter(rule).filter("new_start < b AND new_end > a").select("session_id", "idx").distinct()
        return rows.join(clash, ["session_id", "idx"], "left_anti")

    asked = edits.filter(F.col("new_end") - F.col("new_start") >= LEAST_SEC)
    good = free(asked, intervals.select("session_id", F.col("idx").alias("i"), F.col("start_sec").alias("a"), F.col("end_sec").alias("b")), "idx <> i")
    good = free(good, good.select("session_id", F.col("idx").alias("i"), F.col("new_start").alias("a"), F.col("new_end").alias("b")), "idx > i")
    rows = intervals.join(good, ["session_id", "idx"], "left")
    return rows.select("session_id", "idx", "label", F.coalesce("new_start", "start_sec").alias("start_sec"), F.coalesce("new_end", "end_sec").alias("end_sec"))


def rename_label(intervals: DataFrame, old: str, new: str) -> DataFrame:
    """The new label wherever the old one was; onto a label in use it merges them."""
    return intervals.withColumn("label", F.when(F.col("label") == old, F.lit(new)).otherwise(F.col("label")))


def label_library(intervals: DataFrame) -> DataFrame:
    """Labels of each session with their count, in order of first use."""
    used = intervals.groupBy("session_id", "label").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    return used.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("first_idx")))


def next_interval(intervals: DataFrame, times: DataFrame) -> DataFrame:
    """For each different time the start that comes next after it and the one before it, by more than 1 ms.

    Two as-of joins look ahead from 1 ms after the time, and, with all times negated, from 1 ms before it."""
    day = 86_400

    def beyond(sign: int, name: str) -> DataFrame:
        starts = intervals.filter("start_sec IS NOT NULL").select("session_id", (sign * F.col("start_sec")).alias("us"), F.lit(0).alias("ord"))
        asked = times.select("session_id", (sign * F.col("at_sec") + 1e-3).alias("us"), F.lit(0).alias("ord"), "at_sec").distinct()
        met = _meet(asked, starts, ["session_id"], [], day, True)
        return met.select("session_id", "at_sec", (sign * F.col("__ahead.us")).alias(name))

    return beyond(1, "next_sec").join(beyond(-1, "previous_sec"), ["session_id", "at_sec"])


def analysis_windows(segments: DataFrame, length: float = 30.0, hop: float = 15.0) -> DataFrame:
    """Window rows of a segment of duration_sec: one shortened window if it is shorter than `length`."""
    span = F.least(F.lit(length), F.col("duration_sec"))
    n = F.floor((F.col("duration_sec") - span) / hop + 1e-9).cast("int")
    rows = segments.withColumn("span", span).withColumn("win_idx", F.explode(F.sequence(F.lit(0), n)))
    return rows.select("session_id", "segment_idx", "win_idx", (F.col("win_idx") * hop).alias("win_start"), (F.col("win_idx") * hop + F.col("span")).alias("win_end"))
