"""An offset applied to whole sessions, and the report of the windows it was pooled from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.operators.alignment import apply_offset, best_lag, reliable
from cadentia.operators.joins import within
from cadentia.operators.segments import append_offset, step_peaks

SEGMENT = ["session_id", "segment_idx"]


def window_counts(curves: DataFrame, max_hr_diff: float | None = 3.0, least_coverage: float = 0.9, keys: list[str] = ["session_id"]) -> DataFrame:  # noqa: B006
    """keys, accepted and windows: how many of the windows (session_id, segment_idx, win_idx) of lag curves are reliable."""
    window = F.struct("segment_idx", "win_idx")
    return curves.groupBy(*keys).agg(F.count_distinct(F.when(reliable(max_hr_diff, least_coverage), window)).alias("accepted"), F.count_distinct(window).alias("windows"))


def pool_report(curves: DataFrame, offsets: DataFrame, max_hr_diff: float | None = 3.0, least_coverage: float = 0.9) -> DataFrame:
    """A row per segment of lag curves: accepted and windows, best (lag, in steps) and corr of its pooled curve (to nine decimals), and nearest_peak to
    the session's offset (session_id, at_lag, in steps).  A segment without a usable window, or whose curve has no peak,
    has nulls for these; a session without an offset has a null nearest_peak and best."""
    fine = curves.filter(reliable(max_hr_diff, least_coverage)).groupBy(*SEGMENT, "lag_idx").agg(F.round(F.avg("corr"), 9).alias("corr"))
    # The curve's operators take any key: here a session and segment.
    pooled = fine.select(F.struct(*SEGMENT).alias("session_id"), "lag_idx", "corr")
    segments = pooled.select("session_id").distinct().withColumn("own", F.col("session_id.session_id"))
    at = segments.join(offsets.select(F.col("session_id").alias("own"), "at_lag"), "own").select("session_id", "at_lag")
    peaks = step_peaks(pooled, at).filter("nearest_peak IS NOT NULL").select("session_id", "nearest_peak")
    found = best_lag(pooled).join(peaks, "session_id").select("session_id.*", F.col("lag").alias("best"), "corr", "nearest_peak")
    return window_counts(curves, max_hr_diff, least_coverage, SEGMENT).join(found, SEGMENT, "left")


def apply_to_sessions(segments: DataFrame, anchors: DataFrame, history: DataFrame, signals: dict[str, DataFrame], offset_sec: float, note: str = "") -> dict[str, DataFrame]:
    """Everything that follows from one offset, as tables to be written in place of the old ones:

    timing: segments (as apply_offset takes them) with anchor_us, start_us, end_us, offset_sec, was_stale and note;
    slices: session_id, idx, kind, us, ord and value of the signals (session_id, us, ord, value), by kind, inside the new bounds;
    anchors: session_id, anchor_us, offset_sec with the anchor moved by what the offset differs from the one before;
    history: the offsets (session_id, place, offset_sec) with this one appended for each session of anchors;
    report: session_id, updated, warnings (segments without any time reference) and resliced, the kinds.

    Slices are cut from the whole signals, so nothing depends on offsets applied before, and 0 restores the first state.  Segments
    without a time reference have no slices and are not in timing.  A null offset before counts as 0."""
    moved = apply_offset(segments, offset_sec).withColumn("note", F.lit(note))
    timing = moved.filter("start_us IS NOT NULL")
    bounds = timing.select("session_id", "idx", F.col("start_us").alias("low_us"), F.col("end_us").alias("high_us"))
    slices = None
    for kind, rows in signals.items():
        part = within(rows.select("session_id", "us", "ord", "value"), bounds).select("session_id", "idx", F.lit(kind).alias("kind"), "us", "ord", "value")
        slices = part if slices is None else slices.unionByName(part)
    new = round(offset_sec, 4)
    delta = F.round((F.lit(new) - F.coalesce("offset_sec", F.lit(0.0))) * 1_000_000).cast("long")
    shifted = anchors.select("session_id", (F.col("anchor_us") - delta).alias("anchor_us"), F.lit(new).alias("offset_sec"))
    report = moved.groupBy("session_id").agg(F.count("start_us").alias("updated"), F.count_if(F.col("start_us").isNull()).alias("warnings"))
    report = report.withColumn("resliced", F.array(*map(F.lit, signals)) if signals else F.array().cast("array<string>"))
    tables = {"timing": timing, "anchors": shifted, "history": append_offset(history, anchors.select("session_id", F.lit(new).alias("offset_sec"))), "report": report}
    return tables if slices is None else {**tables, "slices": slices}
