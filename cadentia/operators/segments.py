"""Segments of a session: which to use, their signals and references, and tables that compare signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadentia.operators.alignment import curve_peaks
from cadentia.operators.joins import asof_nearest, within


def select_segments(segments: DataFrame, label: str | None = None, excluded: DataFrame | None = None, unlabelled: str = "Unlabelled") -> DataFrame:
    """Segments with a label, or with this one; without those excluded (session_id, idx)."""
    rows = segments.filter(F.col("label") != unlabelled) if label is None else segments.filter(F.col("label") == label)
    return rows if excluded is None else rows.join(excluded.select("session_id", "idx").distinct(), ["session_id", "idx"], "left_anti")


def prefer(rows: DataFrame, matches: Column, order: str) -> DataFrame:
    """Of each session the first row by `order` that matches, else the first."""
    first = Window.partitionBy("session_id").orderBy(F.coalesce(matches, F.lit(False)).desc(), order)
    return rows.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")


def merge_sensors(samples: DataFrame, sensors: list[str], aux: list[str]) -> DataFrame:
    """A row per session and time, a column per sensor, and aux__{sensor}__{name} for each name; samples (session_id, us, sensor_id,
    ord, value, aux map).  Of a sensor's rows with one time the first counts, so its columns are of one row."""
    first = lambda c, s: F.min_by(c, F.when(F.col("sensor_id") == s, F.col("ord")))
    values = [first(F.col("value"), s).alias(s) for s in sensors]
    more = [first(F.col("aux")[a], s).alias(f"aux__{s}__{a}") for s in sensors for a in aux]
    return samples.filter(F.col("sensor_id").isin(sensors)).groupBy("session_id", "us").agg(*values, *more)


def comparison_view(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both frames' columns on the union of their times (session_id, us)."""
    return left.join(right, ["session_id", "us"], "full")


def values_at(samples: DataFrame, intervals: DataFrame, times: DataFrame) -> DataFrame:
    """For times (session_id, us, ord) the nearest value of each sensor of the session (the later one of two as near), and the label
    of the first interval by idx that holds the time."""
    sensors = samples.select("session_id", "sensor_id").distinct()
    keys = ["session_id", "sensor_id"]
    # Mirrored, so that the tie goes to the later sample.
    left = times.select("session_id", (-F.col("us")).alias("us"), "ord").join(sensors, "session_id")
    near = asof_nearest(left, samples.select(*keys, (-F.col("us")).alias("us"), (-F.col("ord")).alias("ord"), "value"), None, keys)
    near = near.select(*keys, (-F.col("us")).alias("us"), "ord", F.col("hit.value").alias("value"))
    named = within(times, intervals).groupBy("session_id", "ord").agg(F.min_by("label", "idx").alias("label"))
    return near.join(named, ["session_id", "ord"], "left")


def pool_candidates(segments: DataFrame, traces: DataFrame, references: DataFrame, excluded: DataFrame, estimated: DataFrame) -> DataFrame:
    """segments (session_id, idx, start_us) plus status: excluded, no time, no trace, no reference, estimated or ready."""
    key, rows = ["session_id", "idx"], segments
    for name, table in (("trace", traces), ("reference", references), ("out", excluded), ("done", estimated)):
        rows = rows.join(table.select(*key).distinct().withColumn(name, F.lit(True)), key, "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    status = F.when(has("out"), "excluded").when(F.col("start_us").isNull(), "no time").when(~has("trace"), "no trace").when(~has("reference"), "no reference").when(has("done"), "estimated").otherwise("ready")
    return rows.withColumn("status", status).drop("trace", "reference", "out", "done")


def segment_reference(samples: DataFrame, segments: DataFrame, margin_sec: float) -> DataFrame:
    """Samples (session_id, us, ord, value) from margin_sec before a segment (session_id, idx, start_us, end_us) to as long after it, in
    seconds from its start."""
    margin = round(margin_sec * 1_000_000)
    wide = segments.select("session_id", "idx", "start_us", (F.col("start_us") - margin).alias("low_us"), (F.col("end_us") + margin).alias("high_us"))
    return within(samples, wide).select("session_id", "idx", "ord", ((F.col("us") - F.col("start_us")) / 1e6).alias("t_sec"), "value")


def segment_signal(segments: DataFrame, slices: DataFrame, session: DataFrame) -> DataFrame:
    """The stored slice (session_id, idx, us, ord, value) of each segment; without one, the session's samples between its start and
    end, else between its seconds from the anchor.  own says which."""
    second = lambda c: F.col("anchor_us") + F.round(F.col(c) * 1_000_000).cast("long")
    bounds = segments.join(slices.select("session_id", "idx").distinct(), ["session_id", "idx"], "left_anti")
    bounds = bounds.select("session_id", "idx", F.coalesce("start_us", second("start_sec")).alias("low_us"), F.coalesce("end_us", second("end_sec")).alias("high_us")).filter("low_us <= high_us")
    columns = ["session_id", "idx", "us", "ord", "value"]
    kept = slices.join(segments.select("session_id", "idx").distinct(), ["session_id", "idx"], "left_semi")
    return kept.select(*columns, F.lit(True).alias("own")).unionByName(within(session, bounds).select(*columns, F.lit(False).alias("own")))


def face_coverage(trace: DataFrame, *keys: str) -> DataFrame:
    """Share of the frames with a face, by session, segment and camera, and by `keys` (as win_idx)."""
    return trace.groupBy("session_id", "segment_idx", "camera", *keys).agg(F.avg(F.col("detected").cast("double")).alias("face_coverage"))


def corr_at(curve: DataFrame, at: DataFrame) -> DataFrame:
    """Correlation of each session's curve (session_id, lag_idx, corr) at a lag (session_id, at_lag), linear between neighbours; null
    outside, or beside a missing value."""
    order = Window.partitionBy("session_id").orderBy("lag_idx")
    steps = curve.select(F.col("session_id").alias("s"), F.col("lag_idx").alias("low"), F.col("corr").alias("left"), F.lead("lag_idx").over(order).alias("high"), F.lead("corr").over(order).alias("right"))
    on = (F.col("session_id") == F.col("s")) & (F.col("at_lag") >= F.col("low")) & (F.col("at_lag") < F.coalesce(F.col("high"), F.col("low") + F.lit(1e-9)))
    share = (F.col("at_lag") - F.col("low")) / (F.col("high") - F.col("low"))
    value = F.when(F.col("at_lag") == F.col("low"), F.col("left")).otherwise(F.col("left") + share * (F.col("right") - F.col("left")))
    return at.select("session_id", "at_lag").join(steps, on, "left").select("session_id", "at_lag", value.alias("corr"))


def step_peaks(curve: DataFrame, at: DataFrame, tolerance: float = 0.55) -> DataFrame:
    """For a lag (session_id, at_lag, in steps) the next and previous peak beyond the tolerance, and the nearest (the lower of two)."""
    peaks = curve_peaks(curve).select("session_id", F.col("lag_idx").alias("peak"))
    rows = at.join(peaks, "session_id", "left")
    after = F.when(F.col("peak") > F.col("at_lag") + tolerance, F.col("peak"))
    before = F.when(F.col("peak") < F.col("at_lag") - tolerance, F.col("peak"))
    near = F.min_by("peak", F.struct(F.abs(F.col("peak") - F.col("at_lag")), "peak"))
    return rows.groupBy("session_id", "at_lag").agg(F.min(after).alias("next_peak"), F.max(before).alias("previous_peak"), near.alias("nearest_peak"))


def apply_labels(library: DataFrame, intervals: DataFrame) -> DataFrame:
    """session_id, place, label and kept: the cleaned library (session_id, place, label), then labels that are still used but not in it
    (kept), by first use."""
    clean = library.withColumn("label", F.trim("label")).filter("label != ''").groupBy("session_id", "label").agg(F.min("place").alias("ord")).withColumn("kept", F.lit(False))
    used = intervals.filter("label != ''").groupBy("session_id", "label").agg(F.min("idx").cast("long").alias("ord")).withColumn("kept", F.lit(True))
    more = used.join(clean.select("session_id", "label"), ["session_id", "label"], "left_anti")
    rows = clean.select("session_id", "label", F.col("ord").cast("long").alias("ord"), "kept").unionByName(more.select("session_id", "label", "ord", "kept"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("kept", "ord"))
    return rows.select("session_id", place.alias("place"), "label", "kept")


def append_offset(history: DataFrame, new: DataFrame) -> DataFrame:
    """history (session_id, place, offset_sec) with one more entry for each session of new (session_id, offset_sec), after its last."""
    last = history.groupBy("session_id").agg(F.max("place").alias("last"))
    added = new.join(last, "session_id", "left").select("session_id", (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("place"), F.round("offset_sec", 4).alias("offset_sec"))
    return history.select("session_id", F.col("place").cast("long").alias("place"), "offset_sec").unionByName(added)
