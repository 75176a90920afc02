"""Pooling lag curves, choosing an offset, and applying it to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reliable(max_hr_diff: float | None = 3.0, least_coverage: float = 0.9) -> Column:
    """Whether a window counts: face coverage, a known correlation, and heart rates that agree (None: not asked)."""
    fine = (F.col("face_coverage") >= least_coverage) & F.col("corr").isNotNull()
    return fine if max_hr_diff is None else fine & (F.abs(F.col("video_hr") - F.col("reference_hr")) <= max_hr_diff)


def pool_curves(curves: DataFrame, max_hr_diff: float | None = 3.0, least_coverage: float = 0.9) -> DataFrame:
    """Mean correlation per session and lag over the reliable windows, with the numbers of rows behind it."""
    return curves.filter(reliable(max_hr_diff, least_coverage)).groupBy("session_id", "lag_idx").agg(F.avg("corr").alias("corr"), F.count("*").alias("n"))


def pool_with_fallback(curves: DataFrame, max_hr_diff: float = 3.0, least_coverage: float = 0.9) -> DataFrame:
    """As pool_curves; sessions without a reliable window are pooled without the heart-rate check and marked."""
    strict, loose = reliable(max_hr_diff, least_coverage), reliable(None, least_coverage)
    some = curves.groupBy("session_id").agg(F.max(F.coalesce(strict, F.lit(False))).alias("trusted"))
    rows = curves.join(some, "session_id").filter(F.when(F.col("trusted"), strict).otherwise(loose))
    return rows.groupBy("session_id", "lag_idx").agg(F.avg("corr").alias("corr"), F.count("*").alias("n"), F.first("trusted").alias("trusted"))


def curve_peaks(curve: DataFrame) -> DataFrame:
    """Strict local maxima of each session's curve; a plateau counts at its middle; ends don't count."""
    order = Window.partitionBy("session_id").orderBy("lag_idx")
    rows = curve.filter("corr IS NOT NULL").withColumn("new", F.coalesce((F.col("corr") != F.lag("corr").over(order)).cast("int"), F.lit(1)))
    runs = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("session_id", "run").agg(F.min("lag_idx").alias("low"), F.max("lag_idx").alias("high"), F.first("corr").alias("corr"))
    along = Window.partitionBy("session_id").orderBy("run")
    runs = runs.withColumn("before", F.lag("corr").over(along)).withColumn("after", F.lead("corr").over(along))
    return runs.filter("corr > before AND corr > after").select("session_id", F.floor((F.col("low") + F.col("high")) / 2).alias("lag_idx"), "corr")


def best_lag(curve: DataFrame) -> DataFrame:
    """The lag of the greatest correlation, the first of equals, refined by a parabola through its neighbours:
    shift at most half a step, four decimals."""
    order = Window.partitionBy("session_id").orderBy("lag_idx")
    rows = curve.withColumn("left", F.lag("corr").over(order)).withColumn("right", F.lead("corr").over(order))
    best = rows.filter("corr IS NOT NULL").groupBy("session_id").agg(F.min_by(F.struct("lag_idx", "corr", "left", "right"), F.struct(-F.col("corr"), F.col("lag_idx"))).alias("b")).select("session_id", "b.*")
    bend = F.col("left") - 2 * F.col("corr") + F.col("right")
    shift = F.when(bend < 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("left") - F.col("right")) / bend))).otherwise(0.0)
    return best.select("session_id", "lag_idx", F.round(F.col("lag_idx") + F.coalesce(shift, F.lit(0.0)), 4).alias("lag"), "corr")


def peak_ratio(curve: DataFrame, apart: int = 13) -> DataFrame:
    """Best correlation over the highest other peak more than `apart` lags away; infinite without a positive one."""
    best = best_lag(curve).select("session_id", F.col("lag_idx").alias("best"), F.col("corr").alias("top"))
    other = best.join(curve_peaks(curve), "session_id", "left").withColumn("other", F.when(F.abs(F.col("lag_idx") - F.col("best")) > apart, F.col("corr")))
    high = other.groupBy("session_id").agg(F.first("top").alias("top"), F.max("other").alias("other"))
    return high.select("session_id", F.when(F.col("other") > 0, F.col("top") / F.col("other")).otherwise(F.lit(float("inf"))).alias("ratio"))


def reference_start(segments: DataFrame) -> DataFrame:
    """segments plus reference_us, the start without any offset: from the stored start, else the stored anchor,
    else the session's anchor; and applied_us, the offset they were cut with: the stored one, 0 for a segment with a stored time from
    before offsets existed, else the session's."""
    plain = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    used = F.when(F.col("has_offset"), F.coalesce(plain("offset_sec"), F.lit(0))).when(F.col("start_us").isNotNull() | F.col("anchor_us").isNotNull(), F.lit(0)).otherwise(plain("session_offset_sec"))
    return segments.withColumn("applied_us", used).withColumn(
        "reference_us", F.coalesce(F.col("start_us") + F.col("applied_us"), F.col("anchor_us") + plain("start_sec") + F.col("applied_us"), F.col("session_anchor_us") + plain("start_sec") + plain("session_offset_sec"))
    )


def apply_offset(segments: DataFrame, offset_sec: float) -> DataFrame:
    """Segments cut anew with an offset: anchor, start, end.  Applying 0 restores the first state."""
    moved = F.lit(round(round(offset_sec, 4) * 1_000_000))
    rows = reference_start(segments).withColumn("new_start_us", F.col("reference_us") - moved)
    return rows.select(
        "session_id", "idx",
        (F.col("new_start_us") - F.round(F.col("start_sec") * 1_000_000).cast("long")).alias("anchor_us"),
        F.col("new_start_us").alias("start_us"),
        (F.col("new_start_us") + F.round((F.col("end_sec") - F.col("start_sec")) * 1_000_000).cast("long")).alias("end_us"),
        F.lit(round(offset_sec, 4)).alias("offset_sec"),
        (F.abs(F.col("applied_us") - moved) > 100).alias("was_stale"),
    )
