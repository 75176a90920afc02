"""Synchronising sessions: clipping, pivoting, filling, native rows, anchors and camera plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadentia.operators.running import along


def clip_to_session(samples: DataFrame, anchors: DataFrame) -> DataFrame:
    """Samples in [anchor, anchor + duration], both ends included; sessions without an anchor are not clipped."""
    joined = samples.join(anchors.select("session_id", "anchor_us", "duration_us"), "session_id", "left")
    return joined.filter("anchor_us IS NULL OR us BETWEEN anchor_us AND anchor_us + duration_us").select(samples.columns)


def video_time(samples: DataFrame, anchors: DataFrame) -> DataFrame:
    """samples plus video_sec: seconds from the anchor, or from the sensor's first sample without one."""
    keys = ["session_id", "sensor_id"]
    starts = samples.select(*keys, "us").groupBy(*keys).agg(F.min("us").alias("__first")).join(anchors.select("session_id", "anchor_us"), "session_id", "left")
    starts = starts.select(*keys, F.coalesce("anchor_us", "__first").alias("__start"))
    return samples.join(starts, keys).withColumn("video_sec", (F.col("us") - F.col("__start")) / 1e6).drop("__start")


def first_values(samples: DataFrame) -> DataFrame:
    """The first non-null value of each (session, time, sensor) in load order."""
    return samples.filter("value IS NOT NULL").groupBy("session_id", "us", "sensor_id").agg(F.min_by("value", "ord").alias("value"))


def fill_signals(samples: DataFrame) -> DataFrame:
    """Every sensor on the union of its session's times, filled forward and then backward; the first value
    in load order wins.  Long form: session_id, us, sensor_id, value."""
    values = first_values(samples)
    grid = samples.select("session_id", "us").distinct().join(values.select("session_id", "sensor_id").distinct(), "session_id")
    wide = grid.join(values, ["session_id", "us", "sensor_id"], "left")
    filled = along(wide, ["session_id", "sensor_id"], ["us"], back={"back": "value"}, ahead={"ahead": "value"})
    return filled.select("session_id", "us", "sensor_id", F.coalesce("back", "ahead").alias("value"))


def with_average(filled: DataFrame) -> DataFrame:
    """The mean over sensors at each time, from the filled rows."""
    return filled.groupBy("session_id", "us").agg(F.avg("value").alias("averaged"))


def wide(filled: DataFrame, sensors: list[str]) -> DataFrame:
    """A column per sensor."""
    return filled.groupBy("session_id", "us").pivot("sensor_id", sensors).agg(F.first("value"))


def dedupe_aux(samples: DataFrame) -> DataFrame:
    """The auxiliary value of the first row, even a null one, of each (session, sensor, time)."""
    order = Window.partitionBy("session_id", "sensor_id", "us").orderBy("ord")
    return samples.withColumn("place", F.row_number().over(order)).filter("place = 1").select("session_id", "sensor_id", "us", "aux")


def native_rows(filled: DataFrame, aux: DataFrame) -> DataFrame:
    """Rows at a sensor's own rate: where its own aux is present; for a sensor without aux, where no sensor has
    aux; where no sensor of the session has aux, where the value is known.  A sensor left without rows
    by that keeps its known values."""
    own = aux.filter("aux IS NOT NULL")
    moments = own.groupBy("session_id", "us").agg(F.collect_set("sensor_id").alias("now"))
    sessions = own.groupBy("session_id").agg(F.collect_set("sensor_id").alias("ever"))
    has = lambda c: F.coalesce(F.array_contains(c, F.col("sensor_id")), F.lit(False))
    rows = filled.join(moments, ["session_id", "us"], "left").join(sessions, "session_id", "left")
    known = F.col("value").isNotNull()
    keep = F.when(has("ever"), has("now")).when(F.col("ever").isNotNull(), F.col("now").isNull()).otherwise(known)
    rows = rows.withColumn("keep", keep).withColumn("some", F.max("keep").over(Window.partitionBy("session_id", "sensor_id")))
    return rows.filter(F.when(F.col("some"), F.col("keep")).otherwise(known)).select("session_id", "us", "sensor_id", "value")


def common_duration(cameras: DataFrame) -> DataFrame:
    """Least positive duration of the limiting cameras; of none, the longest; 0 without a positive one."""
    positive = F.when(F.col("duration_sec") > 0, F.col("duration_sec"))
    return cameras.groupBy("session_id").agg(F.coalesce(F.min(F.when(F.col("limits"), positive)), F.max(positive), F.lit(0.0)).alias("common_sec"))


def correct_camera_start(cameras: DataFrame) -> DataFrame:
    """corrected_us by mode: `true` the true start, `reference` a reference time less its video second,
    `offset` the given seconds; otherwise null (not corrected)."""
    second = F.lit(1_000_000)
    return cameras.withColumn(
        "corrected_us",
        F.when(F.col("mode") == "true", F.col("true_us"))
        .when(F.col("mode") == "reference", F.col("true_us") - F.round(F.col("reference_sec") * second).cast("long"))
        .when(F.col("mode") == "offset", F.col("start_us") + F.round(F.col("offset_sec") * second).cast("long")),
    )


def signal_anchor(cameras: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Camera 0's corrected start, else the first corrected one, else camera 0's start; less the session's offset."""
    out = cameras.groupBy("session_id").agg(
        F.min_by("corrected_us", F.when(F.col("corrected_us").isNotNull(), F.col("camera_index"))).alias("corrected"),
        F.min_by("start_us", "camera_index").alias("plain"),
    ).select("session_id", F.coalesce("corrected", "plain").alias("anchor_us"))
    if offsets is None:
        return out
    shifted = F.col("anchor_us") - F.round(F.coalesce("offset_sec", F.lit(0.0)) * 1_000_000).cast("long")
    return out.join(offsets.select("session_id", "offset_sec"), "session_id", "left").select("session_id", shifted.alias("anchor_us"))


def effective_anchor(cameras: DataFrame, stored: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """The anchor that a session's signals were last synchronised with (stored: session_id, stored_us), else that of its cameras;
    both with the session's offset."""
    own = signal_anchor(cameras, offsets)
    rows = own.join(stored.select("session_id", "stored_us"), "session_id", "full")
    return rows.select("session_id", F.coalesce("stored_us", "anchor_us").alias("anchor_us"))


def clock_entries(cameras: DataFrame) -> DataFrame:
    """cameras (start_us, clock_ms: a time of day as typed, in milliseconds) plus true_us: that time on the day (UTC) of the camera's
    start; null without either."""
    day = F.lit(86_400_000_000)
    return cameras.withColumn("true_us", F.floor(F.col("start_us") / day) * day + F.col("clock_ms") * 1000)


def frame_counts(cameras: DataFrame) -> DataFrame:
    """session_id, cameras, least and most frames, and differ: whether a session's videos still differ in length after trimming."""
    rows = cameras.groupBy("session_id").agg(F.count("*").alias("cameras"), F.min("frame_count").alias("least"), F.max("frame_count").alias("most"), F.max(F.col("frame_count").isNull()).alias("unknown"))
    return rows.select("session_id", "cameras", "least", "most", F.coalesce((F.col("least") != F.col("most")) | (F.col("unknown") & F.col("least").isNotNull()), F.lit(False)).alias("differ"))


def in_time_order(samples: DataFrame) -> DataFrame:
    """samples in the order of session, sensor, time and ord, over all partitions: dealt by ranges, so a long session is many parts."""
    return samples.orderBy("session_id", "sensor_id", "us", "ord")


def coherence_warnings(cameras: DataFrame, tolerance_us: int) -> DataFrame:
    """Sessions whose corrected starts differ by more than the tolerance, with the extreme cameras."""
    ends = cameras.filter("corrected_us IS NOT NULL").groupBy("session_id").agg(F.min("corrected_us").alias("low"), F.max("corrected_us").alias("high"))
    named = cameras.join(ends.filter(F.col("high") - F.col("low") > tolerance_us), "session_id")
    at = lambda c: F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.abs(F.col("corrected_us") - F.col(c)) <= 1, F.format_string("%04d", "camera_index")))))
    return named.groupBy("session_id").agg(((F.first("high") - F.first("low")) / 1e6).alias("spread_sec"), at("low").alias("earliest"), at("high").alias("latest"))


def trim_plan(cameras: DataFrame, target_sec: float | None = None) -> DataFrame:
    """Seconds to trim at the start (over 0.01) and end (over 0.1) so that all cameras of a session agree.

    The target is the least positive duration left of the cameras that limit it; without one, the longest."""
    session = Window.partitionBy("session_id")
    start = F.max("sync_sec").over(session) - F.col("sync_sec")
    rows = cameras.withColumn("trim_start", F.when(start > 0.01, start).otherwise(0.0))
    left = F.col("duration_sec") - F.col("trim_start")
    rows = rows.withColumn("left_sec", left)
    target = F.lit(target_sec) if target_sec is not None else F.coalesce(F.min(F.when(F.col("limits") & (F.col("left_sec") > 0), F.col("left_sec"))).over(session), F.greatest(F.max("left_sec").over(session), F.lit(0.0)))
    return rows.withColumn("target_sec", target).select(
        "session_id", "camera_index", "trim_start", F.when((F.col("target_sec") > 0) & (F.col("left_sec") - F.col("target_sec") > 0.1), F.col("left_sec") - F.col("target_sec")).otherwise(0.0).alias("trim_end")
    )


def union_signals(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe_ts(samples: DataFrame) -> DataFrame:
    """Of a sensor's samples with one time the first by ord."""
    order = Window.partitionBy("session_id", "sensor_id", "us").orderBy("ord")
    return samples.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def stitch_slices(slices: DataFrame) -> DataFrame:
    """Of equal times in a session the sample of the first segment stays."""
    order = Window.partitionBy("session_id", "us").orderBy("idx", "ord")
    return slices.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")
