"""Session metadata as JSON, one document per session: cameras, paths of signals, anchor and offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAMERA = """label string, final_video_path string, fps double, frame_count long, dimensions array<int>, codec string, duration_sec double,
start_datetime_utc string, sync_offset_sec double, sync_audio_start_offset_sec double, time_correction_mode string, true_start_datetime_utc string,
reference_video_time_sec double, video_reference_datetime_utc string, time_correction_offset_sec double, limits_common_duration boolean"""
SESSION = f"""cameras array<struct<{", ".join(f.strip().replace(" ", ":", 1) for f in CAMERA.split(","))}>>,
hr_signal_paths array<string>, signal_paths array<string>, ecg_signal_paths array<string>, synced_hr_paths array<string>, synced_hr_path string,
synced_signal_path string, synced_ecg_paths array<string>, synced_ecg_path string, signal_anchor_datetime_utc string,
time_coherence_tolerance_sec double, time_coherence_warnings array<string>, video_signal_offset_sec double, video_signal_offset_note string"""
#: What a camera has where its document says nothing.
DEFAULTS = {"final_video_path": "", "fps": 0.0, "frame_count": 0, "codec": "", "duration_sec": 0.0, "sync_offset_sec": 0.0, "sync_audio_start_offset_sec": 0.0, "time_correction_mode": "none", "reference_video_time_sec": 0.0, "time_correction_offset_sec": 0.0, "limits_common_duration": True}


def _named(paths: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "")))


def _one(path: Column) -> Column:
    return F.when(path.isNotNull(), F.array(path))


def parse_sessions(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and cameras of documents (session_id, json); older keys are read where the present ones are missing.

    A text that is no JSON gives a session with defaults and no camera."""
    d = documents.select("session_id", F.from_json("json", SESSION).alias("d"))
    col = lambda name: F.col(f"d.{name}")
    sessions = d.select(
        "session_id",
        _named(F.coalesce(col("hr_signal_paths"), col("signal_paths"))).alias("hr_signal_paths"),
        _named(col("ecg_signal_paths")).alias("ecg_signal_paths"),
        _named(F.coalesce(col("synced_hr_paths"), _one(F.coalesce(col("synced_hr_path"), col("synced_signal_path"))))).alias("synced_hr_paths"),
        _named(F.coalesce(col("synced_ecg_paths"), _one(col("synced_ecg_path")))).alias("synced_ecg_paths"),
        col("signal_anchor_datetime_utc").alias("signal_anchor_datetime_utc"),
        col("time_coherence_tolerance_sec").alias("time_coherence_tolerance_sec"),
        F.coalesce(col("time_coherence_warnings"), F.array().cast("array<string>")).alias("time_coherence_warnings"),
        F.coalesce(col("video_signal_offset_sec"), F.lit(0.0)).alias("video_signal_offset_sec"),
        F.coalesce(col("video_signal_offset_note"), F.lit("")).alias("video_signal_offset_note"),
    )
    rows = d.select("session_id", F.posexplode("d.cameras").alias("camera_index", "c"))
    names = [f.split()[0] for f in CAMERA.split(",")]
    filled = [(F.coalesce(F.col(f"c.{n}"), F.lit(DEFAULTS[n])) if n in DEFAULTS else F.col(f"c.{n}")).alias(n) for n in names if n not in ("label", "dimensions")]
    label = F.coalesce("c.label", F.concat(F.lit("Camera "), (F.col("camera_index") + 1).cast("string")))
    size = [F.coalesce(F.get("c.dimensions", F.lit(k)), F.lit(0)).alias(n) for k, n in enumerate(("width", "height"))]
    return sessions, rows.select("session_id", "camera_index", label.alias("label"), *filled, *size)


def read_sessions(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """parse_sessions of files; session_id is the file's path."""
    return parse_sessions(spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("session_id"), F.col("value").alias("json")))


def session_documents(sessions: DataFrame, cameras: DataFrame) -> DataFrame:
    """session_id and json of each session, its cameras in order; columns other than session_id become keys."""
    keys = [c for c in cameras.columns if c not in ("session_id", "camera_index", "width", "height")]
    size = [F.array("width", "height").alias("dimensions")] if {"width", "height"} <= set(cameras.columns) else []
    listed = cameras.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("camera_index", F.struct(*keys, *size).alias("c")))).alias("cameras"))
    rows = sessions.join(listed.select("session_id", F.col("cameras.c").alias("cameras")), "session_id", "left")
    return rows.select("session_id", F.to_json(F.struct(*(c for c in rows.columns if c != "session_id"))).alias("json"))


def write_sessions(sessions: DataFrame, cameras: DataFrame, path: str) -> None:
    """A folder of JSON lines, {"session_id": ..., "json": ...} per session."""
    session_documents(sessions, cameras).write.json(path)


def offset_of(json: Column | str, key: str = "video_signal_offset_sec") -> Column:
    """The offset under `key` of a JSON text, null there being 0.  Where the key is missing, or the text no JSON object, the query fails."""
    text = F.col(json) if isinstance(json, str) else json
    has = F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))
    value = F.coalesce(F.get_json_object(text, f"$.{key}").cast("double"), F.lit(0.0))
    return F.when(has, value).otherwise(F.raise_error(F.lit(f"no {key} in the record")).cast("double"))
