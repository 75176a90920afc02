"""Tables that sessions keep beside their signals: manifests, offsets, file listings and plotted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadentia.functions.scalars import segment_folder
from cadentia.operators.joins import label_samples


#: Faults that an error names.
SHOWN = 20


def manifest(segments: DataFrame) -> DataFrame:
    """index, label, start_sec, end_sec, duration_sec and folder of each segment, numbered by start from 1."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("start_sec", "idx"))
    rows = segments.withColumn("index", place.cast("long"))
    return rows.select("session_id", "index", "label", "start_sec", "end_sec", (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"), segment_folder(F.col("index"), F.col("label")).alias("folder"))


def manifest_faults(manifests: DataFrame) -> DataFrame:
    """Rows of a manifest that cannot be used, with the reason: blank label or folder, or a start not before the end."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fault = F.when(blank("label"), "label").when(blank("folder"), "folder").when(~F.coalesce(F.col("start_sec") < F.col("end_sec"), F.lit(False)), "times")
    return manifests.withColumn("fault", fault).filter("fault IS NOT NULL")


def read_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """session_id (the file's path), idx (by start, from 1), label, start_sec, end_sec and folder of the segments of manifest CSVs.

    Labels and folders are trimmed.  A ValueError names the first faulty rows: a missing column, a blank label or folder, times that
    are no numbers or not in order; or the files without a row.  What comes to the driver is no more than SHOWN of these."""
    raw = spark.read.csv(paths, header=True)
    raw = raw.toDF(*(c.lstrip("\ufeff").strip() for c in raw.columns))
    missing = {"label", "start_sec", "end_sec", "folder"} - set(raw.columns)
    if missing:
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    rows = raw.select(F.col("_metadata.file_path").alias("session_id"), F.trim("label").alias("label"), F.trim("folder").alias("folder"), *(F.trim(c).try_cast("double").alias(c) for c in ("start_sec", "end_sec")))
    faults = manifest_faults(rows).limit(SHOWN).collect()
    if faults:
        raise ValueError("; ".join(f"{r.fault} of '{r.label}' in {r.session_id}: {r.start_sec} to {r.end_sec}, folder '{r.folder}'" for r in faults))
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("session_id"))
    empty = files.join(rows.select("session_id").distinct(), "session_id", "left_anti").limit(SHOWN).collect()
    if empty:
        raise ValueError("no segments in " + ", ".join(r.session_id for r in empty))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("start_sec", "end_sec", "label", "folder"))
    return rows.select("session_id", place.cast("long").alias("idx"), "label", "start_sec", "end_sec", "folder")


def current_offsets(history: DataFrame) -> DataFrame:
    """The offset applied last in each session of a history (session_id, place, offset_sec), and how many there were."""
    return history.groupBy("session_id").agg(F.max_by("offset_sec", "place").alias("offset_sec"), F.count("*").alias("applied"))


def reconcile_artifacts(recorded: DataFrame, listing: DataFrame, categories: list[str], rule: Column) -> DataFrame:
    """The files of a listing (session_id, path, size) against a recorded manifest (session_id, path, size, category).

    category: the recorded one if it is known, else what `rule` says of the path; status: same, changed (other
    size), missing (not listed) or foreign (not recorded)."""
    old = recorded.select("session_id", "path", F.col("size").alias("recorded_size"), F.col("category").alias("recorded"))
    rows = old.join(listing.select("session_id", "path", "size"), ["session_id", "path"], "full")
    status = F.when(F.col("size").isNull(), "missing").when(F.col("recorded_size").isNull(), "foreign").when(F.col("size") != F.col("recorded_size"), "changed").otherwise("same")
    return rows.select("session_id", "path", F.coalesce(F.when(F.col("recorded").isin(categories), F.col("recorded")), rule).alias("category"), status.alias("status"), F.coalesce("size", "recorded_size").alias("size"))


def plotted_table(samples: DataFrame, intervals: DataFrame, sensors: list[str]) -> DataFrame:
    """A row per session and video_sec, rounded to six decimals: us, the label there, and a column per sensor with its
    first value.  samples: session_id, sensor_id, us, ord, value, video_sec."""
    rows = samples.filter("value IS NOT NULL").withColumn("t", F.round("video_sec", 6))
    firsts = [F.min_by("value", F.when(F.col("sensor_id") == s, F.col("ord"))).alias(s) for s in sensors]
    table = rows.filter(F.col("sensor_id").isin(sensors)).groupBy("session_id", "t").agg(F.min("us").alias("us"), F.min("ord").alias("ord"), *firsts)
    return label_samples(table, intervals).drop("ord").withColumnRenamed("t", "video_time_sec")


def classify_artifacts(listing: DataFrame, cameras: DataFrame, alignment_folder: str = "ppg_alignment") -> DataFrame:
    """session_id, path, size and category of the files of a listing that are full or intermediate videos, or alignment files.

    path is relative to the session's folder.  Videos lie in the folder itself and are named by pattern or as
    cameras (session_id, final_name, intermediate_name) record; alignment files lie anywhere below their folder."""
    name = F.lower("path")
    known = [cameras.select("session_id", F.lower(c).alias("name"), F.lit(kind).alias("recorded")) for c, kind in (("final_name", "full"), ("intermediate_name", "intermediate"))]
    recorded = known[0].union(known[1]).filter("name IS NOT NULL").groupBy("session_id", "name").agg(F.min("recorded").alias("recorded"))
    rows = listing.select("session_id", "path", "size", name.alias("name")).join(recorded, ["session_id", "name"], "left")
    video = F.col("name").rlike(r"^[^/]+\.(mp4|mov|mkv|avi|m4v)$")
    full = (F.col("recorded") == "full") | F.col("name").rlike(r"^cam\d+_[^/]*_final\.[^./]*$")
    part = (F.col("recorded") == "intermediate") | F.col("name").rlike(r"^cam\d+_[^/]*_(concat|trimstart)\.[^./]*$")
    category = F.when(F.col("path").startswith(f"{alignment_folder}/"), "alignment").when(video & full, "full").when(video & part, "intermediate")
    return rows.select("session_id", "path", "size", category.alias("category")).filter("category IS NOT NULL")


def valid_traces(traces: DataFrame, videos: DataFrame, settings: dict, version: int) -> DataFrame:
    """The traces (session_id, segment, camera, version, file, size, mtime, settings, ...) that still fit their video
    (session_id, camera, file, size, mtime) and the settings.  Settings that are off (None or False) are left out of the comparison; traces keep theirs as a map of strings."""
    on = {k: str(v) for k, v in settings.items() if v is not None and v is not False}
    wanted = F.array_sort(F.map_entries(F.create_map(*(F.lit(x) for kv in on.items() for x in kv)).cast("map<string,string>")))
    fresh = traces.filter((F.col("version") == version) & F.array_sort(F.map_entries("settings")).eqNullSafe(wanted))
    return fresh.join(videos.select("session_id", "camera", "file", "size", "mtime").distinct(), ["session_id", "camera", "file", "size", "mtime"], "left_semi")


def estimate_record(curves: DataFrame, offset_lag: int, lag_sec: float, first_sec: float) -> DataFrame:
    """One record per session of pooled curves (session_id, segment_idx, window_idx, lag_idx, corr): segments and windows
    used, the mean correlation at the applied lag, and the best lag's offset and correlation (the least lag of equal ones)."""
    used = curves.groupBy("session_id").agg(F.array_sort(F.collect_set("segment_idx")).alias("segments"), F.count_distinct("segment_idx", "window_idx").alias("windows"))
    pooled = curves.groupBy("session_id", "lag_idx").agg(F.round(F.avg("corr"), 9).alias("corr"))
    top = F.max(F.struct("corr", (-F.col("lag_idx")).alias("back")))
    best = pooled.groupBy("session_id").agg(F.max(F.when(F.col("lag_idx") == offset_lag, F.col("corr"))).alias("at"), top.alias("top"))
    return used.join(best, "session_id").select(
        "session_id", "segments", "windows", F.round("at", 4).alias("correlation"), F.round(first_sec - F.col("top.back") * lag_sec, 6).alias("best_offset_sec"), F.round("top.corr", 4).alias("best_correlation")
    )
