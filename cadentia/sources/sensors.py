"""Sensor files: chest-strap and ECG CSV, watch CSV with metadata lines; and the writers of per-sensor tables."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAMPS = ("dd/MM/yyyy HH:mm:ss.SSS", "dd/MM/yyyy HH:mm:ss")
#: Date formats of the watch, tried in this order.
WATCH_DATES = ("dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")


def _day_first(name: str):
    return F.coalesce(*(F.try_to_timestamp(F.trim(name), F.lit(f)) for f in STAMPS))


def read_strap(spark: SparkSession, paths: list[str], value: str = "HR") -> DataFrame:
    """path, us, value, aux of strap CSVs with one header: Time, the value's column, and all others as aux text.
    Rows without a time or value are left out; a byte order mark is dropped."""
    raw = spark.read.csv(paths, header=True)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    more = [c for c in raw.columns if c not in ("Time", value)]
    aux = F.map_filter(F.create_map(*(x for c in more for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull()) if more else F.lit(None).cast("map<string,string>")
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.unix_micros(_day_first("Time")).alias("us"), F.col(value).try_cast("double").alias("value"), aux.alias("aux"))
    return rows.filter("us IS NOT NULL AND value IS NOT NULL")


def read_ecg(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_strap(spark, paths, "EcgWaveform").drop("aux")


def read_watch(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, us, value of watch CSVs: two metadata lines (Date, Start time), then a header and elapsed times."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("lines"))
    cells = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x))
    at = lambda row, names, name: F.try_element_at(row, F.array_position(names, F.lit(name)).cast("int"))
    heads = files.filter(F.size("lines") > 3).select("path", "lines", cells(F.col("lines")[0]).alias("meta"), cells(F.col("lines")[1]).alias("facts"), cells(F.col("lines")[2]).alias("names"))
    both = F.filter("names", lambda n: F.upper(n).contains("HR") & F.upper(n).contains("BPM"))
    any_ = F.filter("names", lambda n: F.upper(n).contains("HR"))
    heads = heads.withColumn("day", F.coalesce(*(F.try_to_timestamp(at(F.col("facts"), F.col("meta"), "Date"), F.lit(f)) for f in WATCH_DATES))).withColumn("start", at(F.col("facts"), F.col("meta"), "Start time")).withColumn("rate", F.coalesce(F.try_element_at(both, F.lit(1)), F.try_element_at(any_, F.lit(1))))
    seconds = lambda c: F.aggregate(F.slice(F.concat(F.transform(F.split(c, ":"), lambda p: p.try_cast("double")), F.array(F.lit(0.0))), 1, 3), F.lit(0.0), lambda a, p: a * 60 + p)
    rows = heads.select("path", "names", "day", "start", "rate", F.explode(F.slice("lines", 4, 1_000_000_000)).alias("line")).withColumn("cells", cells(F.col("line")))
    rows = rows.withColumn("elapsed", at(F.col("cells"), F.col("names"), "Time")).withColumn("value", F.try_element_at("cells", F.array_position("names", F.col("rate")).cast("int")).try_cast("double"))
    us = F.unix_micros("day") + F.round((seconds(F.col("start")) + seconds(F.col("elapsed"))) * 1_000_000).cast("long")
    return rows.select("path", us.alias("us"), "value").filter("us IS NOT NULL AND value IS NOT NULL")


def assign_sensor_ids(files: DataFrame) -> DataFrame:
    """files (session_id, kind, src_ord) plus sensor_id: Kind_1, Kind_2 in file order."""
    place = F.row_number().over(Window.partitionBy("session_id", "kind").orderBy("src_ord"))
    return files.withColumn("sensor_id", F.concat_ws("_", "kind", place.cast("string")))


def write_device_samples(samples: DataFrame, path: str) -> None:
    """Parquet by kind and sensor file name (lower case, `_1` added without a number), sorted by time."""
    name = F.lower(F.when(F.col("sensor_id").rlike("_[0-9]+$"), F.col("sensor_id")).otherwise(F.concat("sensor_id", F.lit("_1"))))
    rows = samples.withColumn("sensor_file", name).sortWithinPartitions("session_id", "us")
    # Sensors that samples has are replaced whole, in one commit; others stay as they are.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "sensor_file").parquet(path)


#: Loaders in the order they are tried: name, test on a header's columns, reader of (spark, paths).
LOADERS: list[tuple[str, Callable[[list[str]], bool], Callable[[SparkSession, list[str]], DataFrame]]] = []


def register_loader(name: str, matches: Callable[[list[str]], bool], read: Callable[[SparkSession, list[str]], DataFrame]) -> None:
    """Adds a kind of file, tried after those there are; a name that is there is replaced in its place."""
    at = next((k for k, x in enumerate(LOADERS) if x[0] == name), len(LOADERS))
    LOADERS[at : at + 1] = [(name, matches, read)]


register_loader("ECG", lambda names: {"Time", "EcgWaveform"} <= set(names), read_ecg)
register_loader("Polar", lambda names: {"Date", "Start time"} <= set(names), read_watch)
register_loader("Zephyr", lambda names: {"Time", "HR"} <= set(names) and bool({"BR", "SkinTemp", "Posture", "Activity", "HRConfidence"} & set(names)), read_strap)


def first_lines(spark: SparkSession, paths: list[str], most: int = 1 << 20) -> DataFrame:
    """path (a URI) and header, the first line (of `most` bytes at most) without a byte order mark, of each file.

    Spark lists the files, those of no byte left out; a task opens each and reads block by block up to the line's end, however long the file is."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"))

    def run(batches):
        from pyarrow.fs import FileSystem

        for batch in batches:
            lines = []
            for path in batch.column("path").to_pylist():
                fs, name = FileSystem.from_uri(path)
                head = b""
                with fs.open_input_file(name) as source:
                    while b"\n" not in head and len(head) < most and (more := source.read(4096)):
                        head += more
                lines.append(head.split(b"\n", 1)[0].decode("utf-8", "replace").rstrip("\r").replace("\ufeff", ""))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(lines, pa.string())], ["path", "header"])

    return files.mapInArrow(run, "path string, header string")


def classify_signal_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, header and kind of each file: the first loader whose test its first line passes, else `Unknown sensor`.

    Tasks read the beginning of each file only; what comes to the driver is each different header once."""
    heads = first_lines(spark, paths)
    names = lambda h: [c.strip().strip('"') for c in h.split(",")]
    kinds = [(r.header, next((n for n, fits, _ in LOADERS if fits(names(r.header))), "Unknown sensor")) for r in heads.select("header").distinct().collect()]
    return heads.join(spark.createDataFrame(kinds, "header string, kind string"), "header").select("path", "header", "kind").orderBy("path")


def load_signals(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """kind, path, us, value, aux of all known files, and the paths of the unknown ones.

    Files are read together only where their headers are equal, as one read has one header."""
    groups: dict[tuple[str, str], list[str]] = {}
    for r in classify_signal_files(spark, paths).collect():
        groups.setdefault((r.kind, r.header), []).append(r.path)
    readers, out = {n: read for n, _, read in LOADERS}, None
    for (kind, _), own in sorted(groups.items()):
        if kind in readers:
            part = readers[kind](spark, [unquote(p) for p in own]).withColumn("kind", F.lit(kind))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, sorted(p for (kind, _), own in groups.items() if kind not in readers for p in own)


def infer_aux_types(samples: DataFrame, names: list[str]) -> DataFrame:
    """A column for each name of samples' aux: double where at least one of its values is a number (others null), else text."""
    numbers = samples.agg(*(F.count(F.col("aux")[n].try_cast("double")).alias(f"n{k}") for k, n in enumerate(names))).first()
    return samples.select("*", *((F.col("aux")[n].try_cast("double") if numbers[k] else F.col("aux")[n]).alias(n) for k, n in enumerate(names)))


def read_synced(spark: SparkSession, path: str, time: str = "timestamp_utc") -> DataFrame:
    """A synchronised CSV with us (UTC) for its time column.  A missing column or a time that can't be read fails the job."""
    raw = spark.read.csv(path, header=True)
    if time not in raw.columns:
        raise ValueError(f"{path} has no column {time}")
    at = F.try_to_timestamp(F.col(time))
    us = F.when(at.isNotNull(), F.unix_micros(at)).otherwise(F.raise_error(F.concat(F.lit("no time: "), F.coalesce(F.col(time), F.lit("null")))).cast("long"))
    return raw.select(us.alias("us"), *(F.col(c).try_cast("double").alias(c) for c in raw.columns if c != time))


def read_combined(spark: SparkSession, path: str, time: str = "timestamp_utc") -> DataFrame:
    """us, sensor_id, value of a wide CSV with one column for each sensor; averages and aux columns are left out."""
    wide = read_synced(spark, path, time)
    sensors = [c for c in wide.columns if c not in ("us", "averaged") and not c.startswith("aux__")]
    return wide.unpivot(["us"], sensors, "sensor_id", "value").filter("value IS NOT NULL")
