"""Column functions: times, names, frames and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time_text(text: Column, fps: Column) -> Column:
    """Seconds of `H:MM:SS.mmm`, `MM:SS`, plain seconds (decimal comma allowed) or `f123`/`#123` frames; else null."""
    plain = F.regexp_replace(F.trim(text), ",", ".")
    frame = F.regexp_extract(plain, r"^[fF#]([0-9]+)$", 1).try_cast("double")
    valid = plain.rlike(r"^([0-9]+:){0,2}[0-9]+(\.[0-9]+)?$")
    parts = F.transform(F.split(plain, ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    return F.when(frame.isNotNull(), F.when(fps > 0, frame / fps)).when(valid, total)


def format_hms(seconds: Column) -> Column:
    """`M:SS`, from an hour on `H:MM:SS`; negative times as 0."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    h, m, s = F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def format_hms_ms(seconds: Column) -> Column:
    """`HH:MM:SS.mmm`."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("long"), F.floor(ms / 60_000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def format_clock(us: Column, with_ms: bool = True) -> Column:
    """`HH:MM:SS.mmm UTC` of a time in microseconds; '' for null."""
    ms = F.floor(us / 1000).cast("long")
    day = F.pmod(ms, F.lit(86_400_000))
    text = F.format_string("%02d:%02d:%02d", F.floor(day / 3_600_000).cast("long"), F.floor(day / 60_000).cast("long") % 60, F.floor(day / 1000).cast("long") % 60)
    return F.coalesce(F.when(us.isNotNull(), F.concat(text, F.format_string(".%03d", day % 1000) if with_ms else F.lit(""), F.lit(" UTC"))), F.lit(""))


def recording_time(name: Column) -> Column:
    """The time in a camera's file name `DJI_YYYYMMDDhhmmss_n`; null without one, or where it is no time."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"DJI_([0-9]{14})_[0-9]+", 1), F.lit("")), F.lit("yyyyMMddHHmmss"))


def recording_name(time: Column) -> Column:
    """`YYYYMMDD_hhmmss` of a time; `unknown` for null."""
    return F.coalesce(F.date_format(time, "yyyyMMdd_HHmmss"), F.lit("unknown"))


def safe_filename(name: Column, fallback: str = "figure") -> Column:
    """Other characters than letters, digits, `.`, `_` and `-` as `_`, without `.` and `_` at the ends; else the fallback."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(name), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(fallback))


def roi_box(x: Column, y: Column, w: Column, h: Column, width_fraction: float, width: int, height: int) -> Column:
    """The inner part of a face's box, as wide as `width_fraction` of it, rounded and inside the frame."""
    margin = w * (1 - width_fraction) / 2
    left, top = F.bround(F.greatest(F.lit(0.0), x + margin)), F.bround(F.greatest(F.lit(0.0), y))
    right, bottom = F.bround(F.least(F.lit(float(width)), x + w - margin)), F.bround(F.least(F.lit(float(height)), y + h))
    return F.struct(left.cast("int").alias("x"), top.cast("int").alias("y"), F.greatest(F.lit(0), (right - left).cast("int")).alias("w"), F.greatest(F.lit(0), (bottom - top).cast("int")).alias("h"))


def sensor_name(stem: Column) -> Column:
    """A sensor's name from its file's: parts capitalised, `ecg` in capitals."""
    part = lambda p: F.when(F.lower(p) == "ecg", F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))))
    return F.array_join(F.transform(F.split(stem, "_"), part), "_")


def frame_to_ms(frame: Column, fps: Column) -> Column:
    return F.ceil(frame * 1000 / fps - 1e-6)


def ms_to_frame(ms: Column, fps: Column) -> Column:
    return F.floor(ms * fps / 1000 + 1e-6)


def trace_key(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def segment_folder(idx: Column, label: Column) -> Column:
    return F.format_string("%04d_%s", idx, F.regexp_replace(label, " ", "_"))


def clean_labels(labels: Column) -> Column:
    """Trimmed labels without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != ""))


def label_color(label: Column, library: Column, palette: Column) -> Column:
    """The palette colour at the label's place in the library, else at its CRC-32, both modulo the palette."""
    place = F.array_position(library, label)
    n = F.size(palette)
    return F.element_at(palette, (F.pmod(F.when(place > 0, place - 1).otherwise(F.crc32(label.cast("binary"))), n) + 1).cast("int"))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes; 0 for empty ones."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def expanded_region(x: Column, y: Column, w: Column, h: Column, width: int, height: int, margin: float) -> Column:
    """The box with a margin on each side (1.3 times as much on top), rounded and inside the frame."""
    left, top = F.greatest(F.lit(0), F.bround(x - w * margin)), F.greatest(F.lit(0), F.bround(y - h * margin * 1.3))
    right, bottom = F.least(F.lit(width), F.bround(x + w + w * margin)), F.least(F.lit(height), F.bround(y + h + h * margin))
    return F.struct(left.cast("int").alias("x"), top.cast("int").alias("y"), (right - left).cast("int").alias("w"), (bottom - top).cast("int").alias("h"))
