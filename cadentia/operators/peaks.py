"""Peaks of signals of any length: filtered in blocks, reduced to turning points, chosen by session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.functions import dsp
from cadentia.operators.beats import mad, sampling_rate
from cadentia.operators.dealing import dealt
from cadentia.operators.running import along, with_halo
from cadentia.operators.storage import stored

#: Samples that a task filters at once, besides the halo.
BLOCK = 200_000
#: Seconds beside a block that its filtering sees.  What the filter remembers fades by e in 1 / (pi times the low edge) seconds or
#: sooner: at 5 Hz by 1e-27 in 4 seconds.
HALO_SEC = 4.0


def placed(samples: DataFrame) -> DataFrame:
    """samples (session_id, us, value) without nulls, the least value of each time, plus k, the place in the session from 0."""
    rows = samples.filter("us IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)").groupBy("session_id", "us").agg(F.min(F.col("value").cast("double")).alias("value"))
    return along(rows, ["session_id"], ["us"], sums={"k": F.lit(1)}).withColumn("k", F.col("k") - 1)


def filtered(rows: DataFrame, rates: DataFrame, low: float, high: float, order: int, block: int = BLOCK) -> DataFrame:
    """rows of placed() with the value band-passed.  A session is cut into blocks of samples; each is filtered with HALO_SEC more on both
    sides, so the result is that of the whole session but for rounding."""
    halo = F.ceil(F.col("rate_hz") * HALO_SEC).cast("long")
    cut = with_halo(rows.join(rates, "session_id"), F.col("k"), block, halo, halo)
    kind = dict(rows.dtypes)["session_id"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        value = dsp.bandpass(part["value"].to_numpy(), part["rate_hz"].iloc[0], low, high, order)
        return part.assign(value=value)[part["__own"].to_numpy()][["session_id", "us", "value", "k"]]

    return dealt(cut, "session_id", "__block").groupBy("session_id", "__block").applyInPandas(run, f"session_id {kind}, us long, value double, k long")


def turning_points(rows: DataFrame) -> DataFrame:
    """(session_id, first, last, level): the runs of equal values that are higher or lower than both neighbours, and the two ends, of
    rows (session_id, k, value); k counts from 0 without gaps.  In buckets, whatever a session's length."""
    before = along(rows.select("session_id", "k", "value"), ["session_id"], ["k"], lags={"last_value": "value"})
    runs = before.filter("last_value IS NULL OR value <> last_value").select("session_id", "k", "value")
    ends = rows.groupBy("session_id").agg(F.max("k").alias("end"))
    near = along(runs, ["session_id"], ["k"], lags={"a": "value"}, leads={"b": "value", "next_k": "k"})
    turns = near.filter("a IS NULL OR b IS NULL OR (value > a) <> (b > value)")
    last = F.coalesce(F.col("next_k") - 1, F.col("end"))
    return turns.join(ends, "session_id").select("session_id", F.col("k").alias("first"), last.alias("last"), F.col("value").alias("level"))


def peaks(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """(session_id, us, ord, prominence) of the peaks of rows (session_id, us, value, k) under limits (session_id, distance, prominence).

    What goes to one task is a session's turning points; there peaks are chosen in linear time."""
    points = turning_points(rows).join(limits.select("session_id", "distance", "prominence"), "session_id")
    kind = dict(rows.dtypes)["session_id"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("first")
        first, last, level = (part[c].to_numpy() for c in ("first", "last", "level"))
        at, heights = dsp.choose_peaks(first, last, level, int(part["distance"].iloc[0]), part["prominence"].iloc[0])
        return pd.DataFrame({"session_id": np.full(len(at), part["session_id"].iloc[0]), "ord": at, "prominence": heights})

    found = dealt(points, "session_id").groupBy("session_id").applyInPandas(run, f"session_id {kind}, ord long, prominence double")
    return found.join(rows.select("session_id", F.col("k").alias("ord"), "us"), ["session_id", "ord"]).select("session_id", "us", "ord", "prominence")


def _distance(seconds: float):
    return F.greatest(F.lit(1), F.bround(F.col("rate_hz") * seconds)).cast("long")


def ecg_peaks(ecg: DataFrame, block: int = BLOCK) -> DataFrame:
    """Candidate R peaks of (session_id, us, value): session_id, us, ord, prominence; strong_peaks() finishes them.

    Band-pass 5 to 25 Hz, distance 0.35 s, prominence 4 median absolute deviations; flat or short signals (fewer than 10
    samples, or two peaks) have none.  Null values are left out; of samples with one time the least counts.  A session sampled at 50 Hz
    or less, which can't hold the band, fails the job."""
    rows = stored(placed(ecg.select("session_id", "us", "value")), "ecg-placed")
    fine = rows.groupBy("session_id").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).filter("n >= 10 AND low < high").select("session_id")
    rates = stored(sampling_rate(rows).join(fine, "session_id", "left_semi"), "ecg-rates")
    calm = stored(filtered(rows, rates, 5.0, 25.0, 3, block), "ecg-filtered")
    scale = mad(calm.withColumn("sensor_id", F.lit(0)))
    found = peaks(calm, rates.join(scale, "session_id").select("session_id", _distance(0.35).alias("distance"), (4 * F.col("mad")).alias("prominence")))
    several = found.groupBy("session_id").count().filter("count > 1")
    return found.join(several, "session_id", "left_semi")


def ppg_pulses(ppg: DataFrame, share: float = 0.05, apart_sec: float = 0.3) -> DataFrame:
    """(session_id, us, ord) of the pulses of (session_id, us, value): peaks `apart_sec` apart whose prominence is `share` of the
    session's range.  Null values are left out; flat signals and those of fewer than three samples have none."""
    rows = stored(placed(ppg.select("session_id", "us", "value")), "ppg-placed")
    wide = rows.groupBy("session_id").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("range")).filter("n >= 3 AND range > 0")
    limits = sampling_rate(rows).join(wide, "session_id").select("session_id", _distance(apart_sec).alias("distance"), (share * F.col("range")).alias("prominence"))
    return peaks(rows, limits).select("session_id", "us", "ord")
