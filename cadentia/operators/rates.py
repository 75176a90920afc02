"""Heart rate over sliding windows, its harmonic correction, and the drift of pulses against beats."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadentia.functions import dsp
from cadentia.operators.joins import asof_backward
from cadentia.operators.running import along


def sample_index(samples: DataFrame) -> DataFrame:
    """samples (session_id, us, ord, value) plus k, the place in the session from 0."""
    return along(samples, ["session_id"], ["us", "ord"], sums={"k": F.lit(1)}).withColumn("k", F.col("k") - 1)


def hr_windows(indexed: DataFrame, fs: float, targets: DataFrame | None = None, seconds: float = 10.0, step_sec: float = 1.0) -> DataFrame:
    """Complete windows as (session_id, start, at_us): one each step, stamped between its first and last sample; with
    targets (session_id, us) one around each different target, moved to lie inside the session.

    Sessions shorter than a window, and targets of unknown sessions, have none."""
    length, step = round(seconds * fs), round(step_sec * fs)
    if length < 9 or step < 1:
        raise ValueError("windows need 9 samples or more, and steps one or more")
    sizes = indexed.groupBy("session_id").agg(F.count("*").alias("n"), F.min("us").alias("first_us")).filter(F.col("n") >= length)
    if targets is not None:
        at = targets.select("session_id", "us").filter("us IS NOT NULL").distinct().join(sizes, "session_id")
        middle = F.bround((F.col("us") - F.col("first_us")) / 1e6 * fs).cast("long")
        return at.select("session_id", F.greatest(F.lit(0), F.least(middle - length // 2, F.col("n") - length)).alias("start"), F.col("us").alias("at_us"))
    starts = sizes.select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - length, F.lit(step).cast("long"))).alias("start"))
    ends = indexed.select("session_id", "k", "us")
    low = starts.join(ends.withColumnsRenamed({"k": "start", "us": "low_us"}), ["session_id", "start"])
    both = low.join(ends.select("session_id", (F.col("k") - length + 1).alias("start"), F.col("us").alias("high_us")), ["session_id", "start"])
    return both.select("session_id", "start", F.floor((F.col("low_us") + F.col("high_us")) / 2).alias("at_us"))


def hr_features(indexed: DataFrame, windows: DataFrame, fs: float, seconds: float = 10.0, low: float = 0.6, high: float = 3.3) -> DataFrame:
    """bpm, half_bpm, half_ratio and acf_bpm of each window.

    A session is cut into blocks of sixty windows' worth of seconds; a sample goes to its own block and, near the
    block's start, to the one before, so a long session is shared by many tasks of bounded size."""
    if not 0 < low < high < fs / 2:
        raise ValueError("0 < low < high < fs / 2")
    length = round(seconds * fs)
    block = max(length, round(60 * fs))
    own = F.floor(F.col("k") / block)
    wanted = F.when(F.col("k") % block < length - 1, F.array(own - 1, own)).otherwise(F.array(own))
    left = indexed.select("session_id", "k", "value", F.explode(wanted).alias("block")).groupBy("session_id", "block")
    right = windows.select(F.col("session_id").alias("session"), F.col("start").alias("start"), F.col("at_us").alias("at_us"), F.floor(F.col("start") / block).alias("part")).groupBy("session", "part")
    names = ["bpm", "half_bpm", "half_ratio", "acf_bpm"]

    def run(samples: pd.DataFrame, wins: pd.DataFrame) -> pd.DataFrame:
        if samples.empty or wins.empty:
            return pd.DataFrame({"session_id": pd.Series(dtype="int64"), "start": [], "at_us": [], **{c: [] for c in names}})
        samples = samples.sort_values("k")
        starts, back = np.unique(wins["start"].to_numpy(), return_inverse=True)
        values = samples["value"].interpolate(limit_direction="both").fillna(0.0).to_numpy()
        places = np.searchsorted(samples["k"].to_numpy(), starts)
        found = dsp.rate_features(values[places[:, None] + np.arange(length)], fs, low, high)
        return wins[["session", "start", "at_us"]].rename(columns={"session": "session_id"}).assign(**{c: found[c][back] for c in names})

    kind = dict(indexed.dtypes)["session_id"]
    return left.cogroup(right).applyInPandas(run, f"session_id {kind}, start long, at_us long, " + ", ".join(f"{c} double" for c in names))


def resolve_harmonics(features: DataFrame, history: int = 5) -> DataFrame:
    """(session_id, at_us, heart_rate_bpm): half_bpm where the strongest frequency is a second harmonic, else bpm.

    By autocorrelation: bpm is 1.6 to 2.4 times acf_bpm and half_bpm within 30 % of it, unless bpm is within 10 % of the
    median of the last outputs.  By continuity: the same against that median, with a half_ratio of 0.2 or more.
    The outputs feed the next decision, so a session (one row a second) is folded in one task."""

    def twice(bpm: float, half: float, base: float) -> bool:
        return 1.6 * base < bpm < 2.4 * base and abs(half - base) <= 0.3 * base

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at_us", "start"])
        out: list[float] = []
        for bpm, half, ratio, acf in rows[["bpm", "half_bpm", "half_ratio", "acf_bpm"]].itertuples(index=False):
            usual = float(np.median(out[-history:])) if out else None
            moved = usual is None or abs(bpm - usual) > 0.1 * usual
            harmonic = moved and twice(bpm, half, acf) or usual is not None and ratio >= 0.2 and twice(bpm, half, usual)
            out.append(half if harmonic else bpm)
        return rows[["session_id", "at_us"]].assign(heart_rate_bpm=out)

    kind = dict(features.dtypes)["session_id"]
    return features.groupBy("session_id").applyInPandas(run, f"session_id {kind}, at_us long, heart_rate_bpm double")


def pulse_phases(pulses: DataFrame, beats: DataFrame) -> DataFrame:
    """pulses (session_id, us, ord) plus phase in [0, 1): how far from the beat before to the next; pulses outside the
    beats (session_id, us, ord) are left out."""
    order = Window.partitionBy("session_id").orderBy("us")
    spans = beats.groupBy("session_id", "us").agg(F.max("ord").alias("ord")).withColumn("value", (F.lead("us").over(order) - F.col("us")).cast("double"))
    at = asof_backward(pulses, spans)
    return at.filter("hit.value > 0").select("session_id", "us", "ord", ((F.col("us") - F.col("hit.us")) / F.col("hit.value")).alias("phase")).filter("phase < 1")


def phase_drift(phases: DataFrame, block: int = 60) -> DataFrame:
    """drift_beats of each session: range of the unwrapped circular mean phase over whole blocks of `block` pulses; null with
    fewer than two."""
    placed = along(phases, ["session_id"], ["us", "ord"], sums={"k": F.lit(1)})
    rows = placed.withColumn("block", F.floor((F.col("k") - 1) / block))
    turn = F.col("phase") * (2 * math.pi)
    means = rows.groupBy("session_id", "block").agg(F.count("*").alias("n"), F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn))).alias("angle")).withColumn("angle", F.when(F.col("n") == block, F.col("angle")))
    ahead = Window.partitionBy("session_id").orderBy("block")
    step = F.col("angle") - F.lag("angle").over(ahead)
    means = means.withColumn("step", F.coalesce(step - 2 * math.pi * F.floor(step / (2 * math.pi) + 0.5), F.lit(0.0)))
    way = means.withColumn("way", F.when(F.col("angle").isNotNull(), F.sum("step").over(ahead)))
    return way.groupBy("session_id").agg(F.count("way").alias("blocks"), ((F.max("way") - F.min("way")) / (2 * math.pi)).alias("range")).select("session_id", "blocks", F.when(F.col("blocks") >= 2, F.col("range")).alias("drift_beats"))
