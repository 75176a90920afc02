"""Jobs on waveforms: Spark keys and shuffles by session (and clip), numpy works on one group at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadentia.functions import dsp
from cadentia.operators.dealing import dealt
from cadentia.operators.joins import held

# Fixed values of the published pulse model (Tang et al. 2020), in radians of the beat's angle.
PULSE_CENTRE = (-1.6184, 0.8903)
PULSE_HEIGHT = (0.7482, 0.0444)
PULSE_WIDTH = (0.9353, 1.9499)


def synthesize_ppg(beats: DataFrame, fs: float = 125.0) -> DataFrame:
    """A synthetic pulse wave of beats (session_id, us): samples at fs between the first and last beat, the closed form of two
    Gaussians' primitives in the angle of the beat (-pi at its start), less the step at its end, scaled to 0 to 1 in the session.
    The pulse's peak lies at 24.7 % of the beat."""
    order = Window.partitionBy("session_id").orderBy("us")
    first = F.min("us").over(Window.partitionBy("session_id"))
    rows = beats.withColumn("t0", (F.col("us") - first) / 1e6).withColumn("next_us", F.lead("us").over(order)).filter("next_us IS NOT NULL").withColumn("t1", F.col("t0") + (F.col("next_us") - F.col("us")) / 1e6).withColumn("origin", F.col("us") - F.round(F.col("t0") * 1_000_000).cast("long"))
    k0, k1 = F.ceil(F.col("t0") * fs - 1e-9), F.ceil(F.col("t1") * fs - 1e-9) - 1
    samples = rows.filter(k1 >= k0).withColumn("k", F.explode(F.sequence(k0, k1)))
    angle = 2 * np.pi * (F.col("k") / fs - F.col("t0")) / (F.col("t1") - F.col("t0")) - np.pi
    wave = lambda x: sum(a * w * w / 4 * F.exp(-F.pow((x - c) / w, 2)) for c, a, w in zip(PULSE_CENTRE, PULSE_HEIGHT, PULSE_WIDTH, strict=True))
    step = wave(F.lit(np.pi)) - wave(F.lit(-np.pi))
    raw = samples.select("session_id", (F.col("origin") + F.round(F.col("k") * (1_000_000 / fs)).cast("long")).alias("us"), (wave(angle) - step * (angle + np.pi) / (2 * np.pi)).alias("raw"))
    ends = raw.groupBy("session_id").agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return raw.join(ends, "session_id").select("session_id", "us", F.when(F.col("high") > F.col("low"), (F.col("raw") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0).alias("value"))


def prepare_reference(references: DataFrame) -> DataFrame:
    """References (session_id, segment_idx, t_sec, value) on an even grid, band-passed 0.7 to 3.5 Hz and standardised; null and
    other values that are not finite are left out, and fewer than 16 samples are standardised only.  A clip is a task's work."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        t, x = dsp.prepare_reference(rows["t_sec"].to_numpy(float), rows["value"].to_numpy(float))
        return pd.DataFrame({"session_id": rows["session_id"].iloc[0], "segment_idx": rows["segment_idx"].iloc[0], "t_sec": t, "value": x})

    return dealt(references.select("session_id", "segment_idx", "t_sec", "value"), "session_id", "segment_idx").groupBy("session_id", "segment_idx").applyInPandas(run, "session_id long, segment_idx long, t_sec double, value double")


def window_correlations(pulses: DataFrame, references: DataFrame, windows: DataFrame, fs: float, max_lag: float = 10.0, step: float = 0.02, margin: float = 2.0) -> DataFrame:
    """Lag curves of analysis windows: pulses (session_id, segment_idx, frame_idx, value, and detected if known) against
    references (session_id, segment_idx, t_sec, value) for windows (session_id, segment_idx, win_idx, win_start, win_end).

    A row per lag at which the correlation is known, with the window's heart rates in pulse and reference (null if too short)
    and its face coverage (1 if `detected` is not given); a window without any has one row with a null lag.  A window is a
    task's work, however long its clip; it is given the reference up to the greatest lag and `margin` seconds beyond,
    which must be no less than the reference's step."""
    keys = ["session_id", "segment_idx", "win_idx"]
    lags = np.round(np.arange(-round(max_lag / step), round(max_lag / step) + 1) * step, 6)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "lag_idx", "lag", "corr", "video_hr", "reference_hr", "face_coverage"]
        if left.empty:
            return pd.DataFrame(columns=names)
        left, right = left.sort_values("frame_idx"), right.dropna().sort_values("t_sec")
        t, ref = right["t_sec"].to_numpy(), right["value"].to_numpy()
        frame = left["frame_idx"].to_numpy()
        pulse = np.full(frame[-1] - frame[0] + 1, np.nan)
        pulse[frame - frame[0]] = left["value"].to_numpy(float)
        curve = dsp.lag_scan(pulse, fs, t - frame[0] / fs, ref, lags)
        at = np.flatnonzero(np.isfinite(curve))
        inside = (t >= left["win_start"].iloc[0]) & (t <= left["win_end"].iloc[0])
        rate = 1 / np.median(np.diff(t)) if len(t) > 1 and np.median(np.diff(t)) > 0 else np.inf
        known = pulse[np.isfinite(pulse)]
        rates = dsp.dominant_rate(known, fs), dsp.dominant_rate(ref[inside], rate)
        whole = [left[k].iloc[0] for k in keys]
        found = (at, lags[at], curve[at]) if len(at) else ([None], [None], [None])
        out = pd.DataFrame(dict(zip(["lag_idx", "lag", "corr"], found, strict=True)))
        fixed = dict(zip([*keys, "video_hr", "reference_hr", "face_coverage"], [*whole, *rates, left["detected"].mean()], strict=True))
        return out.assign(**fixed)[names]

    own = pulses if "detected" in pulses.columns else pulses.withColumn("detected", F.lit(True))
    second = (F.col("frame_idx") / fs).alias("second")
    frames = own.select("session_id", "segment_idx", "frame_idx", "value", F.coalesce(F.col("detected").cast("double"), F.lit(0.0)).alias("detected"), second)
    spans = windows.select(*keys, "win_start", "win_end")
    inside = held(frames, spans, keys[:2], "second", "win_start", "win_end")
    reach = max_lag + margin
    wider = windows.select(*keys, (F.col("win_start") - reach).alias("near_start"), (F.col("win_end") + reach).alias("near_end"))
    near = held(references.select("session_id", "segment_idx", "t_sec", "value"), wider, keys[:2], "t_sec", "near_start", "near_end")
    # New names for its columns, as both sides may come from one table.
    near = near.select(*(F.col(c).alias(c) for c in (*keys, "t_sec", "value")))
    out = dealt(inside, *keys).groupBy(*keys).cogroup(dealt(near, *keys).groupBy(*keys)).applyInPandas(run, "session_id long, segment_idx long, win_idx long, lag_idx long, lag double, corr double, video_hr double, reference_hr double, face_coverage double")
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("video_hr", "reference_hr")})


def estimate_pulse(traces: DataFrame, fs: float, method: str = "POS") -> DataFrame:
    """Pulse of each clip from its mean colours (session_id, segment_idx, frame_idx, r, g, b); frames that lack a colour
    are interpolated whole."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx")
        rgb = rows[["r", "g", "b"]]
        rgb = rgb.where(rgb.notna().all(axis=1)).interpolate(limit_direction="both").fillna(0.0).to_numpy()
        return rows[["session_id", "segment_idx", "frame_idx"]].assign(value=dsp.pulse_from_rgb(rgb, fs, method))

    traces = traces.select("session_id", "segment_idx", "frame_idx", "r", "g", "b")
    return dealt(traces, "session_id", "segment_idx").groupBy("session_id", "segment_idx").applyInPandas(run, "session_id long, segment_idx long, frame_idx long, value double")
