"""Beats, intervals between them, heart-rate variability and agreement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadentia.functions import dsp
from cadentia.operators.dealing import in_groups
from cadentia.operators.joins import asof_backward
from cadentia.operators.running import along, quantile, with_halo


def rr_intervals(beats: DataFrame) -> DataFrame:
    """beats plus rr_ms, the time since the beat before; null for a session's first beat."""
    return along(beats, ["session_id"], ["us", "ord"], lags={"__before": "us"}).withColumn("rr_ms", (F.col("us") - F.col("__before")) / 1000).drop("__before")


def reference_hrv(references: DataFrame) -> DataFrame:
    """References (session_id, us, value) of heart-rate variability that can be one: 1 to 1,000 ms."""
    return references.filter(F.col("value").between(1, 1000))


def accept_intervals(ibi: DataFrame, block: int = 100_000) -> DataFrame:
    """ibi (session_id, ord, ibi_ms) plus accepted: 300 to 2000 ms, and 0.6 to 1.6 times the median of the 11
    intervals around it.  Intervals are numbered in their session and dealt in blocks, with five more at each edge."""
    near = Window.partitionBy("session_id", "__block").orderBy("ord").rowsBetween(-5, 5)
    placed = along(ibi, ["session_id"], ["ord"], sums={"__k": F.lit(1)})
    rows = with_halo(placed, F.col("__k"), block, 5, 5).withColumn("local_ms", F.expr("percentile(ibi_ms, 0.5)").over(near)).filter("__own")
    return rows.drop("__k", "__block", "__own").withColumn("accepted", F.col("ibi_ms").between(300, 2000) & (F.col("ibi_ms") / F.col("local_ms")).between(0.6, 1.6))


def strong_peaks(peaks: DataFrame, share: float = 0.25, half_us: int = 5_000_000, block_us: int = 600_000_000) -> DataFrame:
    """Peaks (session_id, us, prominence, ...) plus local, the 90th percentile of the prominences over (t - half, t + half], where their own is
    `share` of it at least.  A task orders a block of time and the peaks near it; the percentile moves with the frame, at a
    logarithm of its size a step."""
    near = with_halo(peaks, F.col("us"), block_us, half_us, half_us)
    names = peaks.columns
    out = T.StructType([*peaks.schema, T.StructField("local", T.DoubleType())])

    def run(rows: pa.Table, begins: np.ndarray) -> pa.Table:
        us, height = rows["us"].to_numpy(), rows["prominence"].cast("double").to_numpy()
        low, high = np.empty(len(us), np.int64), np.empty(len(us), np.int64)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(us)], strict=True):
            own = us[a:b]
            low[a:b], high[a:b] = a + np.searchsorted(own, own - half_us, "right"), a + np.searchsorted(own, own + half_us, "right")
        local = dsp.sliding_quantile(height, low, high, 0.9)
        keep = np.flatnonzero(rows["__own"].to_numpy() & (height >= share * local))
        return rows.select(names).take(keep).append_column("local", pa.array(local[keep]))

    return in_groups(near, ["session_id", "__block"], ["us"], run, out)


def hrv(ibi: DataFrame, window: int = 300, least: int = 30, block: int = 50_000) -> DataFrame:
    """SDNN and RMSSD of the last `window` accepted intervals at each whole second from the `least`-th on.

    ibi: session_id, ord, us (end of the interval), ibi_ms, accepted.  Pairs for RMSSD are neighbours in the
    original sequence and inside the window; rejected intervals are those that end in the window's span.
    A session is shared by many tasks: sums and neighbours are carried between buckets, the frames over the last accepted
    intervals lie in blocks that have `window` of them from the block before, and an as-of join tells how many had been rejected
    when a frame begins."""
    one = lambda c: F.when(c, 1).otherwise(0)
    told = along(
        ibi, ["session_id"], ["us", "ord"], lags={"__accepted": "accepted", "__ms": "ibi_ms"}, leads={"next_us": "us"},
        sums={"k": one(F.col("accepted")), "rejected": one(~F.col("accepted"))},
    )
    ends = ibi.filter("accepted").groupBy("session_id").agg(F.max("us").alias("end_us"))
    rows = told.select(
        "session_id", "us", "ord", "k", "rejected", "next_us",
        F.when(F.col("accepted"), F.col("ibi_ms")).alias("good"),
        F.when(F.col("accepted") & F.col("__accepted"), F.pow(F.col("ibi_ms") - F.col("__ms"), 2)).alias("square"),
    )
    # A rejected interval has the k of the accepted one before it, and so its figures.
    along_k = Window.partitionBy("session_id", "__block").orderBy("k")
    frame, pairs = along_k.rangeBetween(-(window - 1), 0), along_k.rangeBetween(-(window - 2), 0)
    framed = with_halo(rows, F.col("k"), max(block, window), window - 1, 0).select(
        "*",
        F.stddev_samp("good").over(frame).alias("sdnn_ms"),
        F.sqrt(F.avg("square").over(pairs)).alias("rmssd_ms"),
        F.count("good").over(frame).alias("accepted_intervals"),
        F.min(F.col("us") - F.round(F.col("good") * 1000).cast("long")).over(frame).alias("from_us"),
    ).filter(F.col("__own") & (F.col("k") >= least))
    asked = framed.select("session_id", F.col("from_us").alias("us"), "ord", F.col("us").alias("at_us"), "next_us", "sdnn_ms", "rmssd_ms", "accepted_intervals", "rejected")
    lines = asof_backward(asked, rows.select("session_id", "us", "ord", "rejected"), payload=["rejected"]).join(ends, "session_id")
    second = 1_000_000
    first, last = F.ceil(F.col("at_us") / second), F.floor(F.least(F.col("next_us") - 1, F.col("end_us")) / second)
    before = F.coalesce(F.col("hit.rejected"), F.lit(0))
    out = lines.filter(first <= last).withColumn("sec", F.explode(F.sequence(first, last))).withColumn("rejected_intervals", F.col("rejected") - before)
    return out.select("session_id", (F.col("sec") * second).alias("at_us"), "sdnn_ms", "rmssd_ms", "accepted_intervals", "rejected_intervals", (F.col("accepted_intervals") / (F.col("accepted_intervals") + F.col("rejected_intervals"))).alias("quality_fraction"))


def agreement(pairs: DataFrame) -> DataFrame:
    """n, MAE, RMSE, bias and Pearson r of estimate against reference."""
    d = F.col("estimate") - F.col("reference")
    return pairs.groupBy("session_id").agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.try_divide(F.covar_pop("estimate", "reference"), F.stddev_pop("estimate") * F.stddev_pop("reference")).alias("r"))


def sampling_rate(samples: DataFrame) -> DataFrame:
    """One over the median of the positive time differences."""
    steps = along(samples.select("session_id", "us").withColumn("one", F.lit(1)), ["session_id"], ["us"], lags={"before": "us"})
    steps = steps.select("session_id", ((F.col("us") - F.col("before")) / 1e6).alias("step")).filter("step > 0")
    return quantile(steps, ["session_id"], "step", 0.5, "middle").select("session_id", (1 / F.col("middle")).alias("rate_hz"))


def normalise(samples: DataFrame) -> DataFrame:
    """samples plus scaled: 0 to 1 over the session and sensor; constant signals are 0."""
    ends = samples.groupBy("session_id", "sensor_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    return samples.join(ends, ["session_id", "sensor_id"]).withColumn("scaled", scaled).drop("low", "high")


def mad(samples: DataFrame) -> DataFrame:
    """Median absolute deviation from the median, not scaled."""
    keys = ["session_id", "sensor_id"]
    middle = quantile(samples, keys, "value", 0.5, "middle")
    off = samples.join(middle, keys).withColumn("off", F.abs(F.col("value") - F.col("middle")))
    return quantile(off, keys, "off", 0.5, "mad")


def value_bounds(samples: DataFrame, low_us: int | None = None, high_us: int | None = None) -> DataFrame:
    """Bounds of a plot: least and greatest value in [low_us, high_us] (all, if not given) with a margin of 5 %, or of 0.5 at least
    for a flat signal.  A sensor without a finite value there has none."""
    if low_us is not None:
        samples = samples.filter(F.col("us") >= low_us)
    if high_us is not None:
        samples = samples.filter(F.col("us") <= high_us)
    ends = samples.filter("abs(value) < double('inf')").groupBy("session_id", "sensor_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    margin = F.when(F.col("high") > F.col("low"), 0.05 * (F.col("high") - F.col("low"))).otherwise(F.greatest(0.05 * F.abs("high"), F.lit(0.5)))
    return ends.select("session_id", "sensor_id", (F.col("low") - margin).alias("low"), (F.col("high") + margin).alias("high"))
