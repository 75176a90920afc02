"""Work cut into buckets and blocks against the same work in one piece."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadentia.functions import dsp
from cadentia.operators import beats, intervals, joins, peaks, rates, running, sync, waveforms
from cadentia.operators.dealing import in_groups

#: Number of values, one of 0.7 times their 90th percentile, and the others.
TIES = [(4, 448, 300, 507, 697), (5, 504, 300, 300, 510, 860), (7, 392, *[300] * 4, 504, 644), (9, 392, *[300] * 6, 507, 772)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def samples(spark):
    rng = random.Random(1)
    data = [(s, rng.randrange(5_000), i, rng.choice([None, 1.0, 2.5, rng.random()])) for i, s in enumerate([7] * 600 + [8] * 30 + [9])]
    return spark.createDataFrame(data, "session_id long, us long, ord long, value double").repartition(4)


@pytest.mark.parametrize("each", [1, 7, 100, 10_000])
def test_carried_windows(samples, each):
    order = ["us", "ord"]
    got = running.along(samples, ["session_id"], order, {"lag": "value"}, {"lead": "value"}, {"n": F.lit(1), "s": F.col("ord")}, {"back": "value"}, {"ahead": "value"}, each)
    w = Window.partitionBy("session_id").orderBy(*order)
    up, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = samples.select("*", F.lag("value").over(w), F.lead("value").over(w), F.count("*").over(up), F.sum("ord").over(up), F.last("value", True).over(up), F.first("value", True).over(on))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_quantiles_of_a_sketch_and_a_count(spark, samples, q):
    for accuracy in (4, 50, 10_000):
        got = running.quantile(samples, ["session_id"], "value", q, "q", accuracy)
        want = {r.session_id: r.q for r in samples.groupBy("session_id").agg(F.expr(f"percentile(value, {q})").alias("q")).collect()}
        found = {r.session_id: r.q for r in got.collect()}
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], rel=1e-12) if want[k] is not None else found[k] is None for k in want)
    assert "percentile(" not in plan(got)


def test_hrv_and_accepted_intervals_in_blocks(spark):
    rng = random.Random(5)
    data, us = [], {1: 0, 2: 0}
    for i in range(700):
        s = 1 if i % 5 else 2
        ms = rng.choice([rng.uniform(700, 900), rng.uniform(700, 900), rng.uniform(700, 900), 100.0, 5000.0])
        us[s] += round(ms * 1000)
        data.append((s, i, us[s], ms))
    ibi = spark.createDataFrame(data, "session_id long, ord long, us long, ibi_ms double")
    whole = beats.accept_intervals(ibi)
    assert rows(whole) == rows(beats.accept_intervals(ibi, block=9))
    one, many = beats.hrv(whole, 40, 10), beats.hrv(whole, 40, 10, block=40)
    a, b = rows(one), rows(many)
    assert len(a) > 100 and len(a) == len(b) and all(x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], nan_ok=True) for x, y in zip(a, b))
    # against a plain walk
    for s in (1, 2):
        own = sorted((r.us, r.ibi_ms, r.accepted) for r in whole.filter(F.col("session_id") == s).collect())
        good = [(k, u, ms) for k, (u, ms, ok) in enumerate(own) if ok]
        for r in (r for r in one.collect() if r.session_id == s):
            used = [g for g in good if g[1] <= r.at_us][-40:]
            squares = [(b[2] - a[2]) ** 2 for a, b in zip(used, used[1:]) if b[0] == a[0] + 1]
            assert r.accepted_intervals == len(used)
            assert r.sdnn_ms == pytest.approx(np.std([g[2] for g in used], ddof=1)) and r.rmssd_ms == pytest.approx(np.sqrt(np.mean(squares)))
            start = used[0][1] - round(used[0][2] * 1000)
            assert r.rejected_intervals == sum(not ok and start < u <= r.at_us for u, _, ok in own)


def test_strong_peaks_in_blocks(spark):
    rng = random.Random(6)
    data = [(1, rng.randrange(400_000), rng.random()) for _ in range(500)] + [(2, 5, 0.5)]
    df = spark.createDataFrame(data, "session_id long, us long, prominence double")
    near = Window.partitionBy("session_id").orderBy("us").rangeBetween(-9_999, 10_000)
    want = df.withColumn("local", F.expr("percentile(prominence, 0.9)").over(near)).filter("prominence >= 0.5 * local")
    for block in (15_000, 10**9):
        got = beats.strong_peaks(df, 0.5, 10_000, block)
        assert [r[:3] for r in rows(got)] == [r[:3] for r in rows(want)] and [r[3] for r in rows(got)] == pytest.approx([r[3] for r in rows(want)])


def test_sliding_quantile_is_near_linear():
    x = np.random.default_rng(0).random(400_000)
    took = []
    for n in (100_000, 400_000):
        low = np.maximum(np.arange(n) - 1_250, 0)
        high = np.minimum(np.arange(n) + 1_250, n)
        began = time.perf_counter()
        out = dsp.sliding_quantile(x[:n], low, high, 0.9)
        took.append(time.perf_counter() - began)
        assert out[n // 2] == pytest.approx(np.quantile(x[low[n // 2] : high[n // 2]], 0.9))
    assert took[1] < 12 * took[0]


def quadratic_peaks(x, distance, prominence):
    """Peaks by the definition: each looks for the next higher sample on both sides."""
    edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    end, level = np.append(edge[1:], len(x)) - 1, x[edge]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    found = (edge[top] + end[top]) // 2
    keep = np.ones(len(found), bool)
    if distance > 1:
        for i in np.argsort(x[found], kind="stable")[::-1]:
            if keep[i]:
                keep[np.abs(found - found[i]) < distance] = False
                keep[i] = True
    out = []
    for p in found[keep]:
        left, right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
        a, b = (left[-1] + 1 if len(left) else 0), (p + 1 + right[0] if len(right) else len(x))
        height = x[p] - max(x[a : p + 1].min(), x[p:b].min())
        if height >= prominence:
            out.append((p, height))
    return out


@pytest.mark.parametrize("kind", ["noise", "steps", "walk", "flat", "up", "waves"])
def test_peaks_by_a_stack_against_the_definition(kind):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 400):
        x = {"noise": rng.random(n), "steps": rng.integers(0, 4, n).astype(float), "walk": rng.normal(size=n).cumsum(), "flat": np.ones(n), "up": np.arange(n, dtype=float), "waves": np.sin(np.arange(n) / 7) * np.arange(n)}[kind]
        for distance, prominence in ((1, 0.0), (5, 0.3), (40, 1.0)):
            at, heights = dsp.find_peaks(x, distance, prominence)
            assert list(zip(at, heights)) == quadratic_peaks(x, distance, prominence)


def test_peaks_take_linear_time():
    assert not len(dsp.find_peaks(np.zeros(0))[0])
    took = []
    for n in (200_000, 800_000):
        x = np.sin(np.arange(n) / 30) * np.linspace(1, 2, n)  # each peak is higher than all before
        began = time.perf_counter()
        assert len(dsp.find_peaks(x, 50, 0.5)[0]) > n / 200
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_ecg_peaks_over_the_edges_of_blocks(spark):
    """The same as the whole session at once in numpy, whatever the block."""
    rng = np.random.default_rng(7)
    fs, n = 250, 9_000
    t = np.arange(n) / fs
    beat = np.cumsum(rng.uniform(0.6, 1.1, 60))
    x = sum(np.exp(-0.5 * ((t - b) / 0.015) ** 2) * h for b, h in zip(beat, rng.uniform(0.7, 1.3, 60))) + 0.1 * np.sin(t) + 0.02 * rng.normal(size=n)
    calm = dsp.bandpass(x, fs, 5.0, 25.0, 3)
    at, heights = dsp.find_peaks(calm, round(0.35 * fs), 4 * np.median(np.abs(calm - np.median(calm))))
    data = [(1, round(a * 1e6), float(v)) for a, v in zip(t, x)] + [(2, k, 1.0) for k in range(50)] + [(3, 5, None), (1, 0, 1e9)]
    df = spark.createDataFrame(data, "session_id long, us long, value double").repartition(5)
    for block in (1_100, 10**6):
        got = sorted((r.ord, r.us, r.prominence) for r in peaks.ecg_peaks(df, block).collect())
        assert [g[0] for g in got] == at.tolist() and [g[1] for g in got] == [data[k][1] for k in at]
        assert [g[2] for g in got] == pytest.approx(heights.tolist(), rel=1e-6)
    pulses = peaks.ppg_pulses(df.filter("session_id = 1 AND value < 1e6"))
    own, _ = dsp.find_peaks(x, round(0.3 * fs), 0.05 * np.ptp(x))
    assert sorted(r.ord for r in pulses.collect()) == own.tolist()


def test_overlaps_without_the_product(spark):
    rng = random.Random(8)
    spans = [(rng.choice([1, 1, 2]), i, (a := rng.randrange(100_000)), a + rng.choice([0, 10, 500, 40_000, -5])) for i in range(250)]
    df = spark.createDataFrame(spans, "session_id long, idx long, low_us long, high_us long")
    want = sorted((a[0], a[1], b[1]) for a in spans for b in spans if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and a[3] > b[2] and a[3] >= a[2] and b[3] >= b[2])
    assert sorted(map(tuple, joins.overlapping(df).collect())) == want
    views = [(s, v, low, low + 3_000) for s in (1, 2, 3) for v, low in enumerate((0, 50_000, 99_000))]
    got = joins.visible(df, spark.createDataFrame(views, "session_id long, view_idx long, from_us long, to_us long"))
    assert sorted((r.session_id, r.view_idx, r.idx) for r in got.collect()) == sorted((s, v, i) for s, v, lo, hi in views for t, i, a, b in spans if s == t and a < hi and b > lo and b >= a)
    # one bucket of many short spans and a long one: far fewer pairs are formed than the product
    many = spark.range(3_000).selectExpr("1L AS session_id", "id AS idx", "id * 1000 AS low_us", "CASE WHEN id = 0 THEN 3000000 ELSE id * 1000 + 900 END AS high_us")
    met = joins.overlapping(many)
    assert met.count() == 2_999
    plan_text = met._jdf.queryExecution().executedPlan().toString().split("\n")
    assert all("__left" in line or "Broadcast" in line for line in plan_text if "Join" in line and "__right" in line)


def test_next_and_previous_interval(spark):
    rng = random.Random(9)
    starts = [(s, i, round(rng.uniform(0, 200_000), 3)) for i, s in enumerate([1] * 80 + [2])]
    times = [(s, round(rng.uniform(0, 200_000), 3)) for s in [1] * 50 + [2, 3]] + [(1, starts[3][2]), (1, starts[3][2]), (1, starts[5][2] + 0.0005)]
    got = intervals.next_interval(spark.createDataFrame(starts, "session_id long, idx long, start_sec double"), spark.createDataFrame(times, "session_id long, at_sec double")).collect()
    want = {(s, t): (min((x for r, _, x in starts if r == s and x > t + 1e-3), default=None), max((x for r, _, x in starts if r == s and x < t - 1e-3), default=None)) for s, t in times}
    assert {(r.session_id, r.at_sec): (r.next_sec, r.previous_sec) for r in got} == want and len(got) == len(want)


def test_neighbours_of_beats_and_places_of_samples(samples):
    got = beats.rr_intervals(samples.select("session_id", "us", "ord"))
    w = Window.partitionBy("session_id").orderBy("us", "ord")
    assert rows(got) == rows(samples.select("session_id", "us", "ord", (F.col("us") - F.lag("us").over(w)) / 1000))
    assert rows(rates.sample_index(samples)) == rows(samples.withColumn("k", F.row_number().over(w).cast("long") - 1))
    assert rows(sync.fill_signals(samples.withColumn("sensor_id", F.lit("a")))) == rows(
        samples.withColumn("sensor_id", F.lit("a")).groupBy("session_id", "us", "sensor_id").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("ord"))).alias("value"))
        .withColumn("v", F.coalesce(F.last("value", True).over(Window.partitionBy("session_id").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)), F.first("value", True).over(Window.partitionBy("session_id").orderBy("us").rowsBetween(0, Window.unboundedFollowing))))
        .select("session_id", "us", "sensor_id", "v").join(samples.filter("value IS NOT NULL").select("session_id").distinct(), "session_id", "left_semi")
    )


def test_lag_curves_of_a_noisy_pulse_against_plain_numpy(spark):
    """Correlations below one, missing frames, and windows of unequal length: each window by the definition."""
    rng = np.random.default_rng(11)
    fs, n = 10.0, 600
    t = np.arange(-200, n + 200) / fs
    ref = np.sin(2 * np.pi * 1.1 * t) + 0.5 * rng.normal(size=len(t))
    pulse = np.interp(np.arange(n) / fs - 0.7, t, ref) + 0.8 * rng.normal(size=n)
    pulse[100:130] = np.nan
    pulses = [(s, 0, k, None if np.isnan(v) else float(v), bool(k % 3)) for s in (1, 2) for k, v in enumerate(pulse)]
    references = [(s, 0, float(a), float(b)) for s in (1, 2) for a, b in zip(t, ref)]
    wins = [(1, 0, 0, 0.0, 30.0), (1, 0, 1, 15.0, 45.0), (1, 0, 2, 59.0, 59.5), (2, 0, 0, 5.0, 25.0), (2, 0, 1, 0.0, 59.9), (3, 0, 0, 0.0, 30.0)]
    got = waveforms.window_correlations(
        spark.createDataFrame(pulses, "session_id long, segment_idx long, frame_idx long, value double, detected boolean"),
        spark.createDataFrame(references, "session_id long, segment_idx long, t_sec double, value double"),
        spark.createDataFrame(wins, "session_id long, segment_idx long, win_idx long, win_start double, win_end double"),
        fs, 2.0, 0.1,
    ).collect()
    found = {(r.session_id, r.win_idx, r.lag_idx): r["corr"] for r in got if r.lag_idx is not None}
    for s, _, w, low, high in wins[:5]:
        at = np.array([k for k in range(n) if low <= k / fs <= high and not np.isnan(pulse[k])])
        for i, lag in enumerate(np.round(np.arange(-20, 21) * 0.1, 6)):
            want = np.corrcoef(pulse[at], np.interp(at / fs - lag, t, ref))[0, 1] if len(at) >= 8 else None
            assert found.get((s, w, i)) == (pytest.approx(want, abs=1e-9) if want is not None else None)
        frames = [k for k in range(n) if low <= k / fs <= high]
        assert all(r.face_coverage == pytest.approx(np.mean([bool(k % 3) for k in frames])) for r in got if (r.session_id, r.win_idx) == (s, w))
    assert max(v for (s, w, _), v in found.items() if (s, w) == (1, 0)) < 0.95
    assert all(abs(max((v, i) for (a, b, i), v in found.items() if (a, b) == key)[1] - 27) <= 1 for key in ((1, 0), (1, 1), (2, 1)))


@pytest.mark.parametrize("method", ["GREEN", "CHROM", "POS"])
def test_pulses_of_clips_against_whole_arrays(spark, method):
    rng = np.random.default_rng(12)
    fs, n = 30.0, 300
    k = np.arange(n)
    rgb = np.array([180.0, 120.0, 100.0]) * (1 - 0.01 * np.sin(2 * np.pi * 1.2 * k / fs)[:, None] * np.array([0.3, 1.0, 0.5])) + 0.05 * rng.normal(size=(n, 3))
    rows = [(s, 0, int(i), *((None,) * 3 if 100 <= i < 110 else map(float, rgb[i]))) for s in (1, 2) for i in rng.permutation(n)] + [(3, 0, i, None, None, None) for i in range(60)]
    got = waveforms.estimate_pulse(spark.createDataFrame(rows, "session_id long, segment_idx long, frame_idx long, r double, g double, b double").repartition(4), fs, method).collect()
    filled = rgb.copy()
    for c in range(3):
        filled[100:110, c] = np.interp(np.arange(100, 110), [99, 110], rgb[[99, 110], c])
    want = dsp.pulse_from_rgb(filled, fs, method)
    for s in (1, 2):
        own = [r.value for r in sorted((r for r in got if r.session_id == s), key=lambda r: r.frame_idx)]
        assert own == pytest.approx(want.tolist(), abs=1e-9) and abs(dsp.dominant_rate(np.array(own), fs) - 72) < 1.5
    assert all(r.value == 0 for r in got if r.session_id == 3)


def test_strong_peaks_at_a_tie_as_in_sql(spark):
    """A peak of 0.7 times a local height that is no double: it counts as with DuckDB's quantile."""
    data = [(n, 10 * k, float(v)) for n, *values in TIES for k, v in enumerate(values)]
    df = spark.createDataFrame(data, "session_id long, us long, prominence double")
    got = sorted((r.session_id, r.us, r.prominence, r.local) for r in beats.strong_peaks(df, 0.7, 1_000).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE peaks (session_id BIGINT, us BIGINT, prominence DOUBLE)")
    con.executemany("INSERT INTO peaks VALUES (?, ?, ?)", data)
    want = con.execute("""SELECT * FROM (SELECT *, quantile_cont(prominence, 0.9) OVER (PARTITION BY session_id ORDER BY us RANGE BETWEEN 999 PRECEDING AND 1000 FOLLOWING) AS local FROM peaks)
        WHERE prominence >= 0.7 * local ORDER BY session_id, us""").fetchall()
    assert got == want


def test_groups_come_whole(spark):
    data = [(None if k == 2 else float("nan") if k == 5 else float(k), j) for k in range(9) for j in range(1 + 40 * (k == 3))]
    df = spark.createDataFrame(data, "key double, j long").withColumn("two", F.lit("x"))

    def run(rows, begins):
        ends = np.append(begins[1:], rows.num_rows)
        assert all(rows["j"].to_pylist()[a:b] == list(range(b - a)) for a, b in zip(begins, ends))
        return pa.table({"n": ends - begins, "groups": np.full(len(begins), len(begins))})

    for most in (1, 3, 1_000):
        got = in_groups(df, ["key", "two"], ["j"], run, "n long, groups long", most).collect()
        assert sorted(r.n for r in got) == [1] * 8 + [41]
    assert in_groups(df.limit(0), ["key", "two"], ["j"], run, "n long, groups long").count() == 0
