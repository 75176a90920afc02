from pathlib import Path

import duckdb
import numpy as np
import pytest

from cadentia.functions import dsp
from cadentia.operators import alignment, applied, beats, intervals, joins, peaks, rates, records, waveforms
from cadentia.plans import queries
from cadentia.sources import sensors

DATA = Path("/root/testdata/sf0.001")


def plain(rows, names):
    order = sorted(names)
    return sorted(repr(tuple(None if v is None or v != v else round(v, 4) if isinstance(v, float) else v for v in (r[names.index(c)] for c in order))) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, str(DATA))
    expected = db.sql(queries.ORACLE_SQL[name])
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(expected.fetchall(), expected.columns)


def test_asof_crosses_buckets_and_breaks_ties(spark):
    left = spark.createDataFrame([(1, 100, 0), (1, 5000, 1), (2, 10, 2)], "session_id long, us long, ord long")
    right = spark.createDataFrame([(1, 90, 0, 1.0), (1, 90, 1, 2.0), (1, 110, 2, 3.0)], "session_id long, us long, ord long, value double")
    got = {r.ord: r.hit.value for r in joins.asof_nearest(left, right, None, bucket_us=50).collect()}
    assert got == {0: 2.0, 1: 3.0}
    assert {r.ord for r in joins.asof_nearest(left, right, 10, bucket_us=50).collect()} == {0}


def test_agreement_of_shifted_estimate(spark):
    pairs = spark.createDataFrame([(1, 60.0, 61.0), (1, 62.0, 63.0)], "session_id long, reference double, estimate double")
    r = beats.agreement(pairs).first()
    assert (r.mae, r.bias, round(r.r, 6)) == (1.0, 1.0, 1.0)


def test_offset_can_be_taken_back(spark):
    seg = spark.createDataFrame([(1, 1, 10.0, 20.0, 10_000_000, None, None, 0.0, True, 0.0)], "session_id long, idx long, start_sec double, end_sec double, start_us long, anchor_us long, session_anchor_us long, session_offset_sec double, has_offset boolean, offset_sec double")
    moved = alignment.apply_offset(seg, 1.5).first()
    assert (moved.anchor_us, moved.start_us, moved.end_us) == (-1_500_000, 8_500_000, 18_500_000)
    assert alignment.apply_offset(seg, 0.0).first().anchor_us == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "session_id long, idx long, label string, start_sec double, end_sec double, low_us long, high_us long")
    assert joins.overlapping(none).count() == intervals.subdivide(none, count=3).count() == intervals.label_library(none).count() == 0


def test_ecg_peaks(spark):
    fs, beat = 250, np.arange(1, 10)
    t = np.arange(0, 10, 1 / fs)
    ecg = sum(np.exp(-((t - b) ** 2) / (2 * 0.015**2)) for b in beat)
    df = spark.createDataFrame([(1, int(a * 1e6), float(v)) for a, v in zip(t, ecg)], "session_id long, us long, value double")
    got = sorted(r.us / 1e6 for r in beats.strong_peaks(peaks.ecg_peaks(df)).collect())
    assert len(got) == 9 and np.abs(np.array(got) - beat).max() < 0.02


@pytest.mark.parametrize("method", ["POS", "CHROM", "GREEN"])
def test_pulse_from_colour(method):
    rng, fs = np.random.default_rng(0), 30
    t = np.arange(0, 60, 1 / fs)
    pulse = np.sin(2 * np.pi * 1.2 * t)
    rgb = np.array([180, 120, 100]) * (1 - np.outer(pulse, [0.0015, 0.004, 0.002])) + rng.normal(0, 0.05, (len(t), 3))
    got = dsp.pulse_from_rgb(rgb, fs, method)
    assert np.corrcoef(got, pulse)[0, 1] > 0.8 and abs(dsp.dominant_rate(got, fs) - 72) < 1.5


def test_lag_of_irregular_pulse(spark):
    rng = np.random.default_rng(1)
    beat = np.cumsum(rng.uniform(0.75, 0.95, 130)) - 20
    wave = lambda t: np.exp(-((t[:, None] - beat) ** 2) / 0.02).sum(1)
    t, ref = np.arange(0, 60, 1 / 30), np.arange(-15, 75, 1 / 50)
    pulses = spark.createDataFrame([(1, 0, k, float(v)) for k, v in enumerate(wave(t - 1.31))], "session_id long, segment_idx long, frame_idx long, value double")
    refs = spark.createDataFrame([(1, 0, float(a), float(v)) for a, v in zip(ref, wave(ref))], "session_id long, segment_idx long, t_sec double, value double")
    windows = intervals.analysis_windows(spark.createDataFrame([(1, 0, 60.0)], "session_id long, segment_idx long, duration_sec double"))
    curves = waveforms.window_correlations(pulses, refs, windows, 30.0)
    pooled = curves.groupBy("session_id", "lag_idx").agg({"corr": "avg"}).toDF("session_id", "lag_idx", "corr")
    best = alignment.best_lag(pooled).first()
    assert windows.count() == 3 and abs((best.lag * 0.02 - 10) - 1.31) < 0.015 and best.corr > 0.95


@pytest.mark.parametrize("distance", [1, 2, 7])
def test_peaks_against_brute_force(distance):
    x = np.random.default_rng(3).integers(0, 9, 300).astype(float)
    tops, k = [], 1
    while k < len(x) - 1:
        end = k
        while end + 1 < len(x) and x[end + 1] == x[k]:
            end += 1
        if x[k - 1] < x[k] and end + 1 < len(x) and x[end + 1] < x[k]:
            tops.append((k + end) // 2)
        k = end + 1
    kept = []
    for p in sorted(tops, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    assert dsp.find_peaks(x, distance)[0].tolist() == sorted(kept)


def test_lag_scan_against_plain_loop():
    rng = np.random.default_rng(4)
    t, ref, pulse = np.arange(0, 40, 0.1), rng.normal(size=400), rng.normal(size=240)
    pulse[50:60] = np.nan
    lags = np.arange(-12, 13) * 1.3
    known = np.isfinite(pulse)
    expected = []
    for lag in lags:
        at = (np.arange(240) / 8)[known] - lag
        meets = (at >= t[0]) & (at <= t[-1])
        expected.append(np.corrcoef(pulse[known][meets], np.interp(at[meets], t, ref))[0, 1] if meets.sum() >= 0.8 * known.sum() else np.nan)
    assert np.isnan(expected).any() and np.allclose(dsp.lag_scan(pulse, 8, t, ref, lags, block=700), expected, equal_nan=True)


def test_reference_is_prepared(spark):
    t = np.arange(0, 60, 0.04)
    x = 5 + 3 * np.sin(2 * np.pi * 1.2 * t) + 0.1 * t
    rows = [(1, 0, float(a), float(v)) for a, v in zip(t[::-1], x[::-1])] + [(1, 0, 1.01, None), (1, 0, float("nan"), 1.0), (1, 1, 0.0, 2.0), (1, 1, 1.0, 4.0)]
    got = waveforms.prepare_reference(spark.createDataFrame(rows, "session_id long, segment_idx long, t_sec double, value double")).orderBy("segment_idx", "t_sec").collect()
    long, short = [r for r in got if r.segment_idx == 0], [r for r in got if r.segment_idx == 1]
    y = np.array([r.value for r in long])
    assert len(long) == len(t) and abs(y.mean()) < 1e-9 and abs(y.std() - 1) < 1e-9 and np.corrcoef(y, np.sin(2 * np.pi * 1.2 * t))[0, 1] > 0.99
    assert [r.value for r in short] == [-1.0, 1.0]


def test_windows_of_two_segments_are_pooled(spark):
    """Six windows of two segments, of which one window has lost the face; a third segment has no reference."""
    rng = np.random.default_rng(2)
    pulses, refs = [], []
    for seg in range(3):
        beat = np.cumsum(rng.uniform(0.7, 0.9, 140) + 0.1 * seg) - 20
        wave = lambda t: np.exp(-((t[:, None] - beat) ** 2) / 0.02).sum(1)  # noqa: E731, B023
        pulses += [(1, seg, k, float(v), not (seg == 1 and k < 300)) for k, v in enumerate(wave(np.arange(0, 60, 1 / 30) - 1.3))]
        at = np.arange(-15, 75, 1 / 50)
        refs += [(1, seg, float(a), float(v)) for a, v in zip(at, wave(at))] if seg < 2 else []
    pulses = spark.createDataFrame(pulses, "session_id long, segment_idx long, frame_idx long, value double, detected boolean")
    refs = waveforms.prepare_reference(spark.createDataFrame(refs, "session_id long, segment_idx long, t_sec double, value double"))
    windows = intervals.analysis_windows(spark.createDataFrame([(1, s, 60.0) for s in range(3)], "session_id long, segment_idx long, duration_sec double"))
    curves = waveforms.window_correlations(pulses, refs, windows, 30.0).cache()
    counts = applied.window_counts(curves).first()
    assert (counts.accepted, counts.windows) == (5, 9)
    assert curves.filter("segment_idx = 2 AND lag_idx IS NULL AND reference_hr IS NULL").count() == 3
    best = alignment.best_lag(alignment.pool_curves(curves).select("session_id", "lag_idx", "corr")).first()
    assert abs(best.lag * 0.02 - 10 - 1.3) < 0.04 and best.corr > 0.9
    report = {r.segment_idx: r for r in applied.pool_report(curves, spark.createDataFrame([(1, 565.0)], "session_id long, at_lag double")).collect()}
    assert (report[0].accepted, report[1].accepted, report[2].accepted, report[2].windows, report[2].best) == (3, 2, 0, 3, None)
    assert all(abs(report[s].nearest_peak - 565) <= 1 for s in (0, 1))
    curves.unpersist()


def test_offsets_applied_in_turn_restore_the_first_state(spark):
    segs = spark.createDataFrame([(1, 1, 10.0, 20.0, 10_000_000, None, None, 0.0, True, 0.0), (1, 2, 1.0, 2.0, None, None, None, 0.0, False, None)], "session_id long, idx long, start_sec double, end_sec double, start_us long, anchor_us long, session_anchor_us long, session_offset_sec double, has_offset boolean, offset_sec double")
    anchors = spark.createDataFrame([(1, 0, 0.0), (2, 5, None)], "session_id long, anchor_us long, offset_sec double")
    history = spark.createDataFrame([], "session_id long, place long, offset_sec double")
    samples = spark.createDataFrame([(1, k * 1_000_000, k, float(k)) for k in range(40)], "session_id long, us long, ord long, value double")
    spans = []
    for offset in (1.5, -0.25, 0.0):
        done = applied.apply_to_sessions(segs, anchors, history, {"hr": samples, "ecg": samples}, offset, "n")
        timing = done["timing"].collect()
        assert [(r.idx, r.note) for r in timing] == [(1, "n")]
        spans.append((sorted(r.ord for r in done["slices"].filter("kind = 'hr'").collect()), {r.session_id: r.anchor_us for r in done["anchors"].collect()}))
        segs = spark.createDataFrame([(1, 1, 10.0, 20.0, timing[0].start_us, timing[0].anchor_us, None, 0.0, True, offset)], segs.schema)
        anchors = spark.createDataFrame(done["anchors"].collect(), anchors.schema)
        history = spark.createDataFrame(done["history"].collect(), history.schema)
        report = done["report"].first()
        assert report.updated == 1 and report.resliced == ["hr", "ecg"]
    assert [s[0][0] for s in spans] == [9, 11, 10] and [s[1][1] for s in spans] == [-1_500_000, 250_000, 0] and spans[2][1][2] == 5
    assert sorted((r.place, r.offset_sec) for r in history.filter("session_id = 1").collect()) == [(0, 1.5), (1, -0.25), (2, 0.0)]


def test_hrv_against_plain_python(spark):
    rng = np.random.default_rng(5)
    rows, us = [], 0
    for k in range(120):
        ms = float(rng.integers(600, 1000))
        us += int(ms * 1000)
        rows.append((1, k, us, ms, bool(rng.random() > 0.2)))
    got = {r.at_us: r for r in beats.hrv(spark.createDataFrame(rows, "session_id long, ord long, us long, ibi_ms double, accepted boolean"), 20, 8).collect()}
    good = [k for k, r in enumerate(rows) if r[4]]
    low, high = rows[good[7]][2], rows[good[-1]][2]
    assert sorted(got) == list(range(-(-low // 1_000_000) * 1_000_000, high + 1, 1_000_000))
    for at, r in got.items():
        used = [k for k in good if rows[k][2] <= at][-20:]
        values = np.array([rows[k][3] for k in used])
        pairs = [(rows[k][3] - rows[k - 1][3]) ** 2 for k in used[1:] if k - 1 in used]
        start = min(rows[k][2] - int(rows[k][3] * 1000) for k in used)
        rejected = sum(1 for x in rows if not x[4] and start < x[2] <= at)
        assert (r.accepted_intervals, r.rejected_intervals) == (len(used), rejected)
        assert abs(r.sdnn_ms - values.std(ddof=1)) < 1e-9 and abs(r.rmssd_ms - np.mean(pairs) ** 0.5) < 1e-9
    none = spark.createDataFrame([], "session_id long, ord long, us long, ibi_ms double, accepted boolean")
    assert beats.hrv(none).count() == 0


def test_asof_keeps_columns_and_unmatched_rows(spark):
    left = spark.createDataFrame([(1, 100, 0, "a", 7.0), (2, 5, 1, "b", 8.0)], "session_id long, us long, ord long, name string, value double")
    right = spark.createDataFrame([(1, 100, 5, 1.0, "x"), (3, 1, 6, 2.0, "y")], "session_id long, us long, ord long, value double, label string")
    got = {r.name: (r.value, r.hit and (r.hit.value, r.hit.label)) for r in joins.asof_backward(left, right, payload=["value", "label"]).collect()}
    assert got == {"a": (7.0, (1.0, "x")), "b": (8.0, None)}
    assert joins.asof_nearest(left.limit(0), right).count() == joins.asof_nearest(left, right.limit(0)).count() == 0


def test_synthetic_pulse(spark):
    rows = spark.createDataFrame([(1, 500_000), (1, 1_500_000), (1, 2_500_000)], "session_id long, us long")
    got = waveforms.synthesize_ppg(rows, 20).orderBy("us").collect()
    assert len(got) == 40 and got[0].us == 500_000 and got[-1].us == 2_450_000 and min(r.value for r in got) == 0 and max(r.value for r in got) == 1


def test_sensor_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿Time,HR,BR\n13/05/2026 12:00:00.500,70,12\nbad,71,12\n13/05/2026 12:00:01,,9\n", encoding="utf8")
    (tmp_path / "w.csv").write_text("Name,Date,Start time\nx,13-05-2026,12:00:00\nSample,Time,HR (bpm)\n1,00:00:01,70\n2,00:00:02,\n")
    strap = sensors.read_strap(spark, [str(tmp_path / "s.csv")]).collect()
    watch = sensors.read_watch(spark, [str(tmp_path / "w.csv")]).collect()
    assert [(r.value, r.aux) for r in strap] == [(70.0, {"BR": "12"})] and [r.value for r in watch] == [70.0]
    assert watch[0].us - strap[0].us == 500_000


@pytest.mark.parametrize("seconds,weak", [(30, 0.35), (150, 0.35)])
def test_heart_rate_is_not_doubled(spark, seconds, weak):
    fs, t = 40.0, np.arange(0, seconds, 1 / 40)
    x = weak * np.sin(2 * np.pi * 1.25 * t) + np.sin(2 * np.pi * 2.5 * t)
    rows = spark.createDataFrame([(1, int(a * 1e6), k, float(v)) for k, (a, v) in enumerate(zip(t, x))], "session_id long, us long, ord long, value double")
    indexed = rates.sample_index(rows)
    got = rates.resolve_harmonics(rates.hr_features(indexed, rates.hr_windows(indexed, fs), fs)).collect()
    assert len(got) == seconds - 9 and all(abs(r.heart_rate_bpm - 75) < 3 for r in got)
    targets = spark.createDataFrame([(1, 0), (1, 5_500_000), (1, 5_500_000), (2, 0)], "session_id long, us long")
    assert sorted(r.start for r in rates.hr_windows(indexed, fs, targets).collect()) == [0, 20]


def test_pulses_drift_only_when_stretched(spark):
    rng = np.random.default_rng(3)
    beat = np.cumsum(rng.uniform(0.7, 0.9, 600))
    table = lambda t: spark.createDataFrame([(1, int(v * 1e6), k) for k, v in enumerate(t)], "session_id long, us long, ord long")
    pulse = beat[:-1] + 0.25 * np.diff(beat)
    drift = lambda p: rates.phase_drift(rates.pulse_phases(table(p), table(beat))).first().drift_beats
    assert drift(pulse) < 0.01 and abs(drift(pulse * (1 + 0.25 / beat[-1])) - 0.28) < 0.07 and drift(pulse[:100]) is None


def test_pulses_of_a_wave(spark):
    t = np.arange(0, 10, 1 / 40)
    rows = [(1, int(a * 1e6), float(np.sin(2 * np.pi * a))) for a in t] + [(2, k, 1.0) for k in range(9)] + [(3, 0, None)]
    got = peaks.ppg_pulses(spark.createDataFrame(rows, "session_id long, us long, value double")).collect()
    assert [r.us for r in sorted(got)] == [250_000 + 1_000_000 * k for k in range(10)]


def test_manifest_faults(spark):
    rows = [(1, "a", "f", 0.0, 1.0), (1, " ", "f", 0.0, 1.0), (1, "a", None, 0.0, 1.0), (1, "a", "f", 1.0, 1.0), (1, "a", "f", None, 1.0)]
    df = spark.createDataFrame(rows, "session_id long, label string, folder string, start_sec double, end_sec double")
    assert [r.fault for r in records.manifest_faults(df).collect()] == ["label", "folder", "times", "times"]
