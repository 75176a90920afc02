import numpy as np
import pytest
from pyspark.sql import functions as F

from cadentia.functions import dsp, scalars
from cadentia.operators import intervals, segments, sync, waveforms
from cadentia.sources import sensors


def test_pulse_peaks_at_a_fixed_share_of_the_beat(spark):
    """Long random walk of beats: one pulse a beat, 24.7 % into it."""
    rng = np.random.default_rng(0)
    rr = np.clip(0.85 + np.cumsum(rng.normal(0, 0.004, 300)), 0.6, 1.2)
    beat = np.round(np.concatenate([[0], np.cumsum(rr)]) * 1e6).astype(int)
    got = waveforms.synthesize_ppg(spark.createDataFrame([(1, int(b)) for b in beat], "session_id long, us long"), 125.0).orderBy("us").toPandas()
    us, value = got["us"].to_numpy(), got["value"].to_numpy()
    phase = [(us[a:b][value[a:b].argmax()] - beat[k]) / (beat[k + 1] - beat[k]) for k in range(300) for a, b in [np.searchsorted(us, beat[k : k + 2])]]
    assert abs(np.median(phase) - 0.247) < 0.005 and np.ptp(phase) < 0.02
    # The closed form against the model's equation, integrated over fine steps of one beat.
    x = np.linspace(-np.pi, np.pi, 200_001)
    slope = -sum(a * (x - c) * np.exp(-(((x - c) / w) ** 2)) / 2 for c, a, w in zip(waveforms.PULSE_CENTRE, waveforms.PULSE_HEIGHT, waveforms.PULSE_WIDTH))
    z = np.concatenate([[0], np.cumsum((slope[1:] + slope[:-1]) / 2 * np.diff(x))])
    z -= z[-1] * (x + np.pi) / (2 * np.pi)
    assert abs((x[z.argmax()] + np.pi) / (2 * np.pi) - 0.247) < 0.001


def test_bands_at_the_nyquist_rate(spark):
    with pytest.raises(ValueError, match="needs more than"):
        dsp.bandpass(np.ones(100), 40.0, 5.0, 25.0, 3)
    assert np.isfinite(dsp.bandpass(np.random.default_rng(0).random(100), 6.0, 0.7, 3.5, 2)).all()


def test_trim_follows_the_limiting_cameras(spark):
    rows = [(1, 0, 100.0, 0.0, True), (1, 1, 80.0, 5.0, False), (1, 2, 90.0, 5.0, True), (2, 0, 50.0, 0.0, False), (2, 1, 60.0, 0.0, False)]
    got = sync.trim_plan(spark.createDataFrame(rows, "session_id long, camera_index long, duration_sec double, sync_sec double, limits boolean")).collect()
    assert {(r.session_id, r.camera_index): (r.trim_start, r.trim_end) for r in got} == {(1, 0): (5.0, 5.0), (1, 1): (0.0, 0.0), (1, 2): (0.0, 0.0), (2, 0): (0.0, 0.0), (2, 1): (0.0, 0.0)}


def test_edits_do_not_collide(spark):
    own = spark.createDataFrame([(1, 1, "a", 0.0, 10.0), (1, 2, "b", 20.0, 30.0)], "session_id long, idx long, label string, start_sec double, end_sec double")
    edits = spark.createDataFrame([(1, 1, 0.0, 18.0), (1, 2, 12.0, 30.0)], "session_id long, idx long, new_start double, new_end double")
    assert [(r.start_sec, r.end_sec) for r in intervals.resize(own, edits).orderBy("idx").collect()] == [(0.0, 18.0), (20.0, 30.0)]


def test_small_column_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(scalars.format_hms(F.lit(-3.0))) == "0:00" and value(scalars.format_hms_ms(F.lit(-3.0))) == "00:00:00.000"
    assert value(scalars.format_clock(F.lit(86_400_000_000 * 3 + 3_723_004_999))) == "01:02:03.004 UTC" and value(scalars.format_clock(F.lit(None).cast("long"))) == ""
    name = F.lit("x/DJI_20260529190907_0001.MP4")
    assert value(scalars.recording_name(scalars.recording_time(name))) == "20260529_190907" and value(scalars.recording_name(scalars.recording_time(F.lit("a.mp4")))) == "unknown"
    assert value(scalars.safe_filename(F.lit(" ._a b/c._ "))) == "a_b_c" and value(scalars.safe_filename(F.lit("//"))) == "figure"
    assert tuple(value(scalars.roi_box(*(F.lit(float(v)) for v in (-4, 10, 20, 95)), 0.5, 640, 100))) == (1, 10, 10, 90)
    assert value(scalars.sensor_name(F.lit("ecg_1"))) == "ECG_1" and value(scalars.sensor_name(F.lit("synthetic_ppg"))) == "Synthetic_Ppg"
    assert value(scalars.clean_labels(F.array(F.lit(" a"), F.lit(""), F.lit("a")))) == ["a"]


def test_segments_sensors_and_history(spark):
    seg = spark.createDataFrame([(1, 1, "a"), (1, 2, "Unlabelled"), (1, 3, "b")], "session_id long, idx long, label string")
    assert [r.idx for r in segments.select_segments(seg, excluded=seg.filter("idx = 3")).collect()] == [1] and [r.idx for r in segments.select_segments(seg, "b").collect()] == [3]
    cams = spark.createDataFrame([(1, 0, "side"), (1, 1, "Front left"), (2, 0, None), (2, 1, "x")], "session_id long, k long, label string")
    assert {(r.session_id, r.k) for r in segments.prefer(cams, F.lower("label").contains("front"), "k").collect()} == {(1, 1), (2, 0)}
    history = segments.append_offset(spark.createDataFrame([(1, 0, 1.5)], "session_id long, place long, offset_sec double"), spark.createDataFrame([(1, -0.25), (2, 3.0)], "session_id long, offset_sec double"))
    assert sorted(map(tuple, history.collect())) == [(1, 0, 1.5), (1, 1, -0.25), (2, 0, 3.0)]
    trace = spark.createDataFrame([(1, 0, "c", 0, True), (1, 0, "c", 0, False), (1, 0, "c", 1, True)], "session_id long, segment_idx long, camera string, win_idx long, detected boolean")
    assert segments.face_coverage(trace).first().face_coverage == pytest.approx(2 / 3) and segments.face_coverage(trace, "win_idx").count() == 2
    curve = spark.createDataFrame([(1, k, c) for k, c in enumerate([0.0, 0.5, 0.1, 0.1, 0.8, 0.2])], "session_id long, lag_idx long, corr double")
    at = spark.createDataFrame([(1, 1.0), (1, 2.6), (1, 5.0), (1, 5.5)], "session_id long, at_lag double")
    assert {r.at_lag: r.corr for r in segments.corr_at(curve, at).collect()} == {1.0: 0.5, 2.6: 0.1, 5.0: 0.2, 5.5: None}
    assert {r.at_lag: (r.previous_peak, r.next_peak, r.nearest_peak) for r in segments.step_peaks(curve, at).collect()} == {1.0: (None, 4, 1), 2.6: (1, 4, 4), 5.0: (4, None, 4), 5.5: (4, None, 4)}


def test_two_sensors_from_wide_and_files(spark, tmp_path):
    (tmp_path / "z.csv").write_text("Time,HR,BR,Note\n13/05/2026 12:00:00,70,12,x\n13/05/2026 12:00:01,71,,y\n")
    (tmp_path / "e.csv").write_text("Time,EcgWaveform\n13/05/2026 12:00:00.004,512\n")
    (tmp_path / "p.csv").write_text("Name,Date,Start time\nx,13-05-2026,12:00:00\nSample,Time,HR (bpm)\n1,00:00:01,70\n")
    (tmp_path / "o.csv").write_text("a,b\n1,2\n")
    got, unknown = sensors.load_signals(spark, [str(tmp_path / f"{c}.csv") for c in "zepo"])
    assert sorted((r.kind, r.value) for r in got.collect()) == [("ECG", 512.0), ("Polar", 70.0), ("Zephyr", 70.0), ("Zephyr", 71.0)] and [u.rsplit("/")[-1] for u in unknown] == ["o.csv"]
    typed = sensors.infer_aux_types(got.filter("kind = 'Zephyr'"), ["BR", "Note"]).orderBy("us").collect()
    assert [(r.BR, r.Note) for r in typed] == [(12.0, "x"), (None, "y")]
    (tmp_path / "w.csv").write_text("timestamp_utc,Polar,Zephyr,averaged,aux__Zephyr__BR\n2026-01-01T12:00:00Z,70,80,75,\n2026-01-01T12:00:00.400Z,71,,71,12\n")
    long_ = sensors.read_combined(spark, str(tmp_path / "w.csv")).orderBy("us", "sensor_id").collect()
    assert [(r.sensor_id, r.value) for r in long_] == [("Polar", 70.0), ("Zephyr", 80.0), ("Polar", 71.0)] and long_[2].us - long_[0].us == 400_000
    (tmp_path / "bad.csv").write_text("timestamp_utc,x\nnever,1\n")
    with pytest.raises(Exception, match="no time"):
        sensors.read_synced(spark, str(tmp_path / "bad.csv")).collect()
