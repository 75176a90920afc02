"""Files that are written, replaced and read back."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadentia.operators import alignment, offsets, records
from cadentia.sources import outputs, sensors

T0 = 1_780_000_000_000_000
SEGMENTS = "session_id long, idx long, label string, start_sec double, end_sec double"


@pytest.fixture
def project(spark):
    second = 1_000_000
    ppg = [(s, T0 - 10 * second + k * second // 10, k, k / 7) for s in (1, 2) for k in range(600)]
    hr = [(s, T0 - 10 * second + k * second, k, 70.0) for s in (1, 2) for k in range(60)]
    kind = "session_id long, us long, ord long, value double"
    return {"ppg": spark.createDataFrame(ppg, kind), "hr": spark.createDataFrame(hr, kind)}


def state(spark, path):
    got = outputs.read_outputs(spark, path)
    return {k: sorted(map(tuple, got[k].drop("text").collect()), key=str) for k in ("sessions", "meta", "slices")}, sorted((r.session_id, r.place, r.offset_sec) for r in got["history"].collect())


def test_offsets_applied_to_files_and_taken_back(spark, project, tmp_path):
    path = f"file://{tmp_path}/out"
    segments = spark.createDataFrame([(1, 1, "Resting", 10.0, 20.0), (1, 2, "Squat", 44.0, 49.0), (2, 1, "Rest", 0.0, 1.0)], SEGMENTS)
    sessions = spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "session_id long, anchor_us long")
    outputs.export_segments(path, segments, sessions, project)
    first, history = state(spark, path)
    assert history == [(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)] and len(first["sessions"]) == 3
    low = min(r[3] for r in first["slices"] if r[:3] == (1, 1, "ppg"))
    assert low == T0 + 10_000_000 and sum(r[:3] == (1, 1, "hr") for r in first["slices"]) == 11
    report = outputs.apply_offset_to_outputs(spark, path, project, 1.5, "moved").collect()
    assert {(r.session_id, r.updated, r.warnings) for r in report} == {(1, 2, 0), (2, 1, 0)} and report[0].resliced == ["ppg", "hr"]
    moved, history = state(spark, path)
    assert min(r[3] for r in moved["slices"] if r[:3] == (1, 1, "ppg")) == T0 + 8_500_000
    assert min(r[3] for r in moved["slices"] if r[:3] == (1, 1, "hr")) == T0 + 9_000_000
    assert {r[1] for r in moved["sessions"]} == {T0 - 1_500_000} and {r[2:] for r in moved["sessions"]} == {(1.5, "moved")}
    outputs.apply_offset_to_outputs(spark, path, project, -0.25)
    back, history = state(spark, path)
    assert {r[1] for r in back["sessions"]} == {T0 + 250_000}
    assert [h[2] for h in history if h[0] == 1] == [0.0, 1.5, -0.25]
    outputs.apply_offset_to_outputs(spark, path, project, 0.0)
    again, history = state(spark, path)
    assert again == first and len(history) == 12
    text = outputs.read_outputs(spark, path)["meta"].filter("session_id = 1 AND idx = 1").first().text
    assert '"index":1' in text and '"folder":' in text and '"segment_start_datetime_utc":"2026-' in text and '"video_signal_offset_sec":0.0' in text


def test_stale_slices_go_and_other_sessions_stay(spark, project, tmp_path):
    path = f"file://{tmp_path}/out"
    sessions = spark.createDataFrame([(1, T0), (2, T0)], "session_id long, anchor_us long")
    both = spark.createDataFrame([(1, 1, "a", 0.0, 2.0), (1, 2, "b", 3.0, 4.0), (2, 1, "c", 1.0, 3.0)], SEGMENTS)
    outputs.export_segments(path, both, sessions, project)
    other = [r for r in state(spark, path)[0]["slices"] if r[0] == 2]
    # session 1 has one segment now, inside [1, 2], and one signal only
    outputs.export_segments(path, spark.createDataFrame([(1, 1, "a", 1.0, 2.0)], SEGMENTS), sessions.filter("session_id = 1"), {"hr": project["hr"]})
    now = state(spark, path)[0]
    assert [r[:3] + (r[3] - T0,) for r in now["slices"] if r[0] == 1] == [(1, 1, "hr", 1_000_000), (1, 1, "hr", 2_000_000)]
    assert [r for r in now["slices"] if r[0] == 2] == other and [r[:2] for r in now["meta"]] == [(1, 1), (2, 1)]
    # and then none at all
    outputs.export_segments(path, both.limit(0), sessions.filter("session_id = 1"), project)
    assert {r[0] for r in state(spark, path)[0]["slices"]} == {2}
    with pytest.raises(Exception, match="this kind"):
        outputs.export_segments(path, both, sessions, {"meta": project["hr"]})
    assert {r[0] for r in state(spark, path)[0]["slices"]} == {2}


def test_sensor_tables_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/devices"
    kind = "session_id long, kind string, sensor_id string, us long, value double"
    sensors.write_device_samples(spark.createDataFrame([(1, "HR", "Polar", 2, 1.0), (1, "HR", "Polar", 1, 1.0), (1, "HR", "Zephyr_2", 1, 3.0)], kind), path)
    sensors.write_device_samples(spark.createDataFrame([(1, "HR", "Polar", 5, 9.0)], kind), path)
    got = sorted((r.sensor_file, r.us, r.value) for r in spark.read.parquet(path).collect())
    assert got == [("polar_1", 5, 9.0), ("zephyr_2", 1, 3.0)]


def test_sensor_numbers_follow_the_files(spark):
    files = [(1, "Polar", 3), (1, "Zephyr", 1), (1, "Polar", 2), (2, "Polar", 9)]
    got = sensors.assign_sensor_ids(spark.createDataFrame(files, "session_id long, kind string, src_ord long"))
    assert sorted((r.session_id, r.src_ord, r.sensor_id) for r in got.collect()) == [(1, 1, "Zephyr_1"), (1, 2, "Polar_1"), (1, 3, "Polar_2"), (2, 9, "Polar_1")]


def test_manifests(spark, tmp_path):
    head = "index,label,start_sec,end_sec,duration_sec,folder\n"
    good = tmp_path / "a b%1.csv"
    good.write_text("﻿" + head + "1, Squat ,30,45,15,02_squat\n2,Rest,10,20.5,10.5, 01_rest \n")
    got = records.read_manifests(spark, [str(good)]).collect()
    assert sorted((r.idx, r.label, r.start_sec, r.end_sec, r.folder) for r in got) == [(1, "Rest", 10.0, 20.5, "01_rest"), (2, "Squat", 30.0, 45.0, "02_squat")]
    for k, (row, says) in enumerate([("1, ,1,2,1,f", "label of"), ("1,a,2,2,0,f", "times of"), ("1,a,1,2,1,", "folder of"), ("1,a,x,2,1,f", "times of"), ("", "no segments")]):
        bad = tmp_path / f"bad{k}.csv"
        bad.write_text(head + row + "\n")
        with pytest.raises(ValueError, match=says):
            records.read_manifests(spark, [str(good), str(bad)])
    (tmp_path / "short.csv").write_text("label,start_sec\na,1\n")
    with pytest.raises(ValueError, match="no column end_sec, folder"):
        records.read_manifests(spark, [str(tmp_path / "short.csv")])


def test_headers_are_read_from_the_beginning_of_files(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "big.csv").write_bytes(b"\xef\xbb\xbfTime,EcgWaveform\r\n" + b"01/01/2026 00:00:00.000,1\r\n" * 400_000)
    (folder / "long.csv").write_text("Time,HR,BR," + ",".join(f"c{k}" for k in range(4_000)) + "\n")
    (folder / "none.csv").write_text("\n1\n")
    got = {os.path.basename(r.path): (r.kind, r.header[:16]) for r in sensors.classify_signal_files(spark, [str(folder)]).collect()}
    assert got == {"big.csv": ("ECG", "Time,EcgWaveform"), "long.csv": ("Zephyr", "Time,HR,BR,c0,c1"), "none.csv": ("Unknown sensor", "")}


@pytest.mark.parametrize("case", ["start", "anchor", "both keys", "session"])
def test_reference_start_follows_what_is_stored(spark, case):
    kind = "session_id long, idx long, start_sec double, end_sec double, start_us long, anchor_us long, session_anchor_us long, session_offset_sec double, has_offset boolean, offset_sec double"
    second = 1_000_000
    row = {
        "start": (1, 1, 10.0, 20.0, 1_010 * second, None, 7 * second, 3.0, False, None),
        "anchor": (1, 1, 10.0, 20.0, None, 1_000 * second, 7 * second, 3.0, False, None),
        "both keys": (1, 1, 10.0, 20.0, None, 998 * second, 7 * second, 3.0, True, 2.0),
        "session": (1, 1, 10.0, 20.0, None, None, 997 * second, 3.0, False, None),
    }[case]
    got = alignment.apply_offset(spark.createDataFrame([row], kind), 0.0).first()
    assert got.start_us == 1_010 * second and got.was_stale == (case in ("both keys", "session"))


@pytest.mark.parametrize("block", [50, 333, 16_384])
def test_envelopes_in_blocks_against_whole_arrays(spark, block):
    rng = random.Random(block)
    rows, arrays, pairs = [], {}, []
    for s, shift, n in ((1, 37, 900), (2, -120, 700), (3, 0, 3), (4, 5, 60)):
        base = [rng.random() ** 4 for _ in range(n + 400)]
        left, right = base[200 : 200 + n], base[200 + shift : 200 + shift + n - 1]
        for c, env in ((0, left), (1, right)):
            arrays[s, c] = env
            rows += [(s, c, k, v) for k, v in enumerate(env)]
        pairs.append((s, 0, 1, 0.5, None))
    pairs.append((9, 0, 1, 0.0, 1.0))
    kind = "session_id long, left long, right long, left_start_sec double, right_start_sec double"
    frames = spark.createDataFrame(rows, "session_id long, camera long, hop long, value double").repartition(3)
    whole = spark.createDataFrame([(*p, arrays.get((p[0], 0)), arrays.get((p[0], 1))) for p in pairs], kind + ", left_env array<double>, right_env array<double>")
    want = {r.session_id: r.offset_sec for r in offsets.envelope_offset(whole, 15.0, 0.1).collect()}
    got = offsets.envelope_offset_rows(frames, spark.createDataFrame(pairs, kind), 15.0, 0.1, block).collect()
    assert {r.session_id: pytest.approx(r.offset_sec) for r in got} == want
    assert want[1] == pytest.approx(3.7 + 0.5)


def test_short_envelopes_have_few_sums(spark):
    """Only lags at which values meet are shuffled, not all within the greatest lag; without an overlap the lag is 0."""
    rng = random.Random(3)
    rows = [(s, c, k, rng.random()) for s in range(200) for c in (0, 1, 2) for k in range(1 + (s + c) % 4)]
    kind = "session_id long, left long, right long, left_start_sec double, right_start_sec double"
    pairs = spark.createDataFrame([(s, c, c + 1, 0.0, 0.0) for s in range(200) for c in (0, 1)], kind)
    frames = spark.createDataFrame(rows, "session_id long, camera long, hop long, value double")
    arrays = {}
    for s, c, _, v in rows:
        arrays.setdefault((s, c), []).append(v)
    made = []
    real = offsets.in_groups

    def counted(*args):
        made.append(real(*args))
        return made[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(offsets, "in_groups", counted)
        got = offsets.envelope_offset_rows(frames, pairs, 60.0, 0.032, 4_096).collect()
    for r in got:
        a, b = np.array(arrays[r.session_id, r.left]), np.array(arrays[r.session_id, r.right])
        assert r.offset_sec == pytest.approx(0.032 * offsets.envelope_lag(a, b, 1_875))
    assert len(got) == 400 and made[0].count() == sum(len(arrays[s, c]) + len(arrays[s, c + 1]) - 1 for s in range(200) for c in (0, 1))
