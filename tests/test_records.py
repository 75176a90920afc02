from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadentia.operators import boxes, offsets
from cadentia.plans import queries
from cadentia.sources import sessions

DATA = "/root/testdata/sf0.001"
BOXES = "clip_id long, frame_idx long, t_sec double, x double, y double, w double, h double, score double"


def iou(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_suppression_equals_brute_force(spark):
    frames = {}
    for r in queries._detections(spark, DATA).collect():
        frames.setdefault((r.clip_id, r.frame_idx), []).append((float(r.score), float(r.x), float(r.y), float(r.w), float(r.h)))
    expected = []
    for key, found in frames.items():
        kept = []
        for d in sorted(found, key=lambda d: (-d[0], *d[1:])):
            if all(iou(d[1:], k[1:]) <= 0.3 for k in kept):
                kept.append(d)
        expected += [(*key, *d) for d in kept]
    got = [(r.clip_id, r.frame_idx, r.score, r.x, r.y, r.w, r.h) for r in queries.suppress_boxes(spark, DATA).collect()]
    assert sorted(got) == sorted(expected) and any(len(f) > 1 for f in frames.values())


def test_track_goes_on_and_ends(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0.5, 2.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 0.8, None, None, None, None, None), (1, 3, 1.2, None, None, None, None, None), (1, 4, 1.3, 50.0, 0.0, 10.0, 10.0, 0.5)]
    got = boxes.track_boxes(spark.createDataFrame(rows, BOXES)).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.track_id) for r in got] == [(0, 0), (1, 0), (2, 0), (4, 1)]
    # Speed is half of 4 a second; after 0.3 s the box has grown by a quarter around its centre.
    assert (round(got[2].x, 6), round(got[2].w, 6), round(got[2].age_sec, 6)) == (round(7 + 2 * 0.3 - 6.25, 6), 12.5, 0.3)
    none = spark.createDataFrame([], BOXES)
    assert boxes.track_boxes(none).count() == boxes.suppress(none).count() == 0


@pytest.mark.parametrize("centred", [False, True])
def test_face_is_followed(spark, centred):
    rows = [(1, 0, 0.0, None, None, None, None, None)]
    rows += [(1, k, 0.0, float(k), 0.0, 10.0, 10.0, 0.9) for k in range(1, 21)] + [(1, k, 0.0, 200.0, 0.0, 5.0, 5.0, 0.9) for k in range(1, 21)]
    rows += [(1, k, 0.0, None, None, None, None, None) for k in range(21, 90)] + [(2, 0, 0.0, None, None, None, None, None)]
    got = boxes.follow_face(spark.createDataFrame(rows, BOXES), 30.0, centred=centred).orderBy("clip_id", "frame_idx").collect()
    assert len(got) == 91 and got[0].x is None and not got[0].detected and got[-1].x is None
    assert [r.detected for r in got[1:90]] == [True] * 79 + [False] * 10 and {r.w for r in got[1:90]} == {10.0}
    if centred:
        assert np.allclose([r.x for r in got[2:20]], range(2, 20)) and got[50].x == 20
    else:  # detections in frames 1, 5, 10, 15 and 20
        x = 1.0
        for k in (5, 10, 15, 20):
            x = 0.65 * x + 0.35 * k
        assert np.isclose(got[60].x, x) and got[4].x == 1


def test_mean_colour_prefers_skin(spark):
    skin, blue = bytes([100, 120, 180]), bytes([255, 0, 0])
    rows = spark.createDataFrame([(0, skin * 2 + blue * 2), (1, skin + blue * 9), (2, b""), (3, None)], "k long, p binary")
    got = [tuple(r.c) for r in rows.select("k", boxes.roi_mean_rgb("p").alias("c")).orderBy("k").collect()]
    assert got[0] == (180, 120, 100) and np.allclose(got[1], (18, 12, 239.5)) and got[2] == got[3] == (None,) * 3


def test_envelope_offset(spark):
    env = np.random.default_rng(0).random(400) - 0.5
    row = (1, 0, 1, env.tolist(), env[37:].tolist(), 0.0, 0.5)
    back = (1, 1, 0, env[37:].tolist(), env.tolist(), None, None)
    schema = "session_id long, left long, right long, left_env array<double>, right_env array<double>, left_start_sec double, right_start_sec double"
    got = {r.left: r.offset_sec for r in offsets.envelope_offset(spark.createDataFrame([row, back, (1, 2, 0, None, [], 0.0, 0.0)], schema)).collect()}
    assert np.allclose([got[0], got[1], got[2]], [37 * 0.032 - 0.5, -37 * 0.032, 0])
    a, b = env[:50], env[20:90]
    brute = [sum(a[t + k] * b[t] for t in range(len(b)) if 0 <= t + k < len(a)) for k in range(-30, 31)]
    assert offsets.envelope_lag(a, b, 30) == int(np.argmax(brute)) - 30


def test_reconciled_offsets_drop_the_outlier(spark):
    true = [0.0, 1.0, -2.0, 0.5]
    rows = [(1, a, b, true[b] - true[a] + (9.0 if (a, b) == (0, 2) else 0.0)) for a, b in product(range(4), repeat=2) if a < b]
    schema = "session_id long, left long, right long, offset_sec double"
    got = offsets.reconciled_offsets(spark.createDataFrame(rows, schema)).orderBy("camera_index").collect()
    assert np.allclose([r.offset_sec for r in got], true) and got[0].max_residual == 9.0 and got[0].median_residual == 0
    with pytest.raises(Exception, match="do not connect"):
        offsets.reconciled_offsets(spark.createDataFrame([(1, 1, 2, 0.0)], schema)).collect()


def test_reconciled_offsets_keep_every_session(spark):
    schema = "session_id long, left long, right long, offset_sec double"
    rows = [(1, 0, 1, 2.0), (1, 1, 2, 1.0), (2, 2, 3, 5.0), (2, 0, 1, 1.0), (3, 0, 1, None)]
    got = offsets.reconciled_offsets(spark.createDataFrame(rows, schema), unconnected="null").orderBy("session_id", "camera_index").collect()
    assert [(r.session_id, r.camera_index, r.offset_sec, r.connected) for r in got[:3]] == [(1, 0, 0.0, True), (1, 1, 2.0, True), (1, 2, 3.0, True)]
    assert [(r.session_id, r.camera_index) for r in got[3:]] == [(2, 0), (2, 1), (2, 2), (2, 3), (3, 0), (3, 1)]
    assert all(r.offset_sec is None and r.max_residual is None and not r.connected for r in got[3:])


def test_reconciled_offsets_query_takes_all_orders(spark, tmp_path):
    items = [(1, 1, 4.0), (1, 2, 5.0), (1, 3, 6.0), (2, 1, 7.0), (3, 1, 1.0), (3, 4, 2.0), (4, 2, 3.0)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.QUERIES["reconciled_offsets"](spark, str(tmp_path)).groupBy("session_id").agg(F.bool_and("connected").alias("c"), F.count("*").alias("n")).collect()
    assert {r.session_id: (r.c, r.n) for r in got} == {1: (True, 4), 2: (True, 2), 3: (True, 3), 4: (False, 3)}


def test_session_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cameras": [{"fps": 30.0, "dimensions": [640, 480]}, {"label": "left"}],\n "signal_paths": ["h.csv", "", "h.csv"], "synced_signal_path": "s.csv", "video_signal_offset_sec": null}')
    (tmp_path / "b.json").write_text('{"hr_signal_paths": [], "signal_paths": ["old.csv"]}')
    kept, cameras = sessions.read_sessions(spark, [str(tmp_path)])
    a, b = kept.orderBy("session_id").collect()
    assert (a.hr_signal_paths, a.synced_hr_paths, a.video_signal_offset_sec, b.hr_signal_paths) == (["h.csv"], ["s.csv"], 0.0, [])
    assert [(r.label, r.fps, r.width, r.limits_common_duration) for r in cameras.orderBy("camera_index").collect()] == [("Camera 1", 30.0, 640, True), ("left", 0.0, 0, True)]
    sessions.write_sessions(kept, cameras, str(tmp_path / "out"))
    again = sessions.parse_sessions(spark.read.schema("session_id string, json string").json(str(tmp_path / "out")))
    order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert order(again[0]) == order(kept) and order(again[1]) == order(cameras)


def test_offset_must_be_there(spark):
    rows = spark.createDataFrame([('{"video_signal_offset_sec": 1.5}',), ('{"video_signal_offset_sec": null}',)], "j string")
    assert [r.o for r in rows.select(sessions.offset_of("j").alias("o")).collect()] == [1.5, 0.0]
    with pytest.raises(Exception, match="no video_signal_offset_sec"):
        rows.select(sessions.offset_of(F.lit("{}")).alias("o")).collect()


def test_camera_alone_and_trees_in_blocks(spark, monkeypatch):
    schema = "session_id long, left long, right long, offset_sec double"
    one = offsets.reconciled_offsets(spark.createDataFrame([(1, 0, 0, None)], schema), unconnected="null").collect()
    assert [(r.camera_index, r.offset_sec, r.median_residual, r.connected) for r in one] == [(0, 0.0, None, True)]
    edges = [np.array(c) for c in zip(*[(a, b, b - a + (a * 7 + b * 3) % 5 / 10) for a in range(5) for b in range(a + 1, 5)], strict=True)]
    whole = offsets._best_tree(*edges, 5)
    monkeypatch.setattr(offsets, "BLOCK_TREES", 3)
    assert offsets._best_tree(*edges, 5) == whole


def test_boxes_without_a_frame_go(spark):
    rows = spark.createDataFrame([(1, None, 0.0, 1.0, 1.0, 5.0, 5.0, 0.5), (1, 2, 0.1, 1.0, 1.0, 5.0, 5.0, 0.5)], BOXES)
    assert [r.frame_idx for r in boxes.track_boxes(rows).collect()] == [r.frame_idx for r in boxes.follow_face(rows, 30.0).collect()] == [2]


def clips_of_all_kinds(spark):
    """120 clips of one to 60 frames: frames of many boxes and of none, long gaps, ties and times that are unknown."""
    rng = np.random.default_rng(4)
    rows = []
    for clip in range(120):
        for frame in np.unique(rng.integers(0, 90, 1 + clip // 2)).tolist():
            t = None if rng.random() < 0.01 else frame / 30
            rows += [(clip, frame, t, None, None, None, None, None)] if rng.random() < 0.2 else []
            for _ in range(12 if rng.random() < 0.03 else rng.integers(0, 4)):
                x, y, w, h = (float(v) for v in rng.integers([0, 0, 8, 8], [60, 40, 30, 30]))
                rows.append((clip, frame, t, x, y, w, None if rng.random() < 0.02 else h, float(rng.integers(0, 5)) / 4))
    return spark.createDataFrame(rows, BOXES), rows


def by_clip(rows):
    clips = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], *((v is None, v or 0) for v in (None if r[7] is None else -r[7], *r[3:7], r[2])))):
        clips.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    return clips


def test_tracks_of_many_clips_as_one_by_one(spark):
    df, rows = clips_of_all_kinds(spark)
    want = []
    for clip, frames in by_clip(rows).items():
        tracks, made = [], 0
        for frame, found in frames.items():
            t = found[0][2] if found[0][2] is not None else float("nan")
            taken = []
            for r in found:
                if None in r[3:7]:
                    continue
                new = r[3:7]
                middle = [new[0] + new[2] / 2, new[1] + new[3] / 2]
                best, rank = None, 0
                for k in tracks:
                    off = [middle[j] - (k["box"][j] + k["box"][j + 2] / 2) for j in (0, 1)]
                    share = iou(new, k["box"])
                    share = 0.01 if share <= 0 and np.hypot(*off) < 0.75 * max(*k["box"][2:], *new[2:]) else share
                    if k["id"] not in taken and share > rank:
                        best, rank, moved = k, share, off
                if best is None:
                    best = {"id": made, "speed": [0.0, 0.0]}
                    tracks, made = [*tracks, best], made + 1
                else:
                    past = max(1e-3, t - best["seen"])
                    best["speed"] = [(v + m / past) / 2 for v, m in zip(best["speed"], moved)]
                best["box"], best["seen"], taken = new, t, [*taken, best["id"]]
            tracks = [k for k in tracks if t - k["seen"] <= 0.6]
            for k in tracks:
                age = max(t - k["seen"], 0)
                grown = [v * (1 + 0.5 * age / 0.6) for v in k["box"][2:]]
                want.append((clip, frame, k["id"], *(k["box"][j] + k["box"][j + 2] / 2 + k["speed"][j] * age - grown[j] / 2 for j in (0, 1)), *grown, age))
    got = boxes.track_boxes(df)
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()  # no call for each clip
    got, want = np.array(sorted(map(tuple, got.collect()))), np.array(sorted(want))
    assert got.shape == want.shape and np.array_equal(got[:, :3], want[:, :3]) and np.allclose(got, want)


def test_suppression_of_many_frames_as_one_by_one(spark):
    df, rows = clips_of_all_kinds(spark)
    want = []
    for clip, frames in by_clip(rows).items():
        for frame, found in frames.items():
            kept = []
            for r in found:
                if None not in r[3:] and all(iou(r[3:7], k[3:7]) <= 0.3 for k in kept):
                    kept.append(r)
            want += [(clip, frame, *r[3:]) for r in kept]
    got = boxes.suppress(df)
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("centred", [False, True])
def test_faces_of_many_clips_as_one_by_one(spark, centred):
    df, rows = clips_of_all_kinds(spark)
    want = []
    for clip, frames in by_clip(rows).items():
        face, at, path = None, [], []
        for frame, found in frames.items():
            found = sorted(r[3:7] for r in found if None not in r[3:7])
            if found and (face is None or frame % 5 == 0):
                share = [iou(face, b) if face else 0 for b in found]
                best = found[int(np.argmax(share))] if max(share) > 0.1 else max(found, key=lambda b: b[2] * b[3])
                face = best if centred or face is None else tuple(0.65 * a + 0.35 * b for a, b in zip(face, best))
                at.append((frame, face))
            path.append(face)
        if centred and at:
            each = np.arange(min(frames), max(frames) + 1)
            x, y, w, h = (np.interp(each, [f for f, _ in at], [b[k] + (b[k + 2] / 2 if k < 2 else 0) for _, b in at]) for k in range(4))
            near = lambda v, k, f: np.array([f(v[max(j - k, 0) : j + k + 1]) for j in range(len(v))])
            w, h = near(w, 7, np.median), near(h, 7, np.median)
            smooth = np.stack([near(x, 1, np.mean) - w / 2, near(y, 1, np.mean) - h / 2, w, h], 1)
            path = [p and tuple(smooth[f - each[0]]) for f, p in zip(frames, path)]
        for frame, p in zip(frames, path):
            seen = [f for f, _ in at if f <= frame]
            want.append((clip, frame, *(p or (np.nan,) * 4), bool(seen) and frame - seen[-1] < 15))
    got = boxes.follow_face(df, 30.0, centred=centred, hold_sec=0.5)
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = np.array(sorted(tuple(np.nan if v is None else v for v in r) for r in got.collect()), float)
    assert np.allclose(got, np.array(sorted(want), float), equal_nan=True)


def test_sessions_with_the_same_relations_go_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(2)
    shapes = [[(0, 1)], [(0, 1), (0, 2), (1, 2)], [(0, 1), (0, 1), (2, 1), (3, 0), (2, 3)], [(0, 2), (0, 2)], [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2), (1, 3), (2, 2)]]
    rows = [(s, *e, float(rng.integers(-4, 5)) / 2) for s in range(300) for e in shapes[s % 5]]
    want = []
    for s in range(300):
        own = sorted(r[1:] for r in rows if r[0] == s)
        size, best = 1 + max(max(r[:2]) for r in own), None
        for tree in combinations(own, size - 1):
            at = {0: 0.0}
            for _ in tree:
                for a, b, off in tree:
                    if a in at:
                        at.setdefault(b, at[a] + off)
                    elif b in at:
                        at[a] = at[b] - off
            if len(at) == size:
                left = [abs(at[b] - at[a] - off) for a, b, off in own]
                score = tuple(np.round([np.median(left), np.mean(left), max(left)], 9).tolist())
                best = (score, at) if best is None or score < best[0] else best
        want += [(s, k, best and best[1][k], *(best[0] if best else (None,) * 3), best is not None) for k in range(size)]
    df = spark.createDataFrame(rows, "session_id long, left long, right long, offset_sec double").repartition(3)
    got = offsets.reconciled_offsets(df, unconnected="null")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == want
    # One enumeration of the trees for all sessions of a shape.
    calls, real = [], offsets._trees
    monkeypatch.setattr(offsets, "_trees", lambda *a: calls.append(a) or real(*a))
    offs = rng.random((100, 3))
    residuals, found = offsets._best_trees((0, 0, 1), (1, 2, 2), offs, 3)
    assert len(calls) == 1 and all(offsets._best_tree(*np.array([(0, 1), (0, 2), (1, 2)]).T, o, 3) == (tuple(r.tolist()), f.tolist()) for o, r, f in zip(offs, residuals, found))
