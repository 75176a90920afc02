"""Boxes found in frames: suppression of overlapping ones, tracks through a clip, and the mean colour inside.

A box is (x, y, w, h).  Frames are dealt one by one where they do not depend on each other, else by clip; what a task has of them is
worked on side by side, a step of all at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cadentia.functions import dsp
from cadentia.operators.dealing import in_groups

BOX = ["x", "y", "w", "h"]


def _known(c: str) -> Column:
    """The number c, or null where it is none."""
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value), value).alias(c)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes a and b, whose first axis is x, y, w, h."""
    wide, high = (np.clip(np.minimum(a[k] + a[k + 2], b[k] + b[k + 2]) - np.maximum(a[k], b[k]), 0, None) for k in (0, 1))
    both = wide * high
    union = a[2] * a[3] + b[2] * b[3] - both
    return np.divide(both, union, out=np.zeros(union.shape), where=union > 0)


def _ragged(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """low[k], low[k] + 1, ..., `many[k]` numbers for each k, one after the other."""
    return np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())


def _boxes(rows: pa.Table) -> np.ndarray:
    return np.stack([rows[c].to_numpy() for c in BOX])


def _frames(rows: pa.Table, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each frame, and the first frame of each clip, for clips that begin at `begins` and whose frames are in order."""
    frame = rows["frame_idx"].to_numpy()
    new = np.append(True, frame[1:] != frame[:-1])
    new[begins] = True
    low = np.flatnonzero(new)
    return low, np.searchsorted(low, begins)


def suppress(detections: DataFrame, limit: float = 0.3) -> DataFrame:
    """The detections (clip_id, frame_idx, x, y, w, h, score) left in each frame: from the highest score down, one stays
    unless it overlaps one that stays by more than `limit`.  Ties go by x, y, w, h.  A row without box or score goes.

    Frames are dealt one by one, and those of a call go side by side: first the best boxes of all, then the second ones."""
    rows = detections.select("clip_id", "frame_idx", *(F.col(c).cast("double").alias(c) for c in [*BOX, "score"])).dropna()

    def run(part: pa.Table, begins: np.ndarray) -> pa.Table:
        box, keep = _boxes(part), np.ones(part.num_rows, bool)
        at, ends = begins, np.append(begins[1:], part.num_rows)
        while len(at):
            at, ends = at[at + 1 < ends], ends[at + 1 < ends]
            best = keep[at]
            many = ends[best] - at[best] - 1
            one, other = np.repeat(at[best], many), _ragged(at[best] + 1, many)
            left = keep[other]
            one, other = one[left], other[left]
            keep[other[_share(box[:, one], box[:, other]) > limit]] = False
            at = at + 1
        return part.filter(pa.array(keep))

    return in_groups(rows, ["clip_id", "frame_idx"], [F.desc("score"), *BOX], run, rows.schema)


def _tracks(box: np.ndarray, time: np.ndarray, whole: np.ndarray, low: np.ndarray, first: np.ndarray, persistence_sec: float) -> tuple[np.ndarray, ...]:
    """Frame (its number among all), track, box and age of what is masked, for the frames that begin at rows `low`, and clips that begin at
    frames `first`.  All clips take their first frames, then their second ones, and so on; of a frame, all take their first boxes."""
    good = np.append(0, np.cumsum(whole))
    count = good[np.append(low[1:], len(whole))] - good[low]
    begin, good = good[low], np.flatnonzero(whole)
    frames = np.append(first[1:], len(low)) - first
    clips = np.argsort(-frames, kind="stable")
    first, frames = first[clips], frames[clips]
    # Tracks of a clip in the order of their numbers; gone ones leave gaps until there is no room.
    room, used = 8, np.zeros(len(clips), np.int64)
    track, seen, live = np.zeros((len(clips), room), np.int64), np.zeros((len(clips), room)), np.zeros((len(clips), room), bool)
    at, speed, made = np.zeros((4, len(clips), room)), np.zeros((2, len(clips), room)), np.zeros(len(clips), np.int64)
    out = []
    for k in range(int(frames[0]) if len(frames) else 0):
        n = int(np.searchsorted(-frames, -k, "left"))  # clips with more frames than k
        own = first[:n] + k
        now, many, start = time[low[own]], count[own], begin[own]
        free = np.ones((n, room), bool)
        for turn in range(int(many.max(initial=0))):
            c = np.flatnonzero(many > turn)
            if used[c].max() == room:
                order = np.argsort(~live, axis=1, kind="stable")
                track, seen, live = (np.take_along_axis(x, order, 1) for x in (track, seen, live))
                at, speed = (np.take_along_axis(x, order[None], 2) for x in (at, speed))
                free = np.take_along_axis(free, order[:n], 1)
                used = live.sum(1)
                if 2 * used.max() > room:
                    widen = lambda x, room=room: np.concatenate([x, np.zeros((*x.shape[:-1], room), x.dtype)], -1)
                    track, seen, live, at, speed = map(widen, (track, seen, live, at, speed))
                    free, room = np.concatenate([free, np.ones((n, room), bool)], -1), 2 * room
            new = box[:, good[start[c] + turn], None]
            old = at[:, c]
            rank = _share(new, old)
            moved = np.stack([new[j] + new[j + 2] / 2 - (old[j] + old[j + 2] / 2) for j in (0, 1)])
            near = np.hypot(*moved) < 0.75 * np.maximum(np.maximum(old[2], old[3]), np.maximum(new[2], new[3]))
            rank = np.where(live[c], np.where((rank <= 0) & near, 0.01, rank) * free[c], 0)
            best = rank.argmax(1)
            hit = rank[np.arange(len(c)), best] > 0
            i, j = c[hit], best[hit]
            past = np.fmax(1e-3, now[i] - seen[i, j])
            speed[:, i, j] = (speed[:, i, j] + moved[:, hit, j] / past) / 2
            at[:, i, j], seen[i, j], free[i, j] = new[:, hit, 0], now[i], False
            i = c[~hit]
            j = used[i]
            track[i, j], seen[i, j], live[i, j], free[i, j] = made[i], now[i], True, False
            at[:, i, j], speed[:, i, j] = new[:, ~hit, 0], 0
            made[i] += 1
            used[i] += 1
        live[:n] &= now[:, None] - seen[:n] <= persistence_sec
        i, j = np.nonzero(live[:n])
        age = np.clip(now[i] - seen[i, j], 0, None)
        grown = at[2:, i, j] * (1 + (0.5 * age / persistence_sec if persistence_sec > 0 else 0 * age))
        corner = at[:2, i, j] + at[2:, i, j] / 2 + speed[:, i, j] * age - grown / 2
        out.append((own[i], track[i, j], *corner, *grown, age))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def track_boxes(detections: DataFrame, persistence_sec: float = 0.6) -> DataFrame:
    """Boxes to mask in each frame: clip_id, frame_idx, track_id, x, y, w, h, age_sec.

    detections: clip_id, frame_idx, t_sec, x, y, w, h, score; a frame without any has one row with nulls.  From the
    highest score down a detection takes the free track it overlaps most, else one whose centre is nearer than 0.75 of
    the larger side, else it starts a track.  An unseen track moves on with its blended speed, grows by up to half, and
    ends after `persistence_sec`.  Rows without a frame_idx go.  A clip is one ordered walk, so one clip is one task; a task's clips
    walk side by side."""
    rows = detections.select("clip_id", "frame_idx", *map(_known, ["t_sec", *BOX, "score"])).dropna(subset=["frame_idx"])

    def run(part: pa.Table, begins: np.ndarray) -> pa.Table:
        box = _boxes(part)
        low, first = _frames(part, begins)
        frame, track, *numbers = _tracks(box, part["t_sec"].to_numpy(), ~np.isnan(box).any(0), low, first, persistence_sec)
        row = low[frame]
        whole = {c: part[c].take(row) for c in ("clip_id", "frame_idx")}
        return pa.table({**whole, "track_id": track} | {c: pa.array(x, from_pandas=True) for c, x in zip([*BOX, "age_sec"], numbers, strict=True)})

    kinds = dict(rows.dtypes)
    order = ["frame_idx", F.desc_nulls_last("score"), *map(F.asc_nulls_last, [*BOX, "t_sec"])]
    return in_groups(rows, ["clip_id"], order, run, f"clip_id {kinds['clip_id']}, frame_idx {kinds['frame_idx']}, track_id long, x double, y double, w double, h double, age_sec double")


def _faces(box: np.ndarray, low: np.ndarray, many: np.ndarray, first: np.ndarray, blend: float, centred: bool) -> np.ndarray:
    """The face (x, y, w, h) after each of the looks, of which look k sees the boxes low[k], ... (`many[k]`), for clips whose looks begin at
    `first`.  All clips take their first looks, then their second ones."""
    def best(value: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest value of each stretch, and its place in the stretch, the first of equal ones."""
        begin = np.cumsum(many) - many
        top = np.maximum.reduceat(value, begin)
        place = np.flatnonzero(value == np.repeat(top, many))
        of = np.repeat(np.arange(len(many)), many)[place]
        head = np.append(True, of[1:] != of[:-1])
        return top, place[head] - begin

    if not len(low):
        return np.zeros((4, 0))
    own = _ragged(low, many)
    choice = low + best(box[2, own] * box[3, own], many)[1]
    out = box[:, choice]
    looks = np.append(first[1:], len(low)) - first
    clips = np.argsort(-looks, kind="stable")
    first, looks = first[clips], looks[clips]
    for k in range(1, int(looks[0])):
        at = first[: int(np.searchsorted(-looks, -k, "left"))] + k
        face, n = out[:, at - 1], many[at]
        top, place = best(_share(np.repeat(face, n, 1), box[:, _ragged(low[at], n)]), n)
        found = box[:, np.where(top > 0.1, low[at] + place, choice[at])]
        out[:, at] = found if centred else (1 - blend) * face + blend * found
    return out


def follow_face(detections: DataFrame, fs: float, every: int = 5, blend: float = 0.35, centred: bool = False, hold_sec: float = 2.0) -> DataFrame:
    """One box per frame: clip_id, frame_idx, x, y, w, h (null before the first face) and detected (seen in the last `hold_sec`).

    detections are as in track_boxes.  Every `every`-th frame, and each frame while there is no face, the box that overlaps
    the face most counts if it does by more than 0.1, else the largest.  It is blended into the face; or with `centred`
    the boxes found are interpolated, then centres averaged over 3 frames and sizes set to the median of 15.  Rows without a frame_idx go.
    A clip is a task's work; a task's clips go side by side."""
    rows = detections.select("clip_id", "frame_idx", *map(_known, BOX)).dropna(subset=["frame_idx"])

    def smooth(frame: np.ndarray, known: np.ndarray, found: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Boxes of all frames from those found in the frames `known`, for clips of the frames first .. ends."""
        middle = found.copy()
        middle[:2] += found[2:] / 2
        spans, values = [], []
        at = np.searchsorted(known, np.stack([first, ends]))
        for a, b, low, high in zip(first.tolist(), ends.tolist(), *at.tolist(), strict=True):
            each = np.arange(frame[a], frame[b - 1] + 1)
            spans.append(len(each))
            values.append([np.interp(each, frame[known[low:high]], c[low:high]) for c in middle] if low < high else np.full((4, len(each)), np.nan))
        values, span = np.concatenate(values, 1), np.array(spans)
        end = np.cumsum(span)
        begin, place = np.repeat(end - span, span), np.arange(len(values[0]))
        near = lambda k: dsp.Frames(low=np.maximum(place - k, begin), high=np.minimum(place + k + 1, np.repeat(end, span)))
        x, y = (pd.Series(c).rolling(near(1), min_periods=1).mean().to_numpy() for c in values[:2])
        w, h = (pd.Series(c).rolling(near(7), min_periods=1).median().to_numpy() for c in values[2:])
        many = ends - first
        return np.stack([x - w / 2, y - h / 2, w, h])[:, np.repeat(end - span, many) + frame - np.repeat(frame[first], many)]

    def run(part: pa.Table, begins: np.ndarray) -> pa.Table:
        box = _boxes(part)
        low, first = _frames(part, begins)
        whole = ~np.isnan(box).any(0)
        good = np.append(0, np.cumsum(whole))
        many, begin = good[np.append(low[1:], part.num_rows)] - good[low], good[low]
        box, frame = box[:, whole], part["frame_idx"].to_numpy()[low]
        ends = np.append(first[1:], len(low))
        clip = np.repeat(np.arange(len(first)), ends - first)
        seen = np.flatnonzero(many > 0)
        start = np.append(True, clip[seen][1:] != clip[seen][:-1])
        look = seen[start | (frame[seen] % every == 0)]
        new = np.flatnonzero(np.append(True, clip[look][1:] != clip[look][:-1]))[: len(look)]
        faces = _faces(box, begin[look], many[look], new, blend, centred)
        last = np.searchsorted(look, np.arange(len(low)), "right") - 1
        has = last >= 0
        has[has] = clip[look[last[has]]] == clip[has]
        path, detected = np.full((4, len(low)), np.nan), np.zeros(len(low), bool)
        path[:, has] = faces[:, last[has]]
        detected[has] = frame[has] - frame[look[last[has]]] < int(hold_sec * fs)
        if centred:
            path = np.where(has, smooth(frame, look, faces, first, ends), np.nan)
        ids = {c: part[c].take(low) for c in ("clip_id", "frame_idx")}
        return pa.table({**ids, **{c: pa.array(x, from_pandas=True) for c, x in zip(BOX, path, strict=True)}, "detected": detected})

    kinds = dict(rows.dtypes)
    return in_groups(rows, ["clip_id"], ["frame_idx", *map(F.asc_nulls_last, BOX)], run, f"clip_id {kinds['clip_id']}, frame_idx {kinds['frame_idx']}, x double, y double, w double, h double, detected boolean")


def roi_mean_rgb(pixels: Column | str, skin_only: bool = True, least: float = 0.15) -> Column:
    """Struct r, g, b: the mean of a region's pixels (binary, three bytes each in the order b, g, r).

    With `skin_only` only pixels with 133 <= Cr <= 173 and 77 <= Cb <= 127 count, unless they are fewer than `least` of
    the region.  A null or empty region gives nulls."""

    @pandas_udf("r double, g double, b double")
    def mean(regions: pd.Series) -> pd.DataFrame:
        out = np.full((len(regions), 3), np.nan)
        for k, region in enumerate(regions):
            if not region:
                continue
            bgr = np.frombuffer(region, np.uint8).reshape(-1, 3).astype(float)
            luma = bgr @ [0.114, 0.587, 0.299]
            cr, cb = np.rint((bgr[:, 2] - luma) * 0.713 + 128), np.rint((bgr[:, 0] - luma) * 0.564 + 128)
            skin = (cr >= 133) & (cr <= 173) & (cb >= 77) & (cb <= 127)
            out[k] = bgr[skin if skin_only and skin.mean() >= least else slice(None)].mean(0)[::-1]
        return pd.DataFrame(out, columns=["r", "g", "b"]).astype(object).where(~np.isnan(out), None)

    return mean(pixels)
