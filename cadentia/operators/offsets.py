"""Offsets between the cameras of a session from their sound's onset envelopes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.operators.dealing import in_groups
from cadentia.operators.running import with_halo

HOP_SEC = 512 / 16_000
#: Products of two envelopes' values that are added one by one; more go by transforms.
SHORT = 1_024
#: Spanning trees whose residuals are taken at once, of all sessions that go side by side, and how many sessions do.
BLOCK_TREES = 4_096
BLOCK_SESSIONS = 512


def envelope_lag(reference: np.ndarray, target: np.ndarray, most: int) -> int:
    """The lag k within +-most at which sum(reference[t + k] * target[t]) is largest; the first of equal ones."""
    if not len(reference) or not len(target):
        return 0
    size = 1 << (len(reference) + len(target) - 1).bit_length()
    both = np.fft.irfft(np.fft.rfft(reference, size) * np.conj(np.fft.rfft(target, size)), size)
    lags = np.arange(max(-most, 1 - len(target)), min(most, len(reference) - 1) + 1)
    return int(lags[both[lags].round(9).argmax()])


def envelope_offset(pairs: DataFrame, max_offset_sec: float = 60.0, hop_sec: float = HOP_SEC) -> DataFrame:
    """session_id, left, right, offset_sec for pairs (session_id, left, right, left_env, right_env, left_start_sec,
    right_start_sec), envelopes being arrays at `hop_sec`.  Starts are where each camera's sound was cut."""

    def run(batches):
        for rows in batches:
            lags = [envelope_lag(np.asarray(a, float), np.asarray(b, float), int(max_offset_sec / hop_sec)) for a, b in zip(rows["left_env"], rows["right_env"], strict=True)]
            cut = rows["right_start_sec"] - rows["left_start_sec"]
            yield rows[["session_id", "left", "right"]].assign(offset_sec=np.array(lags, float) * hop_sec - cut)

    empty = F.array().cast("array<double>")
    starts = (F.coalesce(c, F.lit(0.0)).alias(c) for c in ("left_start_sec", "right_start_sec"))
    rows = pairs.select(F.col("session_id").cast("long"), F.col("left").cast("long"), F.col("right").cast("long"), F.coalesce("left_env", empty).alias("left_env"), F.coalesce("right_env", empty).alias("right_env"), *starts)
    return rows.mapInPandas(run, "session_id long, left long, right long, offset_sec double")


def envelope_offset_rows(envelopes: DataFrame, pairs: DataFrame, max_offset_sec: float = 60.0, hop_sec: float = HOP_SEC, block: int = 16_384) -> DataFrame:
    """As envelope_offset for envelopes of any length, given as rows (session_id, camera, hop, value), hop from 0 without gaps, and
    pairs (session_id, left, right, left_start_sec, right_start_sec).

    Overlap-save: the right envelope is cut into blocks, and each meets the part of the left one that it can overlap within the
    greatest lag; the blocks' sums over products are added up by lag.  No array is longer than a block and two greatest lags, and
    only lags at which two values of a block meet have a sum, so short envelopes have few."""
    most = int(max_offset_sec / hop_sec)
    named = pairs.select("session_id", "left", "right", F.coalesce("left_start_sec", F.lit(0.0)).alias("a"), F.coalesce("right_start_sec", F.lit(0.0)).alias("b"))
    side = lambda c: envelopes.select("session_id", F.col("camera").alias(c), F.col("hop").cast("long").alias("hop"), F.col("value").cast("double").alias("value"))
    keys = ["session_id", "left", "right", "__block"]
    target = with_halo(side("right"), F.col("hop"), block, 0, 0).join(named.select("session_id", "left", "right"), ["session_id", "right"])
    reference = with_halo(side("left"), F.col("hop"), block, most, most).filter("__block >= 0").join(named.select("session_id", "left", "right"), ["session_id", "left"])
    both = target.select(*keys, F.lit(0).alias("side"), "hop", "value").unionByName(reference.select(*keys, F.lit(1).alias("side"), "hop", "value"))

    def run(rows: pa.Table, begins: np.ndarray) -> pa.Table:
        turn, hop, value = (rows[c].to_numpy() for c in ("side", "hop", "value"))
        value = np.where(np.isnan(value), 0.0, value)
        ends = np.append(begins[1:], len(hop))
        cut = begins + np.add.reduceat(turn == 0, begins)  # where a group's left side begins
        met = (cut > begins) & (cut < ends)
        begins, cut, ends = begins[met], cut[met], ends[met]
        least = np.maximum(hop[cut] - hop[cut - 1], -most)
        many = np.maximum(np.minimum(hop[ends - 1] - hop[begins], most) + 1 - least, 0)
        at = np.cumsum(many) - many
        sums = np.zeros(int(many.sum()))
        short = (cut - begins) * (ends - cut) <= SHORT
        a, b = _crossed(begins[short], cut[short], ends[short])
        lag, own = hop[b] - hop[a], np.repeat(np.flatnonzero(short), ((cut - begins) * (ends - cut))[short])
        within = np.abs(lag) <= most
        np.add.at(sums, (at[own] + lag - least[own])[within], (value[a] * value[b])[within])
        for k in np.flatnonzero(~short).tolist():
            y, x = np.zeros(hop[cut[k] - 1] - hop[begins[k]] + 1), np.zeros(hop[ends[k] - 1] - hop[cut[k]] + 1)
            y[hop[begins[k] : cut[k]] - hop[begins[k]]] = value[begins[k] : cut[k]]
            x[hop[cut[k] : ends[k]] - hop[cut[k]]] = value[cut[k] : ends[k]]
            size = 1 << (len(x) + len(y) - 1).bit_length()
            product = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
            lags = np.arange(least[k], least[k] + many[k])
            sums[at[k] : at[k] + many[k]] = product[lags - (hop[cut[k]] - hop[begins[k]])]
        whole = {c: rows[c].take(np.repeat(begins, many)) for c in keys[:3]}
        return pa.table({**whole, "lag": np.arange(len(sums)) - np.repeat(at - least, many), "product": sums})

    kinds = dict(both.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys[:3]) + ", lag long, product double"
    added = in_groups(both, keys, ["side", "hop"], run, schema).groupBy("session_id", "left", "right", "lag").agg(F.sum("product").alias("product"))
    best = added.groupBy("session_id", "left", "right").agg(F.max(F.struct(F.round("product", 9).alias("p"), (-F.col("lag")).alias("back"))).alias("best"))
    lag = F.coalesce(-F.col("best.back"), F.lit(0))
    return named.join(best, ["session_id", "left", "right"], "left").select("session_id", "left", "right", (lag * hop_sec - (F.col("b") - F.col("a"))).alias("offset_sec"))


def _crossed(begins: np.ndarray, cut: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of begins..cut with each of cut..ends, group by group."""
    one, two = cut - begins, ends - cut
    a = np.repeat(np.repeat(begins - np.cumsum(one) + one, one) + np.arange(one.sum()), np.repeat(two, one))
    turn = np.repeat(two, one)
    b = np.repeat(np.repeat(cut, one), turn) + np.arange(turn.sum()) - np.repeat(np.cumsum(turn) - turn, turn)
    return a, b


def reference_offsets(relations: DataFrame, cameras: DataFrame) -> DataFrame:
    """session_id, camera_index, offset_sec: what relates each camera with camera 0; null where nothing does."""
    direct = relations.filter("left = 0").groupBy("session_id", F.col("right").alias("camera_index")).agg(F.min("offset_sec").alias("offset_sec"))
    rows = cameras.select("session_id", "camera_index").distinct().join(direct, ["session_id", "camera_index"], "left")
    return rows.select("session_id", "camera_index", F.when(F.col("camera_index") == 0, 0.0).otherwise(F.col("offset_sec")).alias("offset_sec"))


def _trees(left: tuple[int, ...], right: tuple[int, ...], size: int) -> Iterator[tuple[list[int], list[tuple[int, int, int]]]]:
    """Spanning trees of relations: their places, and the steps (known camera, new camera, place; negative from right to left, as ~place)
    that lead from camera 0 to all others."""
    for tree in combinations(range(len(left)), size - 1):
        known, open_, steps = {0}, list(tree), []
        while open_:
            rest = []
            for e in open_:
                a, b = left[e], right[e]
                if a in known:
                    if b not in known:
                        steps.append((a, b, e))
                        known.add(b)
                elif b in known:
                    steps.append((b, a, ~e))
                    known.add(a)
                else:
                    rest.append(e)
            if len(rest) == len(open_):
                break
            open_ = rest
        if known == set(range(size)):
            yield list(tree), steps


def _best_trees(left: tuple[int, ...], right: tuple[int, ...], off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Residuals (median, mean, largest; n x 3) and offsets (n x size) of the spanning tree with the least, the first of equal ones, for n
    sessions with the same relations, ordered by left, right and off (n x relations); None if there is no tree.  A camera
    alone, without relations, is its own tree and has no residuals."""
    n = len(off)
    if not len(left):
        return (np.full((n, 3), np.nan), np.zeros((n, 1))) if size == 1 else None
    found, best = _trees(left, right, size), None
    while block := list(islice(found, max(1, BLOCK_TREES // n))):
        at = np.zeros((n, len(block), size))
        for k, (_, steps) in enumerate(block):
            for a, b, e in steps:
                at[:, k, b] = at[:, k, a] + off[:, e] if e >= 0 else at[:, k, a] - off[:, ~e]
        residual = np.abs(at[:, :, list(right)] - at[:, :, list(left)] - off[:, None])
        scores = np.stack([np.median(residual, 2), residual.mean(2), residual.max(2)], 2).round(9)
        some = np.ones(scores.shape[:2], bool)
        for c in range(3):
            least = np.where(some, scores[:, :, c], np.inf).min(1)
            some &= scores[:, :, c] == least[:, None]
        k = some.argmax(1)
        own = scores[np.arange(n), k], at[np.arange(n), k]
        if best is None:
            best = own
        else:
            less = np.zeros(n, bool)
            same = np.ones(n, bool)
            for c in range(3):
                less |= same & (own[0][:, c] < best[0][:, c])
                same &= own[0][:, c] == best[0][:, c]
            best = np.where(less[:, None], own[0], best[0]), np.where(less[:, None], own[1], best[1])
    return best


def _best_tree(left: np.ndarray, right: np.ndarray, off: np.ndarray, size: int) -> tuple[tuple[float, ...], list[float]] | None:
    """As _best_trees, for one session, whose relations come in any order."""
    order = np.lexsort((off, right, left))
    best = _best_trees(*(tuple(np.asarray(c)[order].astype(int).tolist()) for c in (left, right)), np.asarray(off, float)[order][None], size)
    return best and (tuple(best[0][0].tolist()), best[1][0].tolist())


def reconciled_offsets(relations: DataFrame, unconnected: str = "raise") -> DataFrame:
    """session_id, camera_index, offset_sec, median_residual, mean_residual, max_residual, connected from relations.

    Of all spanning trees of a session's cameras 0..n that one counts whose offsets leave the least residuals (median,
    then mean, then largest).  A session whose relations do not connect its cameras fails the job or, if `unconnected`
    is "null", has a row per camera with nulls and connected = false; cameras are then counted from relations without an
    offset too.  The trees of a session are tried one by one, so this is for the handful of cameras that one session has;
    sessions with the same relations are tried side by side."""
    if unconnected not in ("raise", "null"):
        raise ValueError(f"unconnected: {unconnected}")

    def run(rows: pa.Table, begins: np.ndarray) -> pa.Table:
        left, right, off = (rows[c].cast("double").to_numpy() for c in ("left", "right", "offset_sec"))
        whole = ~(np.isnan(left) | np.isnan(right) | np.isnan(off))
        size = 1 + np.maximum.reduceat(np.fmax(np.fmax(left, right), 0), begins).astype(np.int64)
        many = np.add.reduceat(whole.astype(np.int64), begins)
        left, right, off = left[whole].astype(np.int64), right[whole].astype(np.int64), off[whole]
        at = np.cumsum(many) - many
        sessions = rows["session_id"].take(begins).to_numpy(zero_copy_only=False)
        # Sessions with as many cameras and the same relations, which come in order.
        shapes: dict[tuple[int, bytes], list[int]] = {}
        edges = np.stack([left, right], 1)
        for k, (a, n, cameras) in enumerate(zip(at.tolist(), many.tolist(), size.tolist(), strict=True)):
            shapes.setdefault((cameras, edges[a : a + n].tobytes()), []).append(k)
        parts = []
        for (cameras, _), own in shapes.items():
            first, n = at[own[0]], many[own[0]]
            shape = tuple(left[first : first + n].tolist()), tuple(right[first : first + n].tolist())
            for some in np.array_split(own, -(-len(own) // BLOCK_SESSIONS)):
                best = _best_trees(*shape, off[at[some][:, None] + np.arange(n)], cameras)
                if best is None and unconnected == "raise":
                    raise ValueError(f"session {sessions[some[0]]}: relations do not connect its cameras")
                residuals, found = best or (np.full((len(some), 3), np.nan), np.full((len(some), cameras), np.nan))
                each = np.repeat(np.arange(len(some)), cameras)
                parts.append((sessions[some][each], np.tile(np.arange(cameras), len(some)), found.reshape(-1), *residuals[each].T, np.full(len(each), best is not None)))
        names = ["session_id", "camera_index", "offset_sec", "median_residual", "mean_residual", "max_residual", "connected"]
        return pa.table({c: pa.array(x, from_pandas=True) for c, x in zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)})

    rows = relations.select(F.col("session_id").cast("long"), F.col("left").cast("long"), F.col("right").cast("long"), F.col("offset_sec").cast("double"))
    rows = rows.dropna() if unconnected == "raise" else rows.dropna(subset=["session_id"])
    return in_groups(rows, ["session_id"], ["left", "right", "offset_sec"], run, "session_id long, camera_index long, offset_sec double, median_residual double, mean_residual double, max_residual double, connected boolean")
