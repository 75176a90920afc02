"""Signal processing in numpy, for use inside grouped tasks; one array in, one array out."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd


def band_response(frequency: np.ndarray, fs: float, low: float, high: float, order: int) -> np.ndarray:
    """Squared magnitude of a digital Butterworth band-pass (bilinear transform, edges pre-warped)."""
    warp = lambda f: 2 * fs * np.tan(np.pi * np.minimum(f, 0.4999 * fs) / fs)
    w, a, b = warp(frequency), warp(np.float64(low)), warp(np.float64(high))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (w * w - a * b) / (w * (b - a))
    return np.where(w > 0, 1 / (1 + ratio ** (2 * order)), 0.0)


def bandpass(x: np.ndarray, fs: float, low: float, high: float, order: int) -> np.ndarray:
    """Zero-phase band-pass: the squared magnitude over the signal with odd extensions at both ends.

    Signals of fewer than 10 samples only lose their mean.  A band at or over the Nyquist rate is an error; that of order 2
    ends at 0.95 of it instead."""
    x = np.asarray(x, float)
    n = len(x)
    if order == 2:
        high = min(high, 0.95 * fs / 2)
    if not 0 < low < high < fs / 2:
        raise ValueError(f"a band of {low} to {high} Hz needs more than {fs} samples a second")
    if n < 10:
        return x - x.mean() if n else x
    pad = min(n - 1, int(10 * fs / max(low, 0.1)))
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    size = 1 << int(2 * len(wide) - 1).bit_length()
    gain = band_response(np.fft.rfftfreq(size, 1 / fs), fs, low, high, order)
    return np.fft.irfft(np.fft.rfft(wide - wide.mean(), size) * gain, size)[pad : pad + n]


def turning_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place and value of each run of equal values that is higher or lower than both neighbours, or at an end."""
    x = np.asarray(x, float)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    last, level = np.append(first[1:], len(x)) - 1, x[first]
    rises = level[1:] > level[:-1]
    turns = np.ones(len(level), bool)
    turns[1:-1] = rises[1:] != rises[:-1]
    return first[turns], last[turns], level[turns]


def _bases(level: np.ndarray) -> np.ndarray:
    """The least value from each place back to the last higher one (or the beginning); a stack holds what is not yet surpassed."""
    out = np.empty(len(level))
    tops: list[tuple[float, float]] = []
    for k, height in enumerate(level.tolist()):
        least = height
        while tops and tops[-1][0] <= height:
            least = min(least, tops.pop()[1])
        tops.append((height, least))
        out[k] = least
    return out


def choose_peaks(first: np.ndarray, last: np.ndarray, level: np.ndarray, distance: int = 1, prominence: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The peaks of a signal's turning points, thinned to a distance with the higher first, then by prominence; in linear time but for
    one sort."""
    if len(level) < 3:
        return np.zeros(0, int), np.zeros(0)
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (first[top] + last[top]) // 2
    keep = np.ones(len(peaks), bool)
    if distance > 1:
        low, high = np.searchsorted(peaks, peaks - distance, "right"), np.searchsorted(peaks, peaks + distance)
        for i in np.argsort(level[top], kind="stable")[::-1]:
            if keep[i]:
                keep[low[i] : high[i]] = False
                keep[i] = True
    heights = level[top] - np.maximum(_bases(level)[top], _bases(level[::-1])[::-1][top])
    keep &= heights >= prominence
    return peaks[keep], heights[keep]


def find_peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima (plateaus at their middle), thinned to a distance with the higher first, then by prominence."""
    return choose_peaks(*turning_points(x), distance, prominence)


class Frames(pd.api.indexers.BaseIndexer):
    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.low, self.high


def _mixed(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """a (1 - share) + b share, the first product added without being rounded."""
    c, p = 1 - share, b * share
    halves = []
    for x in (a, c):
        big = 134_217_729.0 * x
        high = big - (big - x)
        halves.append((high, x - high))
    (a_high, a_low), (c_high, c_low) = halves
    product = a * c
    lost = ((a_high * c_high - product) + a_high * c_low + a_low * c_high) + a_low * c_low
    total = product + p
    back = total - product
    return total + (((product - (total - back)) + (p - back)) + lost)


def sliding_quantile(x: np.ndarray, low: np.ndarray, high: np.ndarray, q: float) -> np.ndarray:
    """Quantile of x[low[k] : high[k]] for each k, between ranks by interpolation; low and high ascend.  Values enter and leave an
    ordered list, so a step costs the logarithm of the frame.

    Whether a value reaches a share of the quantile is often a tie, so it is interpolated in the way of DuckDB's quantile_cont, to the
    last bit; x is finite or NaN."""
    frames = Frames(low=np.asarray(low, np.int64), high=np.asarray(high, np.int64))
    rolling = pd.Series(x).rolling(frames, min_periods=1)
    below, above = (rolling.quantile(q, interpolation=way).to_numpy() for way in ("lower", "higher"))
    known = np.append(0, np.cumsum(~np.isnan(x)))
    rank = (known[frames.high] - known[frames.low] - 1) * q
    share = rank - np.floor(rank)
    return np.where(share == 0, below, _mixed(below, above, share))


def standardise(x: np.ndarray) -> np.ndarray:
    spread = x.std()
    return (x - x.mean()) / spread if spread > 0 else x - x.mean()


def dominant_rate(x: np.ndarray, fs: float, low: float = 0.7, high: float = 3.5) -> float:
    """Beats a minute of the strongest frequency in the band, by a Hann periodogram; NaN if too short."""
    x = np.asarray(x, float)
    if len(x) < max(8, 4 * fs):
        return float("nan")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x))
    size = max(8192, 1 << int(len(x) - 1).bit_length())
    power = np.abs(np.fft.rfft((x - x.mean()) * window, size)) ** 2
    f = np.fft.rfftfreq(size, 1 / fs)
    inside = (f >= low) & (f <= high)
    return float(60 * f[inside][power[inside].argmax()])


def pulse_from_rgb(rgb: np.ndarray, fs: float, method: str = "POS", span: float = 1.6) -> np.ndarray:
    """Pulse from the mean colour of skin: GREEN, CHROM (de Haan 2013) or POS (Wang 2017), by overlap-add."""
    rgb = np.asarray(rgb, float)
    n, size = len(rgb), max(2, min(len(rgb), round(span * fs)))
    if method == "GREEN":
        out = -(rgb[:, 1] - rgb[:, 1].mean())
    else:
        out = np.zeros(n)
        parts = np.lib.stride_tricks.sliding_window_view(rgb, size, 0)  # window, colour, time
        c = parts / np.maximum(parts.mean(2, keepdims=True), 1e-9)
        r, g, b = c[:, 0], c[:, 1], c[:, 2]
        x, y = (g - b, g + b - 2 * r) if method == "POS" else (3 * r - 2 * g, 1.5 * r + g - 1.5 * b)
        ratio = x.std(1, keepdims=True) / np.maximum(y.std(1, keepdims=True), 1e-12)
        h = x + ratio * y if method == "POS" else x - ratio * y
        h = h - h.mean(1, keepdims=True)
        if method == "CHROM":
            h = h * np.hanning(size)
        np.add.at(out, np.arange(len(h))[:, None] + np.arange(size), h)
        out = -out if method == "POS" else out
    return standardise(bandpass(out, fs, 0.7, 3.5, 2))


def lag_scan(pulse: np.ndarray, fs: float, ref_t: np.ndarray, ref: np.ndarray, lags: np.ndarray, least: float = 0.8, block: int = 1_000_000) -> np.ndarray:
    """Pearson r of pulse(t) with reference(t - lag) for each lag; NaN where fewer than `least` of the samples meet, 8 at least.

    Samples of the pulse that are not finite are left out.  Lags are taken together, about `block` values at a time."""
    out = np.full(len(lags), np.nan)
    known = np.flatnonzero(np.isfinite(pulse))
    if len(known) < 8 or len(ref_t) < 2:
        return out
    a = np.asarray(pulse, float)[known]
    rows = max(1, block // len(known))
    for k in range(0, len(lags), rows):
        at = known / fs - lags[k : k + rows, None]
        meets = (at >= ref_t[0]) & (at <= ref_t[-1])
        count = meets.sum(1, keepdims=True)
        share = meets / np.maximum(count, 1)
        b = np.interp(at, ref_t, ref)
        x = np.where(meets, a - (share * a).sum(1, keepdims=True), 0.0)
        y = np.where(meets, b - (share * b).sum(1, keepdims=True), 0.0)
        scale = np.sqrt((x * x).sum(1) * (y * y).sum(1))
        fine = (count[:, 0] >= max(8, least * len(known))) & (scale > 0)
        out[k : k + rows][fine] = (x * y).sum(1)[fine] / scale[fine]
    return out


def prepare_reference(t: np.ndarray, x: np.ndarray, low: float = 0.7, high: float = 3.5) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of a reference in order, without what is not finite, on the median step, band-passed and standardised.

    Fewer than 16 samples, or a median step of 0, are standardised only."""
    fine = np.isfinite(t) & np.isfinite(x)
    order = np.argsort(t[fine], kind="stable")
    t, x = t[fine][order], x[fine][order]
    step = np.median(np.diff(t)) if len(t) >= 16 else 0.0
    if step <= 0:
        return t, standardise(x) if len(x) else x
    even = t[0] + step * np.arange(int(np.floor((t[-1] - t[0]) / step + 0.5 - 1e-9)) + 1)
    return even, standardise(bandpass(np.interp(even, t, x), 1 / step, low, high, 2))


@lru_cache(maxsize=4)
def _residual_maker(n: int, smoothness: float) -> np.ndarray:
    """The matrix that takes the smoothness-prior trend (Tarvainen 2002) off a window of n samples."""
    bend = np.diff(np.eye(n), 2, axis=0)
    return np.eye(n) - np.linalg.inv(np.eye(n) + smoothness**2 * bend.T @ bend)


def _vertex(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where a parabola through three points has its top, in steps from the middle one, at most half a step."""
    bend = left - 2 * middle + right
    flat = np.abs(bend) <= np.finfo(float).eps
    return np.where(flat, 0.0, np.clip(0.5 * (left - right) / np.where(flat, 1.0, bend), -0.5, 0.5))


def _fine_bin(power: np.ndarray, bins: np.ndarray) -> np.ndarray:
    rows, inner = np.arange(len(power)), np.clip(bins, 1, power.shape[1] - 2)
    logs = [np.log(np.maximum(power[rows, inner + d], np.finfo(float).tiny)) for d in (-1, 0, 1)]
    return bins + np.where(bins == inner, _vertex(*logs), 0.0)


def rate_features(windows: np.ndarray, fs: float, low: float = 0.6, high: float = 3.3) -> dict[str, np.ndarray]:
    """Rates in beats a minute of each row of `windows`: bpm of the strongest frequency in the band, half_bpm of the
    strongest of five bins around half of it, half_ratio of their powers, and acf_bpm of the autocorrelation."""
    count, n = windows.shape
    calm = windows @ _residual_maker(n, 100.0 * (fs / 30.0) ** 2).T
    size = 1 << (8 * n - 1).bit_length()
    power = np.abs(np.fft.rfft(np.stack([bandpass(w, fs, low, high, 1) for w in calm]), size)) ** 2
    rows, f = np.arange(count), np.fft.rfftfreq(size, 1 / fs)
    inside = np.flatnonzero((f >= low) & (f <= high))
    top = inside[power[:, inside].argmax(1)]
    fine = _fine_bin(power, top)
    near = np.maximum(np.rint(fine / 2).astype(int)[:, None] + np.arange(-2, 3), 1)
    half = near[rows, np.take_along_axis(power, near, 1).argmax(1)]
    lags = np.arange(max(1, round(fs / high)), min(n - 2, round(fs / low)) + 1)
    scores = np.fft.irfft(power, size)[:, lags] / (n - lags)
    best = np.empty(count, int)
    for k, s in enumerate(scores):
        peaks = find_peaks(s)[0]
        best[k] = peaks[s[peaks].argmax()] if len(peaks) else s.argmax()
    inner = np.clip(best, 1, len(lags) - 2)
    lag = lags[best] + np.where(best == inner, _vertex(scores[rows, inner - 1], scores[rows, inner], scores[rows, inner + 1]), 0.0)
    bpm = 60 * fs / size
    ratio = power[rows, half] / np.maximum(power[rows, top], np.finfo(float).tiny)
    return {"bpm": fine * bpm, "half_bpm": _fine_bin(power, half) * bpm, "half_ratio": ratio, "acf_bpm": 60 * fs / lag}
