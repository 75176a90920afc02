"""Content-defined anchors: which places of a text could take part in a repeat of WIDTH bytes.

The anchor of a window of WIDTH bytes is its first q-gram of least hash.  Equal windows have their anchors
at the same place, so a repeat always shows as two anchors with one q-gram; a q-gram that is the
anchor of one place only proves all of its windows unique.  An anchor's region is the stretch of all
windows that it stands for, less than two widths.
"""

from __future__ import annotations

import numpy as np

from cadentia.llm.common import keyed, mix, stretches

GRAM = 32
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            _POWERS[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _POWERS[size]


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of each stretch of `length` bytes.  It is linear, so texts can be made whose hashes meet; that costs a comparison, as
    nothing is settled by it."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
        return mix((sums[length:] - sums[:-length]) * inverse[:n])


def regions(at: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """row, anchor's place, first and last window (all from the row's start), q-gram hash, region hash.

    Rows shorter than width have no window.  `at` has the rows' offsets into data."""
    gram = min(GRAM, max(1, width // 3))
    base = int(at[0])
    part = data[base : int(at[-1])]
    offsets = at - base
    span = width - gram + 1
    empty = np.zeros(0, np.int64)
    if len(part) < width:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    h = rolling(part, gram)
    bits = np.uint64(int(len(h)).bit_length())
    packed = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    least, step = packed, 1
    while 2 * step <= span:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    anchor = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)  # of each window
    start = np.arange(len(anchor))
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + width <= offsets[row + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    low = np.flatnonzero(inside & new)
    ends = np.ones(len(anchor), bool)
    ends[:-1] = new[1:] | ~inside[1:]
    high = np.flatnonzero(inside & ends)
    row, place = row[low], anchor[low]
    content = keyed(stretches(part, low, high + width) ^ (place - low).astype(np.uint64))
    begin = offsets[row]
    return row, place - begin, low - begin, high - begin, h[place], content
