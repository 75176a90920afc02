"""Suffix sorting by external induction, for one shard that may be larger than memory.

Suffixes of type L follow from smaller ones and suffixes of type S from larger ones, so two passes over a
priority queue order all suffixes once the leftmost S suffixes are ordered.  Those are named by their
substrings, which the same two passes order, and the string of names is sorted by recursion, whatever its
alphabet.

Keys never fall behind what was taken, so the priority queue is one of buckets: a block of symbols has a first-in
first-out list, blocks are kept in groups, and the lists of later groups go to a file beyond a bound of memory.  An entry
is (symbol, position, common prefix with the entry before it in its symbol); it is one more than the least common prefix
passed since the last insertion there, which a stack of falling minima answers.  The recursion hands its common
prefixes up: equal names stand for the text between two leftmost S suffixes, and the first different ones for the
least common prefix of the names between them.

Whatever is as long as the shard (text, types, names, orders, common prefixes) lies in a Room: in memory up to a
bound for each array, beyond it in an unnamed file of the task that is mapped and goes when the task does.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Stands for a common prefix of any length: of strings that are equal, and of nothing.
FAR = np.int32(1 << 30)
#: Entries that the queue's lists, and an array of a Room, keep in memory.
IN_MEMORY = 4_000_000
#: Blocks of symbols in a group.
GROUP = 32


def _order(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of keys from 0 to most; numpy counts those of 16 bits, others it merges."""
    return np.argsort(keys.astype(np.int16) if most < 1 << 15 else keys, kind="stable")


def _new(x: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    out = np.empty(len(x), bool)
    out[:1] = True
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


class Room:
    """Arrays of a shard, in memory or in mapped files."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory = in_memory

    def array(self, n: int, kind) -> np.ndarray:
        if n <= self.in_memory:
            return np.zeros(n, kind)
        return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=n)

    def chunks(self, n: int) -> Iterator[tuple[int, int]]:
        step = max(1, min(self.in_memory, 1 << 20))
        return ((k, min(n, k + step)) for k in range(0, n, step))


class BlockQueue:
    """Lists of (symbol, position, common prefix, symbol that is inserted next) for blocks of symbols, taken in the blocks'
    order."""

    def __init__(self, cuts: np.ndarray, in_memory: int):
        self.cuts, self.group_cuts = cuts, np.append(cuts[:-1:GROUP], cuts[-1])
        self.groups: list[list] = [[] for _ in self.group_cuts[1:]]
        self.near: dict[int, list] = {}
        self.group, self.held, self.in_memory, self.file = -1, 0, in_memory, None

    def push(self, entries: tuple[np.ndarray, ...]) -> None:
        """Entries in order of symbol, then arrival; none before the block that was taken last."""
        symbol = entries[0]
        near = int(np.searchsorted(symbol, self.group_cuts[self.group + 1])) if self.group >= 0 else 0
        if near:
            self._deal([x[:near] for x in entries])
        if near < len(symbol):
            at = near + np.searchsorted(symbol[near:], self.group_cuts)
            for g in np.flatnonzero(at[1:] > at[:-1]).tolist():
                self.groups[g].append([x[at[g] : at[g + 1]] for x in entries])
            self.held += len(symbol) - near
            if self.held > self.in_memory:
                self._spill()

    def _deal(self, entries: list[np.ndarray]) -> None:
        first = self.group * GROUP
        cuts = self.cuts[first : first + GROUP + 1]
        at = np.searchsorted(entries[0], cuts)
        for b in np.flatnonzero(at[1:] > at[:-1]).tolist():
            self.near.setdefault(first + b, []).append([x[at[b] : at[b + 1]] for x in entries])

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.groups:
            for k, part in enumerate(parts):
                if isinstance(part, list):
                    parts[k] = (self.file.tell(), len(part[0]))
                    for x in part:
                        self.file.write(x.astype(np.int64).tobytes())
        self.held = 0

    def enter(self, block: int) -> None:
        """Brings the block's group near; its lists are dealt to their blocks part by part."""
        while self.group < block // GROUP:
            self.group += 1
            parts, self.groups[self.group] = self.groups[self.group], []
            for part in parts:
                if isinstance(part, tuple):
                    at, n = part
                    self.file.seek(at)
                    part = np.frombuffer(self.file.read(32 * n), np.int64).reshape(4, n)
                    part = [part[0], part[1], part[2].astype(np.int32), part[3]]
                else:
                    self.held -= len(part[0])
                self._deal(part)

    def pop(self, block: int) -> list[np.ndarray] | None:
        """The oldest entries of a block of one symbol: all, or about as many as memory may hold."""
        parts = self.near.get(block)
        if not parts:
            return None
        k, size = 1, len(parts[0][0])
        while k < len(parts) and size < self.in_memory:
            size, k = size + len(parts[k][0]), k + 1
        self.near[block] = parts[k:]
        return parts[0] if k == 1 else [np.concatenate(x) for x in zip(*parts[:k], strict=True)]

    def take(self, block: int) -> list[np.ndarray] | None:
        """All entries of the block, in order of symbol, then arrival."""
        parts = self.near.pop(block, None)
        if not parts:
            return None
        if len(parts) == 1:
            return parts[0]
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        return [x[order] for x in joined]


class Since:
    """Least common prefix passed since the last insertion for a symbol."""

    def __init__(self, symbols: int, room: Room):
        self.last = room.array(symbols, np.int64)  # one more than the rank after which the last insertion came
        self.rank, self.low = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.passed = 0

    def through(self, symbol: np.ndarray, at: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Takes a batch of common prefixes; after place `at` of it something is inserted for `symbol` (sorted, then by
        place).  Returns the common prefixes of what is inserted."""
        got = np.zeros(0, np.int32)
        if len(at):
            heads = np.flatnonzero(_new(symbol))
            bounds = np.empty(2 * len(at), np.int64)
            bounds[1::2] = at + 1
            bounds[2::2] = bounds[1:-1:2]
            bounds[2 * heads] = 0
            padded = np.empty(len(common) + 1, np.int32)
            padded[:-1], padded[-1] = common, FAR
            least = np.minimum.reduceat(padded, bounds)[::2]
            names = symbol[heads]
            before = self.last[names]
            slot = np.searchsorted(self.rank, before)  # what was passed from there to this batch
            least[heads] = np.minimum(least[heads], np.append(self.low, FAR)[slot])
            got = np.where(least >= FAR, FAR, least + 1).astype(np.int32)
            got[heads[before == 0]] = 0
            ends = np.empty(len(heads), np.int64)
            ends[:-1], ends[-1] = heads[1:] - 1, len(at) - 1
            self.last[names] = self.passed + at[ends] + 2
        tail = np.minimum.accumulate(common[::-1])[::-1]
        kept = np.ones(len(common), bool)
        np.less(common[:-1], tail[1:], out=kept[:-1])
        keep = np.flatnonzero(kept)
        old = int(np.searchsorted(self.low, tail[0]))
        self.rank = np.append(self.rank[:old], self.passed + 1 + keep)
        self.low = np.append(self.low[:old], common[keep])
        self.passed += len(common)
        return got


class Order:
    """Positions and common prefixes, written one after the other."""

    def __init__(self, n: int, room: Room, kind):
        self.position, self.common, self.n = room.array(n, kind), room.array(n, np.int32), 0

    def put(self, position: np.ndarray, common: np.ndarray) -> None:
        self.position[self.n : self.n + len(position)] = position
        self.common[self.n : self.n + len(position)] = common
        self.n += len(position)


def kinds(text: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each suffix is of type S, that is less than the next one (the end is less than all symbols), how often its
    first symbol stands at its start, and how often right before it."""
    n = len(text)
    smaller, run, back = room.array(n, bool), room.array(n, np.int32), room.array(n, np.int32)
    after, later, until = -1, False, n
    for low, high in reversed(list(room.chunks(n))):
        part = np.append(text[low:high].astype(np.int64), after)
        step = np.sign(np.diff(part))
        at = np.where(step != 0, np.arange(low, high), until if after == part[-2] else high - 1)
        ends = np.minimum.accumulate(at[::-1])[::-1]
        smaller[low:high] = np.where(ends < high, step[np.minimum(ends, high - 1) - low] > 0, later)
        run[low:high] = ends + 1 - np.arange(low, high)
        after, later, until = int(part[0]), bool(smaller[low]), int(ends[0])
    before, begun = -1, 0
    for low, high in room.chunks(n):
        part = np.append(before, text[low:high])
        start = np.maximum.accumulate(np.where(part[1:] != part[:-1], np.arange(low, high), begun))
        back[low:high] = np.arange(low, high) - start
        before, begun = int(part[-1]), int(start[-1])
    return smaller, run, back


def blocks_of(text: np.ndarray, symbols: int, room: Room) -> np.ndarray:
    """Bounds of blocks of symbols: a few times the root of their number in suffixes, or one symbol alone."""
    counts = room.array(symbols, np.int64)
    for low, high in room.chunks(len(text)):
        counts += np.bincount(text[low:high], minlength=symbols)
    target = max(1, int(64 * len(text) ** 0.5))
    place = np.cumsum(counts) // target
    big = np.flatnonzero(counts > target)
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return np.unique(np.concatenate([cuts, big, big + 1, [0, symbols]]))


def _pass(text, run, back, takes, given, shared, symbols, cuts, up: bool, room: Room, loose: bool, first: int | None, own: Order | None, out: Order | None) -> None:
    """One way through the symbols, upwards or downwards.  Of a symbol first what was inserted comes, then what is `given`
    (in this order, with common prefixes `shared`); the suffix before each, if `takes` has it, is inserted.  `own` gets
    what was inserted, `out` everything."""
    key = (lambda at: text[at].astype(np.int64)) if up else (lambda at: symbols - 1 - text[at].astype(np.int64))
    if not up:
        cuts = symbols - cuts[::-1]
    queue, since = BlockQueue(cuts, room.in_memory), Since(symbols, room)
    begin = np.zeros(len(cuts), np.int64)
    for low, high in room.chunks(len(given)):
        begin += np.searchsorted(key(given[low:high]), cuts)

    def put(position, common, mine) -> None:
        if own is not None and mine is not None:
            own.put(position[mine], common[mine])
        if out is not None:
            out.put(position, common)

    def into(position: np.ndarray) -> np.ndarray:
        """The symbol that the suffix before is inserted for; `symbols` if it isn't."""
        before = np.maximum(position, 1) - 1
        own = np.flatnonzero(takes[before] & (position > 0))
        out = np.full(len(position), symbols)
        out[own] = key(before[own])
        return out

    nothing = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]

    def step(position: np.ndarray, common: np.ndarray, before: np.ndarray, high: int) -> list[np.ndarray]:
        """Inserts what stands before (for symbols `before`); returns what goes to symbols below `high`."""
        at = np.flatnonzero(before < symbols)
        symbol = before[at]
        order = _order(symbol, symbols)
        at, symbol = at[order], symbol[order]
        fresh = position[at] - 1
        entries = [symbol, fresh, since.through(symbol, at, common), into(fresh)]
        k = int(np.searchsorted(symbol, high))
        if k < len(symbol):
            queue.push(tuple(x[k:] for x in entries))
        return [x[:k] for x in entries]

    def seam(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of an inserted suffix and a given one with its symbol: their types differ, so it is their runs'."""
        return np.zeros(len(b), np.int32) if loose else np.minimum(run[a], run[b])

    def generations(part: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """All that is inserted for one symbol, from what other symbols insert for it: after those come the suffixes one symbol
        further into the runs that end there, and so on.  Position, common prefix, and symbol that is inserted next."""
        _, position, common, before = part
        more = back[position]
        if not more.any():
            return position, common, before
        of = np.repeat(np.arange(len(more)), more + 1)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        order = _order(turn, int(more.max()))
        of, turn = of[order], turn[order]
        old = np.append(-1, of[:-1])
        least = least_between(common, old + 1, of)
        least = np.where(least >= FAR, FAR, least + turn).astype(np.int32)
        heads = np.flatnonzero(_new(turn))
        least[heads[1:]] = turn[heads[1:]]
        least[0] = common[0]
        position = position[of] - turn
        own = turn == more[of]
        before = np.full(len(of), symbols)
        before[own] = into(position[own])
        return position, least, before

    if first is not None:
        last = np.array([first])
        queue.push((key(last), last, np.zeros(1, np.int32), into(last)))
        since.last[key(last)] = 1
    all_, none = slice(None), None
    for b in range(len(cuts) - 1):
        low, high = int(cuts[b]), int(cuts[b + 1])
        queue.enter(b)
        if high - low == 1:
            last, whole = None, queue.near.get(b)
            whole = whole and sum(len(x[0]) for x in whole) <= room.in_memory
            while (part := queue.pop(b)) is not None:
                part = generations(part) if whole else part[1:]
                put(part[0], part[1], all_)
                step(*part, low)
                last = part[0][-1:]
            for x, y in room.chunks(int(begin[b + 1] - begin[b])):
                position = np.asarray(given[begin[b] + x : begin[b] + y]).astype(np.int64)
                common = np.array(shared[begin[b] + x : begin[b] + y])
                if x == 0:
                    common[0] = 0 if last is None else seam(last, position[:1])[0]
                put(position, common, none)
                step(position, common, into(position), low)
            continue
        old = queue.take(b) or nothing
        g = np.asarray(given[begin[b] : begin[b + 1]]).astype(np.int64)
        g = [key(g), g, np.array(shared[begin[b] : begin[b + 1]]), into(g)]
        old_least, g_least = (np.append(np.minimum.accumulate(x[3][::-1])[::-1], high) for x in (old, g))
        i, j, fresh = 0, 0, nothing  # inserted before this block, given, and inserted from within it
        while i < len(old[0]) or j < len(g[0]) or len(fresh[0]):
            least = min(int(x[0][k]) if k < len(x[0]) else high for x, k in ((old, i), (g, j), (fresh, 0)))
            # Up to the first symbol that something in this block is inserted for, all is known.
            cut = min(int(old_least[i]), int(g_least[j]), int(fresh[3].min(initial=high)))
            alone = cut <= least
            to = least + 1 if alone else cut
            i_to, j_to, k = int(np.searchsorted(old[0], to)), int(np.searchsorted(g[0], to)), int(np.searchsorted(fresh[0], to))
            batch = [np.append(x[i:i_to], y[:k]) for x, y in zip(old, fresh, strict=True)] if k else [x[i:i_to] for x in old]
            more = [[x[k:] for x in fresh]]
            if alone:
                last = None
                if len(batch[0]):
                    batch = generations(batch)
                    put(batch[0], batch[1], all_)
                    last = batch[0][-1:]
                    more.append(step(*batch, high))
                if j_to > j:
                    position, common = g[1][j:j_to], g[2][j:j_to]
                    common[0] = 0 if last is None else seam(last, position[:1])[0]
                    put(position, common, none)
                    more.append(step(position, common, g[3][j:j_to], high))
            else:
                mine = len(batch[0])
                batch = [np.append(x, y[j:j_to]) for x, y in zip(batch, g, strict=True)] if j_to > j else batch
                order = np.argsort(batch[0], kind="stable")
                symbol, position, common, before = (x[order] for x in batch)
                mine = order < mine
                new = _new(symbol)
                edge = np.flatnonzero(~mine & (new | np.append(True, mine[:-1])))
                common[edge] = np.where(new[edge], 0, seam(position[edge - 1], position[edge]))
                put(position, common, mine)
                more.append(step(position, common, before, high))
            more = [x for x in more if len(x[0])]
            fresh = nothing if not more else more[0]
            if len(more) > 1:
                fresh = [np.concatenate(x) for x in zip(*more, strict=True)]
                order = np.argsort(fresh[0], kind="stable")
                fresh = [x[order] for x in fresh]
            i, j = i_to, j_to
    if queue.file:
        queue.file.close()


def induce(text, smaller, run, back, seeds, shared, symbols: int, cuts, room: Room, loose: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order with the common prefix of each with the one before, from the ordered leftmost S suffixes
    `seeds`.  With loose ones, ordered by their first symbol only, the leftmost S substrings come in order, and those that are
    equal to the one before have FAR."""
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    large = room.array(n, bool)
    for low, high in room.chunks(n):
        large[low:high] = ~smaller[low:high]
    own = Order(int(large.sum()), room, kind)
    _pass(text, run, back, large, seeds, shared, symbols, cuts, True, room, loose, n - 1, own, None)
    down, common = room.array(own.n, kind), room.array(own.n, np.int32)
    for low, high in room.chunks(own.n):
        down[own.n - high : own.n - low] = own.position[low:high][::-1]
        common[own.n - high : own.n - low] = np.append(own.common[low + 1 : high + 1], 0)[: high - low][::-1]
    del own
    out = Order(n, room, kind)
    _pass(text, run, back, smaller, down, common, symbols, cuts, False, room, loose, None, None, out)
    del down, common
    order, common = room.array(n, kind), room.array(n, np.int32)
    for low, high in room.chunks(n):
        order[n - high : n - low] = out.position[low:high][::-1]
        common[n - high : n - low] = np.append(out.common[low + 1 : high + 1], 0)[: high - low][::-1]
    return order, common


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray, cap: int, most: np.ndarray | None = None) -> np.ndarray:
    """common, made longer while the suffixes a and b agree, up to cap and `most`."""
    most = np.minimum(len(text) - np.maximum(a, b), cap if most is None else np.minimum(most, cap))
    going = np.flatnonzero(common < most)
    while len(going):
        k = common[going]
        going = going[text[a[going] + k] == text[b[going] + k]]
        common[going] += 1
        going = going[common[going] < most[going]]
    return common


class Least:
    """Least of values[low..high], both included, for many ranges at once, from tables of the least of 1, 2, 4 ... values from each
    place on, which are made as ranges ask for them."""

    def __init__(self, values: np.ndarray, room: Room):
        self.levels, self.room = [values], room

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out, span = np.full(len(low), FAR, np.int32), high - low + 1
        k = 0
        while (span >= 1 << k).any():
            if k == len(self.levels):
                self.levels.append(self._next())
            own = np.flatnonzero((span >= 1 << k) & (span < 2 << k))
            out[own] = np.minimum(self.levels[k][low[own]], self.levels[k][high[own] - (1 << k) + 1])
            k += 1
        return out

    def _next(self) -> np.ndarray:
        last, step = self.levels[-1], 1 << len(self.levels) - 1
        level = self.room.array(max(len(last) - step, 0), np.int32)
        for low, high in self.room.chunks(len(level)):
            level[low:high] = np.minimum(last[low:high], last[low + step : high + step])
        return level


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """As Least, for values that are in memory."""
    return Least(np.asarray(values), Room(len(values) + 1)).between(low, high)


def by_symbol(text: np.ndarray, seeds: np.ndarray, cuts: np.ndarray, room: Room) -> np.ndarray:
    """The seeds in order of their symbols, else as they come: dealt to blocks of symbols chunk by chunk, and each block, which is short or
    has one symbol, ordered by itself."""
    out, begin = room.array(len(seeds), seeds.dtype), np.zeros(len(cuts), np.int64)
    for low, high in room.chunks(len(seeds)):
        begin[1:] += np.bincount(np.searchsorted(cuts, text[seeds[low:high]], "right") - 1, minlength=len(cuts) - 1)[: len(cuts) - 1]
    begin = np.cumsum(begin)
    free = begin.copy()
    for low, high in room.chunks(len(seeds)):
        own = np.asarray(seeds[low:high])
        block = np.searchsorted(cuts, text[own], "right") - 1
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        many = np.diff(np.append(first, len(block)))
        out[np.repeat(free[block[first]] - first, many) + np.arange(len(block))] = own[order]
        free[block[first]] += many
    for k in np.flatnonzero((np.diff(cuts) > 1) & (np.diff(begin) > 1)).tolist():
        own = np.asarray(out[begin[k] : begin[k + 1]])
        out[begin[k] : begin[k + 1]] = own[np.argsort(text[own], kind="stable")]
    return out


def shared_by_names(text, seeds, ranked, slot, name, cap: int, room: Room) -> np.ndarray:
    """For each name the common prefix of its substring with that of the name before, 0 for the first.  ranked has the seeds in order of
    their substrings, slot the number of each, name its name."""
    count, n = len(seeds), len(text)
    between, before = room.array(int(name[-1]) + 1, np.int32), -1

    def length(at):
        ends = np.where(at + 1 < count, seeds[np.minimum(at + 1, count - 1)], n - 1).astype(np.int64)
        return ends + 1 - seeds[at]

    for low, high in room.chunks(count):
        own = np.asarray(name[low:high])
        heads = np.flatnonzero(np.r_[low == 0 or own[0] != name[low - 1], own[1:] != own[:-1]]) + low
        if not len(heads):
            continue
        pairs = heads if before < 0 else np.append(before, heads)
        a, b = ranked[pairs[:-1]].astype(np.int64), ranked[pairs[1:]].astype(np.int64)
        most = np.minimum(length(slot[pairs[:-1]]), length(slot[pairs[1:]]))
        between[name[pairs[1:]]] = _extend(text, a, b, np.zeros(len(a), np.int32), cap, most)
        before = int(heads[-1])
    return between


def sort_suffixes(text: np.ndarray, symbols: int, cap: int = 100, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of `text` (symbols 0 to symbols - 1) and the common prefix of each with the one
    before, exact up to `cap` symbols."""
    room, n = Room(in_memory), len(text)
    smaller, run, back = kinds(text, room)
    cuts = blocks_of(text, symbols, room)
    kind = np.int32 if n < 1 << 31 else np.int64
    star = room.array(n, bool)
    count = 0
    for low, high in room.chunks(n):
        star[low:high] = smaller[low:high] & ~np.append(True if low == 0 else smaller[low - 1], smaller[low : high - 1])
        count += int(star[low:high].sum())
    if not count:
        return induce(text, smaller, run, back, np.zeros(0, kind), np.zeros(0, np.int32), symbols, cuts, room)
    seeds, at = room.array(count, kind), 0
    for low, high in room.chunks(n):
        found = np.flatnonzero(star[low:high]) + low
        seeds[at : at + len(found)] = found
        at += len(found)
    loose, far = by_symbol(text, seeds, cuts, room), room.array(count, np.int32)
    far[:] = FAR
    order, equal = induce(text, smaller, run, back, loose, far, symbols, cuts, room, loose=True)
    del loose, far
    # The seeds in order of their substrings, and the least value since the seed before.
    ranked, name, at, least, held = room.array(count, kind), room.array(count, np.int64), 0, FAR, -1
    for low, high in room.chunks(n):
        position, value = np.asarray(order[low:high]), np.asarray(equal[low:high]).copy()
        value[0] = min(value[0], least)
        found = np.flatnonzero(star[position])
        if len(found):
            since = np.minimum.reduceat(value[: found[-1] + 1], np.append(0, found[:-1] + 1))
            own = held + np.cumsum(since < FAR)
            if held < 0:
                own += int(since[0] >= FAR)
            ranked[at : at + len(found)], name[at : at + len(found)] = position[found], own
            at, held = at + len(found), int(own[-1])
            least = value[found[-1] + 1 :].min() if found[-1] + 1 < len(value) else FAR
        else:
            least = value.min()
    del order, equal
    slot = room.array(count, np.int64)
    for low, high in room.chunks(count):
        slot[low:high] = np.searchsorted(seeds, ranked[low:high])
    between = shared_by_names(text, seeds, ranked, slot, name, cap, room)
    names = int(name[-1]) + 1
    if names == count:
        shared = between
    else:
        reduced = room.array(count, np.int32 if names < 1 << 31 else np.int64)
        for low, high in room.chunks(count):
            reduced[slot[low:high]] = name[low:high]
        again, same = sort_suffixes(reduced, names, cap, in_memory)
        shared, least = room.array(count, np.int32), Least(between, room)
        for low, high in room.chunks(count):
            ranked[low:high] = seeds[again[low:high]]
        for low, high in room.chunks(count - 1):
            p, q, k = again[low:high].astype(np.int64), again[low + 1 : high + 1].astype(np.int64), np.minimum(same[low + 1 : high + 1], cap)
            p_end, q_end = np.minimum(p + k, count - 1), np.minimum(q + k, count - 1)
            x, y = reduced[p_end].astype(np.int64), reduced[q_end].astype(np.int64)
            own = seeds[q_end].astype(np.int64) - seeds[q] + np.where(x < y, least.between(x + 1, y), 0)
            shared[low + 1 : high + 1] = np.minimum(own, cap)
    for low, high in room.chunks(count - 1):  # a run that goes on beyond a substring's end
        a, b = ranked[low:high].astype(np.int64), ranked[low + 1 : high + 1].astype(np.int64)
        shared[low + 1 : high + 1] = _extend(text, a, b, np.array(shared[low + 1 : high + 1]), cap)
    return induce(text, smaller, run, back, ranked, shared, symbols, cuts, room)
