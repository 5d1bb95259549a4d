"""Suffix and common-prefix arrays of one shard by external induced sorting.

Suffixes are L or S (larger or smaller than the one that follows), the leftmost S of a row are the seeds. Sorted seeds
induce the order of all other suffixes: taking suffixes from a priority queue in order, each hands on its predecessor.
Tuples (position, common prefix with the tuple before) of one first symbol enter the queue in order, so the queue is a
first-in-first-out run per symbol. A predecessor's common prefix is one more than the least common prefix since the last
predecessor with its symbol.

Seeds are sorted by inducing their substrings, naming these, and sorting the string of names the same way, until it is
small. The names' common prefixes come back from the recursion: they say how many whole substrings two seeds share, and
only what follows is compared symbol by symbol. So order and common prefixes are exact up to ``cap`` symbols.

Whatever has more than ``memory`` entries is on disk: the queue's tuples as sorted runs, and text, types, names and order
as mapped files that are written and mostly read a block at a time. What a sort itself holds is a few blocks.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples handled at once; entries that one array or queue holds in memory; names up to so many are sorted in memory.
CHUNK, MEMORY, SMALL = 1 << 19, 1 << 23, 1 << 21


def on_disk(n: int | tuple, kind) -> np.ndarray:
    with tempfile.TemporaryFile(prefix="suffixes-") as f:
        return np.memmap(f, kind, "w+", shape=n)


def room(n: int, kind, memory: int, fill=None) -> np.ndarray:
    x = np.empty(n, kind) if n <= memory else on_disk(n, kind)
    if fill is not None:
        x[:] = fill
    return x


def blocks(n: int) -> Iterator[tuple[int, int]]:
    return ((k, min(n, k + CHUNK)) for k in range(0, n, CHUNK))


class Growing:
    """Arrays put one behind another; beyond ``memory`` entries in a file."""

    def __init__(self, memory: int, *width: int):
        self.memory, self.width, self.n, self.held, self.inside, self.file = memory, width, 0, [], 0, None

    def add(self, x: np.ndarray) -> None:
        self.held.append(x)
        self.n += len(x)
        self.inside += len(x)
        if self.inside > self.memory:
            self.flush()

    def flush(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="suffixes-")
        for x in self.held:
            self.file.write(np.ascontiguousarray(x, np.int64))
        self.file.flush()
        self.held, self.inside = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate([np.zeros((0, *self.width), np.int64), *self.held])
        self.flush()
        return np.memmap(self.file, np.int64, "r", shape=(self.n, *self.width))


class Queue:
    """Priority queue of (position, common prefix) by symbol; tuples of a symbol come in in their order."""

    def __init__(self, memory: int):
        self.memory, self.held, self.fresh, self.runs = memory, 0, {}, []

    def push(self, symbol: np.ndarray, rows: np.ndarray) -> None:
        if not len(symbol):
            return
        order = np.argsort(symbol, kind="stable")
        symbol, rows = symbol[order], rows[order]
        cuts = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        for c, part in zip(symbol[cuts].tolist(), np.split(rows, cuts[1:]), strict=True):
            self.fresh.setdefault(c, []).append(part)
        self.held += len(rows)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """One more run on disk: all tuples held, by symbol, with a directory of where each symbol's end."""
        symbols = np.array(sorted(self.fresh), np.int64)
        rows, ends, at = on_disk((self.held, 2), np.int64), room(len(symbols), np.int64, CHUNK), 0
        for k, c in enumerate(symbols.tolist()):
            for x in self.fresh[c]:
                rows[at : at + len(x)] = x
                at += len(x)
            ends[k] = at
        known = room(len(symbols), np.int64, CHUNK)
        known[:] = symbols
        self.runs.append((known, ends, rows))
        self.fresh, self.held = {}, 0

    def pop(self, c: int) -> Iterator[np.ndarray]:
        """Tuples of symbol ``c``, oldest first, with those that come in meanwhile."""
        done = 0
        while True:
            while done < len(self.runs):
                symbols, ends, rows = self.runs[done]
                k = int(np.searchsorted(symbols, c))
                if k < len(symbols) and symbols[k] == c:
                    a, b = int(ends[k - 1]) if k else 0, int(ends[k])
                    for i in range(a, b, CHUNK):
                        yield np.array(rows[i : min(b, i + CHUNK)])
                done += 1
            parts = self.fresh.pop(c, None)
            if parts is None:
                return
            rows = np.concatenate(parts)
            self.held -= len(rows)
            for i, j in blocks(len(rows)):  # what comes in meanwhile stands behind all of these
                yield rows[i:j]


class RunMinima:
    """For each symbol the least common prefix since its last tuple.

    ``last`` has the place of each symbol's last tuple, -1 before its first; of the common prefixes since the first symbol
    changed only the minima of their ends are kept, which are at most ``cap`` + 1."""

    def __init__(self, last: np.ndarray, cap: int):
        self.last, self.cap, self.at = last, cap, 0
        self.kind = np.uint8 if cap < 256 else np.int64
        self.restart()

    def restart(self) -> None:
        self.begin = self.at
        self.place, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def step(self, lcp: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Common prefixes of the predecessors that entries ``at`` of a chunk hand on, in order. ``lcp`` is the chunk's."""
        out, n = np.zeros(len(at), np.int64), len(lcp)
        if len(at):
            levels = [lcp.astype(self.kind)]
            while 2 << (len(levels) - 1) <= n:
                x, w = levels[-1], 1 << (len(levels) - 1)
                levels.append(np.minimum(x[: len(x) - w], x[w:]))

            def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                """Least of lcp[a..b], all non-empty."""
                k = np.frexp((b - a + 1).astype(float))[1] - 1
                r = np.empty(len(a), np.int64)
                for level in np.unique(k):
                    i = k == level
                    r[i] = np.minimum(levels[level][a[i]], levels[level][b[i] - (1 << level) + 1])
                return r

            order = np.argsort(symbol, kind="stable")
            s, x = symbol[order], at[order]
            first = np.append(True, s[1:] != s[:-1])
            m = np.empty(len(s), np.int64)
            inner = np.flatnonzero(~first)
            m[inner] = least(x[inner - 1] + 1, x[inner])
            f = np.flatnonzero(first)
            p = np.asarray(self.last[s[f]])
            before = np.append(self.value, self.cap)[np.searchsorted(self.place, p, side="right")]
            m[f] = np.minimum(np.where(p < self.begin, 0, before), least(np.zeros(len(f), np.int64), x[f]))
            val = np.minimum(m + 1, self.cap)
            val[f[p < 0]] = 0
            out[order] = val
            end = np.append(f[1:], len(s)) - 1
            self.last[s[end]] = self.at + x[end]
        if n:
            down = np.minimum.accumulate(lcp[::-1])[::-1]
            here = np.flatnonzero(np.append(down[:-1] < down[1:], True))  # the last place of each minimum
            old = self.value < down[0]
            self.place = np.concatenate([self.place[old], self.at + here])
            self.value = np.concatenate([self.value[old], down[here]])
            self.at += n
        return out


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, have: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, up to ``cap``, of the suffixes at ``a`` and at ``b``, of which ``have`` symbols are known to be equal.
    The last symbol of ``t`` is its only least one, so comparisons end there."""
    have = have.copy()
    live = np.flatnonzero(have < cap)
    while len(live):
        live = live[t[a[live] + have[live]] == t[b[live] + have[live]]]
        have[live] += 1
        live = live[have[live] < cap]
    return np.minimum(have, cap)


class Induced:
    """Sorting of all suffixes of ``t`` (unsigned symbols; the last is the only least one) from sorted seeds."""

    def __init__(self, t: np.ndarray, cap: int, memory: int = MEMORY, small: int = SMALL):
        self.t, self.cap, self.memory, self.small = t, cap, memory, small
        n = len(t)
        self.symbols = int(t.max()) + 1
        self.present = room(self.symbols, bool, memory, False)
        is_s, after = room(n, bool, memory), True
        for i, j in reversed([*blocks(n)]):
            x = t[i : j + 1].astype(np.int64)
            self.present[x] = True
            step = np.sign(np.append(x[:-1] - x[1:], [] if j < n else [-1])).astype(np.int8)
            # equal neighbours take the type of the next that differs
            change = np.flatnonzero(step)
            k = np.searchsorted(change, np.arange(j - i))
            is_s[i:j] = np.append(step[change] < 0, after)[k]
            after = bool(is_s[i])
        seeds = Growing(memory)
        for i, j in blocks(n - 1):
            seeds.add(np.flatnonzero(is_s[i + 1 : j + 1] & ~is_s[i:j]) + i + 1)
        self.seeds = seeds.array()

    def run(self, pos: int) -> int:
        """How often the symbol at ``pos`` stands there in a row, up to ``cap``."""
        x = self.t[pos : pos + self.cap + 1]
        other = np.flatnonzero(x != x[0])
        return int(other[0]) if len(other) else self.cap

    def seam(self, left: int, right: int) -> int:
        return min(self.run(left), self.run(right), self.cap)

    def _symbols(self, down: bool) -> Iterator[int]:
        parts = [*blocks(self.symbols)]
        for i, j in reversed(parts) if down else parts:
            found = np.flatnonzero(self.present[i:j]) + i
            yield from (found[::-1] if down else found).tolist()

    def induce(self, seeds_of: Callable[[int], Iterator[np.ndarray]], plain: bool = False) -> Iterator[np.ndarray]:
        """All suffixes from the largest, in chunks of (position, common prefix with the one before it in this order).

        ``seeds_of(c)`` gives the seeds of a first symbol in order, with their common prefixes. ``plain``: common prefixes
        are left at zero, which is enough for naming."""
        t, cap = self.t, self.cap

        def hand_on(rows: np.ndarray, keep, queue: Queue, minima: RunMinima) -> None:
            pos = rows[:, 0]
            at = np.flatnonzero(pos > 0)
            before = pos[at] - 1
            ok = keep(t[before], t[pos[at]])
            at, before = at[ok], before[ok]
            symbol = t[before].astype(np.int64)
            prefix = np.zeros(len(at), np.int64) if plain else minima.step(rows[:, 1], at, symbol)
            queue.push(symbol, np.stack([before, prefix], axis=1))

        q, low = Queue(self.memory), RunMinima(room(self.symbols, np.int64, self.memory, -1), cap)
        laid, begin, end = Growing(self.memory, 2), *(room(self.symbols, np.int64, self.memory, 0) for _ in range(2))
        for c in self._symbols(down=False):
            low.restart()
            begin[c], last = laid.n, -1
            for rows in q.pop(c):
                laid.add(rows)
                hand_on(rows, lambda p, s: p >= s, q, low)
                last = int(rows[-1, 0])
            end[c] = laid.n
            for k, rows in enumerate(seeds_of(c)):
                if not k:
                    rows[0, 1] = self.seam(last, int(rows[0, 0])) if last >= 0 else 0
                hand_on(rows, lambda p, s: p > s, q, low)
        larger = laid.array()
        q, low = Queue(self.memory), RunMinima(room(self.symbols, np.int64, self.memory, -1), cap)
        for c in self._symbols(down=True):
            low.restart()
            last = -1
            if c == int(t[-1]):
                q.push(np.array([c]), np.array([[len(t) - 1, 0]]))
            for rows in q.pop(c):  # from the largest; each with the common prefix to the one before it here
                hand_on(rows, lambda p, s: p <= s, q, low)
                last = int(rows[-1, 0])
                yield rows
            a, b = int(begin[c]), int(end[c])
            carry = self.seam(int(larger[b - 1, 0]), last) if last >= 0 and b > a else 0
            for hi in range(b, a, -CHUNK):
                x = larger[max(a, hi - CHUNK) : hi]
                down = np.array(x[::-1])
                down[1:, 1], down[0, 1], carry = x[::-1][:-1, 1], carry, int(x[0, 1])
                hand_on(down, lambda p, s: p < s, q, low)
                yield down

    def _named(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Seeds in the order of their substrings up to the next seed; the name of each seed's, by position; whether all differ."""
        seeds, t, n = self.seeds, self.t, len(self.t)
        size, is_seed, rough = room(n, np.int64, self.memory), room(n, bool, self.memory, False), Queue(self.memory)
        for i, j in blocks(len(seeds)):
            s = np.asarray(seeds[i:j])
            size[s] = np.append(seeds[i + 1 : j + 1], [n - 1] if j == len(seeds) else []).astype(np.int64) - s + 1
            is_seed[s] = True
            rough.push(t[s].astype(np.int64), np.stack([s, np.zeros_like(s)], axis=1))
        found = Growing(self.memory)
        for rows in self.induce(rough.pop, plain=True):
            found.add(rows[is_seed[rows[:, 0]], 0])
        order = found.array()[::-1]
        names, upto = room(n, np.int64, self.memory), 0
        names[order[0]] = 0
        for i, j in blocks(len(order) - 1):
            a, b = np.asarray(order[i:j]), np.asarray(order[i + 1 : j + 1])
            length = size[a]
            same = (length == size[b]) & (common(t, a, b, np.zeros(j - i, np.int64), int(length.max())) >= length)
            name = upto + np.cumsum(~same)
            names[b], upto = name, int(name[-1])
        out = room(len(seeds), np.int64, self.memory)
        for i, j in blocks(len(seeds)):
            out[i:j] = names[seeds[i:j]]
        return order, out, upto + 1 == len(seeds)

    def sorted_seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Seeds in the order of their suffixes, and the common prefix of each with the one before it, up to ``cap``."""
        seeds, m = self.seeds, len(self.seeds)
        if m < 2:
            return seeds, np.zeros(m, np.int64)
        order, names, differ = self._named()
        if differ:
            return order, self._prefixes(order, None, None)
        if m <= self.small:
            which = self._doubled(names)
            shared = np.zeros(m, np.int64)
            shared[1:] = common(names, which[:-1], which[1:], shared[1:], self.cap)
        else:
            t, ranked = room(m + 1, np.int64, self.memory), Growing(self.memory, 2)
            for i, j in blocks(m):
                t[i:j] = names[i:j] + 1
            t[m] = 0
            for rows in Induced(t, self.cap, self.memory, self.small).descending():
                ranked.add(rows)
            ranked = ranked.array()
            # the least is the end of the string; of the others each one's prefix stands with the one that is larger
            which, shared = ranked[:-1, 0][::-1], ranked[:, 1][:0:-1]
        order = room(m, np.int64, self.memory)
        for i, j in blocks(m):
            order[i:j] = seeds[which[i:j]]
        return order, self._prefixes(order, which, shared)

    def _prefixes(self, order: np.ndarray, which, shared) -> np.ndarray:
        """From the number of whole substrings that each seed shares with the one before it to the symbols."""
        out = room(len(order), np.int64, self.memory, 0)
        for i, j in blocks(len(order) - 1):
            a, b = np.asarray(order[i:j]), np.asarray(order[i + 1 : j + 1])
            have = np.zeros(j - i, np.int64)
            if which is not None:
                w = np.asarray(which[i + 1 : j + 1])
                have = np.minimum(self.seeds[w + shared[i + 1 : j + 1]] - b, self.cap)
            out[i + 1 : j + 1] = common(self.t, a, b, have, self.cap)
        return out

    def _doubled(self, names: np.ndarray) -> np.ndarray:
        """Order of the suffixes of a small string of names, doubling the compared length until it exceeds ``cap``."""
        rank, h = names, 1
        while True:
            far = np.zeros(len(rank), np.int64)
            far[:-h] = rank[h:] + 1 if h < len(rank) else far[:-h]
            key = rank * (int(rank.max()) + 2) + far
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            h *= 2
            if rank.max() + 1 == len(rank) or h > self.cap or h >= len(rank):
                return order

    def descending(self) -> Iterator[np.ndarray]:
        """All suffixes from the largest, in chunks of (position, common prefix with the one before it in this order)."""
        order, lcp = self.sorted_seeds()
        ends = room(self.symbols + 1, np.int64, self.memory, 0)
        for i, j in blocks(len(order)):  # sorted by their first symbols
            c, k = np.unique(self.t[order[i:j]], return_counts=True)
            ends[c.astype(np.int64) + 1] += k
        np.cumsum(ends, out=ends)

        def seeds_of(c: int) -> Iterator[np.ndarray]:
            a, b = int(ends[c]), int(ends[c + 1])
            for k in range(a, b, CHUNK):
                yield np.stack([order[k : min(b, k + CHUNK)], lcp[k : min(b, k + CHUNK)]], axis=1)

        return self.induce(seeds_of)


def equal_groups(t: np.ndarray, length: int, valid: np.ndarray, memory: int = MEMORY, small: int = SMALL) -> Iterator[np.ndarray]:
    """Chunks of (position, first position) of valid positions whose ``length`` symbols also start at an earlier one.

    ``t`` ends with its only least symbol.
    """

    def groups(rows: np.ndarray) -> np.ndarray:
        """Of some whole groups."""
        group = np.cumsum(rows[:, 1] < length)
        ok = valid[rows[:, 0]]
        pos, group = rows[ok, 0], group[ok]
        if not len(pos):
            return np.zeros((0, 2), np.int64)
        by = np.lexsort((pos, group))
        pos, group = pos[by], group[by]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        lead = np.repeat(pos[head], np.diff(np.append(head, len(pos))))
        return np.stack([pos[pos != lead], lead[pos != lead]], axis=1)

    def one(pos: np.ndarray) -> Iterator[np.ndarray]:
        """Of one group, of any size."""
        if len(pos) > 1:
            lead = int(pos.min())
            for i, j in blocks(len(pos)):
                p = np.sort(pos[i:j])
                yield np.stack([p[p != lead], np.full(int((p != lead).sum()), lead)], axis=1)

    last = Growing(memory)
    for rows in Induced(t, length, memory, small).descending():
        breaks = np.flatnonzero(rows[:, 1] < length)
        if len(breaks):
            a, b = int(breaks[0]), int(breaks[-1])
            last.add(rows[:a, 0][valid[rows[:a, 0]]])
            yield from one(last.array())
            if b > a:
                yield groups(rows[a:b])
            rows, last = rows[b:], Growing(memory)
        last.add(rows[:, 0][valid[rows[:, 0]]])
    yield from one(last.array())
