"""Byte-pair merging of many short symbol sequences at once, in numpy.

Each sequence takes its best merge (lowest rank, leftmost) step by step, as an agenda would;
sequences of like length are the rows of one matrix, so a step is a few array operations for
thousands of them. Long sequences take the same merges from a heap, one by one.

With dropout, a candidate merge (start, split, end of a sequence) is skipped if its keyed hash
falls below the rate. The hash depends on nothing else, so a run can be repeated exactly.
"""

from __future__ import annotations

import heapq

import numpy as np

from .shared import mix

NEVER = np.int32(2**31 - 1)
#: Symbols beyond which a sequence takes the heap.
LONG = 48


class Merges:
    """Open-addressing table from pairs of symbols to the rank and the symbol of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.ranks = np.full(size, NEVER)
        self.merged = np.zeros(size, np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 1
        while len(todo):
            empty = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            who, first = np.unique(slot[todo[empty]], return_index=True)
            placed = todo[empty][first]
            self.keys[who], self.ranks[who], self.merged[who] = keys[placed], rank[placed], merged[placed]
            left_over = np.ones(len(todo), bool)
            left_over[np.flatnonzero(empty)[first]] = False
            todo = todo[left_over]
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a missing pair's slot has rank NEVER."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        open_ = np.flatnonzero(self.keys[slot] != keys)
        for _ in range(self.probes):
            if not len(open_):
                return slot
            lost = self.keys[slot[open_]] == np.uint64(2**64 - 1)
            open_ = open_[~lost]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
        return slot


def _dropped(keys: np.ndarray, start: np.ndarray, split: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidates' keyed hashes fall below rate."""
    place = start.astype(np.uint64) << np.uint64(42) ^ split.astype(np.uint64) << np.uint64(21) ^ end.astype(np.uint64)
    return (mix(keys ^ mix(place + np.uint64(0x632BE59BD9B4E019))) >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


def _by_heap(symbols: np.ndarray, merges: Merges, key: np.ndarray | None, rate: float) -> np.ndarray:
    """One long sequence."""
    n = len(symbols)
    ids, starts, after, before = symbols.tolist(), list(range(n)) + [n], list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    version = [0] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def push(at: np.ndarray) -> None:
        nxt = np.array([after[i] for i in at], np.int64)
        at = at[nxt < n]
        nxt = nxt[nxt < n]
        if not len(at):
            return
        slot = merges.find(np.array([ids[i] for i in at]), np.array([ids[i] for i in nxt]))
        rank = merges.ranks[slot]
        ok = rank < NEVER
        if key is not None:
            ends = np.array([after[i] for i in nxt], np.int64)
            ok &= ~_dropped(np.full(len(at), key), at, nxt, ends, rate)
        for i, j, r, m in zip(at[ok].tolist(), nxt[ok].tolist(), rank[ok].tolist(), merges.merged[slot[ok]].tolist(), strict=True):
            heapq.heappush(heap, (r, i, version[i], version[j], m))

    push(np.arange(n - 1))
    while heap:
        _, i, v, w, m = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or version[i] != v or j >= n or version[j] != w:
            continue
        ids[i], alive[j], after[i] = m, False, after[j]
        version[i] += 1
        version[j] += 1
        if after[j] < n:
            before[after[j]] = i
        push(np.array([x for x in (before[i], i) if x >= 0], np.int64))
    del starts
    return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int64)


def merge_all(symbols: np.ndarray, lens: np.ndarray, merges: Merges, keys: np.ndarray | None = None, rate: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of the sequences, laid end to end, and their new lengths.

    keys: a hash key for each sequence, if candidates are to be dropped at the rate given.
    """
    starts = np.cumsum(lens) - lens
    counts = np.array(lens, np.int64)
    out = np.array(symbols, np.int64)
    kept = np.zeros(len(out), bool)
    classes = np.minimum(np.ceil(np.maximum(lens, 1) / 4).astype(int), LONG // 4 + 1)
    for c in np.unique(classes):
        rows = np.flatnonzero(classes == c)
        if c > LONG // 4:
            for r in rows:
                got = _by_heap(symbols[starts[r] : starts[r] + lens[r]], merges, None if keys is None else keys[r], rate)
                out[starts[r] : starts[r] + len(got)] = got
                kept[starts[r] : starts[r] + len(got)] = True
                counts[r] = len(got)
            continue
        width = int(c) * 4
        for lo in range(0, len(rows), 20_000):
            _matrix(symbols, starts, lens, rows[lo : lo + 20_000], width, merges, keys, rate, out, kept, counts)
    return out[kept], counts


def _matrix(symbols, starts, lens, rows, width, merges, keys, rate, out, kept, counts) -> None:  # noqa: ANN001
    cols = np.arange(width)
    size = lens[rows].astype(np.int64)
    inside = cols < size[:, None]
    at = np.minimum(starts[rows][:, None] + cols, max(len(symbols) - 1, 0))
    s = np.where(inside, symbols[at], 0).astype(np.int32) if len(symbols) else np.zeros((len(rows), width), np.int32)
    pos = None if keys is None else np.minimum(np.arange(width + 1), size[:, None]).astype(np.int8)
    pairs = inside[:, 1:]
    rank = np.full((len(rows), width), NEVER, np.int32)
    y, x = np.nonzero(pairs)
    if len(y):
        rank[y, x] = _ranks(s, pos, y, x, merges, None if keys is None else keys[rows], rate)
    live, size_live = np.arange(len(rows)), size.copy()
    own = None if keys is None else keys[rows]

    def finish(done: np.ndarray) -> None:
        which = rows[live[done]]
        n = size_live[done]
        valid = cols < n[:, None]
        where = starts[which][:, None] + cols
        out[where[valid]] = s[done][valid]
        kept[where[valid]] = True
        counts[which] = n

    while len(live):
        best = rank.argmin(1)
        over = rank[np.arange(len(live)), best] == NEVER
        if over.any():
            finish(np.flatnonzero(over))
            go = ~over
            s, pos, rank, live, size_live, best = s[go], pos if pos is None else pos[go], rank[go], live[go], size_live[go], best[go]
            own = own if own is None else own[go]
            if not len(live):
                break
        r = np.arange(len(live))
        slot = merges.find(s[r, best], s[r, best + 1])
        later = cols > best[:, None]
        s = np.where(later, np.concatenate((s[:, 1:], s[:, :1]), 1), s)
        s[r, best] = merges.merged[slot]
        if pos is not None:
            pos = np.where(np.append(cols, width) > best[:, None], np.concatenate((pos[:, 1:], pos[:, -1:]), 1), pos)
        rank = np.where(later, np.concatenate((rank[:, 1:], np.full((len(live), 1), NEVER, np.int32)), 1), rank)
        size_live = size_live - 1
        rank[r, best] = NEVER
        y = np.flatnonzero(best + 1 < size_live)
        if len(y):
            rank[y, best[y]] = _ranks(s, pos, y, best[y], merges, own, rate)
        y = np.flatnonzero(best > 0)
        if len(y):
            rank[y, best[y] - 1] = _ranks(s, pos, y, best[y] - 1, merges, own, rate)


def _ranks(s, pos, y, x, merges, keys, rate) -> np.ndarray:  # noqa: ANN001
    rank = merges.ranks[merges.find(s[y, x], s[y, x + 1])]
    if keys is not None:
        rank = np.where((rank < NEVER) & _dropped(keys[y], pos[y, x], pos[y, x + 1], pos[y, x + 2], rate), NEVER, rank)
    return rank
