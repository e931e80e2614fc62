"""Character n-grams of order ORDER, packed into 64 bits: 16 bits a character, the last one lowest.

Characters beyond the basic plane count as U+FFFD. START pads the left end, so that every
character has a full context.
"""

from __future__ import annotations

import numpy as np

ORDER = 4
WIDTH = 16
START = "\x02"
MASK = np.uint64((1 << WIDTH) - 1)


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all characters of the texts, one after the other, and each text's count."""
    pad = START * (ORDER - 1)
    raw = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le"), np.uint32)
    raw = np.where(raw > 0xFFFF, 0xFFFD, raw).astype(np.uint64)
    counts = np.array([len(t) for t in texts], np.int64)
    grams = np.zeros(max(len(raw) - ORDER + 1, 0), np.uint64)
    for j in range(ORDER):
        grams = grams << np.uint64(WIDTH) | raw[j : j + len(grams)]
    # positions where a text's own character is the last one
    begins = np.cumsum(counts + ORDER - 1) - counts - ORDER + 1
    at = np.repeat(begins, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return grams[at], counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values (rows) over runs of the given lengths; empty runs give 0."""
    out = np.zeros((len(counts), *values.shape[1:]))
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out


class SortedHashes:
    """A sorted array of keys with an index on their hash's top bits, for fast exact lookups."""

    def __init__(self, keys: np.ndarray) -> None:
        hashed = self._hash(keys)
        self.order = np.argsort(hashed)
        self.hashes = hashed[self.order]
        self.bits = max(1, int(np.ceil(np.log2(max(len(keys), 1) * 2))))
        tops = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(tops, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max(initial=0))

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        """A bijection of 64-bit values: equal hashes mean equal keys."""
        x = keys * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row in the array that the index was made of, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.hashes):
            return out
        hashed = self._hash(keys)
        top = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[top], self.starts[top + 1]
        open_ = np.flatnonzero(at < end)
        for _ in range(self.deepest):
            same = self.hashes[at[open_]] == hashed[open_]
            out[open_[same]] = self.order[at[open_[same]]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
            if not len(open_):
                break
        return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts one, two and more, by the counts of counts."""
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(d, [0.05, 0.05, 0.05], [0.95, 1.9, 2.85])


class KneserNey:
    """Interpolated modified Kneser-Ney model of one language, from counts of full-order n-grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        keys, amounts = [grams], [counts.astype(np.float64)]
        for k in range(ORDER - 1, 0, -1):
            low, amount = np.unique(keys[0] & np.uint64((1 << WIDTH * k) - 1), return_counts=True)
            keys.insert(0, low)
            amounts.insert(0, amount.astype(np.float64))
        self.keys, self.gram_index, self.first, self.context_index, self.gamma = keys, [], [], [], []
        for key, a in zip(keys, amounts, strict=True):
            d = discounts(a)
            context, inverse = np.unique(key >> np.uint64(WIDTH), return_inverse=True)
            total = np.bincount(inverse, a)
            kept = d[np.minimum(a, 3).astype(int) - 1]
            self.gram_index.append(SortedHashes(key))
            self.first.append(np.maximum(a - kept, 0) / total[inverse])
            self.context_index.append(SortedHashes(context))
            self.gamma.append(np.bincount(inverse, kept) / total)
        self.floor = 1 / (len(keys[0]) + 1)

    def probability(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of the last character, given the ones before, for n-grams of the given order."""
        if not order:
            return np.full(len(grams), self.floor)
        lower = self.probability(grams & np.uint64((1 << WIDTH * (order - 1)) - 1), order - 1)
        row, context = self.gram_index[order - 1].find(grams), self.context_index[order - 1].find(grams >> np.uint64(WIDTH))
        gamma = np.where(context >= 0, self.gamma[order - 1][context], 1.0)
        return np.where(row >= 0, self.first[order - 1][row], 0.0) + gamma * lower
