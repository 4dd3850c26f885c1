"""An FM-index over integers: wavelet matrix of the BWT with packed bits.

Searches run for many patterns at once; every step of all of them is a few
numpy operations.  Occurrences may have weights, which prefix sums in suffix
order add up.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in the order of their first ``longest`` symbols at least (prefix doubling)."""
    n, rank, k = len(s), s.astype(np.int64), 1
    while True:
        key = rank * (n + 2)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= min(longest, n):
            return order


#: MASKS[k] has the k lowest bits.
MASKS = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with rank: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + b"\0" * (-len(packed) % 8 + 8), np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)
        self.zeros = np.int32(len(bits) - int(bits.sum()))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place (32-bit)."""
        at = i >> 6
        held = self.words.take(at)
        held &= MASKS.take(i & 63)
        out = self.before.take(at)
        out += np.bitwise_count(held)
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, weights: np.ndarray, longest: int) -> None:
        """text: dense ids from 0; weights: of the pattern occurrences that start at each place."""
        s = np.append(text.astype(np.int64) + 1, 0)
        order = suffix_array(s, longest)
        bwt = s[order - 1]
        self.size = len(s)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s))))
        self.weight = np.concatenate(([0], np.cumsum(np.append(weights, 0)[order])))
        self.depth = max(1, int(s.max()).bit_length())
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bits = (bwt >> level & 1).astype(bool)
            self.levels.append(Bits(bits))
            bwt = np.concatenate((bwt[~bits], bwt[bits]))
        every = np.arange(len(self.first) - 1, dtype=np.int32)
        self.begin = self._down(every, np.zeros(len(every), np.int32))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.ones(i)
            one = (symbol & (1 << level)).astype(bool)
            i -= ones
            ones += bits.zeros
            np.copyto(i, ones, where=one)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with the symbol and go on as the rows lo to hi."""
        symbol = (symbol + 1).astype(np.int32)
        n = len(symbol)
        ends = self._down(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)).astype(np.int32))
        shift = self.first[symbol] - self.begin[symbol]
        return shift + ends[:n], shift + ends[n:]

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weight[hi] - self.weight[lo]


def repeated_intervals(index: FMIndex, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of text[start:end] with ``window`` symbols or more that occur ``least`` times and hold all windows that do.

    All given stretches advance together, each by backward search.  The first
    search goes from the right end as far as it can; windows that are not in
    what it found begin further left and end no more than a window away.  These
    are searched from left to right: where one fails, no window that holds the
    part that failed can occur again; where one succeeds, longer ones are tried.
    Returns stretch number, from, to.
    """
    who = np.flatnonzero(ends - starts >= window)
    j, e = starts[who].copy(), ends[who].copy()
    s, lo, hi = e.copy(), np.zeros(len(who), np.int64), np.full(len(who), index.size, np.int64)
    # limit: last end to try (0 in the first search); ahead: how much longer the next try is; good: end of the last success.
    limit, ahead, good = np.zeros(len(who), np.int64), np.ones(len(who), np.int64), e.copy()
    found: list[tuple[np.ndarray, ...]] = []
    while len(who):
        lo, hi = index.extend(text[s - 1], lo, hi)
        ok = index.occurrences(lo, hi) >= least
        s = s - ok
        full, first = ok & (s == j), limit == 0
        report = (full | (~ok & first)) & (e - s >= window)
        if report.any():
            found.append((who[report], s[report], e[report]))
        ended = full & (first | (e >= limit))
        event = (full | ~ok) & ~ended
        if event.any():
            i = np.flatnonzero(event)
            f, was_first, was_full, was_long = s[i] - 1, first[i], full[i], e[i] > j[i] + window
            limit[i] = np.where(was_first, np.minimum(e[i] - 1, f + window), limit[i])
            good[i] = np.where(was_full, e[i], good[i])
            # After the first search from the left end; after a success from the same place, longer; else further right.
            nj = np.where(was_first | was_full, j[i], np.where(was_long, good[i] - window + 1, f + 1))
            ne = np.where(was_full & ~was_first, np.minimum(e[i] + ahead[i], limit[i]), nj + window)
            ahead[i] = np.where(was_full & ~was_first, 2 * ahead[i], 1)
            j[i], e[i], s[i] = nj, ne, ne
            lo[i], hi[i] = 0, index.size
            ended[i] |= ne > limit[i]
        if ended.any():
            stay = ~ended
            who, j, e, s, lo, hi, limit, ahead, good = (x[stay] for x in (who, j, e, s, lo, hi, limit, ahead, good))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
