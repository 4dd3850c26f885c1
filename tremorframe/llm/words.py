"""Words and their hashes for many texts at once, in numpy.

A word is a run of bytes other than space and 0x09-0x0D, so in UTF-8 exactly a
match of ``[^\\x20\\x09-\\x0D]+``.  A word's hash is taken from prefix sums of a
polynomial over Z/2^64: (P[end] - P[start]) / B^start, then mixed.  No Python
code runs per word.
"""

from __future__ import annotations

import numpy as np

from .shared import CLEARED

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 19
_powers: dict[str, np.ndarray] = {}
CLEARED.append(_powers.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["b"]) < n + 1:
        size = 1 << max(20, (n + 1).bit_length())
        for key, base in (("b", _BASE), ("i", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["b"], _powers["i"]


def _block_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    b, inverse = _power_tables(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * b[: len(a)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a list of texts: starts, ends (in buffer), hashes, bounds.

    bounds[d] to bounds[d + 1] are the words of text d; offsets[d] is where the
    text begins in the buffer.  lower folds A-Z; trim takes up to so many ASCII
    punctuation marks off both ends of a word (never the last byte).
    """

    def __init__(self, texts: list[bytes], lower: bool = False, hashes: bool = True, trim: int = 0) -> None:
        self.buffer = b"\n".join(texts) + b"\n"
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))[: len(texts) + 1]
        a = np.frombuffer(self.buffer.translate(_LOWER) if lower else self.buffer, np.uint8)
        self.bytes = a
        white = _WHITE[a]
        change = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            change = np.concatenate(([0], change))
        if len(change) % 2:
            change = np.concatenate((change, [len(a)]))
        self.starts, self.ends = change[0::2], change[1::2]
        self.bounds = np.searchsorted(self.starts, self.offsets)
        for _ in range(trim):
            self.ends = self.ends - (_PUNCTUATION[a[self.ends - 1]] & (self.ends - self.starts > 1))
            self.starts = self.starts + (_PUNCTUATION[a[self.starts]] & (self.ends - self.starts > 1))
        if hashes:
            self.hashes = np.empty(len(self.starts), np.uint64)
            i = 0
            while i < len(self.starts):
                at = self.starts[i]
                j = max(i + 1, int(np.searchsorted(self.ends, at + _BLOCK, "right")))
                self.hashes[i:j] = _block_hashes(a[at : self.ends[j - 1]], self.starts[i:j] - at, self.ends[i:j] - at)
                i = j

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; entry i begins at word i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : n + i]
    return mixed(out)


def chunks(texts: list[bytes], size: int = 1 << 21):
    """Slices of the list with about so many bytes each (one text at least)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
