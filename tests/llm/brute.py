"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def classes(texts: list[str | None]) -> list[tuple[int, int]]:
    """For each row the size of its set and the first row of its component."""
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    shared = Counter()
    for rows in by.values():
        rows = sorted(rows)
        for n, a in enumerate(rows):
            for b in rows[n + 1 :]:
                shared[a, b] += 1
    for (a, b), both in shared.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_duplicates(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """doc_id, n_shingles, component_id, kept of each row."""
    found, least = classes([t for _, t in rows]), defaultdict(lambda: None)
    for (i, _), (_, c) in zip(rows, found, strict=True):
        if i is not None and (least[c] is None or i < least[c]):
            least[c] = i
    return [(i, n, least[c], i == least[c]) for (i, _), (n, c) in zip(rows, found, strict=True)]


def repeated_words(texts: list[str | None], window: int = 35) -> list[tuple[int, list[str]]]:
    """For each text the number of its words and the kept words."""
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out
