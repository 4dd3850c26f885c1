from __future__ import annotations

import numpy as np
from brute import WORD
from hypothesis import given, settings
from hypothesis import strategies as st

from tremorframe.llm.words import Words, chunks, shingles

TEXTS = st.lists(st.text(st.sampled_from("ab cdé\n\t\x0b\x85 .A"), max_size=40), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    w = Words(raw)
    found = [[w.buffer[w.starts[i] : w.ends[i]].decode() for i in range(a, b)] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert found == [WORD.findall(t) for t in texts]
    by = {}
    for t, h in zip(sum(found, []), w.hashes.tolist(), strict=True):
        assert by.setdefault(t, h) == h
    assert len(set(by.values())) == len(by)


def test_hashes_do_not_depend_on_place_or_block():
    long = b" ".join(b"w%d" % (i % 1000) for i in range(300_000))
    h = Words([b"x", long]).hashes[1:]
    assert np.array_equal(h[:1000], h[1000:2000]) and np.array_equal(h[:1000], h[-1000:])
    assert len(np.unique(h)) == 1000
    s = shingles(h, 5)
    assert np.array_equal(s[:990], s[1000:1990]) and len(shingles(h[:3], 5)) == 0


def test_trim_lower_and_chunks():
    w = Words([b'"Hello," ... (world)!'], lower=True, trim=3)
    assert [w.bytes[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)] == [b"hello", b".", b"world"]
    assert list(chunks([b"a" * 10] * 5, 25)) == [(0, 2), (2, 4), (4, 5)] and list(chunks([])) == []
