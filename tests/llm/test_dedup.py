"""Near and substring dedup against plain versions."""

from __future__ import annotations

import hashlib
import random

import brute
import numpy as np
import pytest

from tremorframe.llm import neardup, substring
from tremorframe.llm.components import _large_star, _small_star, components
from tremorframe.llm.fmindex import FMIndex, repeated_intervals

ROWS = "doc_id long, text string, digest string, component long, text2 string"


def corpus(seed: int, docs: int = 60, words: int = 30) -> list[tuple[int | None, str | None]]:
    """Originals, exact and near copies, shared passages, repeats, short, empty and null texts."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "xyzw"]
    passage = [r.choice(vocabulary) for _ in range(50)]
    out, texts = [], []
    for _ in range(docs):
        kind = r.random()
        if texts and kind < 0.15:
            w = list(r.choice(texts))
        elif texts and kind < 0.5:
            w = list(r.choice(texts))
            for _ in range(r.randint(1, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
        elif kind < 0.6:
            w = [r.choice(vocabulary)] * r.randint(30, 90)
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice((0, 1, 3, 4, 5, words, 3 * words)))]
            if r.random() < 0.3:
                w = w + passage + w[:7]
        texts.append(w)
        out.append((len(out) * 7 + 3, r.choice((" ", "\n", "  ")).join(w)))
    return [*out, (9001, None), (9002, "")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "clash") for i, t in rows], ROWS)


def near(spark, rows):
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr)


@pytest.mark.parametrize("seed,leaf,task", [(1, None, None), (2, None, 3), (3, 4, None), (4, 2, 3)])
def test_near_duplicates(spark, monkeypatch, seed, leaf, task):
    if leaf:
        for name, value in (("LEAF", leaf), ("BLOCK", max(2, leaf - 1)), ("PIVOTS", 1)):
            monkeypatch.setattr(neardup, name, value)
    if task:
        monkeypatch.setattr("tremorframe.llm.components.TASK_ROWS", task)
    rows = corpus(seed)
    assert near(spark, rows) == sorted(brute.near_duplicates(rows), key=repr)


def test_no_pair_is_lost_in_rounds(spark, monkeypatch):
    """Pairs of like documents, with components found by rounds over all tasks."""
    monkeypatch.setattr("tremorframe.llm.components.TASK_ROWS", 3)
    words = [[f"w{i}x{j}" for j in range(60)] for i in range(12)]
    rows = [(2 * i + k, " ".join(w if not k else [*w[:-1], "other"])) for i, w in enumerate(words) for k in (0, 1)]
    assert near(spark, rows) == [x for x in sorted(((i, 56, i - i % 2, i % 2 == 0) for i, _ in rows), key=repr)]


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, "A B c d e f"), (8, None), (8, None), (None, "q r"), (None, "Q r"), (None, "")]
    assert near(spark, rows) == sorted([(None, 2, 4, False), (5, 2, 4, False), (5, 2, 4, False), (4, 2, 4, True), (8, 0, 8, True), (8, 0, 8, True), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)], key=repr)


def test_one_id_with_two_texts(spark):
    w, v = (" ".join(f"{x}{i}" for i in range(40)) for x in "wv")
    rows = [(5, w), (5, v), (7, f"{w} x"), (8, f"{v} y"), (9, f"{v} y"), (3, f"z {v} y")]
    for order in (rows, rows[::-1]):
        got = near(spark, order)
        assert got == sorted(brute.near_duplicates(rows), key=repr)
        assert {(i, c) for i, _, c, _ in got} == {(5, 5), (7, 5), (5, 3), (8, 3), (9, 3), (3, 3)}
    df = spark.createDataFrame([(i, t, f"s{n}", "clash") for n, (i, t) in enumerate(rows * 2)], "doc_id long, text string, source string, key_a string")
    stays = neardup.representatives(df, ("doc_id", "source", "text", "key_a")).collect()
    assert sorted((r["doc_id"], r["text"][:2], r["source"], r["key_a"]) for r in stays) == [(3, "z ", "s11", "clash"), (5, "w0", "s0", "clash")]


def test_very_long_text(spark):
    long = " ".join(f"w{i % 50_021}" for i in range(400_000))
    rows = [(1, long), (2, long + " tail"), (3, "short one of five words")]
    assert [(i, c, k) for i, _, c, k in near(spark, rows)] == [(1, 1, True), (2, 1, False), (3, 3, True)]


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    up = {i: i for p in links for i in p}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {i: find(i) for p in links if p[0] != p[1] for i in p}
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["id"]: r["component"] for r in components(df).collect()} == want
    monkeypatch.setattr("tremorframe.llm.components.TASK_ROWS", 3)
    many = {r["id"]: r["component"] for r in components(df).collect()}
    assert many == want
    assert components(df.limit(0)).count() == 0
    assert _small_star(_large_star(df.toDF("u", "v").where("u > v"))).columns == ["u", "v"]


@pytest.mark.parametrize("seed,hot", [(1, None), (2, None), (3, 2), (4, 1)])
def test_repeated_words(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(substring, "HOT", hot)
        monkeypatch.setattr(substring, "SHARD", 500)
    rows = corpus(seed + 10)
    want = {i: (n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, _), (n, k) in zip(rows, brute.repeated_words([t for _, t in rows]), strict=True)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [1, 3, 20_000])
def test_a_passage_in_many_documents(spark, monkeypatch, hot):
    """Anchors in unlike surroundings are split; the words that go are those of the plain version."""
    monkeypatch.setattr(substring, "HOT", hot)
    r = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(40):
        cut = passage[r.choice((0, 0, 3, 9)) : r.choice((40, 40, 36, 20))]
        rows.append((i, " ".join([r.choice("abcdef") for _ in range(r.randint(0, 30))] + cut + [r.choice("abcdef") for _ in range(r.randint(0, 30))])))
    rows += rows[:5]
    want = sorted((i, n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, _), (n, k) in zip(rows, brute.repeated_words([t for _, t in rows]), strict=True))
    assert sorted(tuple(x) for x in substring.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    assert substring.lengths() == [8, 22, 29, 32, 34, 35]


def test_repeats_in_very_long_texts(spark):
    passage = " ".join(f"p{i}" for i in range(45))
    long = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(300_000))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(frame(spark, [(1, f"{long} {passage} x"), (2, f"y {passage}")])).collect()}
    assert got == {1: (300_046, 45), 2: (46, 45)}


def test_repeated_words_of_odd_tables(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(frame(spark, [(1, text), (1, text), (None, "a  b"), (2, text + " z")]), text=True).collect()]
    assert sorted(got, key=repr) == sorted([(1, 40, 40, ""), (1, 40, 40, ""), (None, 2, 0, "a b"), (2, 41, 40, "z")], key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        k, window = int(rng.integers(2, 6)), int(rng.integers(2, 7))
        parts = [rng.integers(0, k, rng.integers(1, 30)).tolist() for _ in range(rng.integers(1, 9))]
        weights = rng.integers(1, 3, len(parts)).tolist()
        text, weight, starts, ends = [], [], [], []
        for n, (p, w) in enumerate(zip(parts, weights, strict=True)):
            starts.append(len(text))
            text += [*p, k + n]
            weight += [w] * len(p) + [1]
            ends.append(len(text) - 1)
        index = FMIndex(np.array(text), np.array(weight), 40)
        seen = {}
        for a, b, w in zip(starts, ends, weights, strict=True):
            for i in range(a, b - window + 1):
                key = tuple(text[i : i + window])
                seen[key] = seen.get(key, 0) + w
        want = {j for a, b in zip(starts, ends, strict=True) for i in range(a, b - window + 1) if seen[tuple(text[i : i + window])] > 1 for j in range(i, i + window)}
        found = repeated_intervals(index, np.array(text), np.array(starts), np.array(ends), window)
        assert {j for _, a, b in zip(*found, strict=True) for j in range(a, b)} == want
