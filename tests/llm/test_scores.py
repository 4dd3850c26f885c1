"""Toxicity, quality rules, licences, mixing and the language model."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import WORD, lower
from pyspark.sql import functions as F

from tremorframe.llm import licenses, lm, mixing, quality, toxicity

WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "st")]


def documents(n: int = 400, seed: int = 1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        bad = r.random() < 0.25
        w = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        if bad:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(("Scum,", "moron!", "idiot")))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(9000, None, ""), (None, "idiot scum", ""), (9001, "", ""), (0, rows[0][1], "")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(9000, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["doc_id"] in truth and r["doc_id"] % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(got) and all(r["predicted"] == 0 and r["score"] == 0.0 for r in none)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels, keep=("doc_id", "text", "toxic")).columns == ["doc_id", "text", "toxic", "score", "predicted"]


def test_toxicity_in_shards_and_of_long_texts(spark, monkeypatch):
    rows = documents(300, 3)
    long = " ".join(WORDS[i * 7919 % len(WORDS)] for i in range(400_000))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7000, long), (7001, long + " idiot moron scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 20_000)
    weights = toxicity.train(docs, labels, bits=18)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights, 18).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows]) > 0.9 and got[7001] > got[7000]
    assert weights == toxicity.train(docs.repartition(5), labels, bits=18)


def plain_ftrl(rows, alpha, beta, l1, l2, epochs):
    """A dictionary entry for each coordinate, one at a time."""
    z, n = {}, {}

    def weight(i):
        l1_of = 0.0 if i == "bias" else l1
        if abs(z.get(i, 0.0)) <= l1_of:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1_of) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for label, x in rows:
            own = [*x, "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in own:
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if i != "bias"}, weight("bias")


@pytest.mark.parametrize("alpha,l1,l2", [(3.0, 3.0, 0.0), (0.5, 0.2, 0.1)])
def test_ftrl_is_the_plain_update(alpha, l1, l2):
    rng = np.random.default_rng(9)
    rows = [(int(rng.random() < 0.4), np.unique(rng.integers(0, 60, rng.integers(0, 9))).astype(np.int32)) for _ in range(300)]
    got, bias = toxicity.ftrl(rows, 6, alpha, 1.0, l1, l2, 3)
    want, plain_bias = plain_ftrl([(y, x.tolist()) for y, x in rows], alpha, 1.0, l1, l2, 3)
    assert np.allclose([got[i] for i in range(64)], [want.get(i, 0.0) for i in range(64)], atol=1e-4) and abs(bias - plain_bias) < 1e-4
    assert {i for i in range(64) if got[i]} == {i for i, w in want.items() if w}


def test_ftrl_is_sparse():
    rng = np.random.default_rng(2)
    rows = [(int(i % 2), np.unique(np.concatenate(([7 if i % 2 else 8], rng.integers(100, 1 << 16, 40)))).astype(np.int32)) for i in range(400)]
    w, _ = toxicity.ftrl(rows, 17)
    assert w[7] > 0 > w[8] and (w != 0).sum() < 200


def plain_measures(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality(spark):
    r = random.Random(3)
    texts = [None, "", "a", "a b c a b c", "x  y\n\nx  y\nz\x0b|#é", " ".join(["one two"] * 40), "w " * 2000]
    texts += [" ".join(r.choice(WORDS) for _ in range(r.randint(45, 300))) + r.choice(("", "\nsame line\nsame line")) for _ in range(60)]
    texts += [" ".join(f"{r.choice(WORDS)}***" for _ in range(120)) for _ in range(5)]
    rows = [(i, t, r.choice(("en", "de", None)), r.choice(("a", "b", None)), 7) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = quality.quality(df).collect()
    assert len(got) == len(rows)
    for g in got:
        want = plain_measures(texts[g["doc_id"]])
        assert tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (want[-1] and g["kept"])
    kept = {g["doc_id"]: g["kept"] for g in got}
    assert not any(kept[len(texts) - k] for k in range(1, 6)) and np.mean([kept[i] for i in range(7, 67) if not plain_measures(texts[i])[-1]]) > 0.9
    assert quality.quality(df.limit(0)).count() == 0


def test_sketches_merge_and_are_accurate(spark):
    rng = np.random.default_rng(4)
    v = rng.lognormal(-2, 1, 4000)
    zero = dict.fromkeys((f"{r}_high" for r in list(quality.RATES)[1:]), 0.5)
    df = spark.createDataFrame([("g" if i % 2 else "h", float(x)) for i, x in enumerate(v)], "g string, symbol_rate_high double").select("*", *(F.lit(x).alias(k) for k, x in zero.items()))
    read = lambda sketch, q: quality.gathered(sketch, ["g"]).where("rate = 'symbol_rate'").select(quality.quantile(q).alias("v")).first()["v"]
    whole = quality.sketches(df.withColumn("g", F.lit("all")), ["g"])
    parts = quality.merged(quality.sketches(df, ["g"]).withColumn("g", F.lit("all")), ["g"])
    for q in (10, 50, 90):
        assert read(parts, q) == read(whole, q) and abs(read(whole, q) / np.quantile(v, q / 100) - 1) < 0.03


def limits(spark, groups: dict[str, list[float]]):
    rows = [("en", s, float(x), 0.1, 0.1, 0.1, False) for s, v in groups.items() for x in v]
    df = spark.createDataFrame(rows, "lang string, source string, symbol_rate_high double, dup_line_rate_high double, repeat_rate_high double, upper_rate_high double, base_failed boolean")
    return {r["source"]: r["symbol_rate_limit"] for r in quality.thresholds(df).collect()}


def test_limits_come_from_the_sketches(spark):
    """They differ with the groups, scale with the data, hold against much junk, and small groups lean on their language."""
    rng = np.random.default_rng(5)
    calm, loud = rng.lognormal(-6, 0.3, 3000), rng.lognormal(-4, 0.3, 3000)
    got = limits(spark, {"calm": calm, "loud": loud})
    ten = limits(spark, {"calm": 10 * calm, "loud": 10 * loud})
    assert 5 < got["loud"] / got["calm"] < 10 and all(abs(ten[s] / got[s] / 10 - 1) < 0.15 for s in got)
    for s, v in (("calm", calm), ("loud", loud)):
        assert np.mean(v > got[s]) < 0.02 and got[s] < 3 * np.median(v)
    junk = limits(spark, {"calm": np.concatenate((calm, np.full(2500, 2.9))), "loud": loud})
    assert junk["calm"] < 30 * np.median(calm) < 0.1
    few = limits(spark, {"calm": calm, "few": np.full(5, 2.9)})
    assert few["few"] < 30 * np.median(calm) and abs(few["calm"] / got["calm"] - 1) < 0.3


def test_limits_of_the_tables(spark):
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = quality.quality(spark.read.parquet(f"{sf}/documents.parquet"), ("doc_id", "lang", "source"))
    per = rows.groupBy("lang", "source").agg(*(F.max(f"{r}_limit").alias(r) for r in quality.RATES)).collect()
    for r in quality.RATES:
        # Line rates are small whole numbers over small whole numbers, so their limits are fewer.
        assert len({g[r] for g in per}) > (0.05 if r == "dup_line_rate" else 0.5) * len(per) and max(g[r] for g in per) > 1.2 * min(g[r] for g in per)


def test_texts_of_one_length(spark):
    """Where a source's texts are alike, shorter and longer clean ones pass, one event proves nothing, and junk goes all the same."""
    r = random.Random(8)
    text = lambda n: " ".join(f"{r.choice(WORDS)}{r.choice(WORDS)}{i}" for i in range(n))
    texts = [text(400) for _ in range(300)] + [text(r.randint(60, 200)) for _ in range(30)] + [text(3000) for _ in range(5)] + [text(80) + " #", "One line\n" + text(90) + "\nOne line"]
    clean = len(texts)
    texts += [" ".join(f"{w}|" for w in text(n).split()) for n in (60, 400)] + [text(100).upper(), "\n".join([text(12)] + ["same old line"] * 4 + [text(60)] + ["same old line"] * 8)]
    got = {x["doc_id"]: x for x in quality.quality(spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(clean)) and not any(got[i]["kept"] for i in range(clean, clean + 3))
    assert all(got[i][f"{x}_low"] == 0 for i in range(330) for x in ("symbol_rate", "dup_line_rate", "repeat_rate"))


def test_quality_of_a_very_long_text(spark):
    long = " ".join(f"{WORDS[i * 7919 % len(WORDS)]}{i}" for i in range(200_000))
    (got,) = quality.quality(spark.createDataFrame([(1, long, "en", None)], "doc_id long, text string, lang string, source string")).collect()
    assert got["n_words"] == 200_000 and got["n_repeat_words"] == 0 and got["kept"]


def test_licenses(spark, monkeypatch):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 100)
    british = "Copyright (c) 2020 A. Person\nAll rights reserved.\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(", ", " ,\n  ")
    rows = [(1, british), (2, "Some text.\nReleased under the  MIT Licence\nmore"), (3, None), (4, "!!!"), (5, mit + " and more"), (6, "Released under the MIT License."), (6, "Released under the MIT License.")]
    rows += [(7, "Copyright (c) 1999 B. Person. " + mit), (8, mit.replace("sublicense", "sub-\nlicense")), (9, "")]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, license string, row string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert licenses.scan(df).count() == 10 and licenses.scan(df.limit(0)).count() == 0
    assert [got[i]["license"] for i in (1, 6, 7, 8, 5)] == ["MIT"] * 4 + [None]
    assert got[2]["license"] is None and got[2]["n_license_lines"] == 1 and got[2]["line_licenses"] == "MIT"
    assert all(got[i]["digest"] is None and not got[i]["is_license"] for i in (3, 4, 9))
    known = [("mine", "some text released under the mit license more"), ("z", "some text released under the mit license more"), (None, "x"), ("none", None)]
    for most in (licenses.BROADCAST, 0):
        monkeypatch.setattr(licenses, "BROADCAST", most)
        for own in (known, spark.createDataFrame(known, "license string, text string")):
            assert [r["doc_id"] for r in licenses.scan(df, own).where("license = 'mine'").collect()] == [2]
        assert licenses.scan(df, []).where("is_license or n_license_lines > 0").count() == 0
        kept = licenses.scan(df, keep=("doc_id", "row")).collect()
        assert len(kept) == 10 and all(r["row"] == "clash" for r in kept)


def test_every_known_licence_in_other_dress(spark):
    """Titles, wrapped lines, other punctuation, old spellings, copyright lines in front: still itself; a word more or less: not."""
    import textwrap

    texts = licenses.KNOWN[4:]
    dress = [
        lambda t: t, lambda t: "Copyright (c) 2019, A. Person <a@example.org>\n\n" + t, lambda t: "\n".join(textwrap.wrap(t, 60)), lambda t: "  * " + t.replace("\n", "\n  * ") + "\n", lambda t: t.upper(),
        lambda t: t.replace("license", "licence").replace("acknowledgment", "acknowledgement").replace("authorization", "authorisation").replace('"', "''"),
    ]
    rows = [(k * 100 + d, name, f(t)) for k, (name, t) in enumerate(texts) for d, f in enumerate(dress)]
    other = [(10_000 + 2 * k, name, t + " indeed") for k, (name, t) in enumerate(texts)] + [(10_001 + 2 * k, name, t.replace("software", "hardware", 1).replace("SOFTWARE", "HARDWARE", 1).replace("Software", "Hardware", 1)) for k, (name, t) in enumerate(texts) if "software" in t.lower()]
    df = spark.createDataFrame(rows + other, "doc_id long, name string, text string")
    got = licenses.scan(df, keep=("doc_id", "name")).collect()
    assert len({n for n, _ in texts}) == 21 and all(r["license"] == r["name"] for r in got if r["doc_id"] < 10_000)
    assert all(r["license"] is None for r in got if r["doc_id"] >= 10_000)


def test_license_lines_in_any_dress(spark):
    """Every line of the known form counts, whatever stands around its words and however long it is."""
    notice = "Licensed under CC BY-NC 4.0."
    dressed = [f"\t{notice}", f'"{notice}"', f"//{notice}", f"({notice})", "*" * 9000 + notice, "licenced under cc-by-nc-4.0", f"\x0b{notice}\r", f"Copyright (c) 2001 A\n{notice}\nsub\n{notice}\nlicense", f"Copyright (c) 2001 A. {notice}"]
    dressed += ["word " * 700_000 + "\n" + " \t" * 500_000 + notice]
    n = len(dressed)
    df = spark.createDataFrame(list(enumerate([f"before\n{x}\nafter" for x in dressed] + ["under cc by nc 4 0", f"{notice} not"])), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_license_lines"], r["line_licenses"]) for r in licenses.scan(df).collect()}
    assert got == {**{i: (2 if i == 7 else 1, "CC-BY-NC-4.0") for i in range(n)}, n: (0, ""), n + 1: (0, "")}
    own = [("CC0-1.0", "CC0 1.0 Universal"), ("PD", "Public domain dedication."), ("v", "v2 v2"), ("none", "!"), ("l", "license license")]
    lines = ["CC0-1.0 universal", "  public domain dedication", "version 2 version 2", "v2 ver. 2", "*" * 500 + " V2 V 2", "!", "licence licence", "Licence--license"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(f"a\n{x}\nb" for x in lines)), "doc_id long, text string"), own).collect()
    assert [r["line_licenses"] for r in sorted(got)] == ["CC0-1.0", "PD", "v", "v", "v", "", "l", "l"]


def poisson(u: float, rate: float) -> int:
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else "small", i) for i in range(900)] + [(None, None, None, None, 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_copy long")
    out = mixing.replicate(df, {"big": 0.25, "small": 0.75}).collect()
    assert all(r["input_mix_copy"] == (1 if r["doc_id"] is None else r["doc_id"]) for r in out)
    copies = Counter(r["doc_id"] for r in out)
    n = {"big": 600, "small": 300}
    for i in range(900):
        source = "big" if i % 3 else "small"
        u = int(hashlib.md5(f"{i}|t{i}|{mixing.SEED}".encode()).hexdigest()[:13], 16) / 16**13
        assert copies[i] == poisson(u, {"big": 0.25, "small": 0.75}[source] * 902 / n[source])
    assert copies[None] == 0 and sorted(r["mix_copy"] for r in out if r["doc_id"] == out[0]["doc_id"]) == list(range(1, copies[out[0]["doc_id"]] + 1))
    again = mixing.replicate(df.repartition(7), {"big": 0.25, "small": 0.75}).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert mixing.replicate(df.limit(0)).count() == 0 and mixing.replicate(df).count() > 600
    big = mixing.replicate(df, {"small": 1.0}, size=1e6).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert len(big) == 300 and abs(sum(r["n"] for r in big) / 1e6 - 1) < 0.01
    clash = df.select("doc_id", "text", "source", *(F.lit(c).alias(c) for c in ("key", "row", "own", "first", "mix_rate", "input_mix_rate", "mix_copies", "_key", "_source")))
    got = mixing.replicate(clash, {"big": 0.25, "small": 0.75})
    assert got.columns == ["doc_id", "text", "source", "key", "row", "own", "first", "input_input_mix_rate", "input_mix_rate", "input_mix_copies", "_key", "_source", *mixing.OWN]
    assert sorted((r["doc_id"], r["mix_copy"]) for r in got.collect()) == sorted((r["doc_id"], r["mix_copy"]) for r in out)
    long = mixing.replicate(df.limit(3).withColumn("text", F.repeat(F.lit("word "), 600_000)), {"big": 0.5, "small": 0.5}, size=30)
    assert {len(r["text"]) for r in long.collect()} == {3_000_000}


def test_mixing_of_rare_sources(spark, monkeypatch):
    """Mean rates over 64 follow from the table; counts are those of the plain quantile."""

    def plain(u: float, rate: float) -> int:
        k, c = 0, math.exp(-rate)
        while c <= u:
            k += 1
            c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        return k

    rare = [(-i, f"r{i}", None) for i in range(1, 4)]
    df = spark.range(20_000).selectExpr("id as doc_id", "concat('t', id) as text", "'big' as source").unionByName(spark.createDataFrame(rare[:1], "doc_id long, text string, source string"))
    named = df.where("source is not null").unionByName(spark.createDataFrame([(i, t, "rare") for i, t, _ in rare], "doc_id long, text string, source string"))
    for sources in (mixing.BROADCAST_SOURCES, 1):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
        for docs, targets in ((df, None), (named, {"big": 0.99, "rare": 0.01}), (named, {"rare": 1.0})):
            out = mixing.replicate(docs, targets).where("doc_id < 0").groupBy("doc_id", "text", "mix_rate", "mix_copies").agg(F.count("*").alias("n"), F.countDistinct("mix_copy").alias("d"), F.max("mix_copy").alias("top")).collect()
            assert len(out) == (1 if targets is None else 3)
            for r in out:
                u = int(hashlib.md5(f"{r['doc_id']}|{r['text']}|{mixing.SEED}".encode()).hexdigest()[:13], 16) / 16**13
                assert r["mix_rate"] > 64 and r["n"] == r["d"] == r["top"] == r["mix_copies"] == plain(u, r["mix_rate"])


def test_language_model(spark):
    r = random.Random(5)
    a, b = WORDS[:40], WORDS[35:]
    rows = [(i, " ".join(r.choice(a if i % 2 else b) for _ in range(r.randint(0, 120))) + (" Q%d" % i if i % 4 == 0 else "")) for i in range(300)]
    rows += [(1001, None), (1002, ""), (None, "ban"), (1, rows[1][1])]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))
    got = lm.score(df, training).collect()
    assert len(got) == len(rows)
    in_training = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    tokens = [(i, [*WORD.findall(lower(t or "")), None]) for i, t in rows]
    c = Counter(x for i, t in tokens for x in t if in_training(i))
    total, v = sum(c.values()), len(c)
    base = {(i, tuple(t)): sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in t) for i, t in tokens}
    want = sorted(((i or -1, in_training(i), len(t), sum(c[x] > 0 for x in t), total, round(base[i, tuple(t)], 6)) for i, t in tokens))
    assert want == sorted((g["doc_id"] or -1, g["training"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got)
    held = [g for g in got if not g["training"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)
    assert lm.score(df.limit(0), training).count() == 0
    nothing = lm.score(df, F.lit(False)).collect()
    assert all(g["train_tokens"] == 0 and math.isfinite(g["score"]) for g in nothing)


def test_forward_is_the_plain_recursion():
    rng = np.random.default_rng(6)
    k, v = 3, 5
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = lm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((v, k)), 0))
    texts = [rng.integers(0, v, n) for n in (1, 4, 9, 4)]
    p = lm.Packed(texts)
    got, _, _ = lm.forward(m, p)
    start, move, gamma = lm.expected(m, p)
    all_start, all_move = np.zeros(k), np.zeros((k, k))
    for t, g in zip(texts, got, strict=True):
        a, alphas = m.start * m.emit[t[0]], [m.start * m.emit[t[0]]]
        for x in t[1:]:
            a = (a @ m.move) * m.emit[x]
            alphas.append(a)
        assert math.log(a.sum()) == pytest.approx(g)
        betas = [np.ones(k)]
        for x in t[:0:-1]:
            betas.append(m.move @ (m.emit[x] * betas[-1]))
        betas = betas[::-1]
        z = alphas[-1].sum()
        all_start += alphas[0] * betas[0] / z
        for i in range(len(t) - 1):
            all_move += alphas[i][:, None] * m.move * (m.emit[t[i + 1]] * betas[i + 1])[None] / z
    assert np.allclose(start, all_start) and np.allclose(move, all_move) and gamma.sum() == pytest.approx(sum(map(len, texts)))


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_blocks_of_long_texts_give_the_same(monkeypatch, block):
    """Likelihoods and expected counts of texts cut into blocks are those of whole texts."""
    rng = np.random.default_rng(8)
    k, v = 3, 6
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = lm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((v, k)), 0))
    texts = [rng.integers(0, v, n) for n in (1, 9, 4, 2, 13)]
    whole = lm.Packed(texts)
    want, (start, move, gamma) = lm.forward(m, whole)[0], lm.expected(m, whole)
    states = np.zeros((v, k))
    np.add.at(states, whole.symbols, gamma)
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "GROUP", 4)
    parts, of, chain = lm.blocks(m, texts)
    assert max(map(len, parts)) <= block and np.array_equal(np.concatenate(parts), np.concatenate(texts))
    each, total, moves, found = np.zeros(len(parts)), np.zeros(k), np.zeros((k, k)), np.zeros((v, k))
    for group in lm._groups(parts):
        p = lm.Packed([parts[i] for i in group])
        each[group] = lm.forward(m, p, prior=chain.prior[group])[0]
        a, b, g = lm.expected(m, p, chain.of(group))
        total, moves = total + a, moves + b
        np.add.at(found, p.symbols, g)
    assert np.allclose(np.bincount(of, each), want) and np.allclose(total, start) and np.allclose(moves, move) and np.allclose(found, states)


def test_language_model_of_a_very_long_text(spark):
    """Steps do not follow the longest text: half a million tokens beside a few short texts."""
    words = [f"w{i * 7919 % 997}" for i in range(500_000)]
    df = spark.createDataFrame([(1, " ".join(words)), *((i, "w1 w2 w3") for i in range(2, 20))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(df, F.lit(True)).collect()}
    assert got[1]["n_tokens"] == 500_001 and math.isfinite(got[1]["score"]) and got[1]["score"] > 1.01 * got[1]["base_score"]
