"""Sliding operators against plain loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorframe.functions import kernels
from tremorframe.operators import frames, signal, triggers
from tremorframe.operators.signal import Stream

S = Stream()


def frame(spark, *streams):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"stream_id": k, "idx": np.arange(len(x)), "value": np.asarray(x, float)}) for k, x in enumerate(streams)]))


def values(df, column):
    return df.orderBy("stream_id", "idx").toPandas()[column].to_numpy()


def burst(n=600, at=400, seed=0):
    x = np.random.default_rng(seed).normal(0, 1, n)
    x[at : at + 60] *= 12
    return x


def plain_ratio(x, s, n):
    out = np.zeros(len(x))
    for i in range(n, len(x)):
        long = (x[i - n + 1 : i + 1] ** 2).mean()
        out[i] = (x[i - s + 1 : i + 1] ** 2).mean() / long if long > 1e-10 else 0
    return out


@pytest.mark.parametrize("lta", [50, 300])
def test_sta_lta_with_narrow_and_wide_frames(spark, lta):
    x = burst()
    got = values(frame(spark, x).select("stream_id", "idx", signal.sta_lta(S, 5, lta).alias("r")), "r")
    assert np.allclose(got, plain_ratio(x, 5, lta), atol=1e-8)


def test_triggers_are_those_of_a_loop(spark):
    x = burst()
    r = plain_ratio(x - x.mean(), 5, 50)
    want, on = [], None
    for i, v in enumerate(r):
        if on is None and v >= 3:
            on, peak = i, v
        elif on is not None:
            if v < 1.5:
                want.append((on, i, peak))
                on = None
            else:
                peak = max(peak, v)
    got = triggers.stalta_triggers(frame(spark, x), S, 5, 50, 3.0, 1.5).orderBy("on_idx").collect()
    assert [(g["on_idx"], g["off_idx"]) for g in got] == [w[:2] for w in want] and want
    assert np.allclose([g["peak"] for g in got], [w[2] for w in want])
    with pytest.raises(ValueError):
        triggers.threshold_triggers(frame(spark, x), S, "value", 1.0, 2.0)


def test_open_trigger_is_left_out(spark):
    x = np.concatenate((np.zeros(30), np.ones(10)))
    rows = frame(spark, x)
    assert triggers.threshold_triggers(rows, S, "value", 0.9, 0.5).count() == 0
    assert triggers.hysteresis(rows, S, F.col("value") > 0.9, F.col("value") < 0.5, F.col("value"), keep_open=True).count() == 1


def plain_moments(x, w):
    """Kurtosis and skewness of the w samples before each, in two passes over each frame."""
    k, s = np.zeros(len(x)), np.zeros(len(x))
    for i in range(w, len(x)):
        d = x[i - w : i] - x[i - w : i].mean()
        m2 = (d**2).mean()
        if m2 > 1e-20:
            k[i], s[i] = (d**4).mean() / m2**2 - 3, (d**3).mean() / m2**1.5
    return k, s


@pytest.mark.parametrize("w,block,offset", [(30, 1 << 18, 0.0), (20, 64, 1e5), (1000, 1 << 18, 1e5), (1000, 700, 0.0), (7, 3, -1e5), (1, 10, 0.0)])
def test_moments(spark, w, block, offset):
    x = np.concatenate((burst(1500, 900), np.full(1200, 3.0), burst(400, 100))) + offset
    got = frames.sliding_moments(frame(spark, x, x[:100]), S, w, block)
    k, s = plain_moments(x, w)
    assert got.count() == len(x) + 100
    one = got.where("stream_id = 0")
    # A frame of equal samples with an offset has a variance of rounding errors alone: neither side says anything there.
    sure = np.array([i < w or x[i - w : i].std() > 1e-9 for i in range(len(x))])
    assert np.allclose(values(one, "kurtosis")[sure], k[sure], atol=1e-5) and np.allclose(values(one, "skewness")[sure], s[sure], atol=1e-5)
    assert np.allclose(values(one, "hos")[sure], np.hypot(k, s)[sure], atol=1e-5)
    other = plain_moments(x[:100], w)[0]
    assert np.allclose(values(got.where("stream_id = 1"), "kurtosis"), other, atol=1e-5)


def test_a_burst_leaves_nothing_behind(spark):
    """Sums over frames after a burst of 1e8 are exact, whatever the frame."""
    x = np.concatenate((np.ones(300), np.full(50, 1e8), np.ones(1500)))
    rows = frames.frame_sums(frame(spark, x), S, {"a": (F.col("value") * F.col("value"), 300), "b": (F.col("value"), 1)})
    a = values(rows, "a")
    assert (a[:300] == np.arange(1, 301)).all() and (a[649 + 1 :] == 300).all() and (values(rows, "b") == x).all()
    noise = np.random.default_rng(0).normal(0, 1e-4, 4000)
    noise[500:520] = 1.0
    late = [i for i, phase, _ in kernels.ml_backend(noise, 100.0, 0.1) if phase == "P" and i > 600]
    true = plain_moments(noise, 50)[0]
    assert all(true[i] > 4.9 for i in late)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_scans_over_blocks(spark, block):
    """Recursions and running sums are the same for any size of block."""
    x = burst(500, 200)
    df = frame(spark, x, x[:90], [2.0])
    sta, lta = 5, 50
    want, short, long = [], 0.0, 0.0
    for i, e in enumerate(x * x):
        if i < lta:
            long += (e - long) / (i + 1)
            short = long
        else:
            short, long = short + (e - short) / sta, long + (e - long) / lta
        want.append(0.0 if i < lta or long <= 1e-10 else short / long)
    got = frames.recursive_sta_lta(df, S, sta, lta, 1e-10, block)
    assert got.count() == 591 and np.allclose(values(got.where("stream_id = 0"), "ratio"), want)
    assert np.allclose(values(frames.integrate(df, S, 4.0, block).where("stream_id = 0"), "y"), x[0] + np.concatenate(([0], np.cumsum(x[1:] / 4))))
    e = x * x
    assert np.allclose(values(frames.z_detector(df, S, block).where("stream_id = 0"), "z"), np.cumsum((e - e.mean()) / e.std()))
    n = len(x)
    aic = [0.0] + [k * np.log(max(x[:k].var(), 1e-20)) + (n - k - 1) * np.log(max(x[k:].var(), 1e-20)) for k in range(1, n - 1)] + [0.0]
    for offset in (0.0, 1e5):
        shifted = df.withColumn("value", F.col("value") + offset)
        assert np.allclose(values(frames.aic_curve(shifted, S, block=block).where("stream_id = 0"), "aic"), aic, atol=1e-4)


def test_aic_finds_the_step(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 0.1, 50), rng.normal(0, 5, 50)))
    rows = frame(spark, x).withColumn("aic", signal.aic(S))
    assert abs(signal.argmin(rows, S, "aic", 5, F.lit(95)).first()["idx"] - 50) <= 5


def test_energy_ratio_peaks_at_the_step(spark):
    x = np.concatenate((np.full(500, 0.1), np.full(500, 5.0))) * np.tile([1, -1], 500)
    got = values(frame(spark, x).select("stream_id", "idx", signal.energy_ratio(S, 50).alias("r")), "r")
    assert abs(got.argmax() - 500) <= 100 and got.max() > 10


def test_recursive_ratio(spark):
    x = np.concatenate((np.ones(200), np.full(50, 10.0)))
    got = values(frames.recursive_sta_lta(frame(spark, x), S, 5, 50, 1e-10), "ratio")
    assert (got[:50] == 0).all() and got[150] == pytest.approx(1, abs=0.2) and got[210] > 2 * got[199]


def test_three_components(spark):
    rng = np.random.default_rng(2)
    t = rng.normal(0, 1, 80)
    line = pd.DataFrame({"stream_id": 0, "idx": np.arange(80), "z": t, "n": 0.5 * t, "e": -t, "value": t})
    noise = pd.DataFrame({"stream_id": 1, "idx": np.arange(80), "z": rng.normal(size=80), "n": rng.normal(size=80), "e": rng.normal(size=80), "value": t})
    got = spark.createDataFrame(pd.concat((line, noise))).select("stream_id", "idx", signal.rectilinearity(S, "z", "n", "e", 20).alias("r")).toPandas()
    assert got[(got.stream_id == 0) & (got.idx >= 20)].r.min() > 0.99
    assert got[(got.stream_id == 1) & (got.idx >= 20)].r.mean() < 0.6


def test_pickers(spark):
    x = burst(1200, 700)
    p = triggers.stalta_picks(frame(spark, x), S, 20.0).collect()
    assert len(p) == 1 and abs(p[0]["pick_idx"] - 700) < 12 and p[0]["phase"] == "P" and p[0]["amplitude"] > 10
    a = triggers.aic_picks(frame(spark, x), S, 20.0).collect()
    assert any(abs(r["pick_idx"] - 700) < 12 for r in a)
    three = frame(spark, x).withColumn("z", F.col("value")).withColumn("n", F.col("value") * 0.3).withColumn("e", F.col("value") * 0.1)
    q = triggers.polarization_picks(three, S, 20.0).collect()
    assert any(abs(r["pick_idx"] - 700) < 40 for r in q)


def test_segments(spark):
    rows = spark.createDataFrame([("a", 0, 10.0, [1.0] * 10), ("a", 1_000_000, 10.0, [2.0] * 5), ("a", 2_500_000, 10.0, [3.0]), ("b", 0, 10.0, [4.0])], "stream_id string, start_us long, sample_rate double, samples array<double>").withColumn("n", F.size("samples"))
    got = triggers.merged_segments(rows).orderBy("stream_id", "segment_id").collect()
    assert [(r["stream_id"], len(r["samples"])) for r in got] == [("a", 15), ("a", 1), ("b", 1)]


def plain_gap(places, gap):
    out = []
    for t in sorted(set(places)):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 18])
def test_minimum_gap(spark, block):
    """Equal to a loop for any block: dense runs, lone places, empty blocks, places a block's length apart, places that occur twice."""
    r = np.random.default_rng(7)
    streams = {"a": [1, 2, 5, 6, 9, 14, 14], "b": list(range(300)), "c": r.integers(0, 2000, 300).tolist(), "d": [10_000_000_000 + 3 * i for i in range(40)], "e": [7], "f": [0, 500, 501, 1700, 1701, 1706]}
    df = spark.createDataFrame([(k, int(t)) for k, v in streams.items() for t in v], "stream_id string, at long").repartition(5)
    for gap in (4, 37):
        got = frames.minimum_gap(df, ("stream_id",), "at", gap, block).collect()
        for k, v in streams.items():
            assert sorted(x["at"] for x in got if x["stream_id"] == k) == plain_gap(v, gap)
    assert frames.minimum_gap(df.limit(0), ("stream_id",), "at", 4).count() == 0


@pytest.mark.parametrize("block", [11, 64, 1 << 18])
def test_looking_ahead_in_blocks(spark, block):
    x = burst(300, 150)
    df = frame(spark, x, x[:40], [2.0])
    loud = frames.loudest_ahead(df, S, 9, block)
    assert loud.count() == 341 and np.allclose(values(loud.where("stream_id = 0"), "loud"), [abs(x[i : i + 9]).max() for i in range(300)])
    assert np.allclose(values(frames.differentiate(df, S, 4.0, block).where("stream_id = 0"), "y"), np.concatenate(([x[1] - x[0]], np.diff(x))) * 4)
    assert values(frames.differentiate(df, S, 4.0, block).where("stream_id = 2"), "y").tolist() == [0.0]
    w = 8
    want = {i: (x[i : i + w] ** 2).sum() / (x[i - w : i] ** 2).sum() for i in range(w, 300 - w, 2)}
    got = {r["idx"]: r["energy_ratio"] for r in frames.aic_candidates(df, S, w, 1.5, block).where("stream_id = 0").collect()}
    assert got == pytest.approx({i: v for i, v in want.items() if v > 2.25})


def test_kernel_pickers(spark):
    from tremorframe.operators import pickers

    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 2400)
    x[1500:1700] += 15 * np.sin(2 * np.pi * 6 * np.arange(200) / 40)
    rows = spark.createDataFrame([("a", 0, 40.0, x.tolist()), ("b", 0, 40.0, [0.0] * 5), ("c", 0, 40.0, None)], "stream_id string, start_us long, sample_rate double, samples array<double>")
    for name, options in (("multiband", {}), ("ar", {"trigger": 4.0}), ("ml", {"min_probability": 0.2})):
        kind, pick = pickers.picker(name)
        got = pick(rows, ["stream_id"], **options).collect()
        assert kind == "arrays" and any(abs(g["idx"] - 1500) < 60 and g["time_us"] == g["idx"] * 25_000 for g in got), name
        assert {g["stream_id"] for g in got} == {"a"}

    class Half:
        name = "half"

        def predict(self, samples, rate):
            return [(len(samples) // 2, "S", 0.9)] if len(samples) else []

    pickers.register_backend("half", Half)
    assert {(g["stream_id"], g["idx"], g["phase"]) for g in pickers.detector(rows, ["stream_id"], "half").collect()} == {("a", 1200, "S"), ("b", 2, "S")}
    with pytest.raises(ValueError):
        pickers.picker("none")
    with pytest.raises(ValueError):
        pickers.backend("none")


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_blocks_do_not_change_triggers(spark, block):
    """Triggers that begin, end, or lie across blocks, in streams of unlike length, are those of one window."""
    long = np.concatenate([burst(300, 100, k) for k in range(4)])
    long[700:900] *= np.linspace(8, 40, 200)
    df = frame(spark, long, burst(60, 30, 9), np.zeros(90), [1.0])
    want = {k: [] for k in range(4)}
    for k, x in enumerate((long, burst(60, 30, 9), np.zeros(90), np.ones(1))):
        on = None
        for i, v in enumerate(plain_ratio(x - x.mean(), 5, 50)):
            if on is None and v >= 2:
                on, peak = i, v
            elif on is not None and v < 1.2:
                want[k].append((on, i, round(peak, 6)))
                on = None
            elif on is not None:
                peak = max(peak, v)
    got = triggers.stalta_triggers(df, S, 5, 50, 2.0, 1.2, block=block).orderBy("on_idx").collect()
    assert {k: [(g["on_idx"], g["off_idx"], round(g["peak"], 6)) for g in got if g["stream_id"] == k] for k in range(4)} == want
    assert sum(map(len, want.values())) >= 5
    ratios = triggers.block_ratios(df, S, 5, 50, block=block)
    assert np.allclose(values(ratios, "ratio"), np.concatenate([plain_ratio(x - x.mean(), 5, 50) for x in (long, burst(60, 30, 9), np.zeros(90), np.ones(1))]), atol=1e-8)


@pytest.mark.parametrize("block", [None, 4, 16])
def test_open_triggers_in_blocks(spark, block):
    df = frame(spark, [0, 0, 5, 5, 1, 1, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 1, 5])
    c = F.col("value")
    got = triggers.hysteresis(df, S, c >= 5, c < 1, c, keep_open=True, block=block).collect()
    assert sorted((g["on_idx"], g["off_idx"], g["peak"]) for g in got) == [(2, None, 5.0)]
    got = triggers.hysteresis(df, S, c >= 5, c < 2, c, keep_open=True, block=block).collect()
    assert sorted((g["on_idx"], g["off_idx"]) for g in got if g["off_idx"]) == [(2, 4), (6, 18)] and len(got) == 3


@pytest.mark.parametrize("block", [9, 50, 10_000])
def test_measures_in_blocks(spark, block):
    x = burst(400, 150, 3)
    df = frame(spark, x, x[:70])
    measures = lambda s: {"k": signal.energy_ratio(s, 10), "e": signal.moving_envelope(s, 20)}
    whole = df.select("stream_id", "idx", *(c.alias(k) for k, c in measures(S).items()))
    got = frames.in_blocks(df, S, 20, measures, block)
    assert got.count() == 470
    for c in "ke":
        assert np.allclose(values(got, c), values(whole, c), atol=1e-8)


def test_samples_near_picks(spark):
    df = frame(spark, np.arange(10_000.0), np.arange(50.0))
    picks = spark.createDataFrame([(0, 0), (0, 4095), (0, 9_999), (1, 20), (1, 400)], "stream_id long, p long")
    got = triggers.near_samples(df, S, picks, F.col("p") - 3, F.col("p") + 4).groupBy("stream_id", "p").agg(F.min("_i").alias("a"), F.max("_i").alias("b"), F.count("*").alias("n")).collect()
    assert {(r["stream_id"], r["p"]): (r["a"], r["b"], r["n"]) for r in got} == {(0, 0): (0, 3, 4), (0, 4095): (4092, 4098, 7), (0, 9_999): (9_996, 9_999, 4), (1, 20): (17, 23, 7)}
