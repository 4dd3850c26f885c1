"""Waveform windows, magnitudes over all events, cells of the globe, regions."""

from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorframe.functions import cells, kernels
from tremorframe.operators import magnitude, regions
from tremorframe.operators.locate import haversine
from tremorframe.plans import QUERIES
from tremorframe.plans.entity_queries import recordings

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_windows(origins, segments, stations, begin, end, least, most):
    """Every origin with every segment."""
    out = []
    for o in origins.itertuples():
        for s in segments.itertuples():
            st = stations[(stations.net == s.net) & (stations.sta == s.sta)].iloc[0]
            d = float(haversine(o.lat, o.lon, st.lat, st.lon))
            if least <= d <= most:
                a, b = (math.floor((o.time_us + f(d) * 1e6 - s.start_us) / 1e6 * s.sample_rate) for f in (begin, end))
                a, b = max(a, 0), min(b, len(s.samples))
                if b > a:
                    out.append((o.event_id, s.sta, s.start_us, round(d, 4), o.depth, s.sample_rate, np.asarray(s.samples[a:b], float)))
    return out


@pytest.mark.parametrize("bucket_s", [3600.0, 7.0])
def test_windows_equal_all_pairs(spark, bucket_s):
    """Segments of any length, across buckets, over each other, twice there, of unknown stations."""
    rng = np.random.default_rng(6)
    stations = pd.DataFrame({"net": "N", "sta": [f"S{i}" for i in range(5)], "lat": rng.uniform(30, 40, 5), "lon": rng.uniform(-180, -170, 5)})
    stations.loc[4, ["lat", "lon"]] = [35.0, 179.5]
    origins = pd.DataFrame({"event_id": range(12), "time_us": rng.integers(0, 200_000_000, 12), "lat": rng.uniform(30, 40, 12), "lon": rng.uniform(-180, -170, 12), "depth": 7.0})
    rows = [("N", f"S{i % 5}", "BHZ", int(rng.integers(-50_000_000, 400_000_000)), float(rng.choice([1.0, 10.0])), rng.normal(size=int(rng.integers(1, 900))).tolist()) for i in range(40)]
    segments = pd.DataFrame([*rows, ("N", "none", "BHZ", 0, 1.0, [1.0] * 500)], columns=["net", "sta", "chan", "start_us", "sample_rate", "samples"])
    begin, end = (lambda d: d / 3.5 - 2), (lambda d: d / 3.5 + 30)
    df = spark.createDataFrame(segments)
    got = magnitude.windows(spark.createDataFrame(origins), df, spark.createDataFrame(stations), begin, end, 5.0, 600.0, bucket_s).collect()
    want = plain_windows(origins, segments[segments.sta != "none"], stations, begin, end, 5.0, 600.0)
    key = lambda e, s, d, x: (e, s, round(d, 4), len(x), round(float(np.sum(x)), 6))
    assert sorted(key(r["event_id"], r["sta"], r["distance"], r["samples"]) for r in got) == sorted(key(w[0], w[1], w[3], w[6]) for w in want) and len(want) > 20


def moved(x):
    return x.assign(lat=x.lat / 20, lon=x.lon / 20)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["local_magnitudes", "moment_magnitudes", "surface_magnitudes"])
def test_magnitudes_of_all_events(spark, name):
    """The query's rows over whole tables against every origin with every waveform, and formulas spelt out."""
    o = pd.read_parquet(f"{SF}/orders.parquet")
    us = pd.to_datetime(o.o_orderdate).astype("datetime64[us]").astype("int64")
    origins = pd.DataFrame({"event_id": o.o_orderkey, "time_us": us, "lat": o.o_custkey * 7919 % 18000 / 100 - 90, "lon": o.o_custkey * 104729 % 36000 / 100 - 180, "depth": (o.o_orderkey % 700).astype(float)})
    s = pd.read_parquet(f"{SF}/supplier.parquet")
    stations = pd.DataFrame({"net": s.s_nationkey.astype(str), "sta": s.s_suppkey.astype(str), "lat": s.s_suppkey * 7919 % 18000 / 100 - 90, "lon": s.s_suppkey * 104729 % 36000 / 100 - 180})
    rate, offset = {"local_magnitudes": (10.0, 0), "moment_magnitudes": (20.0, 0), "surface_magnitudes": (0.5, 1800)}[name]
    segments = recordings(spark, SF, rate, offset).toPandas()
    if name != "surface_magnitudes":
        origins, stations = moved(origins), moved(stations)
    # Only origins of the days that have a waveform can meet one; the rest is compared with all.
    day = lambda t: t // 86_400_000_000
    want = []
    for d, part in segments.groupby(day(segments.start_us)):
        near = origins[abs(day(origins.time_us) - d) <= 1]
        spans = {"local_magnitudes": (-0.5, 10.0, 5.0, 600.0, 10), "moment_magnitudes": (0.0, 5.0, 10.0, 500.0, kernels.SPECTRUM_MIN), "surface_magnitudes": (-30.0, 60.0, 2200.0, 17_800.0, 10)}[name]
        for e, sta, _, km, z, hz, x in plain_windows(near, part, stations, lambda d: d / 3.5 + spans[0], lambda d: d / 3.5 + spans[1], spans[2], spans[3]):
            if len(x) < spans[4]:
                continue
            hypo = math.hypot(km, z)
            if name == "local_magnitudes":
                m = magnitude_of("ml", float(np.abs(kernels.wood_anderson(x, hz)).max()), hypo)
            elif name == "moment_magnitudes":
                omega, _, _ = kernels.spectral_fit(x, hz, hypo * 1000)
                m = magnitude_of("mw", omega, hypo) if omega > 0 else None
                m = m if m is not None and 0 < m < 10 else None
            else:
                m = magnitude_of("ms", float(np.abs(kernels.bandpass(x, hz, 1 / 25, 1 / 15, 3)).max()), km / 111.195)
            if m is not None:
                want.append((e, sta, round(m, 2)))
    got = [(r["event_id"], r["sta"], round(r["magnitude"], 2)) for r in QUERIES[name](spark, SF).collect()]
    assert len(got) == len(want) > 0
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 0.03


def magnitude_of(kind: str, amplitude: float, far: float) -> float:
    """Local, moment and surface magnitudes of nanometres (metre-seconds) and kilometres (degrees), written out."""
    if kind == "ml":
        return math.log10(amplitude / 1e6) + math.log10(far / 100) + 0.00301 * (far - 100) + 3
    if kind == "mw":
        return 2 / 3 * math.log10(4 * math.pi * 2700 * 3500**3 * far * 1000 * amplitude / 1.2 * 1e7) - 10.7
    return math.log10(amplitude / 20_000) + 1.66 * math.log10(far) + 3.3


def test_cells_hold_their_circles_and_boxes(spark):
    rng = np.random.default_rng(9)
    centres = [(float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), float(10 ** rng.uniform(0, 4.3))) for _ in range(150)] + [(90.0, 0.0, 50.0), (-90.0, 0.0, 900.0), (0.0, 180.0, 30.0), (0.0, -180.0, 30.0), (10.0, 359.0, 400.0)]
    for size in cells.SIZES:
        rows = []
        for k, (lat, lon, km) in enumerate(centres):
            for _ in range(6):
                # A point at a distance just inside, in any direction.
                d, a, p, q = km * float(rng.uniform(0.5, 0.9999)) / 6371.0, float(rng.uniform(0, 2 * math.pi)), math.radians(lat), math.radians(lon)
                y = math.asin(max(-1.0, min(1.0, math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(a))))
                x = q + math.atan2(math.sin(a) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(y))
                rows.append((k, lat, lon, km, math.degrees(y), math.degrees(x)))
        df = spark.createDataFrame(rows, "k long, lat double, lon double, km double, y double, x double")
        lost = df.where(~F.array_contains(cells.of_circle("lat", "lon", "km", size), cells.of("y", "x", size)))
        assert lost.count() == 0
    assert cells.size_for(100.0) == 1 and cells.size_for(20_000.0) == 60


def test_regions_of_any_number(spark):
    """Boxes, circles and polygons in cells against a test of every pair; no bound on their number."""
    rng = np.random.default_rng(4)
    made = []
    for i in range(60):
        lat, lon, a, b = rng.uniform(-80, 70), rng.uniform(-170, 160), rng.uniform(0.1, 30), rng.uniform(0.1, 60)
        kind = i % 3
        made.append((f"r{i}", f"box:{lat},{lat + a},{lon},{lon + b}" if kind == 0 else f"circle:{lat},{lon},{a * 100}" if kind == 1 else f"polygon:{lat},{lon};{lat},{lon + b};{lat + a},{lon + b / 2}", int(rng.integers(3)), ""))
    made += [("world", "everywhere", 0, ""), ("upside down", "box:10,-10,20,-20", 0, "")]
    points = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), float(rng.uniform(-5, 700))) for i in range(400)] + [(900, None, 1.0, 1.0), (901, 89.0, 190.0, 1.0), (902, 0.0, 0.0, 5000.0)]
    r, p = regions.regions(spark, made), spark.createDataFrame(points, "id long, lat double, lon double, depth double")
    got = {(x["id"], x["region"]) for x in regions.all_matches(p, r).collect()}
    pairs = p.crossJoin(r.select(F.struct(*r.columns).alias("_r"))).where(regions.in_bounds("lat", "lon", "depth", "_r"))
    assert got == {(x["id"], x["_r"]["name"]) for x in pairs.collect()} and len(got) > 400
