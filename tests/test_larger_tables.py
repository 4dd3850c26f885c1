"""What shows only in larger tables: keys that come twice, places on an edge, numbers over 2^31."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import difference
from pyspark.sql import functions as F

from tremorframe.functions import arrays as A
from tremorframe.functions import cells, geo, kernels
from tremorframe.operators import associate, catalog, frames, locate, magnitude, recorded
from tremorframe.operators.signal import Stream
from tremorframe.operators.velocity import Model
from tremorframe.plans import ORACLES, QUERIES


def table(folder, name: str, frame: pd.DataFrame) -> None:
    pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), f"{folder}/{name}.parquet", coerce_timestamps="us")


def same_as_sql(spark, folder, name: str) -> int:
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLES[name]).df()
    assert not difference(QUERIES[name](spark, str(folder)).toPandas(), want)
    return len(want)


def test_merged_waveforms_of_a_thousand_segments(spark, tmp_path):
    """Times of a stream's segment over 670 no longer fit an integer."""
    n = 1000
    table(tmp_path, "embeddings", pd.DataFrame({"vec_id": np.arange(n), "embedding": [np.full(64, k % 7, "float32") for k in range(n)], "label": np.zeros(n, "int32")}))
    assert same_as_sql(spark, tmp_path, "merged_waveforms") == n // 10


def test_point_in_polygon_of_all_places(spark, tmp_path):
    """A customer for each place that keys can give, those on the edges among them."""
    n = 36_000
    table(tmp_path, "orders", pd.DataFrame({"o_orderkey": np.arange(n), "o_custkey": np.arange(n), "o_orderdate": pd.Timestamp("1995-01-01")}))
    assert same_as_sql(spark, tmp_path, "point_in_polygon") > 1000


def test_edges_of_a_polygon_are_outside(spark):
    corners = "array(named_struct('lat', 0D, 'lon', 0D), named_struct('lat', 0D, 'lon', 10D), named_struct('lat', 10D, 'lon', 10D), named_struct('lat', 4D, 'lon', 5D), named_struct('lat', 10D, 'lon', 0D))"
    inside = [(1.0, 1.0), (3.9, 5.0), (9.0, 0.5), (9.0, 9.5), (4.0, 4.0)]
    outside = [(0.0, 5.0), (5.0, 0.0), (5.0, 10.0), (10.0, 10.0), (4.0, 5.0), (0.0, 0.0), (6.0, 5.0), (7.0, 2.5), (11.0, 0.0), (-1.0, 5.0), (5.0, -1.0), (5.0, 11.0)]
    df = spark.createDataFrame(inside + outside, "lat double, lon double").selectExpr("*", f"{corners} AS v")
    got = {(r["lat"], r["lon"]) for r in df.where(geo.strictly_in_polygon("lat", "lon", "v")).collect()}
    assert got == set(inside)


def test_arrivals_that_come_twice(spark):
    """Two arrivals with one key are two rows, not four."""
    arrival = spark.createDataFrame([(11, "A", 1.0), (11, "B", 2.0), (21, "C", 3.0)], "arid long, sta string, time double")
    assoc = spark.createDataFrame([(11, 1), (11, 1), (21, 2)], "arid long, orid long")
    assert [tuple(r) for r in catalog.query_arrivals(arrival, assoc, 1).collect()] == [(11, "A", 1.0), (11, "B", 2.0)]


def test_stations_without_waveforms_cost_nothing(spark):
    """Thousands of events among thousands of stations, of which one recorded one of them: no row for each pair."""
    origins = spark.range(20_000).selectExpr("id AS event_id", "id * 100000000000 AS time_us", "35D AS lat", "-117D AS lon", "10D AS depth")
    stations = spark.range(20_000).selectExpr("'N' AS net", "concat('S', id) AS sta", "36 + id * 1e-5 AS lat", "-117D AS lon")
    segments = spark.createDataFrame([("N", "S7", "BHZ", 300_000_000_000, 10.0, [1.0] * 1200)], "net string, sta string, chan string, start_us long, sample_rate double, samples array<double>")
    got = magnitude.windows(origins, segments, stations, lambda d: d / 3.5, lambda d: d / 3.5 + 5.0, 5.0, 600.0)
    assert [(r["event_id"], r["sta"], len(r["samples"])) for r in got.collect()] == [(3, "S7", 50)]


def test_fits_of_rows_are_those_of_each(spark):
    rng = np.random.default_rng(3)
    for n in (63, 64, 100, 300):
        x, far = rng.normal(size=(5, n)) * 10.0 ** np.arange(5)[:, None], rng.uniform(1e4, 5e5, 5)
        want = [kernels.spectral_fit(row, 20.0, m) for row, m in zip(x, far, strict=True)]
        np.testing.assert_allclose(np.stack(kernels.spectral_fits(x, 20.0, far), 1), np.array(want), rtol=1e-9)


def test_many_small_streams_share_batches(spark):
    """Twelve thousand streams of two or three places: right places, and no frame for each stream."""
    df = spark.range(30_000).selectExpr("concat('s', id % 12000) AS stream_id", "id * 3 AS at", "id div 12000 AS idx", "1D + id div 12000 AS value")
    kept, ratio = frames.minimum_gap(df, ("stream_id",), "at", 40_000, 1 << 15), frames.recursive_sta_lta(df, Stream(), 1, 2, 1e-10)
    for rows in (kept, ratio):
        assert "InPandas" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["stream_id"], r["at"]) for r in kept.collect())
    # Places of a stream are 36,000 apart, so of three the first and the last stay.
    assert got == sorted((f"s{k % 12000}", k * 3) for k in range(30_000) if k // 12_000 != 1)
    assert ratio.count() == 30_000 and ratio.where("idx = 2").agg({"ratio": "max"}).first()[0] > 1


def test_a_rows_mean_is_computed_once(spark):
    """A prepared row is right, and its mean and loudest sample are not computed for every sample again."""
    def seconds(n):
        df = spark.range(40).selectExpr(f"transform(sequence(1, {n}), i -> cast((i * 7919 + id) % 101 AS double)) AS x").cache()
        df.count()
        begun = time.perf_counter()
        rows = df.select("x", A.prepared("x").alias("y")).collect()
        return time.perf_counter() - begun, rows

    seconds(30)
    took, rows = seconds(600)
    for r in rows[:3]:
        x = np.array(r["x"]) - np.mean(r["x"])
        np.testing.assert_allclose(r["y"], x / np.abs(x).max(), atol=1e-12)
    # 40 rows of 600 samples: 24,000 steps, and not the cube of 600 for each row.
    assert took < 20


def test_events_share_batches(spark):
    """Each event of a batch has the origin that its picks have alone, and no frame of its own."""
    rows = [(k, "N", f"S{i}", 35 + i / 10, -117 + (i * 7 % 4) / 10, 1_000_000 * (3 * i + k % 5), "P", i % 3) for k in range(30) for i in range(5)]
    picks = spark.createDataFrame(rows, "event_id long, net string, sta string, slat double, slon double, time_us long, phase string, quality int")
    got = locate.locate(picks, Model.named("iasp91"), "grid", radius=100.0, h_step=50.0, z_step=25.0, levels=1)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    times, o = locate.Times(Model.named("iasp91")), locate.Options(radius=100.0, h_step=50.0, z_step=25.0, levels=1)
    frame = pd.DataFrame(rows, columns=picks.columns)
    found = {r["event_id"]: r for r in got.collect()}
    assert len(found) == 30
    for k, part in frame.groupby("event_id"):
        want = locate.grid_search(locate.Picks(part), times, o)
        assert all(found[k][c] == want[c] for c in ("lat", "lon", "depth", "time_us", "rms"))


def test_members_travel_once(spark):
    """A pick that is a member many times is one row before the join."""
    picks, members = spark.range(10).selectExpr("id AS pick_id"), spark.range(1000).selectExpr("id % 7 AS pick_id")
    got = associate.unassociated(picks, members)
    assert "HashAggregate" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["pick_id"] for r in got.collect()) == [7, 8, 9]


def test_widest_angles_are_sorted_once(spark):
    """Gaps are those of plain loops, nulls among the azimuths too; what is sorted for the steps is not gathered again."""
    rng = np.random.default_rng(5)
    rows = [(int(k), None if rng.random() < 0.1 else float(rng.integers(0, 360))) for k in rng.integers(0, 60, 400)] + [(99, 7.0), (98, None), (98, None), (None, 10.0), (None, 200.0)]
    got = associate.true_gap(spark.createDataFrame(rows, "orid long, azimuth double"), ("orid",))
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k in {k for k, _ in rows}:
        a = sorted(x for i, x in rows if i == k and x is not None)
        want[k] = max([0.0, *np.diff(a), *([360.0 - (a[-1] - a[0])] if a else [])])
    made = got.collect()
    assert {r["orid"]: r["gap"] for r in made} == want and len(made) == len(want)


def test_a_tasks_rows_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Lines and orders that compress to almost nothing are dealt out by their number all the same."""
    monkeypatch.setattr(frames, "TASK_ROWS", 500)
    n = 20_000
    table(tmp_path, "supplier", pd.DataFrame({"s_suppkey": np.arange(50), "s_nationkey": 1, "s_acctbal": 0.0}))
    table(tmp_path, "orders", pd.DataFrame({"o_orderkey": np.arange(n // 4), "o_custkey": np.arange(n // 4) % 90, "o_orderdate": pd.Timestamp("1995-01-01")}))
    k = np.arange(n)
    table(tmp_path, "lineitem", pd.DataFrame({"l_orderkey": k // 4, "l_linenumber": k % 4, "l_suppkey": k * 7 % 50, "l_returnflag": "A", "l_discount": 0.1, "l_tax": 0.0, "l_quantity": 1.0, "l_extendedprice": 1.0, "l_linestatus": "O", "l_shipdate": pd.Timestamp("1995-01-01")}))
    assert QUERIES["true_gap"](spark, str(tmp_path)).rdd.getNumPartitions() >= n // 500
    assert same_as_sql(spark, tmp_path, "true_gap") == n // 4


def recorded_tables(spark, n: int = 300):
    """Origins, waveforms in several buckets of time and stations, nulls and an unknown station among them."""
    rng = np.random.default_rng(8)
    stations = pd.DataFrame({"net": "N", "sta": [f"S{i}" for i in range(4)], "lat": rng.uniform(30, 33, 4), "lon": rng.uniform(-3, 3, 4)})
    origins = pd.DataFrame({"event_id": [f"e{i}" for i in range(n)], "time_us": rng.integers(0, 2000, n) * 100_037, "lat": rng.uniform(29, 34, n), "lon": rng.uniform(-3, 3, n), "depth": [None if i % 50 == 3 else float(i % 90) for i in range(n)]})
    origins.loc[5, "lat"] = None
    rows = [("N", f"S{i % 5}", "BHZ", int(rng.integers(-50_000_000, 250_000_000)), float(rng.choice([10.0, 20.0])), rng.normal(size=int(rng.integers(5, 2500))).tolist()) for i in range(30)]
    segments = spark.createDataFrame(rows, "net string, sta string, chan string, start_us long, sample_rate double, samples array<double>")
    return spark.createDataFrame(origins.astype(object).where(origins.notna(), None), "event_id string, time_us long, lat double, lon double, depth double"), segments, spark.createDataFrame(stations)


@pytest.mark.parametrize("bucket_s", [3600.0, 20.0])
@pytest.mark.parametrize("by_pair", [False, True])
def test_windows_are_measured_where_they_lie(spark, bucket_s, by_pair):
    """What is measured is what the slices of all pairs give, and no row for a pair keeps its samples beside a kernel."""
    origins, segments, stations = recorded_tables(spark)
    begin, end = (lambda d: d / 3.5 - 2), (lambda d: d / 3.5 + 9)
    kernel = lambda x, rate, far: [x.sum(1) * rate + (far if by_pair else 0), np.full(len(x), float(x.shape[1]))]
    got = recorded.measured(origins, segments, stations, recorded.Span(begin, end, 5.0, 300.0, bucket_s), 12, ["total", "n"], kernel, by_pair)
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda r, total, n: (r["event_id"], r["net"], r["sta"], r["chan"], round(r["distance"], 6), r["depth"], r["sample_rate"], n, None if total is None or total != total else round(total, 5))
    want = [key(r, sum(r["samples"]) * r["sample_rate"] + ((r["hypo"] if r["hypo"] is not None else float("nan")) if by_pair else 0), len(r["samples"])) for r in magnitude.windows(origins, segments, stations, begin, end, 5.0, 300.0, bucket_s).collect() if len(r["samples"]) >= 12]
    rows = got.collect()
    assert sorted((key(r, r["total"], int(r["n"])) for r in rows), key=repr) == sorted(want, key=repr) and len(want) > 300
    assert all((r["hypo"] is None) == (r["depth"] is None) for r in rows)


@pytest.mark.parametrize("name", ["local_magnitudes", "moment_magnitudes", "surface_magnitudes"])
def test_magnitudes_keep_no_samples_beside_kernels(spark, name):
    """A kernel's other columns wait for it on disk, so samples are none of them: pairs times waveforms of samples fill any disk."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("by_pair", [False, True])
def test_a_window_is_measured_once_and_few_are_held(monkeypatch, by_pair):
    """Pairs of one window share its measure; what is held before it is measured stays below the bounds, and nothing is lost at them."""
    monkeypatch.setattr(recorded, "PAIRS", 50)
    span = recorded.Span(lambda d: 0 * d, lambda d: 0 * d + 10.0, 0.0, 500.0)
    origins = recorded.Origins(pa.table({"_at": np.repeat([0, 1_000_000, 2_000_000], 60), "lat": np.full(180, 1.0), "lon": np.zeros(180), "event_id": np.arange(180), "depth": np.arange(180.0)}), span)
    segments = pa.record_batch({"_at": [0, 0], "lat": [0.0, 1.5], "lon": [0.0, 0.0], "net": ["N", "N"], "sta": ["A", "B"], "chan": ["Z", "Z"], "sample_rate": [1.0, 1.0], "samples": [np.arange(8.0), np.arange(20.0)]})
    seen = []

    def kernel(x, rate, far):
        seen.append(len(x))
        return [x.sum(1) + (far if by_pair else 0)]

    windows = recorded.Windows(span, 1, ["total"], kernel, by_pair)
    made = [*windows.met(origins, segments, 0), *windows.left()]
    assert len(made) > 4 and max(b.num_rows for b in made) <= 100 and sum(seen) <= (360 if by_pair else 20)
    table = pa.Table.from_batches(made).to_pandas().sort_values(["sta", "event_id"])
    far = np.hypot(table.distance, table.depth) if by_pair else 0
    begin, n = table.event_id // 60, np.where(table.sta == "A", 8, 20)
    want = [sum(range(b, min(b + 10, m))) for b, m in zip(begin, n, strict=True)]
    np.testing.assert_allclose(table.total - far, want)
    assert table.event_id.tolist() == [*range(180), *range(180)]


def test_cells_of_circles_as_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.uniform(-90, 90)), float(rng.uniform(-180, 360)), float(10 ** rng.uniform(0, 4.3))) for _ in range(200)] + [(90.0, 0.0, 50.0), (-90.0, 10.0, 900.0), (0.0, 180.0, 30.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, km double").withColumn("id", F.monotonically_increasing_id())
    for size in (1, 15, 60):
        want = {(r["id"], c) for r in df.select("id", cells.of_circle("lat", "lon", "km", size).alias("c")).collect() for c in r["c"] or []}
        got = [(r["id"], r["cell"]) for r in cells.with_circle(df, "cell", "lat", "lon", F.col("km"), size).select("id", "cell").collect()]
        assert len(got) == len(set(got)) and set(got) == want
