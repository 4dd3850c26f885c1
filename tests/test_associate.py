"""Shared picks between candidates."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from compare import connection, difference
from pyspark.sql import functions as F

from tremorframe.operators import associate, expected, velocity
from tremorframe.operators.locate import haversine
from tremorframe.plans import ORACLES, QUERIES

DAY = 86_400_000_000


def plain(members, ranked):
    taken, out = set(), []
    for i, _, _, _ in sorted(ranked, key=lambda r: (-r[1], -r[2], r[3], r[0])):
        own = {p for s, p in members if s == i}
        if not own & taken:
            taken |= own
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("rows", [associate.TASK_MEMBERS, 0])
def test_greedy_does_not_depend_on_days(spark, monkeypatch, rows):
    """Two seeds of one event straddle midnight and share their later picks: one stays; so it is for chains of any length."""
    monkeypatch.setattr(associate, "TASK_MEMBERS", rows)
    r = random.Random(8)
    ranked = [(1, 3, 4, DAY - 2_000_000), (2, 3, 3, DAY + 1_000_000)]
    members = [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (2, 4)]
    for i in range(10, 50):
        ranked.append((i, r.randint(3, 5), 5, 2 * DAY + (i - 30) * 60_000_000))
        members += [(i, p) for p in {i * 3 + k for k in range(r.randint(3, 8))}]
    got = associate.greedy(spark.createDataFrame(members, "seed_id long, pick_id long"), spark.createDataFrame(ranked, "seed_id long, station_count long, phase_count long, time_us long")).collect()
    assert sorted(x["seed_id"] for x in got) == plain(members, ranked) and 2 not in {x["seed_id"] for x in got}


def test_all_origins_get_stations(spark, tmp_path):
    """Ids on both sides of 200, places that occur again; each origin's twelve against a plain sort."""
    orders = pd.DataFrame({"o_orderkey": range(150, 260), "o_custkey": [i * 37 % 90 for i in range(110)], "o_orderdate": pd.Timestamp("2024-01-01")})
    suppliers = pd.DataFrame({"s_suppkey": range(1, 31), "s_nationkey": 1, "s_acctbal": 0.0})
    spark.createDataFrame(orders).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(suppliers).write.parquet(str(tmp_path / "supplier.parquet"))
    place = lambda i: (i * 7919 % 18000 / 100 - 90, i * 104729 % 36000 / 100 - 180)
    got = sorted(map(tuple, QUERIES["nearest_k_stations"](spark, str(tmp_path)).collect()))
    want = []
    for o, c in zip(orders.o_orderkey, orders.o_custkey, strict=True):
        near = sorted((round(float(haversine(*place(c), *place(i))), 6), i) for i in suppliers.s_suppkey)
        want += [(o, str(i), k) for k, (_, i) in enumerate(near[:12], 1)]
    assert got == sorted(want)


def test_nearest_in_rings(spark, monkeypatch):
    """A dense cluster, far stations, the poles and the date line: the same as a plain sort, and few distances are computed."""
    rng = np.random.default_rng(2)
    stations = [(i, f"S{i}", float(35 + rng.normal(0, 0.5)), float(-117 + rng.normal(0, 0.5))) for i in range(300)]
    stations += [(300 + i, f"S{i}", float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(100)] + [(500, "P", 89.9, 10.0), (501, "D", 0.0, 179.9), (502, "D", 0.0, -179.9)]
    places = [(0, 35.0, -117.0), (1, 90.0, 0.0), (2, -90.0, 50.0), (3, 0.0, 180.0), (4, 0.0, -180.0), (5, -45.0, 30.0), (6, 60.0, -179.0)] + [(10 + i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(40)]
    got = associate.nearest_stations(spark.createDataFrame(places, "orid long, lat double, lon double"), spark.createDataFrame(stations, "station_id long, sta string, lat double, lon double"), 5).collect()
    want = {(o, i, k) for o, a, b in places for k, (_, i) in enumerate(sorted((round(float(haversine(a, b, c, d)), 6), i) for i, _, c, d in stations)[:5], 1)}
    assert {(r["orid"], r["station_id"], r["k"]) for r in got} == want and len(got) == len(want)


def test_no_stations_and_no_places(spark):
    origins = spark.createDataFrame([(1, 10.0, 20.0), (2, None, 3.0)], "orid long, lat double, lon double")
    stations = spark.createDataFrame([(5, "A", 11.0, 20.0), (6, "B", None, 1.0)], "station_id long, sta string, lat double, lon double")
    got = associate.nearest_stations(origins, stations, 3).collect()
    assert [(r["orid"], r["sta"], r["k"]) for r in got] == [(1, "A", 1)]
    assert associate.nearest_stations(origins, stations.limit(0), 3).count() == 0 and associate.nearest_stations(origins.limit(0), stations, 3).count() == 0


def distant(spark, km: float):
    """A P at its source's station and a late S far away, with the table of the model."""
    model = velocity.Model.named("iasp91")
    far = km / 6371.0 * 180 / math.pi
    stations = spark.createDataFrame([("N", "A", 0.0, 0.0), ("N", "B", 0.0, far)], "net string, sta string, lat double, lon double")
    t = 6.25e6
    tt = velocity.table(model)["S"][int(haversine(0.0, 0.0, 0.0, far)), 10]
    rows = [(1, "N", "A", "P", int(t)), (2, "N", "B", "S", int(tt * 1e6) + 1_000)]
    return spark.createDataFrame(rows, "pick_id long, net string, sta string, phase string, time_us long"), stations, velocity.table_rows(spark, model), tt


@pytest.mark.parametrize("km", [500.0, 2700.0, 2900.0, 2999.0])
def test_late_s_picks_are_found(spark, km):
    picks, stations, times, tt = distant(spark, km)
    got = associate.residuals(picks, stations, times).collect()
    assert [(r["seed_id"], r["pick_id"]) for r in got] == [(1, 2)] and abs(got[0]["residual"]) < 0.01
    assert km < 2700 or tt > 600


def test_residuals_are_those_of_all_pairs(spark):
    """Whatever the buckets' width, the pairs are those of a plain double loop."""
    rng = np.random.default_rng(4)
    places = {f"S{i}": (float(rng.uniform(-20, 20)), float(rng.uniform(-20, 20))) for i in range(6)}
    stations = spark.createDataFrame([("N", k, *v) for k, v in places.items()], "net string, sta string, lat double, lon double")
    rows = [(i, "N", f"S{rng.integers(6)}", str(rng.choice(["P", "Pg", "S", "Pn"])), int(rng.integers(0, 3_000_000_000))) for i in range(150)]
    rows += [(900 + i, *rows[0][1:3], "P", rows[0][4]) for i in range(3)]
    picks = spark.createDataFrame(rows, "pick_id long, net string, sta string, phase string, time_us long")
    want = set()
    for i, _, s, p, t in rows:
        for j, _, u, q, v in rows:
            if p in ("P", "Pg") and (v > t or v == t and j > i):
                d = int(haversine(*places[s], *places[u]))
                tt = math.hypot(min(d, 3000), 10) / (8.0 if q in ("P", "Pn", "Pg") else 4.6)
                if abs((v - t + 6_250_000) // 1000 / 1000 - tt) <= 40:
                    want.add((i, j))
    times = velocity.straight_rows(spark, 8.0, 4.6)
    for bucket in (0.0, 5000.0):
        assert {(r["seed_id"], r["pick_id"]) for r in associate.residuals(picks, stations, times, 40.0, bucket).collect()} == want


@pytest.mark.parametrize("points", [associate.GRID_POINTS, 3])
def test_votes_on_a_grid_in_parts(spark, monkeypatch, points):
    monkeypatch.setattr(associate, "GRID_POINTS", points)
    grid = spark.createDataFrame([(i, float(i), 2.0 * i, 10.0) for i in range(10)], "cell long, lat double, lon double, depth double")
    stations = spark.createDataFrame([("N", f"S{i}", 3.0 + i / 3, 6.0 - i / 2) for i in range(5)], "net string, sta string, lat double, lon double")
    at = 1_000_000_000
    model = velocity.straight_rows(spark, 8.0, 4.6)
    rows = [(i, "N", f"S{i}", "P", at + int(1e6 * math.hypot(int(haversine(3.0, 6.0, 3.0 + i / 3, 6.0 - i / 2)), 10) / 8.0) + 1000) for i in range(5)]
    picks = spark.createDataFrame(rows, "pick_id long, net string, sta string, phase string, time_us long")
    got = {(r["cell"], r["votes"]) for r in associate.nucleator_votes(picks, stations, grid, model, max_residual=2.0, min_votes=5).collect()}
    assert got == {(3, 5)}
    assert associate.nucleator_votes(picks, stations, grid, compat=True).count() == 10


def crowd(spark, n: int, seconds: float, seed: int = 4, twice: bool = False):
    """Picks of six stations, some at one time, and where some of them come twice; two stations at one place, one code in two nets."""
    rng = np.random.default_rng(seed)
    places = [("N", f"S{i}", float(rng.uniform(-20, 20)), float(rng.uniform(-20, 20))) for i in range(4)]
    places += [("N", "S4", *places[0][2:]), ("M", "S1", 5.0, 5.0)]
    rows = [(i, *places[rng.integers(6)][:2], str(rng.choice(["P", "Pg", "S", "Pn"])), int(rng.integers(0, int(seconds)) * 1_000_000)) for i in range(n)]
    if twice:
        rows += [rows[0], rows[0], (rows[1][0], *rows[1][1:4], rows[1][4] + 500_000_000)]
    return rows, {k[:2]: k[2:] for k in places}, spark.createDataFrame(rows, "pick_id long, net string, sta string, phase string, time_us long"), spark.createDataFrame(places, "net string, sta string, lat double, lon double")


def tables(monkeypatch) -> list[int]:
    """Rows of each table that association writes from now on."""
    sizes, write = [], associate.written

    def counted(df, *a, **k):
        out = write(df, *a, **k)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(associate, "written", counted)
    return sizes


def plain_fits(rows, places, most):
    for i, n, s, p, t in rows:
        if p not in ("P", "Pg"):
            continue
        for j, m, u, q, v in rows:
            if v > t or v == t and j > i:
                tt = math.hypot(min(int(haversine(*places[n, s], *places[m, u])), 3000), 10) / (8.0 if q in ("P", "Pn", "Pg") else 4.6)
                residual = (v - t + 6_250_000) // 1000 / 1000 - tt
                if abs(residual) <= most:
                    yield (i, t, *places[n, s]), s, j, u, residual


@pytest.mark.parametrize("twice", [False, True])
def test_counts_and_choice_without_pairs(spark, monkeypatch, twice):
    """Residuals, candidates and the seeds that stay are those of plain loops, whatever the blocks, and no table has a row for each pair."""
    rows, places, picks, stations = crowd(spark, 300, 20_000, twice=twice)
    monkeypatch.setattr(associate, "BLOCK_REACHES", 1)
    monkeypatch.setattr(associate, "RESOLVED_REACHES", 2)
    times, sizes = velocity.straight_rows(spark, 8.0, 4.6), tables(monkeypatch)
    found = list(plain_fits(rows, places, 120.0))
    got = associate.residuals(picks, stations, times, 120.0)
    assert "Join" in (plan := got._jdf.queryExecution().executedPlan().toString()) and plan.count("Join") <= 2 and not sizes
    assert sorted((r["seed_id"], r["pick_id"], r["residual"]) for r in got.collect()) == sorted((x[0][0], x[2], x[4]) for x in found)
    counted: dict = {}
    for i, n, s, p, t in rows:
        if p in ("P", "Pg"):
            counted.setdefault((i, t, *places[n, s]), []).append((s, i))
    for x, _, j, u, _ in found:
        counted[x].append((u, j))
    want = {k: (len({s for s, _ in v}), len(v)) for k, v in counted.items() if len(v) >= 3 and len({s for s, _ in v}) >= 2}
    made = associate.candidates(picks, stations, times, 120.0, 2, 3).collect()
    assert {(r["seed_id"], r["time_us"] + 6_250_000, r["lat"], r["lon"]): (r["station_count"], r["phase_count"]) for r in made} == want and len(made) == len(want) > 50
    ranked = [(k[0], *v, k[1]) for k, v in want.items()]
    stay = sorted(r["seed_id"] for r in associate.chosen(picks, stations, times, 120.0, 2, 3).collect())
    if not twice:
        assert stay == plain([(k[0], j) for k, v in counted.items() if k in want for _, j in v], ranked)
        assert max(sizes) <= len(rows)
    else:
        fits = associate.residuals(picks, stations, times, 120.0)
        old = associate.candidates(picks, stations, times, 120.0, 2, 3, fits=fits)
        assert stay == sorted(r["seed_id"] for r in associate.greedy(associate.members(picks, stations, times, old, fits), old).collect())


def test_picks_that_fit_without_pairs(spark, monkeypatch):
    """Picks that fit, and members of some seeds only, are those of all pairs."""
    rows, places, picks, stations = crowd(spark, 300, 60_000, twice=True)
    times, want = velocity.straight_rows(spark, 8.0, 4.6), list(plain_fits(rows, places, 10.0))
    got = {r["pick_id"] for r in associate.fitting(picks, stations, times, 10.0).collect()}
    assert got == {x[0][0] for x in want} | {x[2] for x in want} and 0 < len(got) < 300
    some = {x[0][0] for x in want if x[0][0] % 3 == 0}
    chosen = spark.createDataFrame([(i,) for i in some], "seed_id long")
    made = associate.members(picks, stations, times, chosen, max_residual=10.0).collect()
    assert {tuple(r) for r in made} == {(x[0][0], x[2]) for x in want if x[0][0] in some} | {(i, i) for i in some}


def test_events_of_many_picks_are_not_pairs(spark, tmp_path, monkeypatch):
    """Ten thousand picks in an hour: millions of pairs; the query writes no table that is longer than the picks."""
    n = 10_000
    kinds = ["click", "purchase", "view", "signup", "error"]
    events = pd.DataFrame({"event_id": range(n), "ts": pd.to_datetime([i * 7919 % 3_600_000 for i in range(n)], unit="ms"), "user_id": [i * 31 % 97 for i in range(n)], "event_type": [kinds[i * 13 % 5] for i in range(n)], "value": 1.0})
    spark.createDataFrame(events).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame(pd.DataFrame({"s_suppkey": range(10), "s_nationkey": 1, "s_acctbal": 0.0})).write.parquet(str(tmp_path / "supplier.parquet"))
    sizes = tables(monkeypatch)
    assert QUERIES["associated_events"](spark, str(tmp_path)).count() > 0
    assert max(sizes) <= n


def test_candidates_are_counted_without_pairs(spark, tmp_path, monkeypatch):
    """The query neither makes pairs nor deals a pick out more than twice."""
    rows, places, picks, stations = crowd(spark, 400, 3_000)
    monkeypatch.setattr(associate, "residuals", None)
    got = associate.candidates(picks, stations, velocity.straight_rows(spark, 8.0, 4.6), 120.0, 2, 3).collect()
    size: dict = {}
    for x, *_ in plain_fits(rows, places, 120.0):
        size[x[0]] = size.get(x[0], 1) + 1
    assert {r["seed_id"]: r["phase_count"] for r in got}.items() <= size.items() and len(got) > 100


def test_votes_of_picks_that_come_twice(spark, monkeypatch):
    """Votes are those of plain loops, an id's votes for one second count once, and times are looked up for places, not for picks."""
    rows, places, picks, stations = crowd(spark, 300, 3_000, twice=True)
    picks = picks.unionByName(picks.where("pick_id < 40").selectExpr("pick_id", "net", "sta", "phase", "time_us + 1 AS time_us")).unionByName(picks.limit(3).selectExpr("CAST(NULL AS long) AS pick_id", "net", "sta", "phase", "time_us"))
    grid = spark.createDataFrame([(i, 3.0 * i, 2.0 * i, 10.0) for i in range(10)], "cell long, lat double, lon double, depth double")
    sizes, want = tables(monkeypatch), {}
    for r in picks.where("pick_id IS NOT NULL").collect():
        for c in range(10):
            tt = math.hypot(min(int(haversine(3.0 * c, 2.0 * c, *places[r["net"], r["sta"]])), 3000), 10) / (8.0 if r["phase"] in ("P", "Pn", "Pg") else 4.6)
            want.setdefault((c, math.floor((r["time_us"] - tt * 1e6) / 100e6)), set()).add(r["pick_id"])
    got = associate.nucleator_votes(picks, stations, grid, velocity.straight_rows(spark, 8.0, 4.6), max_residual=100.0).collect()
    assert sorted((r["cell"], r["bucket"], r["votes"]) for r in got) == sorted((*k, len(v)) for k, v in want.items() if len(v) >= 4)
    # Ten points, five places (two stations share one), two classes.
    assert sizes == [100]


def test_blocks_of_few_picks_share_a_table(spark):
    """Two thousand blocks of two rows each are a few tables, whatever the batches that they come in, and each row is in its own block."""
    n = 2_000
    rows = spark.range(n).selectExpr("id AS pick_id", "id * 1000 AS time_us", "concat('S', id % 3) AS sta")

    def size(*given):
        table = given[-1]
        yield pa.RecordBatch.from_pydict({"n": [len(table)], "blocks": [len(set(table["_block"].to_pylist()))]})

    for most in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            got = expected.in_blocks(rows, 1000, 0, 10, size, "n long, blocks long").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sum(r["n"] for r in got) == 2 * n and sum(r["blocks"] for r in got) == n + 1 and len(got) < 20


@pytest.mark.parametrize("pairs", [1, 40, 1 << 18])
def test_tables_of_blocks_are_whole_blocks(monkeypatch, pairs):
    """However batches cut them, blocks come whole and in order, and only as long as rows times stations are few."""
    monkeypatch.setattr(expected, "PAIRS", pairs)
    rng = np.random.default_rng(8)
    own = np.repeat(np.arange(60), rng.integers(1, 30, 60))
    whole = pa.RecordBatch.from_pydict({"_block": own, "sta": [f"S{k % 2}" for k in range(len(own))], "pick_id": np.arange(len(own))})
    cuts = [0, *sorted(rng.choice(len(own), 40).tolist()), len(own)]
    got = [pa.Table.from_batches(held) for held in expected._together(whole.slice(i, j - i) for i, j in itertools.pairwise(cuts))]
    assert [i for t in got for i in t["pick_id"].to_pylist()] == list(range(len(own)))
    blocks = [set(t["_block"].to_pylist()) for t in got]
    assert sum(map(len, blocks)) == 60 and len(got) == {1: 60, 1 << 18: 1}.get(pairs, len(got))
    assert all(len(b) == 1 or len(t) <= max(pairs, 2 * 30) for b, t in zip(blocks, got, strict=True))


def test_candidates_of_sparse_picks_with_names(spark):
    """Blocks that share a table do not see each other's picks, and ids may be texts."""
    rows, places, picks, stations = crowd(spark, 300, 100_000, twice=True)
    times, size = velocity.straight_rows(spark, 8.0, 4.6), {}
    for i, n, s, p, t in rows:
        if p in ("P", "Pg"):
            size.setdefault((f"{i:06d}", t, *places[n, s]), []).append(s)
    for x, _, _, u, _ in plain_fits(rows, places, 120.0):
        size[f"{x[0]:06d}", *x[1:]].append(u)
    got = associate.candidates(picks.withColumn("pick_id", F.lpad(F.col("pick_id").cast("string"), 6, "0")), stations, times, 120.0, 1, 1).collect()
    assert {(r["seed_id"], r["time_us"] + 6_250_000, r["lat"], r["lon"]): (r["station_count"], r["phase_count"]) for r in got} == {k: (len(set(v)), len(v)) for k, v in size.items()}
    assert len(got) == len(size) and max(map(len, size.values())) > 2


def test_picks_are_dealt_out_by_time_alone(spark, tmp_path):
    """However many suppliers there are, picks are not dealt out by their ten stations, of which each would be one task."""
    n = 300
    events = pd.DataFrame({"event_id": range(n), "ts": pd.to_datetime([i * 7919 % 3_600_000 for i in range(n)], unit="ms"), "user_id": [i * 31 % 97 for i in range(n)], "event_type": ["click", "purchase", "view"] * (n // 3), "value": 1.0})
    spark.createDataFrame(events).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame(pd.DataFrame({"s_suppkey": range(5_000), "s_nationkey": 1, "s_acctbal": 0.0})).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = QUERIES["association_candidates"](spark, str(tmp_path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
        con = connection(str(tmp_path))
        assert not difference(got.toPandas(), con.execute(ORACLES["association_candidates"]).df()) and got.count() > 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
