"""Waveforms to a located event, and the streaming operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tremorframe.operators import catalog, regions, velocity
from tremorframe.operators.catalog import Catalog
from tremorframe.operators.locate import haversine
from tremorframe.operators.velocity import Model, travel_times
from tremorframe.plans import pipeline
from tremorframe.sources.playback import play
from tremorframe.sources.reports import demo_picks, summary_report, synthetic_segments
from tremorframe.streaming import state
from tremorframe.streaming.association import PendingAssociation

START = 1_600_000_000_000_000
LAT, LON = 35.2, -117.4


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(11)
    slat, slon = LAT + rng.uniform(-0.8, 0.8, 8), LON + rng.uniform(-0.8, 0.8, 8)
    slat[0], slon[0] = LAT + 0.3, LON + 0.3
    return pd.DataFrame({"net": "XX", "sta": [f"S{i}" for i in range(8)], "lat": slat, "lon": slon, "elev_m": 0.0})


def test_pipeline(spark, network):
    m = Model.named("iasp91")
    d = haversine(LAT, LON, network.lat.to_numpy(), network.lon.to_numpy())
    rows = network[["net", "sta"]].assign(start_us=START, p_s=40 + travel_times(m, d, 8.0), s_s=40 + travel_times(m, d, 8.0, "S"))
    segments = synthetic_segments(spark, spark.createDataFrame(rows), rate=40.0, seconds=100).cache()
    s = pipeline.Settings(trigger=5.0, max_residual=12.0, locator={"radius": 120.0, "h_step": 10.0})
    out = pipeline.run(segments, spark.createDataFrame(network), s)
    picks = out["picks"].toPandas()
    assert set(network.sta) <= set(picks.sta)
    first = picks.sort_values("time_us").groupby("sta").time_us.first()
    assert (abs((first - START) / 1e6 - rows.set_index("sta").p_s) < 0.6).mean() > 0.7
    origins = out["origins"].toPandas()
    assert len(origins) >= 1 and haversine(LAT, LON, origins.lat, origins.lon).min() < 25
    mags = out["magnitudes"].toPandas()
    assert "ML" in set(mags.magtype) and mags.magnitude.notna().all()


@pytest.fixture(scope="module")
def waveforms(spark, network):
    """Segments of one event, with the times of a model of its region."""
    m = Model.named("simple3")
    d = haversine(LAT, LON, network.lat.to_numpy(), network.lon.to_numpy())
    rows = network[["net", "sta"]].assign(start_us=START, p_s=40 + travel_times(m, d, 8.0), s_s=40 + travel_times(m, d, 8.0, "S"))
    return synthetic_segments(spark, spark.createDataFrame(rows), rate=40.0, seconds=100).cache()


def test_event_processor_stores_events(spark, network, waveforms, tmp_path):
    """From waveforms to the catalog: the region's model locates, all rows come in one commit, numbers go on after what is there."""
    store = Catalog(spark, str(tmp_path / "cat"))
    store.create()
    s = pipeline.Settings(trigger=5.0, max_residual=12.0, band=(1.0, 15.0), locator={"radius": 120.0, "h_step": 10.0})
    regional = regions.regions(spark, [("here", "box:34,37,-119,-116", 5, ""), ("nowhere", "box:0,1,0,1", 9, "")])
    models = {"here": Model.named("simple3")}
    stations = spark.createDataFrame(network)
    out = pipeline.run(waveforms, stations, s, regional, models, store)
    found = out["origins"].toPandas()
    assert len(found) >= 1 and set(found.model) == {"here"} and haversine(LAT, LON, found.lat, found.lon).min() < 25
    for again in (1, 2):
        t = {name: store.table(name) for name in ("event", "origin", "origerr", "arrival", "assoc", "netmag", "stamag")}
        n = {name: rows.count() for name, rows in t.items()}
        assert n["event"] == n["origin"] == n["origerr"] == again * len(found) and n["arrival"] == n["assoc"] == again * out["arrivals"].count() and n["netmag"] >= again and n["stamag"] >= 4 * again
        assert all(catalog.duplicate_keys(rows, name).count() == 0 for name, rows in t.items())
        assert all(catalog.dangling(t[a], t[b], a, c).count() == 0 for a, c, b in (("origin", "evid", "event"), ("assoc", "orid", "origin"), ("assoc", "arid", "arrival"), ("netmag", "orid", "origin"), ("stamag", "magid", "netmag")))
        assert {r["vmodel"] for r in t["assoc"].collect()} == {"simple3"}
        latest = catalog.recent_events(t["event"], t["origin"], t["arrival"], t["assoc"], t["netmag"], 1).first()
        assert len(latest["arrivals"]) >= 4 and latest["magtype"] in ("ML", "Mw")
        if again == 1:
            assert pipeline.store_events(out, store, ("again", 1)) and not pipeline.store_events(out, store, ("again", 1))


def test_events_move_to_the_model_of_their_place(spark, network, waveforms):
    """The earliest station lies in one region, the place found in another: the event is located again."""
    m = Model.named("simple3")
    s = pipeline.Settings(trigger=5.0, max_residual=12.0, locator={"radius": 120.0, "h_step": 10.0})
    picks = pipeline.pick(waveforms, s)
    stations = spark.createDataFrame(network)
    members = pipeline.assemble(picks, stations, velocity.table_rows(spark, m), s).cache()
    first = members.orderBy("time_us").first()
    near = f"box:{first['slat'] - 0.01},{first['slat'] + 0.01},{first['slon'] - 0.01},{first['slon'] + 0.01}"
    regional = regions.regions(spark, [("station", near, 9, ""), ("wide", "box:30,40,-125,-110", 1, "")])
    models = {regions.DEFAULT: Model.named("iasp91"), "station": Model.named("ak135"), "wide": m}
    got = pipeline.locate_by_region(members, regional, models, s).where("converged").collect()
    assert got and all(r["model"] == "wide" for r in got)


def test_association_of_a_stream(spark, tmp_path):
    """Picks of an event come in several batches; lone ones wait and then go to the late ones; a batch that comes again changes nothing."""
    model = Model.named("iasp91")
    places = [(f"S{i}", float(35 + 0.3 * np.cos(i)), float(-117 + 0.3 * np.sin(i))) for i in range(6)]
    stations = spark.createDataFrame([("N", *p) for p in places], "net string, sta string, lat double, lon double")
    kind = "pick_id long, net string, sta string, phase string, time_us long"

    def event(at_s: float, first: int):
        d = haversine(places[0][1], places[0][2], np.array([p[1] for p in places]), np.array([p[2] for p in places]))
        return [(first + i, "N", p[0], "P", int(1e6 * (at_s + t))) for i, (p, t) in enumerate(zip(places, travel_times(model, np.floor(d), 10.0), strict=True))]

    a, b, lone = event(1000, 10), event(1300, 30), [(99, "N", "S1", "P", 1_010_000_000)]
    batches = [a[:2] + lone, a[2:], [], b[:5], b[5:]]
    events, late = {}, {}
    pending = PendingAssociation(str(tmp_path / "state"), stations, velocity.table_rows(spark, model), lambda rows, n: events.update({n: rows.collect()}), lambda rows, n: late.update({n: rows.collect()}), max_residual=8.0)
    for n, rows in enumerate(batches):
        for _ in range(2 if n == 1 else 1):
            pending.batch(spark.createDataFrame(rows, kind), n)
    assert [len({r["event_id"] for r in events[n]}) for n in sorted(events)] == [1, 1] and sorted(events) == [1, 3]
    assert {r["pick_id"] for r in events[1]} >= {10, 11, 12, 13} and {r["pick_id"] for n in late for r in late[n]} == {99} and sorted(late) == [3]
    for k, rows in enumerate(batches[:2]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    other = PendingAssociation(str(tmp_path / "other"), stations, velocity.table_rows(spark, model), lambda rows, n: seen.extend(rows.collect()), max_residual=8.0)
    q = other.start(files).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert len({r["event_id"] for r in seen}) == 1 and len(seen) >= 4


def test_a_batch_leaves_no_tables_behind(spark):
    from pathlib import Path

    from tremorframe import scratch

    shared = Path(scratch.shared_folder(spark).removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    with scratch.passing(spark):
        a = scratch.written(spark.range(3), "gone")
        b = scratch.written(spark.range(4), "stays", session=True)
        assert a.count() == 3
    after = set(shared.iterdir()) - before
    assert [p.name.split("-")[0] for p in after] == ["stays"] and b.count() == 4
    scratch.written(spark.range(1), "plain")
    assert len(set(shared.iterdir()) - before) == 2


def test_playback(spark):
    rows = [("A", int((i * 7) % 23) * 1_000_000, 20.0, [float(i)]) for i in range(23)]
    segments = spark.createDataFrame(rows, "stream_id string, start_us long, sample_rate double, samples array<double>")
    got, waits = [], []
    assert play(segments, lambda part, n: got.append((n, [r["start_us"] for r in part.collect()])), speed=1e6, every=10, sleep=waits.append) == 23
    assert [n for n, _ in got] == [0, 10, 20] and [u for _, us in got for u in us] == sorted(r[1] for r in rows)
    assert len(waits) == 3 and play(segments.limit(0), lambda *_: got.append(1)) == 0 and len(got) == 3
    again = []
    assert play(segments, lambda part, n: again.append((n, [r["start_us"] for r in part.collect()])), start=10) == 23 and again == got[1:]


def test_reports(spark, network):
    events = spark.createDataFrame([(1, START, LAT, LON)], "event_id long, time_us long, lat double, lon double")
    got = demo_picks(spark.createDataFrame(network), events, 5)
    assert got.count() == 5 and got.columns[:3] == ["event_id", "net", "sta"]
    origin = spark.createDataFrame([(1, 35.0, -117.0, 5.0, 0.1, 90.0, 8)], "event_id long, lat double, lon double, depth double, rms double, gap double, phase_count int")
    rows = {r["parameter"]: r for r in summary_report(origin, {"lat": LAT, "lon": LON, "depth": 4.0}).collect()}
    assert rows["depth"]["error"] == 1.0 and rows["epicentral_error_km"]["computed"] > 0 and rows["rms_s"]["truth"] is None


def test_stream_triggers_do_not_depend_on_packets():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 3000)
    x[1000:1100] *= 10
    x[2000:2050] *= 15
    t = np.arange(3000) * 10_000
    own = state.Trigger(10, 200, 4.0, 1.5)
    whole = own.feed(([], 0, None, 0.0), t, x)[1]
    assert len(whole) >= 2
    for cuts in ([100, 1010, 1040, 2500], sorted(rng.choice(3000, 40, replace=False).tolist())):
        now, out = ([], 0, None, 0.0), []
        for a, b in zip([0, *cuts], [*cuts, 3000], strict=True):
            now, more = own.feed(now, t[a:b], x[a:b])
            out += more
        assert [(o[0], o[1]) for o in out] == [(w[0], w[1]) for w in whole]
        assert np.allclose([o[2] for o in out], [w[2] for w in whole])


def test_stream_operators(spark, tmp_path):
    rng = np.random.default_rng(5)
    t = pd.date_range("2024-01-01", periods=4000, freq="100ms")
    x = rng.normal(0, 1, 4000)
    x[2500:2560] *= 12
    for k in range(4):
        part = slice(k * 1000, (k + 1) * 1000)
        spark.createDataFrame(pd.DataFrame({"stream_id": "A", "ts": t[part], "value": x[part], "snr": np.abs(x[part])})).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema("stream_id string, ts timestamp, value double, snr double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    plans = {
        "trig": (state.stalta_stream(files, 5, 100, 5.0, 1.5), "append"), "ring": (state.ring_buffer(files, 30.0, latest_s=1.0), "update"), "spaced": (state.spaced_picks(files, 2.0, 3.0), "append"), "rate": (state.rates(files), "append"),
    }
    for name, (plan, mode) in plans.items():
        q = plan.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    got = spark.sql("select * from trig").collect()
    assert any(abs(r["on_us"] - int(t[2500].timestamp() * 1e6)) < 1_500_000 for r in got)
    assert all(r["n"] <= 300 for r in spark.sql("select * from ring").collect()) and spark.sql("select * from ring").count() == 4
    assert [list(r["latest"]) for r in spark.sql("select * from ring order by start_us").collect()] == [x[k * 1000 + 990 : (k + 1) * 1000].tolist() for k in range(4)]
    kept = sorted(r["time_us"] for r in spark.sql("select * from spaced").collect())
    assert kept and all(b - a >= 2_000_000 for a, b in zip(kept, kept[1:], strict=False))
    assert all(r["n"] == 600 for r in spark.sql("select * from rate").collect())
