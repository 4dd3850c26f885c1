from __future__ import annotations

import pytest
from fixtures import event_picks

from tremorframe.operators import catalog as C
from tremorframe.operators import locate
from tremorframe.operators.velocity import Model
from tremorframe.schemas import CATALOG, KEYS, schema


@pytest.fixture
def stored(spark, tmp_path):
    c = C.Catalog(spark, str(tmp_path / "cat"))
    c.create()
    event = spark.createDataFrame([(i, f"ev{i}", i) for i in range(1, 6)], "evid long, evname string, prefor long")
    origin = spark.createDataFrame([(i, i, 35 + 0.1 * i, -117.0, 10.0, 1e9 + 3600.0 * i) for i in range(1, 6)], "orid long, evid long, lat double, lon double, depth double, time double")
    netmag = spark.createDataFrame([(i, i, i, "ML", 3.0 + 0.5 * i) for i in range(1, 6)], "magid long, orid long, evid long, magtype string, magnitude double")
    c.store({"event": event, "origin": origin, "netmag": netmag})
    return c


def test_tables():
    assert {len(schema(t)) for t in ("event", "origin", "arrival")} == {6, 25, 26}
    assert set(KEYS) == set(CATALOG)


def test_store_and_query(stored):
    e, o, m = stored.table("event"), stored.table("origin"), stored.table("netmag")
    assert stored.version() == "3.0" and stored.next_id("origin") == 6 and stored.next_id("arrival") == 1
    assert C.query_events(e, o).count() == 5
    assert C.query_events(e, o, 1e9, 1e9 + 7300, (35.0, 36.0), (-118.0, -116.0)).count() == 2
    assert {r["evid"] for r in C.query_events(e, o, magnitude=(4.4, 5.1), netmag=m).collect()} == {3, 4}
    assert C.preferred_origin(e, o, 3).first()["orid"] == 3
    assert [r["origins"] for r in C.counts(e, o, stored.table("arrival"), stored.table("site")).collect()] == [5]
    stored.views()
    assert stored.spark.sql("select count(*) from origin").first()[0] == 5
    stored.drop()
    assert stored.table("event").count() == 0


def test_upsert_checks_and_flat_files(stored, tmp_path):
    spark = stored.spark
    rows = lambda v: spark.createDataFrame([("A", -1, v, 0.0), ("B", -1, 2.0, 0.0)], "sta string, ondate long, lat double, lon double")
    stored.upsert("site", rows(1.0))
    stored.upsert("site", rows(5.0))
    assert sorted((r["sta"], r["lat"]) for r in stored.table("site").collect()) == [("A", 5.0), ("B", 2.0)]
    o = stored.table("origin")
    assert C.duplicate_keys(o.union(o.limit(1)), "origin").count() == 1
    assert C.dangling(o, stored.table("event").where("evid <> 2"), "origin", "evid").count() == 1
    C.export(stored, str(tmp_path / "flat"), 1e9, 1e9 + 7300)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "flat" / "origin")).orderBy("value").collect()]
    assert lines[0] == "  35.1000  -117.0000   10.0000  1000003600.00000        1        1" and len(lines) == 2
    assert spark.read.text(str(tmp_path / "flat" / "netmag")).count() == 2
    filled = C.with_sentinels(C.conformed(o, "origin"), "origin").first()
    assert filled["ml"] == -999.0 and filled["etype"] == "-" and filled["jdate"] == -1


def test_complete_event(spark, tmp_path):
    picks = spark.createDataFrame(event_picks())
    origins = locate.locate(picks, Model.named("korea"), "grid", radius=200.0, h_step=40.0, levels=1).selectExpr("*", "event_id as orid", "false as fixed")
    a = locate.arrivals(picks, origins, Model.named("korea")).selectExpr("*", "1L as orid").withColumn("arid", C.F.crc32("sta"))
    p = picks.selectExpr("net", "sta", "time_us", "phase", "quality").withColumn("pick_id", C.F.crc32("sta")).selectExpr("*", "'BHZ' as chan", "cast(null as double) as uncertainty", "1.0D as amplitude", "cast(null as double) as period", "5.0D as snr")
    mags = spark.createDataFrame([(1, 1, "ML", 3, 6.1, 0.1)], "magid long, event_id long, magtype string, nsta long, magnitude double, uncertainty double")
    each = spark.createDataFrame([(1, "ML", s, 100.0, 6.0) for s in ("BJT", "MDJ")], "event_id long, magtype string, sta string, distance double, magnitude double")
    c = C.Catalog(spark, str(tmp_path / "c"))
    c.create()
    c.store(C.complete_event(origins, a, p, mags, each, "korea"))
    assert [c.table(t).count() for t in ("event", "origin", "origerr", "arrival", "assoc", "netmag", "stamag")] == [1, 1, 1, 14, 14, 1, 2]
    assert C.dangling(c.table("assoc"), c.table("arrival"), "assoc", "arid").count() == 0
    assert c.table("event").first()["prefor"] == 1
    nested = C.recent_events(*(c.table(t) for t in ("event", "origin", "arrival", "assoc", "netmag"))).first()
    assert len(nested["arrivals"]) == 14 and nested["magtype"] == "ML"


def test_numbering_is_by_order(spark):
    rows = spark.range(1000).selectExpr("1000 - id as k").repartition(7)
    got = C.numbered(rows, "n", ["k"], 5).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(5, 1005))


def test_all_or_nothing(stored, monkeypatch):
    """A failure, a rollback or a second writer between two tables leaves no half event."""
    spark = stored.spark
    event = spark.createDataFrame([(9, "x", 9)], "evid long, evname string, prefor long")
    bad = spark.range(1).selectExpr("raise_error('broken') as orid")
    with pytest.raises(Exception, match="broken"):
        stored.store({"event": event, "origin": bad})
    assert stored.table("event").count() == 5
    t = stored.transaction()
    t.append("event", event)
    assert t.table("event").count() == 6 and stored.table("event").count() == 5
    t.rollback()
    with pytest.raises(RuntimeError):
        t.append("event", event)
    with pytest.raises(ValueError), stored.transaction() as t:
        t.append("event", event)
        raise ValueError("stop")
    assert stored.table("event").count() == 5
    publish = C.Catalog.publish
    monkeypatch.setattr(C.Catalog, "publish", lambda *_: (_ for _ in ()).throw(OSError("the store is away")))
    with pytest.raises(OSError):
        stored.store({"event": event})
    monkeypatch.setattr(C.Catalog, "publish", publish)
    assert stored.table("event").count() == 5
    stored.store({"event": event})
    assert stored.table("event").count() == 6


def test_two_writers(stored):
    spark = stored.spark
    row = lambda i: spark.createDataFrame([(i, f"ev{i}", i)], "evid long, evname string, prefor long")
    a, b = stored.transaction(), stored.transaction()
    a.append("event", row(11))
    b.append("event", row(12))
    a.commit()
    b.commit()
    assert {r["evid"] for r in stored.table("event").collect()} == {1, 2, 3, 4, 5, 11, 12}
    a, b = stored.transaction(), stored.transaction()
    a.upsert("event", row(1))
    b.append("event", row(13))
    b.commit()
    with pytest.raises(C.Conflict):
        a.commit()
    assert stored.table("event").count() == 8
    stored.compact("event")
    assert stored.table("event").count() == 8 and len(stored.latest()[1]["tables"]["event"]) == 1


def test_a_batch_is_stored_once(stored):
    row = stored.spark.createDataFrame([(21, "a", 1)], "evid long, evname string, prefor long")
    assert [stored.store({"event": row}, ("s", n)) for n in (0, 0, 1, 1, 0)] == [True, False, True, False, False]
    assert stored.store({"event": row}, ("other", 0)) and stored.table("event").count() == 8


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 as k", "id")
    got = C.numbered(rows, "n", ["k"], 10).collect()
    assert all(r["n"] == r["k"] + 10 for r in got) and len(got) == 5000
    assert C.numbered(rows.limit(0), "n", ["k"]).count() == 0
