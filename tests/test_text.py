from __future__ import annotations

import pytest

from tremorframe.operators import regions
from tremorframe.sources import text


def write(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return str(tmp_path / name)


def test_stations(spark, tmp_path):
    p = write(tmp_path, "stations.txt", "# inventory\nIU INCN 37.4777 126.6244 55.0 BHZ 20 0 -90 BHN 20 0 0\n\nbad line\nKS  SEO2\t37.5 127 85 BHZ,BHN\nXX A 1 2\nIU INCN 38 127 60\n")
    got = {r["sta"]: r for r in text.read_stations(spark, p).collect()}
    assert set(got) == {"INCN", "SEO2", "A"}
    assert got["INCN"]["lat"] == 38 and got["INCN"]["depth_km"] == -0.06
    assert [c["code"] for c in got["SEO2"]["channels"]] == ["BHZ", "BHN"] and got["A"]["elev_m"] == 0
    p = write(tmp_path, "one.txt", "IU INCN 37.5 126.6 55 BHZ 20 0 -90 BHN 40 90 0\n")
    (row,) = text.read_stations(spark, p).collect()
    assert [(c["code"], c["rate"], c["dip"]) for c in row["channels"]] == [("BHZ", 20.0, -90.0), ("BHN", 40.0, 0.0)]
    (line,) = text.station_lines(text.read_stations(spark, p)).collect()
    again = write(tmp_path, "two.txt", line["value"] + "\n")
    assert text.read_stations(spark, again).collect() == [row]


@pytest.mark.parametrize(
    "name,body,want",
    [
        ("a.vel", "# c\n0 10 5.8 3.4 2.6\n10 0 8 4.5\n", [(0, 10, 5.8, 3.4, 2.6), (10, 0, 8, 4.5, 2.7)]),
        ("a.hyp", "1.75\n5.8 0\n6.5 20\n8.0 35\n", [(0, 20, 5.8, 5.8 / 1.75, 2.7), (20, 15, 6.5, 6.5 / 1.75, 2.7), (35, 0, 8, 8 / 1.75, 2.7)]),
        ("a.mod", "title\nP-VELOCITY MODEL\n5.8 0\n6.5 20\nS-VELOCITY MODEL\n3.3 0\n", [(0, 20, 5.8, 3.3, 2.7), (20, 0, 6.5, 6.5 / 1.73, 2.7)]),
        ("a.nll", "LAYER 0 5.8 0 3.4 0 2.6 0\nLAYER 20 8 0 4.5 0 3.3 0\n", [(0, 20, 5.8, 3.4, 2.6), (20, 0, 8, 4.5, 3.3)]),
    ],
)
def test_velocity_formats(spark, tmp_path, name, body, want):
    m = text.load_model(spark, write(tmp_path, name, body))
    assert m.name == "a" and [pytest.approx(r) for r in want] == list(m.layers)


def test_settings(spark, tmp_path):
    s = text.settings(spark, write(tmp_path, "a.conf", "top = 1\n[picker]\nsta = 0.5\nuse = Yes\n# sta = 9\nbands = 1, 2 ,,3\nsta=0.7\nurl = a=b\n[x]\nn = q\n"))
    assert s.real("picker.sta") == 0.7 and s.flag("picker.use") and s.words("picker.bands") == ["1", "2", "3"]
    assert s["picker.url"] == "a=b" and s.integer("x.n", 4) == 4 and s.integer("top") == 1 and not s.flag("none")


def test_regions(spark, tmp_path):
    body = "[default]\nmodel_file = d.vel\nbounds_type = default\n[a]\nmodel_file = a.vel\nbounds_type = box\nbounds = 0,10,0,10\npriority = 1\n[b]\nmodel_file = b.vel\nbounds = circle:5,5,100\npriority = 7\n[c]\nmodel_file = c.vel\nbounds_type = polygon\nbounds = 20,20;20,30;30,25\n"
    rows = text.parse_regions(text.lines(spark, write(tmp_path, "r.conf", body)))
    got = {r["name"]: r for r in rows.collect()}
    assert got["b"]["radius_km"] == 100 and got["c"]["max_lat"] == 30 and got["c"]["priority"] == 0
    points = spark.createDataFrame([(1, 5.0, 5.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 22.0, 25.0, 0.0), (4, 29.0, 20.5, 0.0), (5, -50.0, 0.0, 0.0)], "id long, lat double, lon double, depth double")
    only = rows.where("name <> 'default'")
    assert {r["id"]: r["region"] for r in regions.first_match(points, only, "id").collect()} == {1: "b", 2: "a", 3: "c", 4: "default", 5: "default"}
    assert sorted(r["region"] for r in regions.all_matches(points.where("id = 1"), only).collect()) == ["a", "b"]
    again = rows.select("name", regions.bounds_text().alias("bounds"), "priority", "description")
    back = {r["name"]: r for r in again.withColumn("b", regions.parsed_bounds(again.bounds)).select("name", "b.*").collect()}
    assert back["b"]["radius_km"] == 100 and len(back["c"]["vertices"]) == 3


def test_picks(spark, tmp_path):
    p = write(tmp_path, "p.csv", "station,phase,travel_time_s,snr,quality,distance_km,method\nIC.BJT,P,143.4195,4.5,1,1096.4,recursive\nKS.SEO2,P,64.5,7.4,1,464,stalta\n")
    got = text.read_picks(spark, p, 1_000_000).orderBy("sta").collect()
    assert [(r["net"], r["sta"], r["time_us"], r["quality"]) for r in got] == [("IC", "BJT", 144_419_500, 1), ("KS", "SEO2", 65_500_000, 0)]


def test_writers_and_folders(spark, tmp_path):
    conf = write(tmp_path, "a.conf", "top = 1\n[b]\ny = 2\nx = 3\n[a]\nz = 4\n")
    rows = text.parse_settings(text.lines(spark, conf))
    again = write(tmp_path, "b.conf", "\n".join(r["value"] for r in text.setting_lines(rows).collect()))
    assert text.settings(spark, again) == text.settings(spark, conf)
    folder = tmp_path / "models"
    folder.mkdir()
    (folder / "x.vel").write_text("0 0 5 3\n")
    (folder / "x.bounds").write_text("circle:10,20,50\n")
    (folder / "y.mod").write_text("P-VELOCITY\n5 0\n")
    got = {r["name"]: r for r in text.read_regions(spark, str(folder)).collect()}
    assert got["x"]["radius_km"] == 50 and got["x"]["model_file"] == "x.vel" and got["y"]["min_lat"] == -90
    lines_of = text.region_lines(text.read_regions(spark, str(folder)).where("name = 'x'")).collect()
    (folder / "velocity_models.conf").write_text("\n".join(r["value"] for r in lines_of) + "\n")
    listed = text.read_regions(spark, str(folder)).collect()
    assert [(r["name"], r["bounds_type"], r["radius_km"]) for r in listed] == [("x", "circle", 50.0)]
