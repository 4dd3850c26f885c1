"""Queries over stations, picks, origins and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, geo, scales, timeutil
from ..operators import associate, catalog, frames, regions, trial, velocity
from ..operators.magnitude import network, upper_median
from .registry import query
from .tables import ASSOC, EVENTS, NETMAGS, ORIGINS, PICKS, STATIONS, assoc, azimuth_sql, events, haversine_sql, netmags, origins, pick_stations, picks, read, stations

CLAT, CLON = 35.0, -117.0
DIST = haversine_sql("lat", "lon", "35.0::DOUBLE", "(-117.0)::DOUBLE")
TO_STATION = haversine_sql("35.0::DOUBLE", "(-117.0)::DOUBLE", "slat", "slon")


def r(c, n: int = 6):
    return F.round(c, n)


@query(f"SELECT sta, round({haversine_sql('35.0::DOUBLE', '(-117.0)::DOUBLE', 'lat', 'lon')}, 6) AS km, round({azimuth_sql('35.0::DOUBLE', '(-117.0)::DOUBLE', 'lat', 'lon')}, 6) AS azimuth, round({haversine_sql('35.0::DOUBLE', '(-117.0)::DOUBLE', 'lat', 'lon')} / 111.195, 6) AS degrees FROM stations", (STATIONS,))
def haversine_azimuth(spark, sf):
    km = geo.haversine_km(CLAT, CLON, "lat", "lon")
    return stations(spark, sf).select("sta", r(km).alias("km"), r(geo.azimuth_deg(CLAT, CLON, "lat", "lon")).alias("azimuth"), r(geo.km_to_deg(km)).alias("degrees"))


@query(f"SELECT net, sta FROM stations WHERE {haversine_sql('35.0::DOUBLE', '(-117.0)::DOUBLE', 'lat', 'lon')} <= 4000", (STATIONS,))
def stations_within(spark, sf):
    return stations(spark, sf).where(geo.within_km("lat", "lon", CLAT, CLON, 4000.0)).select("net", "sta")


@query(f"SELECT orid, sta, CAST(k AS BIGINT) AS k FROM (SELECT o.orid, s.sta, row_number() OVER (PARTITION BY o.orid ORDER BY round({haversine_sql('o.lat', 'o.lon', 's.lat', 's.lon')}, 6), s.station_id) AS k FROM origin o, stations s) t WHERE k <= 12", (ORIGINS, STATIONS))
def nearest_k_stations(spark, sf):
    """The twelve nearest stations of every origin."""
    return associate.nearest_stations(origins(spark, sf).select("orid", "lat", "lon"), stations(spark, sf), 12).select("orid", "sta", F.col("k").cast("long").alias("k"))


@query("SELECT orid, round(lat + 10.0 / 111.0, 6) AS lat, round(lon + 20.0 / (111.0 * cos(radians(lat))), 6) AS lon FROM origin", (ORIGINS,))
def offset_points(spark, sf):
    return origins(spark, sf).select("orid", r(geo.offset_lat("lat", 10.0)).alias("lat"), r(geo.offset_lon("lat", "lon", 20.0)).alias("lon"))


_REGION = """region AS (SELECT * FROM (VALUES ('socal', 'box', 32.0, 36.0, -121.0, -114.0, 10), ('nocal', 'box', 36.0, 42.0, -125.0, -119.0, 10), ('cascadia', 'box', 42.0, 49.0, -125.0, -120.0, 10), ('alaska', 'box', 55.0, 72.0, -170.0, -130.0, 5), ('hawaii', 'circle', 19.5, -155.5, 200.0, 0.0, 20), ('japan', 'box', 30.0, 46.0, 128.0, 146.0, 10), ('mediterranean', 'box', 30.0, 48.0, -10.0, 40.0, 5), ('korea', 'box', 33.0, 43.0, 124.0, 132.0, 15)) v(name, kind, a, b, c, d, priority)),
hit AS (SELECT o.orid, r.name, r.priority FROM origin o JOIN region r ON CASE WHEN kind = 'circle' THEN """ + haversine_sql("CAST(a AS DOUBLE)", "CAST(b AS DOUBLE)", "lat", "lon") + """ <= c ELSE lat BETWEEN a AND b AND lon BETWEEN c AND d END)"""


@query("SELECT orid, name AS region, CAST(priority AS INTEGER) AS priority FROM hit", (ORIGINS, _REGION))
def region_all_matches(spark, sf):
    return regions.all_matches(origins(spark, sf).select("orid", "lat", "lon", "depth"), regions.regions(spark)).select("orid", "region", "priority")


@query("SELECT o.orid, coalesce(arg_min(h.name, (1000 - h.priority) * 100 + CASE h.name WHEN 'korea' THEN 1 ELSE 0 END), 'default') AS region FROM origin o LEFT JOIN hit h ON h.orid = o.orid GROUP BY o.orid", (ORIGINS, _REGION))
def region_first_match(spark, sf):
    return regions.first_match(origins(spark, sf).select("orid", "lat", "lon", "depth"), regions.regions(spark), "orid").select("orid", "region")


@query("SELECT orid FROM origin WHERE (lat - 0) + abs(lon) * 0.5 < 40 AND lat > -20 AND lat <= 40", (ORIGINS,))
def point_in_polygon(spark, sf):
    """A triangle whose sides meet at 40 N, over 20 S."""
    corners = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((-20.0, -120.0), (-20.0, 120.0), (40.0, 0.0))))
    return origins(spark, sf).where(geo.strictly_in_polygon("lat", "lon", corners)).select("orid")


_LAYERS = "layer AS (SELECT * FROM (VALUES (0.0, 20.0, 5.80, 3.36), (20.0, 15.0, 6.50, 3.75), (35.0, 77.5, 8.04, 4.47), (112.5, 52.5, 8.05, 4.50), (165.0, 45.0, 8.17, 4.51), (210.0, 1e9, 8.30, 4.52)) v(top, thick, vp, vs))"


@query("SELECT o.orid, CAST(l.vp AS DOUBLE) AS vp, CAST(l.vs AS DOUBLE) AS vs, round(CAST(vp AS DOUBLE) / CAST(vs AS DOUBLE), 6) AS ratio, round((pow(CAST(vp AS DOUBLE) / CAST(vs AS DOUBLE), 2) - 2) / (2 * (pow(CAST(vp AS DOUBLE) / CAST(vs AS DOUBLE), 2) - 1)), 6) AS poisson FROM origin o JOIN layer l ON o.depth >= l.top AND o.depth < l.top + l.thick", (ORIGINS, _LAYERS))
def velocity_at_depth(spark, sf):
    layers = F.array(*(F.struct(F.lit(a).alias("top_depth"), F.lit(b).alias("thickness"), F.lit(c).alias("vp"), F.lit(d).alias("vs")) for a, b, c, d, _ in velocity.MODELS["iasp91"]))
    rows = origins(spark, sf).select("orid", velocity.velocity_at(layers, "depth", "vp").alias("vp"), velocity.velocity_at(layers, "depth", "vs").alias("vs"))
    return rows.select("orid", "vp", "vs", r(velocity.vp_vs("vp", "vs")).alias("ratio"), r(velocity.poisson("vp", "vs")).alias("poisson"))


@query()
def travel_time_lookup(spark, sf):
    """P and S times of picks from one place, over a table of one model; its times need loops, so SQL has no twin."""
    times = velocity.table_rows(spark, velocity.Model.named("iasp91"))
    placed = associate.with_stations(picks(spark, sf), pick_stations(spark, sf)).withColumn("distance", geo.haversine_km(CLAT, CLON, "slat", "slon")).withColumn("depth", F.lit(10.0))
    return velocity.lookup(placed, times, "distance", "depth", "phase").select("pick_id", "phase", r("distance").alias("distance"), r("tt").alias("tt"))


@query("SELECT pick_id, net, sta, phase FROM (SELECT *, row_number() OVER (PARTITION BY net, sta ORDER BY time_us, pick_id) AS n FROM picks) t WHERE n = 1".replace(", phase FROM (", ", 'P' AS phase FROM ("), (PICKS,))
def first_arrival(spark, sf):
    return associate.first_arrivals(picks(spark, sf)).select("pick_id", "net", "sta", "phase")


@query("SELECT pick_id, net, sta, 'S' AS phase FROM (SELECT *, row_number() OVER (PARTITION BY net, sta ORDER BY time_us, pick_id) AS n FROM picks) t WHERE n = 2", (PICKS,))
def second_arrival(spark, sf):
    return associate.first_arrivals(picks(spark, sf), rank=2).select("pick_id", "net", "sta", "phase")


@query("SELECT net, sta, arg_min(pick_id, off * 1e9 + pick_id) AS pick_id, round(min(off), 6) AS misfit FROM (SELECT *, abs(snr - 40.0) AS off FROM picks WHERE snr >= 2 AND abs(snr - 40.0) < 25) t GROUP BY net, sta", (PICKS,))
def predicted_pick(spark, sf):
    """snr stands for the observed time; 40 is expected."""
    return associate.predicted_picks(picks(spark, sf), F.lit(40.0), F.col("snr")).select("net", "sta", "pick_id", r("misfit").alias("misfit"))


@query("SELECT orid, round(sqrt(sum(wgt * timeres * timeres) / sum(wgt)), 6) AS rms, round(sqrt(avg(timeres * timeres)), 6) AS plain_rms, count(DISTINCT sta) AS stations, count(*) AS phases FROM assoc GROUP BY orid", (ASSOC,))
def weighted_rms(spark, sf):
    rows = _arrivals(assoc(spark, sf)).withColumn("azimuth", F.lit(0.0))
    return associate.event_summary(rows, ("orid",)).select("orid", r("rms").alias("rms"), r("plain_rms").alias("plain_rms"), F.col("station_count").alias("stations"), F.col("phase_count").alias("phases"))


def _arrivals(rows):
    """Associations with the quality class their weight stands for."""
    quality = F.when(F.col("wgt") == 1.0, 0).when(F.col("wgt") == 0.5625, 1).otherwise(2)
    return rows.withColumn("quality", quality).withColumn("residual", F.col("timeres"))


_GEOMETRY = "geo AS (SELECT a.orid, a.sta, a.timeres, " + azimuth_sql("o.lat", "o.lon", "s.lat", "s.lon") + " AS azimuth FROM assoc a JOIN origin o ON o.orid = a.orid JOIN stations s ON s.station_id = a.l_suppkey)"


def _geometry(spark, sf):
    o = origins(spark, sf).select("orid", F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    s = stations(spark, sf).select("sta", "lat", "lon")
    lines = _arrivals(assoc(spark, sf)).select("orid", "sta", "timeres", "residual", "quality").join(s, "sta")
    n = frames.tasks_for(lines)
    rows = frames.spread(lines, "orid", number=n).join(frames.spread(o, "orid", number=n), "orid")
    return rows.select("orid", "sta", "timeres", "residual", "quality", geo.azimuth_deg("olat", "olon", "lat", "lon").alias("azimuth"))


@query("SELECT orid, round(360.0 - (max(azimuth) - min(azimuth)), 6) AS gap FROM geo GROUP BY orid", (ASSOC, ORIGINS, STATIONS, _GEOMETRY))
def azimuthal_gap(spark, sf):
    return associate.event_summary(_geometry(spark, sf), ("orid",)).select("orid", r("gap").alias("gap"))


@query("SELECT orid, round(greatest(max(step), 360.0 - (max(azimuth) - min(azimuth))), 6) AS gap FROM (SELECT *, coalesce(azimuth - lag(azimuth) OVER (PARTITION BY orid ORDER BY azimuth), 0.0) AS step FROM geo) t GROUP BY orid", (ASSOC, ORIGINS, STATIONS, _GEOMETRY))
def true_gap(spark, sf):
    return associate.true_gap(_geometry(spark, sf), ("orid",)).select("orid", r("gap").alias("gap"))


_QUALITY = "SELECT orid, CASE WHEN gap < 90 AND n >= 8 AND rms < 0.5 THEN 'A' WHEN gap < 135 AND n >= 6 AND rms < 1.0 THEN 'B' WHEN gap < 180 AND n >= 4 AND rms < 2.0 THEN 'C' WHEN gap < 270 AND n >= 3 THEN 'D' ELSE 'E' END AS quality FROM (SELECT orid, 360.0 - (max(azimuth) - min(azimuth)) AS gap, count(*) AS n, sqrt(avg(timeres * timeres)) AS rms FROM geo GROUP BY orid) t"


@query(_QUALITY, (ASSOC, ORIGINS, STATIONS, _GEOMETRY))
def quality_code(spark, sf):
    rows = associate.event_summary(_geometry(spark, sf), ("orid",))
    return rows.select("orid", codes.origin_quality("gap", "phase_count", "plain_rms").alias("quality"))


@query("SELECT net, sta, round(avg(slat), 6) AS lat, round(avg(slon), 6) AS lon, count(*) AS n FROM picks WHERE phase IN ('P', 'Pg', 'Pn') GROUP BY net, sta", (PICKS,))
def centroid(spark, sf):
    p = associate.with_stations(picks(spark, sf), pick_stations(spark, sf))
    return trial.centroid(p, ("net", "sta")).select("net", "sta", r("lat").alias("lat"), r("lon").alias("lon"), "n")


@query("SELECT user_id, round(sum(slat / k) / sum(1.0 / k), 6) AS lat, round(sum(slon / k) / sum(1.0 / k), 6) AS lon FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time_us, pick_id) AS k FROM picks) t GROUP BY user_id", (PICKS,))
def order_weighted_centroid(spark, sf):
    p = associate.with_stations(picks(spark, sf), pick_stations(spark, sf))
    return trial.order_weighted_centroid(p, ("user_id",)).select("user_id", r("lat").alias("lat"), r("lon").alias("lon"))


@query("SELECT user_id, sta, time_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time_us, pick_id) AS k FROM picks WHERE phase IN ('P', 'Pg', 'Pn')) t WHERE k = 1", (PICKS,))
def earliest_p_station(spark, sf):
    p = associate.with_stations(picks(spark, sf), pick_stations(spark, sf))
    return trial.earliest_station(p, ("user_id",)).select("user_id", "sta", "time_us")


#: Times of straight rays at 8 and 4.6 km/s, by whole kilometres up to 3000, as a table for the operators and in SQL.
VP, VS = 8.0, 4.6


def _straight(spark):
    return velocity.straight_rows(spark, VP, VS)


def straight_sql(km: str, depth: str, phase: str) -> str:
    return f"(sqrt(pow(least(floor({km}), 3000), 2) + pow({depth}, 2)) / CASE WHEN {phase} IN ('P', 'Pn', 'Pg') THEN {VP} ELSE {VS} END)"


@query(f"SELECT user_id, first(time_us - CAST(floor(tt * 1000) AS BIGINT) * 1000 ORDER BY round(tt, 6), pick_id) AS origin_us FROM (SELECT *, {straight_sql(TO_STATION, '10', 'phase')} AS tt FROM picks WHERE phase IN ('P', 'Pg')) t GROUP BY user_id", (PICKS,))
def origin_time_estimate(spark, sf):
    """The pick nearest to one place gives the origin time."""
    p = associate.with_stations(picks(spark, sf), pick_stations(spark, sf)).withColumns({"lat": F.lit(CLAT), "lon": F.lit(CLON), "depth": F.lit(10.0)})
    return trial.origin_time(trial.with_times(p, _straight(spark)), ("user_id",))


@query(f"SELECT pick_id, phase, round({TO_STATION}, 6) AS distance, round({straight_sql(TO_STATION, '10', 'phase')}, 6) AS tt FROM picks", (PICKS,))
def straight_time_lookup(spark, sf):
    """Each pick's time from one place in a table of straight rays."""
    p = associate.with_stations(picks(spark, sf), pick_stations(spark, sf)).withColumns({"lat": F.lit(CLAT), "lon": F.lit(CLON), "depth": F.lit(10.0)})
    return trial.with_times(p, _straight(spark)).select("pick_id", "phase", r("distance").alias("distance"), r("tt").alias("tt"))


_MATCH = (
    f"pair AS (SELECT a.pick_id AS seed_id, b.pick_id, a.sta AS seed_sta, b.sta, floor((b.time_us - a.time_us + 6250000) / 1000) / 1000.0 - {straight_sql(haversine_sql('a.slat', 'a.slon', 'b.slat', 'b.slon'), '10', 'b.phase')} AS residual "
    "FROM picks a JOIN picks b ON b.time_us - a.time_us BETWEEN 0 AND 900000000 AND (b.time_us > a.time_us OR b.pick_id > a.pick_id) WHERE a.phase IN ('P', 'Pg')), fit AS (SELECT * FROM pair WHERE abs(residual) <= 120)"
)
_FIT = {"max_residual": 120.0}


@query("SELECT seed_id, CAST(count(DISTINCT sta) AS BIGINT) AS station_count, count(*) AS phase_count FROM (SELECT seed_id, sta FROM fit UNION ALL SELECT pick_id, sta FROM picks WHERE phase IN ('P', 'Pg')) t GROUP BY seed_id HAVING count(DISTINCT sta) >= 2 AND count(*) >= 3", (PICKS, _MATCH))
def association_candidates(spark, sf):
    found = associate.candidates(picks(spark, sf), pick_stations(spark, sf), _straight(spark), min_stations=2, min_phases=3, **_FIT)
    return found.select("seed_id", "station_count", "phase_count")


@query("SELECT seed_id, pick_id, round(residual, 6) AS residual FROM fit", (PICKS, _MATCH))
def association_residuals(spark, sf):
    return associate.residuals(picks(spark, sf), pick_stations(spark, sf), _straight(spark), columns=("seed_id", "pick_id", "residual"), **_FIT).select("seed_id", "pick_id", r("residual").alias("residual"))


@query("SELECT pick_id FROM picks WHERE pick_id NOT IN (SELECT pick_id FROM fit) AND pick_id NOT IN (SELECT seed_id FROM fit)", (PICKS, _MATCH))
def unassociated_picks(spark, sf):
    return associate.unassociated(picks(spark, sf), associate.fitting(picks(spark, sf), pick_stations(spark, sf), _straight(spark), **_FIT)).select("pick_id")


@query()
def associated_events(spark, sf):
    """Candidates over the travel-time table, with shared picks resolved greedily."""
    p, s, t = picks(spark, sf), pick_stations(spark, sf), velocity.table_rows(spark, velocity.Model.named("iasp91"))
    return associate.chosen(p, s, t, min_stations=2, min_phases=2, **_FIT)


_CELLS = "(SELECT i AS cell, CAST(-60 + 30 * (i // 5) AS DOUBLE) AS lat, CAST(-120 + 60 * (i % 5) AS DOUBLE) AS lon FROM range(25) t(i))"
_CELL_TIME = straight_sql(haversine_sql("c.lat", "c.lon", "p.slat", "p.slon"), "10", "p.phase")


def _cells(spark):
    """Twenty-five grid points of the world."""
    return spark.range(25).select(F.col("id").alias("cell"), (-60.0 + 30 * F.floor(F.col("id") / 5)).alias("lat"), (-120.0 + 60 * (F.col("id") % 5)).alias("lon"), F.lit(10.0).alias("depth"))


@query(f"SELECT cell, CAST(bucket AS BIGINT) AS bucket, count(DISTINCT pick_id) AS votes FROM (SELECT c.cell, p.pick_id, floor((p.time_us - {_CELL_TIME} * 1e6) / 300000000.0) AS bucket FROM picks p, {_CELLS} c) u GROUP BY ALL HAVING count(DISTINCT pick_id) >= 4", (PICKS,))
def nucleator_votes(spark, sf):
    """Votes in buckets of 300 s."""
    return associate.nucleator_votes(picks(spark, sf), pick_stations(spark, sf), _cells(spark), _straight(spark), max_residual=300.0)


@query("SELECT orid, round(exp(-0.5 * sum(d * d) / count(*) * 100), 6) AS likelihood, count(*) AS pairs FROM (SELECT a.orid, a.timeres - b.timeres AS d FROM assoc a JOIN assoc b ON a.orid = b.orid AND a.arid < b.arid) t GROUP BY orid", (ASSOC,))
def edt_pairs(spark, sf):
    return trial.pair_likelihood(assoc(spark, sf), ("orid",), scale=100.0).select("orid", r("likelihood").alias("likelihood"), "pairs")


@query("SELECT orid, round(exp(-0.5 * sum(pow(timeres / (0.05 + delta / 100), 2))), 6) AS likelihood FROM assoc GROUP BY orid", (ASSOC,))
def gaussian_likelihood(spark, sf):
    return trial.gaussian_likelihood(assoc(spark, sf), ("orid",), sigma=0.05 + F.col("delta") / 100).select("orid", r("likelihood").alias("likelihood"))


@query(f"SELECT sta, first(cell ORDER BY round(rms, 6), cell) AS cell, round(min(rms), 6) AS rms FROM (SELECT p.sta, c.cell, sqrt(avg(pow((time_us % 600000000) / 1e6 - {_CELL_TIME}, 2))) AS rms FROM picks p, {_CELLS} c GROUP BY 1, 2) u GROUP BY sta", (PICKS,))
def grid_argmin_small(spark, sf):
    """One level of a grid search: of 25 points the first of least misfit wins."""
    p = associate.with_stations(picks(spark, sf), pick_stations(spark, sf)).withColumn("seconds", (F.col("time_us") % 600000000) / 1e6)
    return trial.grid_argmin(trial.grid_misfit(p, _cells(spark), _straight(spark), ("sta",)), ("sta",))


# Magnitudes

_MEDIAN = "SELECT evid, magtype, round(list_sort(list(magnitude))[CAST(floor(count(*) / 2) AS INTEGER) + 1], 6) AS magnitude, round(stddev_pop(magnitude), 6) AS uncertainty, count(*) AS nsta FROM sm GROUP BY evid, magtype"


def _network(rows, kind: str):
    out = network(rows.withColumn("magtype", F.lit(kind)), ["evid", "magtype"])
    return out.select("evid", "magtype", r("magnitude").alias("magnitude"), r("uncertainty").alias("uncertainty"), "nsta")


@query(_MEDIAN, (ASSOC, "sm AS (SELECT orid % 1000 AS evid, 'ML' AS magtype, log10(amp * 1e-6) + log10((delta * 10) / 100.0) + 0.00301 * (delta * 10 - 100) + 3.0 AS magnitude FROM assoc)"))
def ml_network(spark, sf):
    rows = assoc(spark, sf).select((F.col("orid") % 1000).alias("evid"), scales.ml("amp", F.col("delta") * 10).alias("magnitude"))
    return _network(rows, "ML")


@query(_MEDIAN, (ASSOC, "sm AS (SELECT orid % 1000 AS evid, 'Md' AS magtype, -1 + 2 * log10(delta) + 0.0035 * (amp / 1000) AS magnitude FROM assoc)"))
def md_network(spark, sf):
    return _network(assoc(spark, sf).select((F.col("orid") % 1000).alias("evid"), scales.md("delta", F.col("amp") / 1000).alias("magnitude")), "Md")


@query(_MEDIAN, (ASSOC, "sm AS (SELECT orid % 1000 AS evid, 'Mb' AS magtype, log10(amp / 1000.0) + CASE WHEN delta * 3 < 20 THEN 5.9 + 0.05 * delta * 3 WHEN delta * 3 < 100 THEN 6.9 + 0.0015 * delta * 3 ELSE 7.0 END - 0.005 * (orid % 700 - 33) AS magnitude FROM assoc)"))
def mb_network(spark, sf):
    rows = assoc(spark, sf).select((F.col("orid") % 1000).alias("evid"), scales.mb("amp", F.col("delta") * 3, (F.col("orid") % 700).cast("double")).alias("magnitude"))
    return _network(rows, "Mb")


@query(_MEDIAN, (ASSOC, "sm AS (SELECT orid % 1000 AS evid, 'Ms' AS magtype, log10(amp / 1000.0 / 20.0) + 1.66 * log10(delta * 3) + 3.3 AS magnitude FROM assoc)"))
def ms_network(spark, sf):
    return _network(assoc(spark, sf).select((F.col("orid") % 1000).alias("evid"), scales.ms("amp", F.col("delta") * 3).alias("magnitude")), "Ms")


@query("SELECT arid, orid, round(2.0 / 3.0 * log10(4 * pi() * 2700.0 * pow(3500.0, 3) * (delta * 1000.0) * (amp * 1e-9) / 1.2 * 1e7) - 10.7, 6) AS mw FROM assoc", (ASSOC,))
def mw_from_omega(spark, sf):
    return assoc(spark, sf).select("arid", "orid", r(scales.mw(scales.moment(F.col("amp") * 1e-9, "delta"))).alias("mw"))


@query("SELECT arid, round(amp / (1 + pow(delta / 5.0, 2)), 6) AS brune, round(exp(pi() * delta * 2.0 / 200.0), 6) AS attenuation FROM assoc", (ASSOC,))
def brune_attenuation(spark, sf):
    return assoc(spark, sf).select("arid", r(scales.brune("amp", 5.0, "delta")).alias("brune"), r(scales.attenuation("delta", 2.0, 200.0)).alias("attenuation"))


@query("SELECT a.arid, round(log10(amp * 1e-6) + log10((delta * 10) / 100.0) + 0.00301 * (delta * 10 - 100) + 3.0 + coalesce(c.correction, 0), 6) AS magnitude FROM assoc a LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS sta, s_acctbal / 100000.0 AS correction FROM supplier WHERE s_suppkey % 2 = 0) c ON c.sta = a.sta", (ASSOC,))
def station_corrections(spark, sf):
    c = read(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("sta"), (F.col("s_acctbal") / 100000.0).alias("correction"))
    return assoc(spark, sf).join(c, "sta", "left").select("arid", r(scales.ml("amp", F.col("delta") * 10, correction=F.coalesce("correction", F.lit(0.0)))).alias("magnitude"))


@query("SELECT orid, round(CASE WHEN d < 150 THEN d / 6.0 WHEN d - 66 * tan(asin(0.75)) > 0 THEN 66 / (6.0 * cos(asin(0.75))) + (d - 66 * tan(asin(0.75))) / 8.0 ELSE d / 6.5 END, 6) AS pn FROM (SELECT orid, depth AS d FROM origin) t", (ORIGINS,))
def expected_pn(spark, sf):
    return origins(spark, sf).select("orid", r(scales.expected_pn("depth")).alias("pn"))


# Catalog


@query("SELECT e.evid, e.evname, o.orid, round(o.lat, 6) AS lat, round(o.lon, 6) AS lon, o.depth, o.time FROM event e JOIN origin o ON o.orid = e.prefor WHERE o.time BETWEEN 852076800 AND 915148800 AND lat BETWEEN -45 AND 45 AND lon BETWEEN -90 AND 90", (EVENTS,))
def query_events(spark, sf):
    out = catalog.query_events(events(spark, sf), origins(spark, sf), 852076800.0, 915148800.0, (-45.0, 45.0), (-90.0, 90.0))
    return out.select("evid", "evname", "orid", r("lat").alias("lat"), r("lon").alias("lon"), "depth", "time")


@query("SELECT e.evid, o.orid FROM event e JOIN origin o ON o.orid = e.prefor WHERE EXISTS (SELECT 1 FROM netmag n WHERE n.orid = o.orid AND n.magnitude BETWEEN 4.9 AND 6)", (EVENTS, NETMAGS))
def query_events_magnitude(spark, sf):
    return catalog.query_events(events(spark, sf), origins(spark, sf), magnitude=(4.9, 6.0), netmag=netmags(spark, sf)).select("evid", "orid")


@query("SELECT orid, evid, time, depth FROM origin WHERE evid = 7", (ORIGINS,))
def query_origins(spark, sf):
    return catalog.query_origins(origins(spark, sf), 7).select("orid", "evid", "time", "depth")


_AROUND = "(SELECT min(orid) FROM assoc)"


@query(f"SELECT arid, sta, time FROM assoc WHERE orid = {_AROUND}", (ASSOC,))
def query_arrivals(spark, sf):
    rows = assoc(spark, sf)
    orid = rows.agg(F.min("orid")).first()[0]
    return catalog.query_arrivals(rows.select("arid", "sta", "time"), rows.select("arid", "orid"), orid)


@query(f"SELECT arid, orid, sta, round(timeres, 6) AS timeres, wgt FROM assoc WHERE orid = {_AROUND}", (ASSOC,))
def query_associations(spark, sf):
    rows = assoc(spark, sf)
    return catalog.query_associations(rows, rows.agg(F.min("orid")).first()[0]).select("arid", "orid", "sta", r("timeres").alias("timeres"), "wgt")


@query(f"SELECT magid, orid, evid, magtype, round(magnitude, 6) AS magnitude, nsta FROM netmag WHERE orid = {_AROUND}", (NETMAGS,))
def query_magnitudes(spark, sf):
    return catalog.query_magnitudes(netmags(spark, sf), assoc(spark, sf).agg(F.min("orid")).first()[0]).select("magid", "orid", "evid", "magtype", r("magnitude").alias("magnitude"), "nsta")


@query("SELECT evid, orid, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT o.* FROM event e JOIN origin o ON o.orid = e.prefor) t", (EVENTS,))
def preferred_origin(spark, sf):
    return catalog.preferred(events(spark, sf), origins(spark, sf)).select("evid", "orid", r("lat").alias("lat"), r("lon").alias("lon"))


@query("SELECT evid, magtype, round(magnitude, 6) AS magnitude FROM (SELECT *, row_number() OVER (PARTITION BY evid ORDER BY CASE magtype WHEN 'Mw' THEN 0 WHEN 'ML' THEN 1 WHEN 'Mb' THEN 2 WHEN 'Ms' THEN 3 WHEN 'Md' THEN 4 ELSE 5 END, magid) AS k FROM netmag) t WHERE k = 1", (NETMAGS,))
def preferred_magnitude(spark, sf):
    return catalog.preferred_magnitude(netmags(spark, sf)).select("evid", "magtype", r("magnitude").alias("magnitude"))


@query("SELECT t.evid, t.orid, t.time, m.magtype, round(m.magnitude, 6) AS magnitude, coalesce(a.n, 0) AS arrivals FROM (SELECT e.evid, o.orid, o.time FROM event e JOIN origin o ON o.orid = e.prefor ORDER BY o.time DESC, o.orid DESC LIMIT 50) t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY orid ORDER BY CASE magtype WHEN 'ML' THEN 1 ELSE 2 END) AS k FROM netmag) m ON m.orid = t.orid AND m.k = 1 LEFT JOIN (SELECT x.orid, count(*) AS n FROM assoc x JOIN assoc y ON x.arid = y.arid GROUP BY x.orid) a ON a.orid = t.orid", (EVENTS, NETMAGS))
def recent_events_nested(spark, sf):
    """The fifty latest events; the limit is the feature."""
    a = assoc(spark, sf)
    out = catalog.recent_events(events(spark, sf), origins(spark, sf), a.select("arid", "sta", F.lit("P").alias("iphase"), "time"), a.select("orid", "arid", "delta", "timeres"), netmags(spark, sf), 50)
    return out.select("evid", "orid", "time", "magtype", r("magnitude").alias("magnitude"), F.coalesce(F.size("arrivals").cast("long"), F.lit(0)).alias("arrivals"))


@query("SELECT (SELECT count(*) FROM event) AS events, (SELECT count(*) FROM origin) AS origins, (SELECT count(*) FROM assoc) AS arrivals, (SELECT count(*) FROM stations) AS stations", (EVENTS, ASSOC, STATIONS))
def catalog_counts(spark, sf):
    return catalog.counts(events(spark, sf), origins(spark, sf), assoc(spark, sf), stations(spark, sf))


@query("SELECT min(time) AS first_time, max(time) AS last_time FROM origin", (ORIGINS,))
def time_range(spark, sf):
    return catalog.time_range(origins(spark, sf))


@query("SELECT 'evid' AS id, max(evid) + 1 AS next_id FROM event UNION ALL SELECT 'orid', max(orid) + 1 FROM origin UNION ALL SELECT 'arid', max(arid) + 1 FROM assoc", (EVENTS, ASSOC))
def next_ids(spark, sf):
    each = [catalog.next_ids(t, c).select(F.lit(c).alias("id"), "next_id") for t, c in ((events(spark, sf), "evid"), (origins(spark, sf), "orid"), (assoc(spark, sf), "arid"))]
    return each[0].union(each[1]).union(each[2])


@query("SELECT sta, CASE WHEN station_id % 3 = 0 THEN 'new' ELSE 'old' END AS staname FROM stations", (STATIONS,))
def upsert_site(spark, sf):
    """Every third station is stored again; the later row counts."""
    s = stations(spark, sf)
    rows = s.select("sta", F.lit("old").alias("staname"), F.lit(0).alias("seq")).unionByName(s.where("station_id % 3 = 0").select("sta", F.lit("new").alias("staname"), F.lit(1).alias("seq")))
    return regions.latest_by_key(rows, ["sta"], "seq").select("sta", "staname")


@query("SELECT lpad(printf('%.4f', lat), 9, ' ') || ' ' || lpad(printf('%.4f', lon), 10, ' ') || ' ' || lpad(printf('%.4f', depth), 9, ' ') || ' ' || lpad(printf('%.5f', time), 17, ' ') || ' ' || lpad(CAST(orid AS VARCHAR), 8, ' ') || ' ' || lpad(CAST(evid AS VARCHAR), 8, ' ') AS value FROM origin WHERE time BETWEEN 852076800 AND 915148800", (ORIGINS,))
def flat_export(spark, sf):
    return catalog.flat_lines(origins(spark, sf).where(F.col("time").between(852076800, 915148800)), "origin")


@query("SELECT arid, sta, coalesce(CASE WHEN l_linestatus = 'O' THEN amp END, -999.0) AS amp, '-' AS auth, -1 AS commid FROM assoc", (ASSOC,))
def sentinel_view(spark, sf):
    rows = catalog.conformed(assoc(spark, sf).withColumn("amp", F.when(F.col("l_linestatus") == "O", F.col("amp"))).select("arid", "sta", "amp"), "arrival")
    return catalog.with_sentinels(rows, "arrival").select("arid", "sta", "amp", "auth", F.col("commid").cast("int").alias("commid"))


@query("SELECT a.arid, a.orid FROM assoc a LEFT JOIN origin o ON o.orid = a.orid WHERE o.orid IS NULL OR a.orid % 5 = 0", (ASSOC, ORIGINS))
def dangling_references(spark, sf):
    """Associations whose origin is not there, with every fifth origin taken out."""
    return catalog.dangling(assoc(spark, sf), origins(spark, sf).where("orid % 5 <> 0"), "assoc", "orid").select("arid", "orid")


@query("SELECT arid, orid, count(*) AS n FROM assoc GROUP BY arid, orid HAVING count(*) > 1", (ASSOC,))
def duplicate_keys(spark, sf):
    return catalog.duplicate_keys(assoc(spark, sf), "assoc")


@query("SELECT orid, CAST(year(ts) * 1000 + dayofyear(ts) AS INTEGER) AS jdate, time AS epoch, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS text FROM origin", (ORIGINS,))
def time_codes(spark, sf):
    return origins(spark, sf).select("orid", timeutil.jdate("ts").alias("jdate"), "time", timeutil.utc_text("ts").alias("text")).withColumnRenamed("time", "epoch")


@query("SELECT pick_id, CASE WHEN phase IN ('P', 'Pn', 'Pg') THEN 'P' ELSE 'S' END AS class, CASE WHEN snr >= 10 THEN 0 WHEN snr >= 5 THEN 1 ELSE 2 END AS service, CASE WHEN snr > 8 THEN 0 ELSE 1 END AS simulator, CASE WHEN snr >= 15 THEN 0 WHEN snr >= 6 THEN 1 ELSE 2 END AS study, pow(1 - quality / 4.0, 2) AS weight, CASE quality WHEN 0 THEN 'i' WHEN 1 THEN 'e' ELSE '?' END AS qual FROM picks", (PICKS,))
def pick_codes(spark, sf):
    return picks(spark, sf).select("pick_id", codes.phase_class("phase").alias("class"), codes.snr_quality("snr").alias("service"), codes.snr_quality("snr", "simulator").alias("simulator"), codes.snr_quality("snr", "case_study").alias("study"), codes.location_weight("quality").alias("weight"), codes.css_quality("quality").alias("qual"))


@query("SELECT p_partkey, CAST((epoch(make_date(1990 + CAST(p_partkey % 30 AS INTEGER), 1, 1)) + (1 + p_partkey % 365 - 1) * 86400 + (p_partkey % 24) * 3600 + (p_partkey % 60) * 60 + p_size) * 1000000 + (p_partkey % 10000) * 100 AS BIGINT) AS us FROM part")
def btime_parse(spark, sf):
    k = F.col("p_partkey")
    us = timeutil.btime((1990 + k % 30).cast("int"), (1 + k % 365).cast("int"), k % 24, k % 60, F.col("p_size"), k % 10000)
    return read(spark, sf, "part").select("p_partkey", us.alias("us"))


@query("SELECT net || '.' || sta || '..BHZ' AS dots, net || '_' || sta || '__BHZ' AS seed, sta LIKE '1_' AS hit FROM stations", (STATIONS,))
def stream_names(spark, sf):
    s = stations(spark, sf)
    return s.select(codes.stream_id("net", "sta", F.lit(""), F.lit("BHZ")).alias("dots"), codes.stream_id("net", "sta", F.lit(""), F.lit("BHZ"), "_").alias("seed"), codes.selector_matches("1?", "sta").alias("hit"))


@query("SELECT row_number() OVER (ORDER BY CAST(label AS VARCHAR), vec_id) AS wfid, CAST(label AS VARCHAR) AS sta, CAST(vec_id AS DOUBLE) AS time, vec_id + (len(embedding) - 1) / 20.0 AS endtime, CAST(len(embedding) AS BIGINT) AS nsamp, 20.0::DOUBLE AS samprate FROM embeddings")
def wfdisc_rows(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("label").cast("string").alias("sta"), F.lit("BHZ").alias("chan"), (F.col("vec_id") * 1_000_000).alias("start_us"), F.lit(20.0).alias("sample_rate"), F.col("embedding").cast("array<double>").alias("samples"))
    return catalog.wfdisc_rows(e).select(F.col("wfid").cast("long").alias("wfid"), "sta", "time", "endtime", "nsamp", "samprate")


@query("SELECT evid, round(list_sort(list(depth))[CAST(floor(count(*) / 2) AS INTEGER) + 1], 6) AS depth FROM origin GROUP BY evid", (ORIGINS,))
def upper_median_depth(spark, sf):
    return origins(spark, sf).groupBy("evid").agg(r(upper_median("depth")).alias("depth"))
