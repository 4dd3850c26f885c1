"""Queries over whole operators: pickers, stores, windows of waveforms, scalar codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import codes, geo
from ..operators import associate, catalog, magnitude, signal, triggers, velocity
from ..operators.magnitude import network
from ..operators.signal import Stream
from ..sources import reports, text
from .catalog_queries import CLAT, CLON, TO_STATION, r, straight_sql
from .registry import query
from .signal_queries import _SUMS, _W, DEMEANED, LTA, MARKS, OFF, ON, RECT, STA, STALTA, THREE, S, frame, three_components
from .tables import ARRAYS, ASSOC, EVENTS, ORIGINS, PICKS, SAMPLES, STATIONS, arrays, assoc, events, haversine_sql, origins, pick_stations, picks, samples, scratch, stations

# Channels and components

CHANNELS = ("BHZ", "BHN", "BH1", "BHE", "LHZ", "HNX")
_CHANNELS = "chan AS (SELECT net, sta, station_id, c.chan, (station_id * 37 + c.k * 61) % 181 - 90 AS dip FROM stations, (VALUES " + ", ".join(f"('{c}', {k})" for k, c in enumerate(CHANNELS)) + ") c(chan, k))"


def channels(spark, sf):
    """Six channels of every station, with dips from -90 to 90."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("chan"), F.lit(k).alias("k")) for k, c in enumerate(CHANNELS)))).alias("c")
    rows = stations(spark, sf).select("net", "sta", "station_id", each)
    return rows.select("net", "sta", "station_id", "c.chan", ((F.col("station_id") * 37 + F.col("c.k") * 61) % 181 - 90).alias("dip"))


@query("SELECT net, sta, chan FROM chan WHERE chan = 'BHZ' OR chan LIKE '%Z'", (STATIONS, _CHANNELS))
def vertical_channels(spark, sf):
    return channels(spark, sf).where(codes.is_vertical("chan")).select("net", "sta", "chan")


@query("SELECT net, sta, chan, dip < -60 OR dip > 60 AS vertical, abs(dip) < 30 AS horizontal FROM chan", (STATIONS, _CHANNELS))
def channel_orientation(spark, sf):
    return channels(spark, sf).select("net", "sta", "chan", codes.dip_is_vertical("dip").alias("vertical"), codes.dip_is_horizontal("dip").alias("horizontal"))


@query(
    "SELECT sta, start_us, z[1] AS z1, n[1] AS n1, e[1] AS e1, len(z) AS size FROM (SELECT vec_id % 20 AS sta, (vec_id // 60) * 1000000 AS start_us, max(CASE WHEN vec_id // 20 % 3 = 0 THEN vec_id END) AS zi, max(CASE WHEN vec_id // 20 % 3 = 1 THEN vec_id END) AS ni, max(CASE WHEN vec_id // 20 % 3 = 2 THEN vec_id END) AS ei FROM embeddings GROUP BY 1, 2) t "
    "JOIN (SELECT vec_id AS a, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings) x ON a = zi JOIN (SELECT vec_id AS b, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS n FROM embeddings) y ON b = ni JOIN (SELECT vec_id AS c, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) w ON c = ei"
)
def three_component_groups(spark, sf):
    """Segments whose channels are BHZ, BH1 and BHE, put beside each other."""
    v = F.col("vec_id")
    kind = F.floor(v / 20) % 3
    rows = arrays(spark, sf).select(F.lit("XX").alias("net"), (v % 20).alias("sta"), F.when(kind == 0, "BHZ").when(kind == 1, "BH1").otherwise("BHE").alias("chan"), (F.floor(v / 60) * 1_000_000).alias("start_us"), F.lit(20.0).alias("sample_rate"), F.col("x").alias("samples"))
    got = triggers.three_components(rows)
    return got.select("sta", "start_us", *(F.get(c, F.lit(0)).alias(f"{c}1") for c in "zne"), F.size("z").cast("long").alias("size"))


# Pickers, end to end


def _refined(source: str, at: str, reach: int, margin: int = 5, value: str = "value") -> str:
    """near, aic and best: the AIC minimum of the samples within reach of each row's ``at`` in source."""
    return f"""near AS (SELECT q.*, s.idx AS i, s.{value} AS x, row_number() OVER (PARTITION BY q.stream_id, q.{at} ORDER BY s.idx) - 1 AS k, count(*) OVER (PARTITION BY q.stream_id, q.{at}) AS n FROM {source} q JOIN sam s ON s.stream_id = q.stream_id AND s.idx >= q.{at} - {reach} AND s.idx < q.{at} + {reach}),
cum AS (SELECT *, sum(x) OVER b AS s1, sum(x * x) OVER b AS s2, sum(x) OVER (PARTITION BY stream_id, {at}) AS t1, sum(x * x) OVER (PARTITION BY stream_id, {at}) AS t2 FROM near WINDOW b AS (PARTITION BY stream_id, {at} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scored AS (SELECT *, CASE WHEN k > 0 AND k < n - 1 THEN k * ln(greatest(s2 / k - pow(s1 / k, 2), 1e-20)) + (n - k - 1) * ln(greatest((t2 - s2) / (n - k) - pow((t1 - s1) / (n - k), 2), 1e-20)) ELSE 0.0 END AS aic FROM cum),
best AS (SELECT stream_id, {at} AS at, first(i ORDER BY aic, k) AS refined FROM scored WHERE k >= {margin} AND k < n - {margin} GROUP BY 1, 2)"""


_SAM = "sam AS (SELECT * FROM samples)"
_TRIG = "SELECT t.stream_id, t.on_idx, t.off_idx, CAST(coalesce(b.refined, t.on_idx) AS BIGINT) AS pick_idx FROM trig t LEFT JOIN best b ON b.stream_id = t.stream_id AND b.at = t.on_idx"


@query(_TRIG, (SAMPLES, DEMEANED, STALTA, MARKS, _SAM, _refined("trig", "on_idx", 8)))
def aic_refined_triggers(spark, sf):
    rows = samples(spark, sf)
    found = triggers.stalta_triggers(rows, S, STA, LTA, ON, OFF)
    return triggers.aic_refined(rows, S, found, "on_idx", 8).select("stream_id", "on_idx", "off_idx", F.col("refined_idx").cast("long").alias("pick_idx"))


@query(
    f"SELECT p.stream_id, p.on_idx, p.off_idx, p.pick_idx, round(p.peak, 6) AS snr, round(least(1.0, p.peak / 10.0), 6) AS confidence, round(max(abs(s.value)), 6) AS amplitude, 'P' AS phase FROM ({_TRIG.replace('t.off_idx,', 't.off_idx, t.peak,')}) p JOIN samples s ON s.stream_id = p.stream_id AND s.idx BETWEEN p.pick_idx AND p.pick_idx + 1 GROUP BY ALL",
    (SAMPLES, DEMEANED, STALTA, MARKS, _SAM, _refined("trig", "on_idx", 8)),
)
def stalta_picks(spark, sf):
    """The whole picker on samples at 2 Hz."""
    got = triggers.stalta_picks(samples(spark, sf), S, 2.0, STA / 2, LTA / 2, ON, OFF, 8)
    return got.select("stream_id", "on_idx", "off_idx", F.col("pick_idx").cast("long").alias("pick_idx"), r("snr").alias("snr"), r("confidence").alias("confidence"), r("amplitude").alias("amplitude"), "phase")


@query(
    "SELECT stream_id, CAST(pick_idx AS BIGINT) AS pick_idx, round(max(snr), 6) AS snr FROM (SELECT c.stream_id, coalesce(b.refined, c.candidate) AS pick_idx, c.snr FROM cand c LEFT JOIN best b ON b.stream_id = c.stream_id AND b.at = c.candidate) t GROUP BY ALL",
    (
        SAMPLES,
        f"p AS (SELECT *, count(*) OVER (PARTITION BY stream_id) AS total, sum(value * value) {frame(0, 15)} AS a, sum(value * value) {frame(-16, -1)} AS b FROM samples)",
        "cand AS (SELECT stream_id, idx AS candidate, sqrt(a / b) AS snr FROM p WHERE idx >= 16 AND idx < total - 16 AND (idx - 16) % 4 = 0 AND b > 1e-20 AND a / b > 1.44)",
        _SAM,
        _refined("cand", "candidate", 8),
    ),
)
def aic_picks(spark, sf):
    got = triggers.aic_picks(samples(spark, sf), S, 8.0, 2.0, 1.2)
    return got.select("stream_id", F.col("pick_idx").cast("long").alias("pick_idx"), r("snr").alias("snr"))


def _marks(on: str, off: str, peak: str, source: str) -> str:
    """trig: hysteresis triggers of source."""
    return f"""m AS (SELECT *, CASE WHEN {on} THEN 1 WHEN {off} THEN 0 END AS mark FROM {source}),
st AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM m),
pr AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY stream_id ORDER BY idx), 0) AS before FROM st),
isl AS (SELECT *, sum(CASE WHEN state = 1 AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island, state = 0 AND before = 1 AS ends FROM pr),
trig AS (SELECT stream_id, CAST(min(idx) AS BIGINT) AS on_idx, CAST(max(CASE WHEN ends THEN idx END) AS BIGINT) AS off_idx, max(CASE WHEN state = 1 THEN {peak} END) AS peak FROM isl WHERE state = 1 OR ends GROUP BY stream_id, island HAVING max(CASE WHEN ends THEN idx END) IS NOT NULL)"""


_COUPLED = f"cp AS (SELECT stream_id, idx, {RECT} AS rect, (CASE WHEN idx >= 10 AND l > 1e-20 THEN s / l ELSE 0.0 END) * ({RECT}) AS coupled FROM (SELECT *, avg(z * z) {frame(-2, 0)} AS s, avg(z * z) {frame(-9, 0)} AS l FROM iv) t)"


@query("SELECT stream_id, on_idx, off_idx, round(peak, 5) AS peak FROM trig", (THREE, _SUMS, _COUPLED, _marks("coupled >= 0.3 AND rect >= 0.1", "coupled < 0.1 OR rect < 0.05", "coupled", "cp")))
def polarization_triggers(spark, sf):
    both = lambda o: {"rect": signal.rectilinearity(o, "z", "n", "e", _W), "ratio": signal.sta_lta(o, 3, 10, F.col("z"), tiny=1e-20)}
    rows = triggers.in_blocks(three_components(spark, sf), Stream(value="z"), 10, both).withColumn("coupled", F.col("ratio") * F.col("rect"))
    return triggers.polarization_triggers(rows, S, "coupled", "rect", 0.3, 0.1, 0.1, triggers.BLOCK).select("stream_id", "on_idx", "off_idx", r("peak", 5).alias("peak"))


@query(
    "SELECT t.stream_id, t.on_idx, t.off_idx, round(t.peak, 5) AS snr, CAST(coalesce(b.refined, t.on_idx) AS BIGINT) AS pick_idx FROM trig t LEFT JOIN best b ON b.stream_id = t.stream_id AND b.at = t.on_idx",
    (THREE, _SUMS, _COUPLED, _marks("coupled >= 0.3 AND rect >= 0.1", "coupled < 0.1 OR rect < 0.05", "coupled", "cp"), "sam AS (SELECT stream_id, idx, z AS value FROM three)", _refined("trig", "on_idx", 8)),
)
def polarization_picks(spark, sf):
    """The three-component picker on samples at 8 Hz."""
    got = triggers.polarization_picks(three_components(spark, sf), S, 8.0, 3 / 8, 10 / 8, 0.3, 0.1, 1.0, 0.1)
    return got.select("stream_id", "on_idx", "off_idx", r("snr", 5).alias("snr"), F.col("pick_idx").cast("long").alias("pick_idx"))


@query(
    f"SELECT p.stream_id, p.on_idx, p.off_idx, p.pick_idx, round(p.peak, 6) AS snr, round(max(abs(s.value)), 6) AS amplitude FROM ({_TRIG.replace('t.off_idx,', 't.off_idx, t.peak,')}) p JOIN samples s ON s.stream_id = p.stream_id AND s.idx BETWEEN p.pick_idx AND p.pick_idx + 1 GROUP BY ALL",
    (SAMPLES, DEMEANED, STALTA.replace("1e-10", "1e-20"), _marks("ratio >= 1.8", "ratio < 0.9", "ratio", "r"), _SAM, _refined("trig", "on_idx", 8)),
)
def one_component_picks(spark, sf):
    """The polarization picker where a station has one component only, on samples at 2 Hz."""
    got = triggers.one_component_picks(samples(spark, sf), S, 2.0, STA / 2, LTA / 2, 1.8, 0.9, 8)
    return got.select("stream_id", "on_idx", "off_idx", F.col("pick_idx").cast("long").alias("pick_idx"), r("snr").alias("snr"), r("amplitude").alias("amplitude"))


@query("SELECT vec_id, idx, round(coalesce((x - m) / nullif(max(abs(x - m)) OVER (PARTITION BY vec_id), 0), 0), 6) AS y FROM (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS m FROM arr) t", (ARRAYS,))
def detector_input(spark, sf):
    """What a detector is given: the mean off, the loudest sample 1."""
    got = arrays(spark, sf).select("vec_id", F.posexplode(A.prepared("x")).alias("idx", "y"))
    return got.select("vec_id", F.col("idx").cast("long").alias("idx"), r("y").alias("y"))


@query(
    "SELECT stream_id, unnest(list) AS time_us FROM (SELECT user_id AS stream_id, arg_max(list, k) AS list FROM walk GROUP BY 1) t",
    (
        "RECURSIVE " + PICKS,
        "loud AS (SELECT user_id, time_us, row_number() OVER (PARTITION BY user_id ORDER BY time_us, pick_id) AS k FROM picks WHERE snr >= 3)",
        "walk AS (SELECT user_id, k, time_us AS last, [time_us] AS list FROM loud WHERE k = 1 UNION ALL SELECT l.user_id, l.k, CASE WHEN l.time_us - w.last >= 90000000000 THEN l.time_us ELSE w.last END, CASE WHEN l.time_us - w.last >= 90000000000 THEN list_append(w.list, l.time_us) ELSE w.list END FROM walk w JOIN loud l ON l.user_id = w.user_id AND l.k = w.k + 1)",
    ),
)
def spaced_picks(spark, sf):
    """Picks of a stream that come at least 25 hours after the last one kept."""
    return triggers.spaced(picks(spark, sf).withColumnRenamed("user_id", "stream_id"), ("stream_id",), 90_000.0, 3.0)


# Picks, stations and models


@query("SELECT pick_id, sta, round(coalesce(c.lat, 0), 6) AS lat, CASE WHEN c.lat IS NULL THEN 0.0 ELSE pow(1 - quality / 4.0, 2) END AS weight FROM picks p LEFT JOIN (SELECT net, sta AS code, lat FROM stations WHERE station_id % 3 <> 0) c ON c.code = p.sta AND c.net = p.net", (PICKS,))
def picks_without_station(spark, sf):
    """A pick whose station is not in the list stays, with weight 0."""
    known = pick_stations(spark, sf).where("station_id % 3 <> 0")
    rows = associate.with_stations(picks(spark, sf), known, keep_missing=True)
    weight = F.when(F.col("slat").isNull(), 0.0).otherwise(codes.location_weight("quality"))
    return rows.select("pick_id", "sta", r(F.coalesce("slat", F.lit(0.0))).alias("lat"), weight.alias("weight"))


_DT = "(time_us % 600000000) / 1e6"


@query(f"SELECT pick_id, round(dt, 6) AS dt, round(dt - tt, 6) AS residual FROM (SELECT pick_id, snr, {_DT} AS dt, {straight_sql(TO_STATION, '10', chr(39) + 'P' + chr(39))} AS tt FROM picks) t WHERE dt >= -1 AND snr >= 3 AND abs(dt - tt) <= 50", (PICKS,))
def picks_near_model(spark, sf):
    """Picks within 50 s of the P time from one place."""
    p = associate.with_stations(picks(spark, sf), pick_stations(spark, sf)).withColumn("distance", geo.haversine_km(CLAT, CLON, "slat", "slon")).withColumn("depth", F.lit(10.0))
    got = associate.near_model(p, velocity.straight_rows(spark, 8.0, 4.6), (F.col("time_us") % 600000000) / 1e6, max_residual=50.0)
    return got.select("pick_id", r("dt").alias("dt"), r("residual").alias("residual"))


@query(f"SELECT p.pick_id, round(l.km, 6) AS distance FROM picks p LEFT JOIN (SELECT net || '.' || sta AS station, {haversine_sql('35.0::DOUBLE', '(-117.0)::DOUBLE', 'lat', 'lon')} AS km FROM stations WHERE station_id % 2 = 0) l ON l.station = p.net || '.' || p.sta", (PICKS,))
def pick_distances(spark, sf):
    """Distances by the name of a pick's station; null where the list lacks it."""
    listed = stations(spark, sf).where("station_id % 2 = 0").select(F.concat_ws(".", "net", "sta").alias("station"), geo.haversine_km(CLAT, CLON, "lat", "lon").alias("distance"))
    return text.with_distances(picks(spark, sf), listed).select("pick_id", r("distance").alias("distance"))


@query("SELECT net, sta, phase, 1000000 + CAST(trunc(CAST(travel_s AS DOUBLE) * 1e6) AS BIGINT) AS time_us, CASE WHEN snr >= 5 THEN 0 ELSE 1 END AS quality, round(snr, 3) AS snr FROM (SELECT net, sta, phase, round(pick_id * 0.0015, 4) AS travel_s, round(snr, 3) AS snr FROM picks) t", (PICKS,))
def external_picks(spark, sf):
    """Picks written as a CSV table and read again; travel times are 1.5 ms x the pick's number."""
    path = scratch(spark, "external-picks")
    rows = picks(spark, sf).select(F.concat_ws(".", "net", "sta").alias("station"), "phase", F.round(F.col("pick_id") * 0.0015, 4).alias("travel_time_s"), F.round("snr", 3).alias("snr"), F.col("quality"), F.lit(0.0).alias("distance_km"), F.lit("m").alias("method"))
    rows.write.csv(path, header=True)
    return text.read_picks(spark, path, 1_000_000).select("net", "sta", "phase", "time_us", "quality", "snr")


_MODELS = "layer AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a}, {b}, {c}, {d}, {e})" for m, rows in velocity.MODELS.items() for a, b, c, d, e in rows) + ") v(model, top_depth, thickness, vp, vs, density))"


_DEPTHS = "z AS (SELECT depth, count(*) AS n FROM origin GROUP BY depth)"


@query(
    "SELECT model, k, top_depth, thickness, vp, vs, density, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_origins FROM (SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY top_depth) AS INTEGER) AS k, CAST(top_depth AS DOUBLE) AS top_depth, CAST(thickness AS DOUBLE) AS thickness, CAST(vp AS DOUBLE) AS vp, CAST(vs AS DOUBLE) AS vs, CAST(density AS DOUBLE) AS density FROM layer) l LEFT JOIN z ON z.depth >= top_depth AND (thickness <= 0 OR z.depth < top_depth + thickness) GROUP BY ALL",
    (ORIGINS, _DEPTHS, _MODELS),
)
def model_layers(spark, sf):
    """The standard models' layers, numbered by depth, and how many origins lie in each."""
    rows = velocity.layer_rows(spark, [velocity.Model.named(m) for m in velocity.MODELS])
    each = velocity.by_depth(rows).select("model", F.posexplode("layers").alias("k", "l"))
    each = each.select("model", (F.col("k") + 1).alias("k"), "l.top_depth", "l.thickness", "l.vp", "l.vs", "l.density")
    # Depths, not origins, meet the few layers.
    z = origins(spark, sf).groupBy("depth").agg(F.count("*").alias("n"))
    inside = (F.col("depth") >= F.col("top_depth")) & ((F.col("thickness") <= 0) | (F.col("depth") < F.col("top_depth") + F.col("thickness")))
    held = z.join(F.broadcast(each.select("model", "k", "top_depth", "thickness")), inside).groupBy("model", "k").agg(F.sum("n").alias("n_origins"))
    return each.join(held, ["model", "k"], "left").withColumn("n_origins", F.coalesce("n_origins", F.lit(0)))


@query(
    f"SELECT phase_class, d_bin, z_bin, round(sqrt(d_bin * d_bin + z_bin * z_bin) / CASE phase_class WHEN 'P' THEN 6.0 ELSE 3.5 END, 6) AS t, count(*) AS n_origins FROM (SELECT CAST(floor(least({haversine_sql('35.0::DOUBLE', '(-117.0)::DOUBLE', 'lat', 'lon')}, 20000)) AS INTEGER) AS d_bin, CAST(floor(depth) AS INTEGER) AS z_bin FROM origin) o, (VALUES ('P'), ('S')) p(phase_class) WHERE z_bin BETWEEN 0 AND 20 GROUP BY ALL",
    (ORIGINS,),
)
def straight_time_table(spark, sf):
    """The straight-ray table of a half-space at the whole kilometres at which origins down to 20 km lie from one station."""
    table = velocity.straight_rows(spark, 6.0, 3.5, max_km=20_000, max_depth=20)
    seen = origins(spark, sf).select(F.floor(F.least(geo.haversine_km(CLAT, CLON, "lat", "lon"), F.lit(20_000.0))).cast("int").alias("d_bin"), F.floor("depth").cast("int").alias("z_bin"))
    seen = seen.groupBy("d_bin", "z_bin").agg(F.count("*").alias("n_origins"))
    return table.join(seen, ["d_bin", "z_bin"]).select("phase_class", "d_bin", "z_bin", r("t").alias("t"), "n_origins")


@query(f"SELECT orid, round(sqrt(km * km + depth * depth) / 6.0, 6) AS seconds, round(sqrt(km * km + depth * depth), 6) AS hypo FROM (SELECT orid, depth, {haversine_sql('35.0::DOUBLE', '(-117.0)::DOUBLE', 'lat', 'lon')} AS km FROM origin) t WHERE km BETWEEN 555 AND 11100", (ORIGINS,))
def straight_rays_in_range(spark, sf):
    """Straight rays to the places in the range of body-wave magnitudes."""
    rows = origins(spark, sf).withColumn("km", geo.haversine_km(CLAT, CLON, "lat", "lon")).where(magnitude.in_range("km", "Mb"))
    return rows.select("orid", r(velocity.straight_ray("km", "depth", F.lit(6.0))).alias("seconds"), r(geo.hypocentral_km("km", "depth")).alias("hypo"))


_SPAN = "(SELECT min(ts) FROM samples)"


@query("SELECT event_id AS pick_id, vec_id, greatest(0, first) AS first_idx, least(64, stop) - greatest(0, first) AS n, round(list_sum(list_transform(embedding[greatest(0, first) + 1:least(64, stop)], lambda x: CAST(x AS DOUBLE))), 4) AS total FROM (SELECT p.pick_id AS event_id, s.vec_id, s.embedding, CAST(floor((p.time_us - 10000000 - s.start_us) / 1e6 * 0.001) AS BIGINT) AS first, CAST(floor((p.time_us + 60000000 - s.start_us) / 1e6 * 0.001) AS BIGINT) AS stop FROM picks p JOIN (SELECT vec_id, embedding, vec_id % 10 AS sid, 1704067200000000 + (vec_id // 10) * 64000000000 AS start_us FROM embeddings) s ON s.sid = p.user_id % 10 AND p.time_us + 60000000 > s.start_us AND p.time_us - 10000000 < s.start_us + 64000000000) t WHERE least(64, stop) > greatest(0, first)", (PICKS,))
def pick_windows(spark, sf):
    """The samples from 10 s before to 60 s after each pick, of streams with a sample every 1000 s."""
    v = F.col("vec_id")
    segments = arrays(spark, sf).select("vec_id", (v % 10).cast("string").alias("stream_id"), (F.lit(1_704_067_200_000_000) + F.floor(v / 10) * 64_000_000_000).alias("start_us"), F.lit(0.001).alias("sample_rate"), F.col("x").alias("samples"))
    p = picks(spark, sf).select("pick_id", F.col("sta").alias("stream_id"), "time_us")
    got = triggers.pick_windows(p, segments, ("stream_id",), -10.0, 60.0)
    return got.select("pick_id", "vec_id", F.col("first_idx").cast("long").alias("first_idx"), F.size("samples").cast("long").alias("n"), r(A.total("samples"), 4).alias("total"))


def _buffers(spark, sf):
    """Segments of 64 samples at 20 Hz, a second apart."""
    return arrays(spark, sf).select("vec_id", (F.col("vec_id") * 1_000_000).alias("start_us"), F.lit(20.0).alias("sample_rate"), F.col("x").alias("samples"))


@query("SELECT vec_id, vec_id * 1000000 + 2200000 AS start_us, 20::BIGINT AS n, round(list_sum(list_transform(embedding[45:64], lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def latest_samples(spark, sf):
    """The last second of each buffer."""
    got = triggers.latest(_buffers(spark, sf), 1.0)
    return got.select("vec_id", "start_us", F.size("samples").cast("long").alias("n"), r(A.total("samples"), 5).alias("total"))


@query("SELECT vec_id, CASE WHEN i > 0 AND i < 64 THEN 100000000 ELSE vec_id * 1000000 END AS start_us, CAST(CASE WHEN i > 0 AND i < 64 THEN 64 - i ELSE 64 END AS BIGINT) AS n FROM (SELECT vec_id, CAST(floor((100000000 - vec_id * 1000000) / 1e6 * 20) AS BIGINT) AS i FROM embeddings) t")
def trimmed_buffers(spark, sf):
    """Buffers without what comes before second 100."""
    return triggers.trimmed(_buffers(spark, sf), 100_000_000).select("vec_id", "start_us", F.size("samples").cast("long").alias("n"))


@query("SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY start_us, vec_id) AS INTEGER) AS k, vec_id, start_us FROM (SELECT vec_id, vec_id % 10 AS stream_id, (vec_id * 7919 % 1000) * 1000000 AS start_us FROM embeddings) t")
def playback_order(spark, sf):
    """Segments in the order in which they are played."""
    v = F.col("vec_id")
    rows = arrays(spark, sf).select("vec_id", (v % 10).alias("stream_id"), ((v * 7919 % 1000) * 1_000_000).alias("start_us"))
    return triggers.played(rows, ("stream_id",), ("start_us", "vec_id")).select("stream_id", "k", "vec_id", "start_us")


# Codes


@query("SELECT pick_id, phase AS name, CASE WHEN phase IN ('P', 'S', 'Pn', 'Sn', 'Pg', 'Sg', 'Lg') THEN phase ELSE '?' END AS known, phase IN ('P', 'Pn', 'Pg') AS is_p FROM picks", (PICKS,))
def phase_names(spark, sf):
    return picks(spark, sf).select("pick_id", F.col("phase").alias("name"), codes.phase("phase").alias("known"), codes.is_p("phase").alias("is_p"))


_KIND = "['ML', 'Mw', 'Mb', 'Ms', 'Md', 'Mx'][orid % 6 + 1]"
_SIZE = "(orid % 90) / 10.0"


@query(f"SELECT orid, CASE WHEN {_KIND} = 'Mx' THEN 'M?' ELSE {_KIND} END AS kind, CASE WHEN {_SIZE} >= 7 THEN 'major' WHEN {_SIZE} >= 6 THEN 'strong' WHEN {_SIZE} >= 5 THEN 'moderate' WHEN {_SIZE} >= 4 THEN 'light' WHEN {_SIZE} >= 3 THEN 'minor' ELSE 'micro' END AS class FROM origin", (ORIGINS,))
def magnitude_names(spark, sf):
    kind = F.get(F.array(*map(F.lit, ("ML", "Mw", "Mb", "Ms", "Md", "Mx"))), (F.col("orid") % 6).cast("int"))
    return origins(spark, sf).select("orid", codes.magnitude_type(kind).alias("kind"), codes.magnitude_class((F.col("orid") % 90) / 10.0).alias("class"))


# Magnitudes of stations


@query("SELECT evid, 'Md' AS magtype, round(list_sort(list(m))[CAST(floor(count(*) / 2) AS INTEGER) + 1], 6) AS magnitude, count(*) AS nsta FROM (SELECT orid % 500 AS evid, CASE WHEN delta > 20 THEN -1 + 2 * log10(delta) + 0.0035 * (l_suppkey * 10) END AS m FROM assoc) t WHERE m IS NOT NULL GROUP BY evid", (ASSOC,))
def duration_magnitudes(spark, sf):
    """Durations of 20 s or less count as none."""
    seconds = F.when(F.col("delta") > 20, F.col("delta"))
    rows = assoc(spark, sf).select((F.col("orid") % 500).alias("event_id"), F.lit("n").alias("net"), "sta", (F.col("l_suppkey") * 10).cast("double").alias("distance"), seconds.alias("duration_s"))
    out = network(magnitude.duration_stations(rows), ["event_id", "magtype"])
    return out.select(F.col("event_id").alias("evid"), "magtype", r("magnitude").alias("magnitude"), "nsta")


@query(
    "SELECT vec_id, round(log10(a / 1000.0) + CASE WHEN deg < 20 THEN 5.9 + 0.05 * deg WHEN deg < 100 THEN 6.9 + 0.0015 * deg ELSE 7.0 END - 0.005 * (10.0 - 33), 6) AS magnitude FROM (SELECT vec_id, km / 111.195 AS deg, list_max(list_transform(embedding[first + 1:first + 50], lambda x: abs(CAST(x AS DOUBLE)))) AS a FROM (SELECT e.vec_id, e.embedding, s.km, 0 AS first FROM embeddings e JOIN (SELECT station_id, " + TO_STATION.replace("slat", "lat").replace("slon", "lon") + " AS km FROM stations) s ON s.station_id = e.vec_id % 10 + 1) t WHERE km BETWEEN 555 AND 11100) u",
    (STATIONS,),
)
def body_wave_magnitudes(spark, sf):
    """mb of segments that begin with the computed P, of one event for each segment."""
    v = F.col("vec_id")
    s = stations(spark, sf).select("net", "sta", "lat", "lon", "station_id")
    rows = arrays(spark, sf).join(s, s.station_id == v % 10 + 1).withColumn("km", geo.haversine_km(CLAT, CLON, "lat", "lon"))
    origin = rows.select(v.alias("event_id"), (v * 100_000_000_000).alias("time_us"), F.lit(CLAT).alias("lat"), F.lit(CLON).alias("lon"), F.lit(10.0).alias("depth"))
    # Half a sample late, so that the window's ends are not on a sample's edge.
    begin = v * 100_000_000_000 + F.round(F.col("km") / 8.0 * 1e6).cast("long") - 50_000
    segments = rows.select("net", "sta", F.lit("BHZ").alias("chan"), begin.alias("start_us"), F.lit(10.0).alias("sample_rate"), F.col("x").alias("samples"))
    got = magnitude.body_stations(origin, segments, s.select("net", "sta", "lat", "lon"))
    return got.select(F.col("event_id").alias("vec_id"), r("magnitude").alias("magnitude"))


def _drawn_together(spark, sf, name: str):
    """Origins or stations with their places within nine degrees of one."""
    rows = origins(spark, sf).select(F.col("orid").alias("event_id"), (F.col("time") * 1e6).cast("long").alias("time_us"), "lat", "lon", "depth") if name == "origins" else stations(spark, sf).select("net", "sta", "lat", "lon", "station_id")
    return rows.withColumns({"lat": F.col("lat") / 20, "lon": F.col("lon") / 20})


def recordings(spark, sf, rate: float, offset_s: int):
    """Embeddings as waveforms: 768 samples of ten stations in turn, each on a day of the orders', some seconds after midnight."""
    v = F.col("vec_id")
    start = (F.lit(8035) + v * 7919 % 2400) * 86_400_000_000 + (offset_s + v % 60) * 1_000_000 + 250_000
    rows = arrays(spark, sf).select((v % 10 + 1).alias("station_id"), start.alias("start_us"), F.flatten(F.array_repeat("x", 12)).alias("samples"))
    return rows.join(stations(spark, sf), "station_id").select("net", "sta", F.lit("BHZ").alias("chan"), "start_us", F.lit(rate).alias("sample_rate"), "samples")


def _station_magnitudes(f, spark, sf, rate, offset_s):
    got = f(_drawn_together(spark, sf, "origins"), recordings(spark, sf, rate, offset_s), _drawn_together(spark, sf, "stations"))
    return got.select("event_id", "net", "sta", r("distance", 4).alias("distance"), r("magnitude", 4).alias("magnitude"))


@query()
def local_magnitudes(spark, sf):
    """ML of every origin at every station within range that recorded its S wave."""
    return _station_magnitudes(magnitude.local_stations, spark, sf, 10.0, 0)


@query()
def moment_magnitudes(spark, sf):
    """Mw of the same, from five seconds of S."""
    return _station_magnitudes(magnitude.moment_stations, spark, sf, 20.0, 0)


@query()
def surface_magnitudes(spark, sf):
    """Ms of origins and stations all over the globe."""
    o = origins(spark, sf).select(F.col("orid").alias("event_id"), (F.col("time") * 1e6).cast("long").alias("time_us"), "lat", "lon", "depth")
    got = magnitude.surface_stations(o, recordings(spark, sf, 0.5, 1800), stations(spark, sf))
    return got.select("event_id", "net", "sta", r("distance", 4).alias("distance"), r("magnitude", 4).alias("magnitude"))


# Stores and reports


@query("SELECT o.orid, o.evid, round(o.lat, 6) AS lat, o.time, e.prefor = o.orid AS preferred, CAST((SELECT count(*) FROM origin) + 1 AS BIGINT) AS next_id, '3.0' AS version FROM (SELECT row_number() OVER (ORDER BY orid) AS n, * FROM origin) o JOIN event e ON e.evid = o.evid", (EVENTS,))
def stored_rows(spark, sf):
    """Origins and events stored in two commits and read back, with the next id and the schema's version."""
    c = catalog.Catalog(spark, scratch(spark, "catalog"))
    c.create()
    rows = origins(spark, sf)
    c.store({"event": events(spark, sf).select("evid", "evname", "prefor", "auth")})
    c.store({"origin": rows.select("orid", "evid", "lat", "lon", "depth", "time")})
    both = c.table("origin").join(c.table("event").select("evid", "prefor"), "evid")
    number = c.table("origin").agg(F.count("*").alias("n"))
    return both.join(number).select("orid", "evid", r("lat").alias("lat"), "time", (F.col("prefor") == F.col("orid")).alias("preferred"), (F.col("n") + 1).alias("next_id"), F.lit(c.version()).alias("version"))


@query(
    "SELECT 'origin' AS name, count(*) AS n, max(orid) AS last FROM origin UNION ALL SELECT 'assoc', count(*), max(a.arid) FROM assoc a UNION ALL SELECT 'event', count(DISTINCT orid), max(orid) FROM origin UNION ALL SELECT 'netmag', count(*), max(orid) FROM (SELECT DISTINCT orid FROM assoc) t",
    (ORIGINS, ASSOC),
)
def complete_events(spark, sf):
    """Located events, their arrivals and magnitudes as all tables at once, stored in one commit and read back."""
    o = origins(spark, sf).select(F.col("orid").alias("event_id"), "orid", (F.col("time") * 1e6).cast("long").alias("time_us"), "lat", "lon", "depth", *(F.lit(1.0).alias(c) for c in ("lat_err", "lon_err", "depth_err", "time_err", "rms")), F.lit(4).alias("phase_count"), F.lit(False).alias("fixed"), F.lit("GridSearch").alias("algorithm"))
    a = assoc(spark, sf)
    seen = a.select("arid", "orid", "sta", F.lit("P").alias("phase"), F.col("delta").alias("distance"), F.lit(0.0).alias("azimuth"), F.col("timeres").alias("residual"), F.col("wgt").alias("weight"), F.lit(True).alias("used"))
    p = a.select(F.col("arid").alias("pick_id"), "sta", F.lit("BHZ").alias("chan"), (F.col("time") * 1e6).cast("long").alias("time_us"), F.lit("P").alias("phase"), F.lit(0.1).alias("uncertainty"), F.col("amp").alias("amplitude"), F.lit(1.0).alias("period"), F.lit(5.0).alias("snr"), F.lit(0).alias("quality"))
    mags = a.groupBy(F.col("orid").alias("event_id")).agg(F.max("amp").alias("magnitude")).select("event_id", F.col("event_id").alias("magid"), F.lit("ML").alias("magtype"), F.lit(1).alias("nsta"), "magnitude", F.lit(0.1).alias("uncertainty"))
    each = a.select(F.col("orid").alias("event_id"), "sta", F.col("delta").alias("distance"), F.lit("ML").alias("magtype"), F.col("amp").alias("magnitude"))
    c = catalog.Catalog(spark, scratch(spark, "events"))
    c.create()
    c.store(catalog.complete_event(o, seen, p, mags, each, "iasp91"))
    out = None
    for name, key in (("origin", "orid"), ("assoc", "arid"), ("event", "evid"), ("netmag", "orid")):
        rows = c.table(name).agg(F.count("*").alias("n"), F.max(key).alias("last")).select(F.lit(name).alias("name"), "n", "last")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"SELECT net AS network, sta AS station, round(lat, 4) AS latitude, round(lon, 4) AS longitude, elev_m AS elevation, round({haversine_sql('35.0::DOUBLE', '(-117.0)::DOUBLE', 'lat', 'lon')}, 6) AS distance_km FROM stations", (STATIONS,))
def station_report(spark, sf):
    """The stations' report written as CSV and read again."""
    path = scratch(spark, "report")
    reports.write(reports.station_report(stations(spark, sf), CLAT, CLON), "stations", path)
    kinds = "network string, station string, latitude double, longitude double, elevation double, distance_km double"
    got = spark.read.csv(f"{path}/stations", header=True, schema=kinds)
    return got.select("network", "station", r("latitude", 4).alias("latitude"), r("longitude", 4).alias("longitude"), "elevation", r("distance_km").alias("distance_km"))


@query("SELECT printf('%d %s lat %.4f lon %.4f depth %.2f km', evid, strftime(ts, '%Y-%m-%d %H:%M:%S'), lat, lon, depth) AS value FROM origin", (ORIGINS,))
def event_summaries(spark, sf):
    return catalog.summary_text(origins(spark, sf))


@query("SELECT CAST(t.sample AS INTEGER) AS sample, t.station, round(t.ratio, 6) AS ratio FROM (SELECT stream_id AS station, idx AS sample, ratio FROM r) t", (SAMPLES, DEMEANED, STALTA))
def ratio_report(spark, sf):
    """The STA/LTA traces as a report's rows."""
    rows = triggers.block_ratios(samples(spark, sf), S, STA, LTA).withColumn("distance_km", F.lit(0.0))
    return reports.ratio_report(rows, "stream_id").select(F.col("sample").cast("int").alias("sample"), "station", r("ratio").alias("ratio"))
