"""Queries over sample streams: sliding measures, triggers, pickers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import frames, signal, triggers
from ..operators.signal import Stream
from .registry import query
from .tables import ARRAYS, SAMPLES, arrays, exploded, read, samples

S = Stream()
STA, LTA, ON, OFF = 3, 10, 2.0, 0.8
FRAME = "(PARTITION BY stream_id ORDER BY idx ROWS BETWEEN {} AND {})"
P = "PRECEDING"


def frame(first: int, last: int) -> str:
    name = lambda k: f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING" if k > 0 else "CURRENT ROW"
    return f"OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN {name(first)} AND {name(last)})"


RATIO = f"CASE WHEN idx >= {LTA} AND l > 1e-10 THEN s / l ELSE 0.0 END"
DEMEANED = "d AS (SELECT *, value - avg(value) OVER (PARTITION BY stream_id) AS x FROM samples)"
STALTA = f"w AS (SELECT *, avg(x * x) {frame(-(STA - 1), 0)} AS s, avg(x * x) {frame(-(LTA - 1), 0)} AS l FROM d), r AS (SELECT *, {RATIO} AS ratio FROM w)"
MARKS = f"""m AS (SELECT *, CASE WHEN ratio >= {ON} THEN 1 WHEN ratio < {OFF} THEN 0 END AS mark FROM r),
st AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM m),
pr AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY stream_id ORDER BY idx), 0) AS before FROM st),
isl AS (SELECT *, sum(CASE WHEN state = 1 AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island, state = 0 AND before = 1 AS ends FROM pr),
trig AS (SELECT stream_id, CAST(min(idx) AS BIGINT) AS on_idx, CAST(max(CASE WHEN ends THEN idx END) AS BIGINT) AS off_idx, max(CASE WHEN state = 1 THEN ratio END) AS peak FROM isl WHERE state = 1 OR ends GROUP BY stream_id, island HAVING max(CASE WHEN ends THEN idx END) IS NOT NULL)"""


@query(f"SELECT stream_id, on_idx, off_idx, round(peak, 6) AS peak FROM trig", (SAMPLES, DEMEANED, STALTA, MARKS))
def stalta_triggers(spark, sf):
    out = triggers.stalta_triggers(samples(spark, sf), S, STA, LTA, ON, OFF)
    return out.select("stream_id", "on_idx", "off_idx", F.round("peak", 6).alias("peak"))


@query("SELECT stream_id, idx, round(ratio, 6) AS ratio FROM r", (SAMPLES, DEMEANED, STALTA))
def stalta_ratio(spark, sf):
    return triggers.block_ratios(samples(spark, sf), S, STA, LTA).select("stream_id", "idx", F.round("ratio", 6).alias("ratio"))


@query(f"""SELECT stream_id, idx, round(ratio, 5) AS ratio FROM rec""", ("RECURSIVE " + SAMPLES, f"""rec AS (
SELECT stream_id, idx, value * value AS long, value * value AS short, 0.0::DOUBLE AS ratio FROM samples WHERE idx = 0
UNION ALL
SELECT stream_id, idx, long, short, CASE WHEN idx < {LTA} OR long <= 1e-10 THEN 0.0 ELSE short / long END FROM (
  SELECT s.stream_id, s.idx, CASE WHEN s.idx < {LTA} THEN r.long + (s.value * s.value - r.long) / (s.idx + 1) ELSE r.long + (s.value * s.value - r.long) / {LTA}.0 END AS long,
    CASE WHEN s.idx < {LTA} THEN r.long + (s.value * s.value - r.long) / (s.idx + 1) ELSE r.short + (s.value * s.value - r.short) / {STA}.0 END AS short
  FROM rec r JOIN samples s ON s.stream_id = r.stream_id AND s.idx = r.idx + 1) t)"""))  # fmt: skip
def recursive_stalta(spark, sf):
    return frames.recursive_sta_lta(samples(spark, sf), S, STA, LTA, signal.TINY_LTA).select("stream_id", "idx", F.round("ratio", 5).alias("ratio"))


def _moments(w: int, value: str = "value") -> tuple[str, str]:
    """Two passes over each frame: its mean, then the powers of the distances from it."""
    p = f"p AS (SELECT stream_id, idx, list({value}) {frame(-w, -1)} AS l FROM samples)"
    power = lambda k: f"list_sum(list_transform(l, lambda x: pow(x - list_avg(l), {k}))) / {w} AS m{k}"
    return p, f"q AS (SELECT stream_id, idx, {power(2)}, {power(3)}, {power(4)} FROM p)"


KURT = "CASE WHEN idx >= 20 AND m2 > 1e-20 THEN m4 / (m2 * m2) - 3.0 ELSE 0.0 END"
SKEW = "CASE WHEN idx >= 20 AND m2 > 1e-20 THEN m3 / (m2 * sqrt(m2)) ELSE 0.0 END"


def _sliding(spark, sf, column: str, offset: float = 0.0):
    rows = samples(spark, sf).withColumn("value", F.col("value") + offset)
    return frames.sliding_moments(rows, S, 20).select("stream_id", "idx", F.round(column, 4).alias(column))


@query(f"SELECT stream_id, idx, round({KURT}, 4) AS kurtosis FROM q", (SAMPLES, *_moments(20)))
def sliding_kurtosis(spark, sf):
    return _sliding(spark, sf, "kurtosis")


@query(f"SELECT stream_id, idx, round({SKEW}, 4) AS skewness FROM q", (SAMPLES, *_moments(20)))
def sliding_skewness(spark, sf):
    return _sliding(spark, sf, "skewness")


@query(f"SELECT stream_id, idx, round(sqrt(pow({KURT}, 2) + pow({SKEW}, 2)), 4) AS hos FROM q", (SAMPLES, *_moments(20)))
def higher_order_stats(spark, sf):
    return _sliding(spark, sf, "hos")


@query(f"SELECT stream_id, idx, round(sqrt(pow({KURT}, 2) + pow({SKEW}, 2)), 4) AS hos FROM q", (SAMPLES, *_moments(20, "value + 100000")))
def higher_order_of_raw_counts(spark, sf):
    """The same of samples with an offset of 100,000 counts, as digitisers have."""
    return _sliding(spark, sf, "hos", 100_000.0)


@query("SELECT stream_id, idx, round(CASE WHEN idx >= 10 AND f > 1e-20 THEN n / f ELSE 0.0 END, 6) AS energy_ratio FROM p", (SAMPLES, f"p AS (SELECT *, sum(value * value) {frame(-5, -1)} AS n, sum(value * value) {frame(-10, -6)} AS f FROM samples)"))
def energy_ratio(spark, sf):
    got = frames.in_blocks(samples(spark, sf), S, 10, lambda s: {"energy_ratio": signal.energy_ratio(s, 5)})
    return got.select("stream_id", "idx", F.round("energy_ratio", 6).alias("energy_ratio"))


@query("SELECT stream_id, idx, round(sum(CASE WHEN sd > 1e-20 THEN (e - m) / sd ELSE 0.0 END) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS z FROM p", (SAMPLES, "p AS (SELECT *, value * value AS e, avg(value * value) OVER (PARTITION BY stream_id) AS m, stddev_pop(value * value) OVER (PARTITION BY stream_id) AS sd FROM samples)"))
def z_detector(spark, sf):
    return frames.z_detector(samples(spark, sf), S).select("stream_id", "idx", F.round("z", 6).alias("z"))


@query(f"SELECT stream_id, idx, round(avg(abs(value)) {frame(-9, 0)}, 6) AS envelope FROM samples", (SAMPLES,))
def moving_envelope(spark, sf):
    got = frames.in_blocks(samples(spark, sf), S, 10, lambda s: {"envelope": signal.moving_envelope(s)})
    return got.select("stream_id", "idx", F.round("envelope", 6).alias("envelope"))


THREE = """c AS (SELECT user_id % 10 AS stream_id, event_type, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY ts, event_id) - 1 AS idx, value FROM events WHERE event_type IN ('click', 'purchase', 'view')),
three AS (SELECT stream_id, CAST(idx AS BIGINT) AS idx, max(CASE WHEN event_type = 'click' THEN value END) AS z, max(CASE WHEN event_type = 'purchase' THEN value END) AS n, max(CASE WHEN event_type = 'view' THEN value END) AS e FROM c GROUP BY 1, 2 HAVING count(*) = 3)"""
_W = 8
_COV = ", ".join(f"sum({a} * {b}) {frame(-_W, -1)} / {_W} - (sum({a}) {frame(-_W, -1)} / {_W}) * (sum({b}) {frame(-_W, -1)} / {_W}) AS {a}{b}" for a, b in ("zz", "nn", "ee", "zn", "ze", "ne"))
_SUMS = "cv AS (SELECT *, " + _COV + " FROM three), iv AS (SELECT *, zz + nn + ee AS i1, zz * nn + zz * ee + nn * ee - zn * zn - ze * ze - ne * ne AS i2 FROM cv)"
RECT = f"CASE WHEN idx >= {_W} AND i1 > 1e-20 THEN greatest(0.0, least(1.0, 1.0 - 2.0 * sqrt(greatest(i2, 0.0)) / i1)) ELSE 0.0 END"


def three_components(spark, sf):
    """Three kinds of events as vertical, north and east of ten stations."""
    e = read(spark, sf, "events").where(F.col("event_type").isin("click", "purchase", "view"))
    w = Window.partitionBy("stream_id", "event_type").orderBy("ts", "event_id")
    e = e.withColumn("stream_id", F.col("user_id") % 10).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    wide = e.groupBy("stream_id", "idx").pivot("event_type", ["click", "purchase", "view"]).agg(F.max("value"))
    return wide.select("stream_id", "idx", F.col("click").alias("z"), F.col("purchase").alias("n"), F.col("view").alias("e")).dropna()


@query(f"SELECT stream_id, idx, round({RECT}, 5) AS rect FROM iv", (THREE, _SUMS))
def rectilinearity_3c(spark, sf):
    got = frames.in_blocks(three_components(spark, sf), S, _W, lambda s: {"rect": signal.rectilinearity(s, "z", "n", "e", _W)})
    return got.select("stream_id", "idx", F.round("rect", 5).alias("rect"))


@query(f"SELECT stream_id, idx, round(CASE WHEN idx >= {_W} THEN sqrt((sum(z * z) {frame(-_W, -1)} + sum(n * n) {frame(-_W, -1)} + sum(e * e) {frame(-_W, -1)}) / {_W}) ELSE 0.0 END, 5) AS amplitude FROM three", (THREE,))
def polarization_amplitude(spark, sf):
    got = frames.in_blocks(three_components(spark, sf), S, _W, lambda s: {"amplitude": signal.polarization_amplitude(s, "z", "n", "e", _W)})
    return got.select("stream_id", "idx", F.round("amplitude", 5).alias("amplitude"))


@query(
    f"SELECT stream_id, idx, round(coupled, 5) AS coupled, coupled >= 0.5 AND rect >= 0.2 AS fires FROM (SELECT stream_id, idx, {RECT} AS rect, (CASE WHEN idx >= 10 AND l > 1e-20 THEN s / l ELSE 0.0 END) * ({RECT}) AS coupled FROM (SELECT *, avg(z * z) {frame(-2, 0)} AS s, avg(z * z) {frame(-9, 0)} AS l FROM iv) t) u",
    (THREE, _SUMS),
)
def coupled_3c(spark, sf):
    both = lambda s: {"rect": signal.rectilinearity(s, "z", "n", "e", _W), "ratio": signal.sta_lta(s, 3, 10, F.col("z"), tiny=1e-20)}
    rows = frames.in_blocks(three_components(spark, sf), S, 10, both)
    coupled = F.col("ratio") * F.col("rect")
    return rows.select("stream_id", "idx", F.round(coupled, 5).alias("coupled"), ((coupled >= 0.5) & (F.col("rect") >= 0.2)).alias("fires"))


AIC = """pre AS (SELECT *, count(*) OVER (PARTITION BY stream_id) AS n, sum(value) OVER b AS s1, sum(value * value) OVER b AS s2, sum(value) OVER (PARTITION BY stream_id) AS t1, sum(value * value) OVER (PARTITION BY stream_id) AS t2 FROM samples WINDOW b AS (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aic AS (SELECT stream_id, idx, n, CASE WHEN idx > 0 AND idx < n - 1 THEN idx * ln(greatest(s2 / idx - pow(s1 / idx, 2), 1e-20)) + (n - idx - 1) * ln(greatest((t2 - s2) / (n - idx) - pow((t1 - s1) / (n - idx), 2), 1e-20)) ELSE 0.0 END AS aic FROM pre)"""


@query("SELECT stream_id, idx, round(aic, 5) AS aic FROM aic", (SAMPLES, AIC))
def aic_curve(spark, sf):
    return frames.aic_curve(samples(spark, sf), S).select("stream_id", "idx", F.round("aic", 5).alias("aic"))


@query("SELECT stream_id, arg_min(idx, round(aic, 5) * 1000000 + idx) AS idx, round(min(aic), 5) AS aic FROM aic WHERE idx >= 5 AND idx < n - 5 GROUP BY stream_id", (SAMPLES, AIC))
def aic_curve_argmin(spark, sf):
    rows = frames.aic_curve(samples(spark, sf), S)
    inner = rows.where((F.col("idx") >= 5) & (F.col("idx") < F.col("n") - 5)).withColumn("key", F.round("aic", 5) * 1000000 + F.col("idx"))
    return inner.groupBy("stream_id").agg(F.min_by("idx", "key").alias("idx"), F.round(F.min("aic"), 5).alias("aic"))


@query("SELECT stream_id, idx, round(a / b, 6) AS energy_ratio FROM p WHERE idx >= 8 AND idx < n - 8 AND (idx - 8) % 2 = 0 AND b > 1e-20 AND a / b > 2.25", (SAMPLES, f"p AS (SELECT *, count(*) OVER (PARTITION BY stream_id) AS n, sum(value * value) {frame(0, 7)} AS a, sum(value * value) {frame(-8, -1)} AS b FROM samples)"))
def aic_candidates(spark, sf):
    return frames.aic_candidates(samples(spark, sf), S, 8, 1.5).select("stream_id", "idx", F.round("energy_ratio", 6).alias("energy_ratio"))


@query(f"SELECT t.stream_id, t.on_idx, round(max(abs(s.value)), 6) AS amplitude FROM trig t JOIN samples s ON s.stream_id = t.stream_id AND s.idx BETWEEN t.on_idx AND t.on_idx + 4 GROUP BY ALL", (SAMPLES, DEMEANED, STALTA, MARKS))
def pick_amplitude(spark, sf):
    rows = samples(spark, sf)
    found = triggers.stalta_triggers(rows, S, STA, LTA, ON, OFF).select("stream_id", "on_idx")
    loud = frames.loudest_ahead(rows, S, 5).select("stream_id", F.col("idx").alias("on_idx"), F.round("loud", 6).alias("amplitude"))
    return found.join(loud, ["stream_id", "on_idx"])


@query(
    "SELECT stream_id, (min(idx) - min(p)) / 2.0 AS duration_s FROM (SELECT *, max(abs(value)) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS loud, sqrt(avg(CASE WHEN idx >= 10 AND idx < 20 THEN value * value END) OVER (PARTITION BY stream_id)) AS noise, 20 AS p FROM samples) t WHERE idx >= 22 AND loud < 1.5 * noise GROUP BY stream_id",
    (SAMPLES,),
)
def coda_duration(spark, sf):
    return triggers.coda_duration(samples(spark, sf), S, 2.0, F.lit(20))


@query(
    "SELECT stream_id, picked AS pick_idx FROM (SELECT stream_id, unnest(list) AS picked FROM kept)",
    (
        "RECURSIVE " + SAMPLES,
        "loud AS (SELECT stream_id, idx, row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS k FROM samples WHERE value > 20)",
        "walk AS (SELECT stream_id, k, idx AS last, [idx] AS list FROM loud WHERE k = 1 UNION ALL SELECT l.stream_id, l.k, CASE WHEN l.idx - w.last >= 4 THEN l.idx ELSE w.last END, CASE WHEN l.idx - w.last >= 4 THEN list_append(w.list, l.idx) ELSE w.list END FROM walk w JOIN loud l ON l.stream_id = w.stream_id AND l.k = w.k + 1)",
        "kept AS (SELECT stream_id, arg_max(list, k) AS list FROM walk GROUP BY stream_id)",
    ),
)
def minimum_gap(spark, sf):
    loud = samples(spark, sf).where("value > 20").select("stream_id", F.col("idx").alias("pick_idx"))
    return frames.minimum_gap(loud, ("stream_id",), "pick_idx", 4)


@query("SELECT stream_id, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max, max(abs(value)) AS abs_max, count(*) AS n FROM samples GROUP BY stream_id", (SAMPLES,))
def sample_stats(spark, sf):
    return samples(spark, sf).groupBy("stream_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.max(F.abs("value")).alias("abs_max"), F.count("*").alias("n"))


@query("SELECT stream_id, idx, round(sum(CASE WHEN idx = 0 THEN value ELSE value / 4.0 END) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS y FROM samples", (SAMPLES,))
def integrate(spark, sf):
    return frames.integrate(samples(spark, sf), S, 4.0).select("stream_id", "idx", F.round("y", 6).alias("y"))


@query("SELECT stream_id, idx, round(CASE WHEN idx > 0 THEN (value - lag(value) OVER w) * 4.0 ELSE coalesce((lead(value) OVER w - value) * 4.0, 0.0) END, 6) AS y FROM samples WINDOW w AS (PARTITION BY stream_id ORDER BY idx)", (SAMPLES,))
def differentiate(spark, sf):
    return frames.differentiate(samples(spark, sf), S, 4.0).select("stream_id", "idx", F.round("y", 6).alias("y"))


def _array_query(expression):
    def run(spark, sf):
        return exploded(arrays(spark, sf).select("vec_id", expression().alias("y")))

    return run


@query("SELECT vec_id, idx, round(x - avg(x) OVER (PARTITION BY vec_id), 6) AS y FROM arr", (ARRAYS,))
def demean(spark, sf):
    return _array_query(lambda: A.demean("x"))(spark, sf)


@query("SELECT vec_id, idx, round(x - (regr_intercept(x, idx) OVER w + regr_slope(x, idx) OVER w * idx), 6) AS y FROM arr WINDOW w AS (PARTITION BY vec_id)", (ARRAYS,))
def detrend(spark, sf):
    return _array_query(lambda: A.detrend("x"))(spark, sf)


@query("SELECT vec_id, idx, round(x / max(abs(x)) OVER (PARTITION BY vec_id), 6) AS y FROM arr", (ARRAYS,))
def normalize(spark, sf):
    return _array_query(lambda: A.normalize("x"))(spark, sf)


@query("SELECT vec_id, idx, round(x * CASE WHEN idx < m THEN 0.5 * (1 - cos(pi() * idx / m)) ELSE 1 END * CASE WHEN n - 1 - idx < m THEN 0.5 * (1 - cos(pi() * (n - 1 - idx) / m)) ELSE 1 END, 6) AS y FROM (SELECT *, greatest(1, floor(n * 0.05)) AS m FROM arr) t", (ARRAYS,))
def taper(spark, sf):
    return _array_query(lambda: A.taper("x"))(spark, sf)


@query("SELECT vec_id, CAST(k AS BIGINT) AS idx, round(CASE WHEN floor(k * 1.5) + 1 < 64 THEN CAST(embedding[CAST(floor(k * 1.5) AS INTEGER) + 1] AS DOUBLE) * (1 - (k * 1.5 - floor(k * 1.5))) + CAST(embedding[CAST(floor(k * 1.5) AS INTEGER) + 2] AS DOUBLE) * (k * 1.5 - floor(k * 1.5)) ELSE CAST(embedding[64] AS DOUBLE) END, 6) AS y FROM (SELECT vec_id, embedding, unnest(range(0, 42)) AS k FROM embeddings) t")
def resample(spark, sf):
    return _array_query(lambda: A.resample("x", 1.5))(spark, sf)


@query("SELECT vec_id, idx - 10 AS idx, round(x, 6) AS y FROM arr WHERE idx >= 10 AND idx < 20", (ARRAYS,))
def slice_window(spark, sf):
    return _array_query(lambda: A.time_slice("x", F.lit(10), F.lit(20)))(spark, sf)


@query("SELECT CAST(label AS BIGINT) AS label, CAST(k // 10 AS BIGINT) + 1 AS segment_id, CAST(min(k) * 3200000 + (k // 10) * 1000000 AS BIGINT) AS start_us, count(*) * 64 AS n, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 3) AS total FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings) t GROUP BY label, k // 10")
def merged_waveforms(spark, sf):
    """Segments of one network, each right after the one before but for a second's gap after every tenth."""
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    rows = arrays(spark, sf).withColumn("k", k).select(F.col("label").alias("stream_id"), (F.col("k") * 3_200_000 + F.floor(F.col("k") / 10) * 1_000_000).alias("start_us"), F.lit(20.0).alias("sample_rate"), F.lit(64).alias("n"), F.col("x").alias("samples"))
    got = triggers.merged_segments(rows)
    return got.select(F.col("stream_id").alias("label"), "segment_id", "start_us", F.size("samples").cast("long").alias("n"), F.round(A.total("samples"), 3).alias("total"))


@query(
    "SELECT stream_id, CAST(segment AS BIGINT) AS segment_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM (SELECT stream_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY stream_id ORDER BY ts, event_id) <= 14400000000 THEN 0 ELSE 1 END AS fresh FROM samples) t) u GROUP BY 1, 2",
    (SAMPLES,),
)
def gap_segments(spark, sf):
    """A segment ends where the next sample is over four hours away: samples of two hours, give or take two."""
    rows = samples(spark, sf).select("stream_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"), F.lit(1 / 7200).alias("sample_rate"), F.lit(1).alias("n"))
    rows = triggers.gap_segments(rows, tolerance=1.0)
    return rows.groupBy("stream_id", "segment_id").agg(F.count("*").alias("n"), F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"))


@query(
    "SELECT stream_id, count(*) AS n, min(us) AS first_us FROM (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT stream_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY stream_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM samples) t) u GROUP BY stream_id, g",
    (SAMPLES,),
)
def session_swarm(spark, sf):
    """Swarms: sessions of events with less than six hours between them."""
    rows = read(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = rows.groupBy("stream_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"))
    return out.select("stream_id", "n", "first_us")


@query("SELECT stream_id, epoch_us(time_bucket(INTERVAL 1 day, ts)) AS start_us, count(*) AS n, round(avg(value), 6) AS mean FROM samples GROUP BY 1, 2", (SAMPLES,))
def stream_rates(spark, sf):
    rows = read(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = rows.groupBy("stream_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select("stream_id", F.unix_micros("w.start").alias("start_us"), "n", "mean")
