"""Queries that run numpy kernels; their SQL spells the same sums and recursions out, where it can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import associate, locate, pickers, velocity
from .registry import query
from .tables import ARRAYS, arrays, exploded, pick_stations, picks

RATE = 20.0
#: Samples of a segment of the test tables.
N = 64


def _kernel(spark, sf, f, rows: bool = True):
    return exploded(arrays(spark, sf).select("vec_id", kernels.per_segment(f, "x", rows=rows).alias("y")))


# A filter in SQL: the recursion from sample to sample, forward and then back.


def _recursion(name: str, source: str, b: list[float], a: list[float]) -> str:
    """name: vec_id, idx, y and the states of the filtered source (vec_id, idx, x)."""
    n = len(a) - 1

    def row(x: str, z: list[str]) -> str:
        y = f"({b[0]!r} * {x} + {z[0]})"
        states = [f"{b[k + 1]!r} * {x} + {z[k + 1] if k + 1 < n else '0.0::DOUBLE'} - ({a[k + 1]!r}) * {y} AS z{k}" for k in range(n)]
        return ", ".join([f"{y} AS y", *states])

    return f"{name} AS (SELECT vec_id, idx, {row('x', ['0.0::DOUBLE'] * n)} FROM {source} WHERE idx = 0 UNION ALL SELECT s.vec_id, s.idx, {row('s.x', [f'f.z{k}' for k in range(n)])} FROM {name} f JOIN {source} s ON s.vec_id = f.vec_id AND s.idx = f.idx + 1)"


def _both_ways(name: str, source: str, low: float, high: float, rate: float) -> list[str]:
    """CTEs that end with name: vec_id, idx, y."""
    b, a = ([float(v) for v in c] for c in kernels.butterworth(2, rate, low, high))
    return [_recursion(f"{name}_f", source, b, a), f"{name}_r AS (SELECT vec_id, {N - 1} - idx AS idx, y AS x FROM {name}_f)", _recursion(f"{name}_b", f"{name}_r", b, a), f"{name} AS (SELECT vec_id, {N - 1} - idx AS idx, y FROM {name}_b)"]


_DFT = "dft AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * idx / 64)) AS re, -sum(x * sin(2 * pi() * k * idx / 64)) AS im FROM arr, (SELECT unnest(range(0, 33)) AS k) t GROUP BY 1, 2)"
_ANALYTIC = "ana AS (SELECT vec_id, CAST(j AS BIGINT) AS idx, sum(w * (re * cos(2 * pi() * k * j / 64) - im * sin(2 * pi() * k * j / 64))) / 64 AS re, sum(w * (re * sin(2 * pi() * k * j / 64) + im * cos(2 * pi() * k * j / 64))) / 64 AS im FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS w FROM dft) d, (SELECT unnest(range(0, 64)) AS j) t GROUP BY 1, 2)"
_ENVELOPE = "env AS (SELECT vec_id, idx, sqrt(re * re + im * im) AS e, atan2(im, re) AS phase FROM ana)"


@query("SELECT vec_id, idx, round(sqrt(pow(sum(x2 * cos(2 * pi() * idx * j / 64)), 2) + pow(sum(x2 * sin(2 * pi() * idx * j / 64)), 2)), 6) AS y FROM (SELECT vec_id, j, x2, unnest(range(0, 32)) AS idx FROM (SELECT vec_id, idx AS j, x AS x2 FROM arr) s) t GROUP BY vec_id, idx", (ARRAYS,))
def amplitude_spectrum(spark, sf):
    return _kernel(spark, sf, kernels.amplitude_spectrum, rows=False)


@query("SELECT vec_id, idx, round(y, 6) AS y FROM bp", ("RECURSIVE " + ARRAYS, *_both_ways("bp", "arr", 1.0, 5.0, RATE)))
def bandpass_filter(spark, sf):
    return _kernel(spark, sf, lambda x: kernels.bandpass(x, RATE, 1.0, 5.0))


BANDS = [(1.0, 2.0), (2.0, 4.0), (4.0, 8.0)]


@query("SELECT vec_id, idx, round(sqrt(sum(y * y)), 6) AS y FROM (" + " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(len(BANDS))) + ") t GROUP BY ALL", ("RECURSIVE " + ARRAYS, *(c for k, (lo, hi) in enumerate(BANDS) for c in _both_ways(f"b{k}", "arr", lo, hi, RATE))))
def filter_bank_envelope(spark, sf):
    return _kernel(spark, sf, lambda x: kernels.combined_envelope(kernels.filter_bank(x, RATE, BANDS)))


@query("SELECT vec_id, idx, round(e, 6) AS y FROM env", (ARRAYS, _DFT, _ANALYTIC, _ENVELOPE))
def hilbert_envelope(spark, sf):
    return _kernel(spark, sf, kernels.envelope)


@query(f"SELECT vec_id, idx, round(coalesce(d, lead(d) OVER w) * {RATE} / (2 * pi()), 6) AS y FROM (SELECT vec_id, idx, p - 2 * pi() * round(p / (2 * pi())) AS d FROM (SELECT vec_id, idx, phase - lag(phase) OVER (PARTITION BY vec_id ORDER BY idx) AS p FROM env) t) u WINDOW w AS (PARTITION BY vec_id ORDER BY idx)", (ARRAYS, _DFT, _ANALYTIC, _ENVELOPE))
def instantaneous_frequency(spark, sf):
    return _kernel(spark, sf, lambda x: kernels.instantaneous_frequency(x, RATE), rows=False)


@query("SELECT vec_id, idx, round(CASE WHEN idx >= 10 AND l > 1e-10 THEN (s - l) / l ELSE 0.0 END, 6) AS y FROM (SELECT vec_id, idx, avg(e) OVER (PARTITION BY vec_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, avg(e) OVER (PARTITION BY vec_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM env) t", (ARRAYS, _DFT, _ANALYTIC, _ENVELOPE))
def carl_sta_trig(spark, sf):
    return _kernel(spark, sf, lambda x: kernels.carl_sta_trig(x, 3, 10), rows=False)


def _burg_sql(order: int = kernels.AR_ORDER) -> list[str]:
    """CTEs that end with burg: vec_id and the coefficients a, the leading 1 among them, of a segment's first quarter."""
    out = [f"burg0 AS (SELECT vec_id, list(x ORDER BY idx) AS f, list(x ORDER BY idx) AS b, [1.0::DOUBLE] AS a FROM arr WHERE idx < {N // 4} GROUP BY vec_id)"]
    for k in range(order):
        out.append(f"cut{k} AS (SELECT vec_id, a, f[2:] AS f, b[1:len(b) - 1] AS b FROM burg{k})")
        out.append(f"part{k} AS (SELECT *, -2 * list_dot_product(f, b) / (list_dot_product(f, f) + list_dot_product(b, b)) AS k FROM cut{k})")
        out.append(f"burg{k + 1} AS (SELECT vec_id, list_transform(range(1, len(f) + 1), lambda i: f[i] + k * b[i]) AS f, list_transform(range(1, len(f) + 1), lambda i: b[i] + k * f[i]) AS b, list_transform(range(1, len(a) + 2), lambda i: coalesce(a[i], 0) + k * coalesce(a[len(a) + 2 - i], 0)) AS a FROM part{k})")
    return out


@query("SELECT r.vec_id, r.idx, round(CASE WHEN r.idx < 6 THEN 0.0 ELSE abs(sum(s.x * q.a[r.idx - s.idx + 1])) END, 6) AS y FROM arr r JOIN arr s ON s.vec_id = r.vec_id AND s.idx BETWEEN r.idx - 6 AND r.idx JOIN burg6 q ON q.vec_id = r.vec_id GROUP BY r.vec_id, r.idx", (ARRAYS, *_burg_sql()))
def ar_prediction_error(spark, sf):
    return _kernel(spark, sf, kernels.ar_error, rows=False)


@query(f"SELECT vec_id, idx, round({kernels.WA_GAIN} * y, 3) AS y FROM wa", ("RECURSIVE " + ARRAYS, "lin AS (SELECT vec_id, idx, x - (regr_intercept(x, idx) OVER w + regr_slope(x, idx) OVER w * idx) AS x FROM arr WINDOW w AS (PARTITION BY vec_id))", *_both_ways("wa", "lin", *kernels.WA_BAND, 100.0)))
def wood_anderson(spark, sf):
    """Of some hundred counts, to a thousandth."""
    y = kernels.per_segment(lambda x: kernels.wood_anderson(x, 100.0), "x", rows=True)
    return exploded(arrays(spark, sf).select("vec_id", y.alias("y")), 3)


@query(f"SELECT vec_id, arg_max(k, re * re + im * im) * {RATE} / 64 AS hz FROM dft WHERE k BETWEEN 1 AND 31 GROUP BY vec_id", (ARRAYS, _DFT))
def dominant_frequency(spark, sf):
    return arrays(spark, sf).select("vec_id", kernels.per_segment(lambda x: kernels.dominant_frequency(x, RATE), "x", "double").alias("hz"))


_W = int(RATE * 0.5)


@query(
    "SELECT vec_id, CAST(unnest(list) AS DOUBLE) AS sample FROM (SELECT vec_id, arg_max(list, k) AS list FROM walk GROUP BY vec_id) t",
    (
        "RECURSIVE " + ARRAYS,
        "u AS (SELECT vec_id, idx, x / m AS x FROM (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id) AS m FROM (SELECT vec_id, idx, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM arr) a) b)",
        f"fr AS (SELECT vec_id, idx, list(x) OVER (PARTITION BY vec_id ORDER BY idx ROWS BETWEEN {_W} PRECEDING AND 1 PRECEDING) AS l, sum(abs(x)) OVER (PARTITION BY vec_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10 AS env FROM u)",
        f"mo AS (SELECT vec_id, idx, env, list_sum(list_transform(l, lambda v: pow(v - list_avg(l), 2))) / {_W} AS m2, list_sum(list_transform(l, lambda v: pow(v - list_avg(l), 4))) / {_W} AS m4 FROM fr WHERE idx >= {_W})",
        "sc AS (SELECT vec_id, idx, CASE WHEN m2 > 1e-10 THEN m4 / (m2 * m2) - 3 ELSE 0 END AS kurt, (env - avg(env) OVER (PARTITION BY vec_id)) / nullif(stddev_pop(env) OVER (PARTITION BY vec_id), 0) AS z FROM mo)",
        "hit AS (SELECT vec_id, idx, row_number() OVER (PARTITION BY vec_id ORDER BY idx) AS k FROM sc WHERE kurt > 5 OR z > 3)",
        f"walk AS (SELECT vec_id, k, idx AS last, [idx] AS list FROM hit WHERE k = 1 UNION ALL SELECT h.vec_id, h.k, CASE WHEN h.idx - w.last >= {_W} THEN h.idx ELSE w.last END, CASE WHEN h.idx - w.last >= {_W} THEN list_append(w.list, h.idx) ELSE w.list END FROM walk w JOIN hit h ON h.vec_id = w.vec_id AND h.k = w.k + 1)",
    ),
)
def ml_detections(spark, sf):
    """Those of the built-in detector that it is at least a tenth sure of, which all over its thresholds are."""
    found = kernels.per_segment(lambda x: [float(i) for i, _, _ in kernels.ml_backend(x, RATE, 0.1)], "x")
    return arrays(spark, sf).select("vec_id", F.explode(found).alias("sample"))


def event_picks(spark, sf):
    """Each user's picks as those of one event, times folded into ten minutes, the first of each station and phase."""
    p = associate.with_stations(picks(spark, sf), pick_stations(spark, sf)).withColumn("event_id", F.col("user_id")).withColumn("time_us", F.col("time_us") % 600_000_000)
    return p.groupBy("event_id", "net", "sta", "slat", "slon", "phase", "quality").agg(F.min("time_us").alias("time_us"))


def _place(origins):
    return origins.select("event_id", "algorithm", "converged", "phase_count", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("depth", 3).alias("depth"), F.round("rms", 4).alias("rms"))


def located(spark, sf, method: str, **options):
    return _place(locate.locate(event_picks(spark, sf), velocity.Model.named("iasp91"), method, **options))


@query()
def grid_search_locate(spark, sf):
    return located(spark, sf, "grid", radius=100.0, h_step=50.0, z_step=25.0, levels=2)


@query()
def geiger_locate(spark, sf):
    return located(spark, sf, "geiger", radius=100.0)


@query()
def octree_locate(spark, sf):
    return located(spark, sf, "octree", radius=100.0, min_cell=5.0, max_iterations=4)


@query()
def nonlinloc_locate(spark, sf):
    return located(spark, sf, "nonlinloc", radius=100.0, h_step=50.0, z_step=25.0, levels=2)


@query()
def relocated_events(spark, sf):
    """Places of the grid search, moved by linearised location."""
    model = velocity.Model.named("iasp91")
    p = event_picks(spark, sf)
    first = locate.locate(p, model, "grid", radius=100.0, h_step=50.0, z_step=25.0, levels=1)
    return _place(locate.relocate(p, first, model))


def segments(spark, sf):
    """Each embedding, repeated to 640 samples with a louder middle, as a segment of one station."""
    x = F.flatten(F.array_repeat("x", 10))
    loud = F.transform(x, lambda v, i: F.when(i.between(400, 440), v * 30).otherwise(v))
    return arrays(spark, sf).select("vec_id", F.lit(0).cast("long").alias("start_us"), F.lit(RATE).alias("sample_rate"), loud.alias("samples"))


@query()
def multi_band_picks(spark, sf):
    return pickers.multi_band(segments(spark, sf), ["vec_id"]).select("vec_id", "idx", "band", F.round("snr", 4).alias("snr"))


@query()
def autoregressive_picks(spark, sf):
    return pickers.autoregressive(segments(spark, sf), ["vec_id"], trigger=3.0).select("vec_id", "idx", F.round("snr", 4).alias("snr"))


@query()
def detector_picks(spark, sf):
    return pickers.detector(segments(spark, sf), ["vec_id"], min_probability=0.3).select("vec_id", "idx", "phase", F.round("confidence", 4).alias("confidence"))
