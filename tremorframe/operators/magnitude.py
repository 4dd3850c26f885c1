"""Station and network magnitudes.

A station's magnitude needs a stretch of its waveform round a computed arrival;
``recorded`` asks for it by place and time and measures it there.  Network
magnitudes are the upper median with the population deviation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, scales
from ..functions.codes import is_vertical
from ..functions.geo import haversine_km, hypocentral_km, km_to_deg
from .recorded import Span, dealt, measured

DAY_US = 86_400_000_000


#: Least and most distance (km) of each kind.
RANGES = {"ML": (5.0, 600.0), "Mw": (10.0, 500.0), "Mb": (555.0, 11_100.0), "Ms": (2200.0, 17_800.0)}


def in_range(distance, kind: str) -> Column:
    return F.col(distance).between(*RANGES[kind]) if isinstance(distance, str) else distance.between(*RANGES[kind])


def upper_median(value: str) -> Column:
    """The middle one, of two the greater; over groups of one event's stations."""
    v = F.sort_array(F.collect_list(value))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def network(stations: DataFrame, by: list[str], value: str = "magnitude") -> DataFrame:
    """by..., magnitude, uncertainty, nsta."""
    rows = stations.where(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.groupBy(*by).agg(upper_median(value).alias("magnitude"), F.stddev_pop(value).alias("uncertainty"), F.count("*").alias("nsta"))


def windows(origins: DataFrame, segments: DataFrame, stations: DataFrame, begin_s: Callable[[Column], Column], end_s: Callable[[Column], Column], least_km: float, most_km: float, bucket_s: float = 3600.0) -> DataFrame:
    """event_id, net, sta, chan, distance, hypo, depth, sample_rate, samples between begin and end (seconds after the origin, which grow with the distance).

    A segment is at its station's place and in its buckets of time; an origin
    looks where and when any distance in range lets it.  They meet by both, so
    stations that recorded nothing then cost nothing, and what goes on is the
    slice.  A pair that meets in several buckets counts in its first.  What a
    kernel makes of the slices is ``recorded.measured``, without their rows.
    """
    wanted, placed, keys = dealt(origins, segments, stations, Span(begin_s, end_s, least_km, most_km, bucket_s))
    at = lambda seconds, d: F.col("time_us") + seconds(d) * 1e6
    # Pairs may be many more than rows of either side, so both are dealt out, however small they look.
    both = placed.join(wanted.hint("merge"), keys).where(F.col("_b") == F.greatest("_w0", "_s0"))
    both = both.withColumn("distance", haversine_km("lat", "lon", "slat", "slon")).where(F.col("distance").between(least_km, most_km))
    index = lambda t: F.floor((t - F.col("start_us")) / 1e6 * F.col("sample_rate")).cast("int")
    lo, hi = F.greatest(index(at(begin_s, F.col("distance"))), F.lit(0)), F.least(index(at(end_s, F.col("distance"))), F.size("samples"))
    cut = both.where(hi > lo).withColumn("samples", F.slice("samples", lo + 1, hi - lo))
    return cut.select("event_id", "net", "sta", "chan", "distance", hypocentral_km("distance", "depth").alias("hypo"), "depth", "sample_rate", "samples")


def _loudest(f: Callable[[np.ndarray, float], np.ndarray]) -> Callable:
    return lambda x, rate, far: [np.abs(f(x, rate)).max(1)]


def local_stations(origins, segments, stations, corrections: DataFrame | None = None, least: int = 10, **formula) -> DataFrame:
    """ML: from half a second before the computed S to 10 s after."""
    s = lambda d: d / 3.5
    rows = measured(origins, segments, stations, Span(lambda d: s(d) - 0.5, lambda d: s(d) + 10.0, *RANGES["ML"]), least, ["amplitude"], _loudest(kernels.wood_anderson))
    if corrections is not None:
        rows = rows.join(corrections.select("sta", "correction"), "sta", "left")
    shift = F.coalesce(F.col("correction"), F.lit(0.0)) if corrections is not None else F.lit(0.0)
    return rows.withColumn("magnitude", scales.ml("amplitude", "hypo", correction=shift, **formula)).withColumn("magtype", F.lit("ML"))


def moment_stations(origins, segments, stations) -> DataFrame:
    """Mw: five seconds from the computed S; kept between 0 and 10."""
    spectra = lambda x, rate, far: kernels.spectral_fits(x, rate, far * 1000)
    rows = measured(origins, segments, stations, Span(lambda d: d / 3.5, lambda d: d / 3.5 + 5.0, *RANGES["Mw"]), kernels.SPECTRUM_MIN, ["omega", "corner", "misfit"], spectra, by_pair=True)
    rows = rows.withColumn("fit", F.struct("omega", "corner", "misfit")).drop("omega", "corner", "misfit").where("fit.omega > 0")
    rows = rows.withColumn("magnitude", scales.mw(scales.moment("fit.omega", "hypo"))).where((F.col("magnitude") > 0) & (F.col("magnitude") < 10))
    return rows.withColumn("magtype", F.lit("Mw"))


def body_stations(origins, segments, stations, least: int = 10) -> DataFrame:
    """mb: the loudest sample of five seconds from P on vertical channels."""
    rows = windows(origins, segments.where(is_vertical("chan")), stations, lambda d: d / 8.0, lambda d: d / 8.0 + 5.0, *RANGES["Mb"]).where(F.size("samples") >= least)
    rows = rows.withColumn("amplitude", F.array_max(F.transform("samples", lambda v: F.abs(v)))).drop("samples")
    return rows.withColumn("magnitude", scales.mb("amplitude", km_to_deg("distance"), "depth")).withColumn("magtype", F.lit("Mb"))


def surface_stations(origins, segments, stations, least: int = 10) -> DataFrame:
    """Ms: 30 s before to 60 s after the wave at 3.5 km/s, between 15 and 25 s."""
    wave = _loudest(lambda x, rate: kernels.bandpass(x, rate, 1 / 25, 1 / 15, 3))
    rows = measured(origins, segments.where(is_vertical("chan")), stations, Span(lambda d: d / 3.5 - 30.0, lambda d: d / 3.5 + 60.0, *RANGES["Ms"]), least, ["amplitude"], wave)
    return rows.withColumn("magnitude", scales.ms("amplitude", km_to_deg("distance"))).withColumn("magtype", F.lit("Ms"))


def duration_stations(durations: DataFrame) -> DataFrame:
    """Md of (event_id, net, sta, distance, duration_s)."""
    return durations.withColumn("magnitude", scales.md("duration_s", "distance")).withColumn("magtype", F.lit("Md"))


@dataclass(frozen=True)
class Calculator:
    name: str
    stations: Callable[..., DataFrame]


CALCULATORS = {c.name.lower(): c for c in (Calculator("ML", local_stations), Calculator("Mw", moment_stations), Calculator("Mb", body_stations), Calculator("Ms", surface_stations))}


def calculator(name: str = "ML") -> Calculator:
    if name.lower() not in CALCULATORS:
        raise ValueError(f"unknown magnitude {name!r}; known are {', '.join(c.name for c in CALCULATORS.values())}")
    return CALCULATORS[name.lower()]


def event_magnitudes(origins, segments, stations, kinds: tuple[str, ...] = ("ML", "Mw")) -> tuple[DataFrame, DataFrame]:
    """Station and network magnitudes of several kinds."""
    each = None
    for k in kinds:
        rows = calculator(k).stations(origins, segments, stations).select("event_id", "net", "sta", "distance", "magtype", "magnitude")
        rows = rows.groupBy("event_id", "net", "sta", "distance", "magtype").agg(F.max("magnitude").alias("magnitude"))
        each = rows if each is None else each.unionByName(rows)
    return each, network(each, ["event_id", "magtype"])
