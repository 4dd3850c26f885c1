"""Trial points and sums over the picks of an event, as rows.

What the locator kernels compute for one event in numpy, for few points or
when only one of the sums is wanted: plain aggregates that combine on the map
side, over any number of events at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import P_PHASES
from ..functions.geo import haversine_km
from .associate import SEED_PHASES, with_points
from .velocity import lookup


def centroid(picks: DataFrame, by: tuple[str, ...], phases: tuple[str, ...] = P_PHASES) -> DataFrame:
    """by..., lat, lon, n: the mean station of the P picks."""
    rows = picks.where(F.col("phase").isin(*phases))
    return rows.groupBy(*by).agg(F.avg("slat").alias("lat"), F.avg("slon").alias("lon"), F.count("*").alias("n"))


def order_weighted_centroid(picks: DataFrame, by: tuple[str, ...], order: tuple[str, ...] = ("time_us", "pick_id")) -> DataFrame:
    """by..., lat, lon: the mean station, the k-th pick with weight 1 / k."""
    w = 1.0 / F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = picks.withColumn("_w", w)
    return rows.groupBy(*by).agg(*((F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(n) for c, n in (("slat", "lat"), ("slon", "lon"))))


def earliest_station(picks: DataFrame, by: tuple[str, ...], phases: tuple[str, ...] = P_PHASES) -> DataFrame:
    """by..., sta, time_us, slat, slon of the first P pick."""
    first = F.min_by(F.struct("sta", "time_us", "slat", "slon"), F.struct("time_us", "pick_id"))
    return picks.where(F.col("phase").isin(*phases)).groupBy(*by).agg(first.alias("_f")).select(*by, "_f.*")


def with_times(picks: DataFrame, times: DataFrame) -> DataFrame:
    """Picks with a trial point (lat, lon, depth): distance and tt."""
    rows = picks.withColumn("distance", haversine_km("lat", "lon", "slat", "slon"))
    return lookup(rows, times, "distance", "depth", "phase")


def origin_time(timed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by..., origin_us: the time of the nearest first arrival less its travel time, in whole milliseconds."""
    rows = timed.where(F.col("phase").isin(*SEED_PHASES))
    us = F.col("time_us") - F.floor(F.col("tt") * 1000).cast("long") * 1000
    return rows.groupBy(*by).agg(F.min_by(us, F.struct(F.round("tt", 6), "pick_id")).alias("origin_us"))


def grid_misfit(picks: DataFrame, grid: DataFrame, times: DataFrame, by: tuple[str, ...], seconds: str = "seconds") -> DataFrame:
    """by..., cell, rms of every point of a grid (cell, lat, lon, depth) against the picks' seconds after the origin."""
    timed = with_times(with_points(picks, grid), times)
    miss = F.col(seconds) - F.col("tt")
    return timed.groupBy(*by, "cell").agg(F.sqrt(F.avg(miss * miss)).alias("rms"))


def grid_argmin(misfits: DataFrame, by: tuple[str, ...], digits: int = 6) -> DataFrame:
    """by..., cell, rms: the point of least misfit, the first of equal ones."""
    best = F.min(F.struct(F.round("rms", digits).alias("rms"), F.col("cell").alias("cell")))
    return misfits.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.cell", "_b.rms")


def pair_likelihood(residuals: DataFrame, by: tuple[str, ...], key: str = "arid", value: str = "timeres", scale: float = 1.0) -> DataFrame:
    """by..., likelihood, pairs: exp of minus half the mean square of the differences of all pairs of unlike keys.

    The squares of all differences sum up to n times the squares' sum less the
    sum squared, and those inside a key are taken off, so no pair is a row.
    """
    x = F.col(value)
    each = residuals.groupBy(*by, key).agg(F.count(value).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    n, s, q = (F.sum(c) for c in "nsq")
    pairs = (n * n - F.sum(F.col("n") * F.col("n"))) / 2
    inside = F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s"))
    rows = each.groupBy(*by).agg((n * q - s * s - inside).alias("total"), pairs.cast("long").alias("pairs")).where("pairs > 0")
    return rows.select(*by, F.exp(-0.5 * F.col("total") / F.col("pairs") * scale).alias("likelihood"), "pairs")


def gaussian_likelihood(residuals: DataFrame, by: tuple[str, ...], value: str = "timeres", sigma=None) -> DataFrame:
    """by..., likelihood: exp of minus half the sum of squared standardised residuals."""
    z = F.col(value) / (F.lit(0.5) if sigma is None else sigma)
    return residuals.groupBy(*by).agg(F.exp(-0.5 * F.sum(z * z)).alias("likelihood"))
