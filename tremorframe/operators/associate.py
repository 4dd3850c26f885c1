"""From picks to candidate events: range joins instead of nested scans.

A seed pick (P or Pg) puts a trial source at its station; later picks belong
to it if their time fits the travel time from there.  Both meet in blocks of
time (``expected``), where a seed's picks of a station and class are one run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.codes import location_weight, phase_class
from ..functions.geo import EARTH_RADIUS_KM, azimuth_deg, haversine_km
from ..scratch import written
from .expected import Block, Expected, in_blocks
from .frames import spread
from .velocity import lookup

#: Trial depth, and the lead time of a source 50 km away at 8 km/s.
SEED_DEPTH_KM = 10.0
LEAD_MS = 6250
SEED_PHASES = ("P", "Pg")


def seconds_between(later: str, earlier: Column) -> Column:
    """Of epoch microseconds, cut to whole milliseconds towards zero."""
    ms = (F.col(later) - earlier) / 1000
    return F.when(ms >= 0, F.floor(ms)).otherwise(F.ceil(ms)) / 1000.0


def with_stations(picks: DataFrame, stations: DataFrame, keep_missing: bool = False) -> DataFrame:
    """picks with slat and slon of net and sta; those without a station go, or get nulls."""
    dimension = stations.select("net", "sta", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    return picks.join(dimension, ["net", "sta"], "left" if keep_missing else "inner")


def nearest_stations(origins: DataFrame, stations: DataFrame, count: int) -> DataFrame:
    """orid, lat, lon with station_id, sta, k of the count nearest stations, by distance to 1e-6 km and then station_id.

    Origins at one place have the same stations, so places are ranked, not
    origins.  Places and stations meet in cells: each place looks round itself
    as far as a mean station's share of the globe lets expect, and those whose
    count-th station is not proved to be the count-th look three times as far.
    """
    places = origins.select(F.col("lat").cast("double").alias("olat"), F.col("lon").cast("double").alias("olon")).where("olat is not null and olon is not null").distinct()
    known = stations.select("station_id", F.col("lat").cast("double").alias("slat"), F.col("lon").cast("double").alias("slon")).where("slat is not null and slon is not null")
    number = max(1, known.count())
    # Of a sphere of area 4 pi R^2, the radius of a circle that holds twice as many stations as are wanted.
    radius = max(10.0, 2 * EARTH_RADIUS_KM * math.sqrt(2.0 * count / number))
    order, near, left = Window.partitionBy("olat", "olon").orderBy("km", "station_id"), None, places
    while True:
        last = radius >= cells.FARTHEST_KM
        size = cells.size_for(radius)
        there = known.withColumn("cell", cells.of("slat", "slon", size))
        pairs = left.withColumn("cell", F.explode(cells.of_circle("olat", "olon", F.lit(radius), size))).join(there, "cell")
        ranked = pairs.select("olat", "olon", F.round(haversine_km("olat", "olon", "slat", "slon"), 6).alias("km"), "station_id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= count)
        if not last:
            ranked = written(ranked, "nearest")
            proved = ranked.where((F.col("k") == count) & (F.col("km") < radius)).select("olat", "olon")
            left = written(left.join(proved, ["olat", "olon"], "left_anti"), "nearest-left")
            ranked = ranked.join(proved, ["olat", "olon"], "left_semi")
        near = ranked if near is None else near.unionByName(ranked)
        if last or left.isEmpty():
            break
        radius *= 3
    near = near.join(stations.select("station_id", "sta"), "station_id")
    return origins.join(near.select("olat", "olon", "station_id", "sta", "k"), (origins.lat == near.olat) & (origins.lon == near.olon)).drop("olat", "olon")


def _expected(times: DataFrame, max_residual: float, max_km: int = 3000) -> Expected:
    """The rows of the table at the trial depth: (max_km + 1) 2 of them, whatever the number of picks and stations."""
    t = {p: np.full(max_km + 1, np.nan) for p in "PS"}
    for r in times.where((F.col("z_bin") == int(SEED_DEPTH_KM)) & F.col("d_bin").between(0, max_km)).select("phase_class", "d_bin", "t").collect():
        t[r["phase_class"]][r["d_bin"]] = np.nan if r["t"] is None else r["t"]
    return Expected(t, max_residual, LEAD_MS * 1000)


#: A block of time is as wide as so many times the latest pick that a seed may expect.
BLOCK_REACHES = 4


def _blocked(placed: DataFrame, seed: Column) -> DataFrame:
    """The columns that a block of time needs; a seed is a pick that begins an event."""
    return placed.select("pick_id", "time_us", F.col("slat").cast("double").alias("slat"), F.col("slon").cast("double").alias("slon"), "sta", (phase_class("phase") != "P").alias("_late"), seed.alias("_seed"))


def _inside(table: pa.Table, width: int, begin: int = 0) -> np.ndarray:
    """Which rows are in their block itself."""
    return (table["time_us"].to_numpy() + begin) // width == table["_block"].to_numpy()


def _seeds(table: pa.Table, width: int) -> np.ndarray:
    """Rows of the seeds that are in their block itself."""
    return np.flatnonzero(table["_seed"].to_numpy() & _inside(table, width))


def _taken(table: pa.Table, rows: np.ndarray, names: dict[str, str]) -> list[pa.Array]:
    """The columns of some rows; names: a column's name in the result, and in the table."""
    return [table[c].combine_chunks().take(pa.array(rows)) for c in names.values()]


def residuals(picks: DataFrame, stations: DataFrame, times: DataFrame, max_residual: float = 3.0, bucket_s: float = 0.0, columns: tuple[str, ...] | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """seed_id with each later pick that fits: pick_id, distance, residual.

    Picks are dealt out once, in blocks of time as wide as a few times the
    latest pick that a seed may expect (or bucket_s, if that is wider), and
    pairs are made inside of a block; the result does not depend on it.
    columns: those that are wanted, if not all.  seeds: seed_id of those that
    are wanted, if not all.
    """
    placed, expected = with_stations(picks, stations), _expected(times, max_residual)
    width = max(BLOCK_REACHES * expected.reach_us, int(bucket_s * 1e6))
    of_seed = {"slat": "lat", "slon": "lon", "time_us": "seed_us", "pick_id": "seed_id"}
    of_pick = [c for c in ("pick_id", "net", "sta", "phase", "time_us", "quality", "slat", "slon") if c in placed.columns]
    every = ["lat", "lon", "seed_id", "seed_us", "distance", "tt", *of_pick, "residual", "depth"]
    wanted = [c for c in every if columns is None or c in columns]
    more = [c for c in ("net", "phase", "quality") if c in wanted]
    # Names of the columns in a block, where places are numbers for kernels and what else is wanted travels along.
    seeded, begins = placed, F.col("phase").isin(*SEED_PHASES)
    if seeds is not None:
        seeded = placed.join(seeds.select(F.col("seed_id").alias("pick_id"), F.lit(True).alias("_wanted")).distinct(), "pick_id", "left")
        begins = begins & F.col("_wanted").isNotNull()
    seeded = seeded.withColumn("_seed", begins)
    rows = _blocked(seeded, F.col("_seed")) if not more else seeded.select("pick_id", "time_us", F.col("slat").cast("double").alias("slat"), F.col("slon").cast("double").alias("slon"), "sta", (phase_class("phase") != "P").alias("_late"), "_seed", *more)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kinds |= {v: kinds[k] for k, v in of_seed.items()} | {"distance": "double", "tt": "double", "residual": "double", "depth": "double"}
    from_seed, from_pick = {v: k for k, v in of_seed.items() if v in wanted}, {c: c for c in of_pick if c in wanted}

    def run(table):
        seeds = _seeds(table, width)
        if not len(seeds):
            return
        for a, b, distance, tt, residual in Block(table, expected).pairs(seeds):
            made = dict(zip(from_seed, _taken(table, a, from_seed), strict=True)) | dict(zip(from_pick, _taken(table, b, from_pick), strict=True))
            made |= {"distance": pa.array(distance), "tt": pa.array(tt), "residual": pa.array(residual), "depth": pa.array(np.full(len(a), SEED_DEPTH_KM))}
            yield pa.RecordBatch.from_arrays([made[c] for c in wanted], names=wanted)

    return in_blocks(rows, width, 0, expected.reach_us, run, ", ".join(f"{c} {kinds[c]}" for c in wanted))


def candidates(picks: DataFrame, stations: DataFrame, times: DataFrame, max_residual: float = 3.0, min_stations: int = 3, min_phases: int = 4, bucket_s: float = 0.0, fits: DataFrame | None = None) -> DataFrame:
    """seed_id, time_us, lat, lon, station_count, phase_count of seeds with enough stations and picks.

    Stations are told apart by code alone.  The seed counts itself.  fits: what
    ``residuals`` gives, if it is there already; without it picks are counted
    and no pairs are made.
    """
    if fits is None:
        grouped = _counted(picks, stations, times, max_residual, bucket_s)
    else:
        own = with_stations(picks, stations).where(F.col("phase").isin(*SEED_PHASES)).select(F.col("pick_id").alias("seed_id"), F.col("pick_id"), "sta", F.col("time_us").alias("seed_us"), F.col("slat").alias("lat"), F.col("slon").alias("lon"))
        both = own.unionByName(fits.select("seed_id", "pick_id", "sta", "seed_us", "lat", "lon"))
        grouped = both.groupBy("seed_id", "seed_us", "lat", "lon").agg(F.countDistinct("sta").alias("station_count"), F.count("*").alias("phase_count"))
    return grouped.where((F.col("station_count") >= min_stations) & (F.col("phase_count") >= min_phases)).select("seed_id", (F.col("seed_us") - LEAD_MS * 1000).alias("time_us"), "lat", "lon", F.lit(SEED_DEPTH_KM).alias("depth"), "station_count", "phase_count")


def _counted(picks: DataFrame, stations: DataFrame, times: DataFrame, max_residual: float, bucket_s: float) -> DataFrame:
    """seed_id, seed_us, lat, lon, station_count, phase_count of all seeds."""
    expected = _expected(times, max_residual)
    width = max(BLOCK_REACHES * expected.reach_us, int(bucket_s * 1e6))
    rows = _blocked(with_stations(picks, stations), F.col("phase").isin(*SEED_PHASES))
    names = {"seed_id": "pick_id", "seed_us": "time_us", "lat": "slat", "lon": "slon"}

    def run(table):
        seeds = _seeds(table, width)
        if len(seeds):
            of, found, phases = Block(table, expected).counts(seeds)
            yield pa.RecordBatch.from_arrays([*_taken(table, of, names), pa.array(found), pa.array(phases)], names=[*names, "station_count", "phase_count"])

    return in_blocks(rows, width, 0, expected.reach_us, run, f"seed_id {dict(rows.dtypes)['pick_id']}, seed_us long, lat double, lon double, station_count long, phase_count long")


def members(picks: DataFrame, stations: DataFrame, times: DataFrame, chosen: DataFrame | None = None, fits: DataFrame | None = None, **options) -> DataFrame:
    """seed_id, pick_id of all candidates (or of the chosen ones)."""
    if fits is None:
        fits = residuals(picks, stations, times, **{k: v for k, v in options.items() if k in ("max_residual", "bucket_s")}, columns=("seed_id", "pick_id") if chosen is not None else None, seeds=chosen)
    chosen = (candidates(picks, stations, times, fits=fits, **options) if chosen is None else chosen).select("seed_id")
    return fits.select("seed_id", "pick_id").unionByName(chosen.select("seed_id", F.col("seed_id").alias("pick_id"))).join(chosen, "seed_id", "left_semi")


#: Up to so many (seed, pick) rows one task resolves what is left; beyond, rounds over all tasks decide.
TASK_MEMBERS = 50_000


def greedy(members: DataFrame, ranked: DataFrame) -> DataFrame:
    """Seeds that keep disjoint picks: seed_id, best first, those that share a pick with an earlier one go.

    Rank is (station_count, phase_count, earliest), over all candidates at once.
    In a round each seed that is the best left for all its picks stays, and
    those that share a pick with it go, which gives what one pass in the order
    of ranks gives; the best of all is always settled, so rounds end.
    """
    ranks = ranked.select("seed_id", "station_count", "phase_count", "time_us")
    rank = F.struct(-F.col("station_count"), -F.col("phase_count"), "time_us", "seed_id")
    # Every round cuts the lineage, as its rows are used several times.
    left, kept = written(members.select("seed_id", "pick_id").distinct().join(ranks, "seed_id"), "seeds"), None
    while left.count() > TASK_MEMBERS:
        best = left.groupBy("pick_id").agg(F.min_by("seed_id", rank).alias("_best"))
        won = left.join(best, "pick_id").groupBy("seed_id").agg(F.bool_and(F.col("seed_id") == F.col("_best")).alias("_won"))
        won = written(won.where("_won").select("seed_id"), "seeds-kept")
        kept = won if kept is None else kept.unionByName(won)
        taken = left.join(won, "seed_id", "left_semi").select("pick_id").distinct()
        settled = left.join(taken, "pick_id", "left_semi").select("seed_id").distinct()
        left = written(left.join(settled, "seed_id", "left_anti"), "seeds-left")

    def choose(frame):
        taken, out = set(), []
        for r in frame.sort_values(["station_count", "phase_count", "time_us", "seed_id"], ascending=[False, False, True, True]).itertuples():
            if not taken.intersection(r.picks):
                taken.update(r.picks)
                out.append(r.seed_id)
        return frame[["seed_id"]][frame.seed_id.isin(out)]

    rows = left.groupBy("seed_id", "station_count", "phase_count", "time_us").agg(F.collect_list("pick_id").alias("picks"))
    rest = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(choose, "seed_id long")
    return rest if kept is None else kept.unionByName(rest)


#: Blocks in which shared picks are resolved are as wide as so many times the latest pick that a seed may expect.
RESOLVED_REACHES = 8


def chosen(picks: DataFrame, stations: DataFrame, times: DataFrame, max_residual: float = 3.0, min_stations: int = 3, min_phases: int = 4) -> DataFrame:
    """seed_id of the candidates that ``greedy`` keeps of all, without a row for each seed and member.

    Only seeds near in time can share a pick.  In a round each block of time,
    with what is near it, takes its seeds best first and settles those that do
    not hang on seeds beyond; the next round's blocks begin half a block later.
    The best that is left is settled in every round, so rounds end.
    """
    placed = with_stations(picks, stations)
    again = spread(placed.select("pick_id"), "pick_id").select(F.count("*").over(Window.partitionBy("pick_id")).alias("times")).where("times > 1")
    if not again.isEmpty():
        # An id with several times or places has its picks anywhere.
        fits = written(residuals(picks, stations, times, max_residual), "fits")
        found = written(candidates(picks, stations, times, max_residual, min_stations, min_phases, fits=fits), "candidates")
        return greedy(members(picks, stations, times, found, fits), found)
    found = candidates(picks, stations, times, max_residual, min_stations, min_phases).select(F.col("seed_id").alias("pick_id"), "station_count", "phase_count")
    expected = _expected(times, max_residual)
    width, reach = RESOLVED_REACHES * expected.reach_us, expected.reach_us
    # _won: null for what is no seed (any more), false for what is not settled.
    rows = _blocked(placed, F.lit(True)).drop("_seed").join(found, "pick_id", "left").withColumn("_won", F.when(F.col("phase_count").isNotNull(), F.lit(False)))
    rows, schema, begin = written(rows, "ranked"), ", ".join(f"{n} {k}" for n, k in rows.dtypes), 0
    while not rows.where("not _won").isEmpty():

        def run(table, begin=begin):
            inside = _inside(table, width, begin)
            if not inside.any():
                return
            won = pc.fill_null(table["_won"], False).to_numpy()
            left = pc.fill_null(pc.invert(table["_won"]), False).to_numpy()
            settled = table["_won"].to_pylist()
            if left[inside].any():
                rank = [pc.fill_null(table[c], 0).to_numpy() for c in ("phase_count", "station_count")]
                # Rows are in order of time and then of id already.
                seeds = np.flatnonzero(left)
                seeds = seeds[np.lexsort((seeds, -rank[0][seeds], -rank[1][seeds]))]
                stay, unknown = Block(table, expected).resolved(seeds, np.flatnonzero(won), inside[seeds])
                for r in np.flatnonzero(left).tolist():
                    settled[r] = None
                for x, some in ((True, stay), (False, unknown)):
                    for r in some:
                        settled[r] = x
            made = table.drop_columns(["_block", "_at", "_won"]).append_column("_won", pa.array(settled, pa.bool_())).filter(pa.array(inside))
            yield from made.combine_chunks().to_batches()

        rows = written(in_blocks(rows, width, reach, reach, run, schema, begin), "ranked")
        begin = width // 2 - begin
    return rows.where("_won").select(F.col("pick_id").alias("seed_id"))


def fitting(picks: DataFrame, stations: DataFrame, times: DataFrame, max_residual: float = 3.0) -> DataFrame:
    """pick_id of the picks that fit a seed, and of the seeds that a pick fits, without a row for each pair; one may come twice."""
    expected = _expected(times, max_residual)
    width = BLOCK_REACHES * expected.reach_us
    rows = _blocked(with_stations(picks, stations), F.col("phase").isin(*SEED_PHASES))

    def run(table):
        seeds = _seeds(table, width)
        if len(seeds):
            yield pa.RecordBatch.from_arrays(_taken(table, Block(table, expected).covered(seeds), {"pick_id": "pick_id"}), names=["pick_id"])

    return in_blocks(rows, width, 0, expected.reach_us, run, f"pick_id {dict(rows.dtypes)['pick_id']}")


def unassociated(picks: DataFrame, members: DataFrame) -> DataFrame:
    # A pick may be a member many times; tasks leave one row of each before any travels.
    return picks.join(members.select("pick_id").distinct(), "pick_id", "left_anti")


def expired(picks: DataFrame, members: DataFrame, window_s: float = 60.0) -> DataFrame:
    """Picks of no event that are older than twice the window before the newest one (event time)."""
    latest = picks.agg(F.max("time_us")).first()[0]
    return unassociated(picks, members).where(F.col("time_us") < (latest or 0) - int(2e6 * window_s))


#: Points of a grid that travel to the picks at once (some 60 bytes each).
GRID_POINTS = 100_000


def with_points(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row with every point of a grid, whose size is checked: up to GRID_POINTS are one broadcast, more are several."""
    n = grid.count()
    if n <= GRID_POINTS:
        return rows.join(F.broadcast(grid))
    parts, out = -(-n // GRID_POINTS) * 2, None
    for k in range(parts):
        part = grid.where(F.pmod(F.xxhash64(*grid.columns), F.lit(parts)) == k)
        pairs = rows.join(F.broadcast(part))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def nucleator_votes(picks: DataFrame, stations: DataFrame, grid: DataFrame, times: DataFrame | None = None, window_s: float = 60.0, max_residual: float = 3.0, min_votes: int = 4, compat: bool = False) -> DataFrame:
    """cell, bucket, votes of the grid points (cell, lat, lon, depth) that enough picks agree on.

    Each pick votes for the origin second its travel time from the point gives;
    compat counts every pick for every point.  The grid is a fixed list of points,
    of which at most GRID_POINTS are broadcast; a finer one is voted on in parts.
    """
    placed = with_stations(picks, stations).select("pick_id", "phase", "time_us", "slat", "slon")
    if compat:
        n = placed.agg(F.count("*").alias("votes"))
        return grid.select("cell").join(n).where(F.col("votes") >= min_votes)
    # Times from the points to the places, so that no row of a pick and a point is joined with the table of times.
    table = with_points(placed.select("slat", "slon").distinct(), grid).withColumns({"distance": haversine_km("lat", "lon", "slat", "slon"), "_class": F.explode(F.array(F.lit("P"), F.lit("S")))})
    table = written(lookup(table, times, "distance", "depth", "_class").select("slat", "slon", "_class", "cell", "tt"), "grid-times").alias("t")
    # A pick that is there once needs no telling apart from others: its points are counted where they are made.
    once = spread(placed, "pick_id").withColumn("_once", F.count("*").over(Window.partitionBy("pick_id")) == 1).withColumn("_class", phase_class("phase")).alias("p")
    same = F.col("p.slat").eqNullSafe(F.col("t.slat")) & F.col("p.slon").eqNullSafe(F.col("t.slon")) & (F.col("p._class") == F.col("t._class"))
    width = max_residual * 1e6
    pairs = once.join(table, same).select("cell", F.floor((F.col("time_us") - F.col("tt") * 1e6) / width).alias("bucket"), "pick_id", "_once")
    votes = F.count(F.when(F.col("_once"), F.col("pick_id"))) + F.countDistinct(F.when(~F.col("_once"), F.col("pick_id")))
    return pairs.groupBy("cell", "bucket").agg(votes.alias("votes")).where(F.col("votes") >= min_votes)


def first_arrivals(picks: DataFrame, by: tuple[str, ...] = ("net", "sta"), rank: int = 1) -> DataFrame:
    """The rank-th distinct pick of each station; the first is a P, the second an S."""
    w = Window.partitionBy(*by).orderBy("time_us", "pick_id")
    return picks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == rank).drop("_n").withColumn("phase", F.lit("P" if rank == 1 else "S"))


def predicted_picks(picks: DataFrame, expected: Column, dt: Column, by: tuple[str, ...] = ("net", "sta"), most: float = 25.0, min_snr: float = 2.0) -> DataFrame:
    """For each station the pick nearest to its expected time."""
    rows = picks.withColumn("_dt", dt).withColumn("_off", F.abs(dt - expected)).where((F.col("_dt") >= 0) & (F.col("snr") >= min_snr) & (F.col("_off") < most))
    return rows.groupBy(*by).agg(F.min_by("pick_id", F.struct("_off", "pick_id")).alias("pick_id"), F.min("_off").alias("misfit"))


def event_summary(members: DataFrame, by: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """by..., rms (weighted), plain_rms, gap, station and phase counts of arrivals (residual, quality, azimuth, sta)."""
    w, t = location_weight("quality"), F.col("residual")
    return members.groupBy(*by).agg(
        F.sqrt(F.sum(w * t * t) / F.sum(w)).alias("rms"), F.sqrt(F.avg(t * t)).alias("plain_rms"), (360.0 - (F.max("azimuth") - F.min("azimuth"))).alias("gap"), F.countDistinct("sta").alias("station_count"), F.count("*").alias("phase_count")
    )


def near_model(picks: DataFrame, times: DataFrame, dt: Column, least_s: float = -1.0, min_snr: float = 3.0, max_residual: float = 5.0) -> DataFrame:
    """Picks (distance, depth, phase, snr) whose time after the origin fits the table's P time, with dt, tt and residual."""
    rows = lookup(picks.withColumn("_p", F.lit("P")), times, "distance", "depth", "_p").drop("_p").withColumn("dt", dt)
    rows = rows.withColumn("residual", F.col("dt") - F.col("tt"))
    return rows.where((F.col("dt") >= least_s) & (F.col("snr") >= min_snr) & (F.abs("residual") <= max_residual))


def true_gap(rows: DataFrame, by: tuple[str, ...], azimuth: str = "azimuth") -> DataFrame:
    """by..., gap: the widest angle between neighbouring azimuths, all round."""
    w = Window.partitionBy(*by).orderBy(azimuth)
    step = F.coalesce(F.col(azimuth) - F.lag(azimuth).over(w), F.lit(0.0))
    # The last row of each has seen them all, so what is sorted for the steps is not gathered once more.
    rows = rows.select(*by, azimuth, step.alias("_step"), F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    widest, span = F.max("_step").over(so_far), F.max(azimuth).over(so_far) - F.min(azimuth).over(so_far)
    return rows.withColumn("gap", F.greatest(widest, 360.0 - span)).where("_last").select(*by, "gap")


def with_geometry(rows: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return rows.withColumn("distance", haversine_km(lat, lon, "slat", "slon")).withColumn("azimuth", azimuth_deg(lat, lon, "slat", "slon"))
