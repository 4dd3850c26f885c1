"""Origins and the waveforms that may have recorded them, a bucket of time and place at a time.

A bucket's origins are held, its waveforms come one after the other.  Of a pair
goes on what is measured, never samples, and a window that several origins ask
for is measured once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.geo import EARTH_RADIUS_KM, hypocentral_km
from .frames import tasks_for

#: Pairs, windows and samples that a task holds before it measures, and samples that a kernel gets at once.
PAIRS = 1 << 18
WINDOWS = 1 << 17
SAMPLES = 1 << 22
AT_ONCE = 1 << 20
#: A bucket's number holds its cell in so many bits, which is more than any cell's number.
_CELL_BITS = 21


@dataclass(frozen=True)
class Span:
    """The stretch of a waveform from begin to end (seconds after an origin, which grow with the distance) at distances in range, and the width of a bucket of time.

    begin and end take columns as well as arrays.
    """

    begin: Callable
    end: Callable
    least_km: float
    most_km: float
    bucket_s: float = 3600.0

    @property
    def width_us(self) -> int:
        return int(self.bucket_s * 1e6)

    def first(self, time_us, least: Column | float):
        """In buckets: the earliest begin."""
        return (time_us + self.begin(least) * 1e6) / self.width_us


def dealt(origins: DataFrame, segments: DataFrame, stations: DataFrame, span: Span) -> tuple[DataFrame, DataFrame, list[str]]:
    """Origins where and when any distance in range lets them look, segments at their stations (slat, slon) and in their buckets, and the columns by which they meet.

    Both have their first bucket, _w0 and _s0: a pair that meets in several counts in the later one of these.
    """
    first, last = F.floor(span.first(F.col("time_us"), F.lit(float(span.least_km)))), F.floor((F.col("time_us") + span.end(F.lit(float(span.most_km))) * 1e6) / span.width_us)
    wanted = origins.select("event_id", "time_us", "lat", "lon", "depth", first.alias("_w0"), F.explode(F.sequence(first, last)).alias("_b"))
    begun, ended = F.floor(F.col("start_us") / span.width_us), F.floor((F.col("start_us") + (F.size("samples") * 1e6 / F.col("sample_rate")).cast("long")) / span.width_us)
    places = stations.select("net", "sta", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    placed = segments.select("net", "sta", "chan", "start_us", "sample_rate", "samples", begun.alias("_s0"), F.explode(F.sequence(begun, ended)).alias("_b")).join(places, ["net", "sta"])
    # A circle of over a quarter of the globe is in most cells, which then tell nothing.
    if 4 * span.most_km >= cells.FARTHEST_KM:
        return wanted, placed, ["_b"]
    size = cells.size_for(2 * span.most_km)
    return cells.with_circle(wanted, "_cell", "lat", "lon", F.lit(float(span.most_km)), size), placed.withColumn("_cell", cells.of("slat", "slon", size)), ["_cell", "_b"]


def measured(origins: DataFrame, segments: DataFrame, stations: DataFrame, span: Span, least: int, made: list[str], kernel: Callable, by_pair: bool = False) -> DataFrame:
    """event_id, net, sta, chan, distance, hypo, depth, sample_rate and the columns made (doubles), of windows of at least so many samples.

    kernel gets windows as a matrix, their rate and hypocentral distances (km),
    and gives an array for each column; by_pair: it depends on these distances.
    """
    wanted, placed, keys = dealt(origins, segments, stations, span)
    turn = (F.col("_b") * (1 << _CELL_BITS) + (F.col("_cell") if len(keys) > 1 else F.lit(0))) * 2
    place = lambda lat, lon: (F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    own = wanted.select(turn.alias("_turn"), F.col("time_us").cast("long").alias("_at"), *place("lat", "lon"), "event_id", "depth")
    there = placed.select((turn + 1).alias("_turn"), F.col("start_us").cast("long").alias("_at"), *place("slat", "slon"), "net", "sta", "chan", F.col("sample_rate").cast("double").alias("sample_rate"), "samples")
    rows = own.unionByName(there, allowMissingColumns=True)
    kinds = dict(rows.dtypes)
    out = ["event_id", "depth", "net", "sta", "chan", "sample_rate"]

    def run(batches):
        windows, bucket, held, at_hand = Windows(span, least, made, kernel, by_pair), None, [], None
        for batch in batches:
            turns = batch.column("_turn").to_numpy()
            for i, j in itertools.pairwise([*([0] if len(turns) else []), *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(turns)]):
                if turns[i] >> 1 != bucket:
                    bucket, held, at_hand = turns[i] >> 1, [], None
                part = batch.slice(i, j - i)
                if not turns[i] & 1:
                    held.append(part.select(["_at", "lat", "lon", "event_id", "depth"]))
                elif held:
                    at_hand = at_hand or Origins(pa.Table.from_batches(held), span)
                    yield from windows.met(at_hand, part, bucket >> _CELL_BITS)
        yield from windows.left()

    # Of a bucket the origins come first.  What is sorted is dealt out by its number: a circle is in four cells or so.
    number = tasks_for(origins) * (4 if len(keys) > 1 else 1)
    dealt_out = rows.repartition(number, F.shiftright("_turn", 1)).sortWithinPartitions("_turn")
    got = dealt_out.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in out), "distance double", *(f"{c} double" for c in made)]))
    return got.select("event_id", "net", "sta", "chan", "distance", hypocentral_km("distance", "depth").alias("hypo"), "depth", "sample_rate", *made)


class Origins:
    """Those of a bucket, by time."""

    def __init__(self, rows: pa.Table, span: Span) -> None:
        self.rows = rows.take(pa.array(np.argsort(rows["_at"].to_numpy(), kind="stable"))).combine_chunks()
        number = lambda c: np.asarray(self.rows[c].to_numpy(), float)
        self.time, self.lat, self.lon, self.depth = self.rows["_at"].to_numpy(), number("lat"), number("lon"), number("depth")
        self.wide, self.first = np.cos(np.radians(self.lat)), np.floor(span.first(self.time, span.least_km))

    def distance(self, some: slice, lat: float, lon: float) -> np.ndarray:
        a, b = np.sin(np.radians(lat - self.lat[some]) / 2), np.sin(np.radians(lon - self.lon[some]) / 2)
        h = a * a + self.wide[some] * np.cos(np.radians(lat)) * (b * b)
        return 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


class Windows:
    """Pairs and the windows that they ask for, until they are many enough to be measured."""

    def __init__(self, span: Span, least: int, made: list[str], kernel: Callable, by_pair: bool) -> None:
        self.span, self.least, self.made, self.kernel, self.by_pair = span, max(1, least), made, kernel, by_pair
        self._clear()

    def _clear(self) -> None:
        #: samples: stretches of waveforms; windows: begin in them, length, rate and hypo; pairs: columns that are ready, and window.
        self.samples, self.windows, self.pairs = [], [], []
        self.n_samples = self.n_windows = self.n_pairs = 0

    def met(self, origins: Origins, segments: pa.RecordBatch, bucket: int) -> Iterator[pa.RecordBatch]:
        start, rate, lat, lon = (segments.column(c).to_numpy(zero_copy_only=False) for c in ("_at", "sample_rate", "lat", "lon"))
        samples = segments.column("samples")
        at, values = samples.offsets.to_numpy(), samples.values
        begin, end = self.span.begin(self.span.least_km) * 1e6, self.span.end(self.span.most_km) * 1e6
        for r, (s, hz, n) in enumerate(zip(start.tolist(), rate.tolist(), np.diff(at).tolist(), strict=True)):
            # A sample more at both ends than any distance in range can ask for.
            near = np.searchsorted(origins.time, s - end - 1e6 / hz - 1), np.searchsorted(origins.time, s + (n + 1) * 1e6 / hz - begin + 1, "right")
            for a in range(near[0], near[1], PAIRS):
                some = slice(a, min(a + PAIRS, near[1]))
                km = origins.distance(some, lat[r], lon[r])
                k = np.flatnonzero((km >= self.span.least_km) & (km <= self.span.most_km) & (np.maximum(origins.first[some], s // self.span.width_us) == bucket))
                km, who = km[k], k + a
                lo, hi = (np.floor((origins.time[who] + f(km) * 1e6 - s) / 1e6 * hz) for f in (self.span.begin, self.span.end))
                lo, hi = np.maximum(lo, 0), np.minimum(hi, n)
                k = np.flatnonzero(hi - lo >= self.least)
                if len(k):
                    self._hold(origins, segments, r, who[k], km[k], lo[k].astype(np.int64), hi[k].astype(np.int64), values.slice(at[r], n), hz)
                if self.n_pairs >= PAIRS or self.n_windows >= WINDOWS or self.n_samples >= SAMPLES:
                    yield from self.left()

    def _hold(self, origins, segments, r, who, km, lo, hi, values, hz) -> None:
        asked = np.arange(len(who))
        if not self.by_pair:
            _, shows, asked = np.unique(lo * (len(values) + 1) + hi, return_index=True, return_inverse=True)
            lo, hi = lo[shows], hi[shows]
            far = np.zeros(len(shows))
        else:
            far = np.hypot(km, origins.depth[who])
        first, last = int(lo.min()), int(hi.max())
        self.windows.append((lo - first + self.n_samples, hi - lo, np.full(len(lo), hz), far))
        self.samples.append(values.slice(first, last - first).to_numpy(zero_copy_only=False).astype(float))
        taken = origins.rows.select(["event_id", "depth"]).take(pa.array(who))
        self.pairs.append(([*taken.columns, *(pa.chunked_array([pa.repeat(segments.column(c)[r], len(who))]) for c in ("net", "sta", "chan", "sample_rate"))], km, asked + self.n_windows))
        self.n_samples, self.n_windows, self.n_pairs = self.n_samples + last - first, self.n_windows + len(lo), self.n_pairs + len(who)

    def left(self) -> Iterator[pa.RecordBatch]:
        """What is measured of all that is held."""
        if not self.n_pairs:
            return
        samples = np.concatenate(self.samples)
        begin, size, rate, far = (np.concatenate(x) for x in zip(*self.windows, strict=True))
        found = np.empty((len(self.made), len(begin)))
        order = np.lexsort((size, rate))
        alike = np.flatnonzero((np.diff(size[order]) != 0) | (np.diff(rate[order]) != 0)) + 1
        for rows in np.split(order, alike):
            n, hz = int(size[rows[0]]), float(rate[rows[0]])
            for i in range(0, len(rows), max(1, AT_ONCE // n)):
                own = rows[i : i + max(1, AT_ONCE // n)]
                found[:, own] = self.kernel(samples[begin[own][:, None] + np.arange(n)], hz, far[own])
        ready, km, asked = zip(*self.pairs, strict=True)
        asked = np.concatenate(asked)
        columns = [pa.chunked_array([c for column in same for c in column.chunks]).combine_chunks() for same in zip(*ready, strict=True)]
        names = ["event_id", "depth", "net", "sta", "chan", "sample_rate", "distance", *self.made]
        self._clear()
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(km)), *(pa.array(x[asked]) for x in found)], names=names)
