"""One-dimensional velocity models, travel times and their lookup.

A model is a short list of layers, so it lives on the driver as numpy arrays;
its travel-time table (a row for each kilometre of distance and depth and both
phase classes) is a DataFrame that joins picks on whole kilometres.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import phase_class
from ..functions.geo import col
from ..scratch import written

#: Depth, thickness (0: down without end), vp, vs, density.
MODELS = {
    "iasp91": [(0.0, 20.0, 5.80, 3.36, 2.60), (20.0, 15.0, 6.50, 3.75, 2.90), (35.0, 77.5, 8.04, 4.47, 3.38), (112.5, 52.5, 8.05, 4.50, 3.38), (165.0, 45.0, 8.17, 4.51, 3.39), (210.0, 0.0, 8.30, 4.52, 3.40)],
    "ak135": [(0.0, 20.0, 5.80, 3.46, 2.60), (20.0, 15.0, 6.50, 3.85, 2.92), (35.0, 75.0, 8.04, 4.48, 3.32), (110.0, 100.0, 8.05, 4.50, 3.45), (210.0, 0.0, 8.30, 4.52, 3.50)],
    "simple3": [(0.0, 15.0, 5.50, 3.18, 2.60), (15.0, 20.0, 6.30, 3.64, 2.85), (35.0, 0.0, 8.00, 4.62, 3.30)],
    "korea": [(0.0, 1.0, 4.50, 2.60, 2.40), (1.0, 9.0, 5.90, 3.41, 2.70), (10.0, 10.0, 6.20, 3.58, 2.80), (20.0, 13.0, 6.60, 3.81, 2.90), (33.0, 7.0, 7.20, 4.16, 3.10), (40.0, 0.0, 8.00, 4.62, 3.35)],
}
#: What holds where a model has no layer, and the depth that rays reach.
NO_LAYER = {"P": 6.0, "S": 3.5}
BOTTOM_KM = 200.0
ENDLESS_KM = 1e4
LAYERS = "model string, top_depth double, thickness double, vp double, vs double, density double, qp double, qs double"


@dataclass(frozen=True)
class Model:
    """layers: (top, thickness, vp, vs, density), by depth."""

    name: str
    layers: tuple[tuple[float, ...], ...]

    @classmethod
    def named(cls, name: str) -> Model:
        return cls(name, tuple(sorted(MODELS[name])))

    def stack(self, phase: str) -> np.ndarray:
        """top, bottom, velocity of the layers with a velocity."""
        k = 2 if phase == "P" else 3
        return np.array([(r[0], r[0] + r[1] if r[1] > 0 else ENDLESS_KM, r[k]) for r in self.layers if r[k] > 0])

    def velocity(self, depth: float, phase: str) -> float:
        """Of the first layer that holds the depth, else the last one."""
        k = 2 if phase == "P" else 3
        for r in self.layers:
            if r[0] <= depth < r[0] + (r[1] if r[1] > 0 else 1e9):
                return r[k]
        return self.layers[-1][k] if self.layers else NO_LAYER[phase]


def head_waves(stack: np.ndarray, distance: np.ndarray, depth: float) -> np.ndarray:
    """Least time along a faster layer's top, infinite where there is none."""
    best = np.full(len(distance), np.inf)
    for k in range(1, len(stack)):
        top, fast = stack[k, 0], stack[k, 2]
        above = stack[:k]
        if fast <= above[-1, 2] or depth > top + 1.0 or (above[:, 2] >= fast).any():
            continue
        sine = above[:, 2] / fast
        cosine = np.sqrt(1 - sine**2)
        bottom = np.minimum(above[:, 1], top)
        up = np.maximum(bottom - above[:, 0], 0.0)
        down = np.maximum(bottom - np.maximum(above[:, 0], depth), 0.0)
        legs = up + down
        along = distance - (legs * sine / cosine).sum()
        time = (legs / (above[:, 2] * cosine)).sum() + along / fast
        best = np.where((along >= 0) & (time > 0), np.minimum(best, time), best)
    return best


def ray_by_bisection(stack: np.ndarray, distance: np.ndarray, depth: float, source_v: float, steps: int = 30, near: float = 0.5) -> np.ndarray:
    """Time of the slowness whose legs come within ``near`` km of the distance, infinite where none does."""
    bottom = np.minimum(stack[:, 1], BOTTOM_KM)
    used = stack[:, 0] < BOTTOM_KM
    below = np.where(used, np.maximum(bottom - np.maximum(stack[:, 0], depth), 0.0), 0.0)
    above = np.where(used, np.maximum(np.minimum(bottom, depth) - stack[:, 0], 0.0), 0.0)
    legs, v = below + above, stack[:, 2]
    v, legs = v[legs > 0], legs[legs > 0]
    lo, hi = np.full(len(distance), 1e-4), np.full(len(distance), 0.999 / source_v)
    best, open_ = np.full(len(distance), np.inf), distance > 0
    for _ in range(steps):
        p = (lo + hi) / 2
        sine = p[:, None] * v
        turned = (sine >= 1.0).any(1)
        cosine = np.sqrt(np.maximum(1 - sine**2, 1e-300))
        x = np.where(turned, np.inf, (legs * sine / cosine).sum(1))
        t = (legs / (v * cosine)).sum(1)
        hit = open_ & ~turned & (np.abs(x - distance) < near)
        best = np.where(hit & (t > 0), t, best)
        lo = np.where(open_ & (x < distance), p, lo)
        hi = np.where(open_ & (x >= distance), p, hi)
        open_ &= ~hit
    return best


def travel_times(model: Model, distance: np.ndarray, depth: float, phase: str = "P") -> np.ndarray:
    """Least of the straight ray, head waves and the bisected ray, for distances at one depth."""
    stack = model.stack(phase)
    if not len(stack):
        return distance / 6.0
    thick = np.minimum(stack[:, 1], max(depth, 1.0)) - stack[:, 0]
    thick = np.maximum(thick, 0.0)
    mean = (stack[:, 2] * thick).sum() / thick.sum() if thick.sum() > 0 else stack[0, 2]
    straight = np.sqrt(distance**2 + depth**2) / mean
    return np.minimum(straight, np.minimum(head_waves(stack, distance, depth), ray_by_bisection(stack, distance, depth, model.velocity(depth, phase))))


@functools.lru_cache(64)
def table(model: Model, max_km: int = 3000, max_depth: int = 100) -> dict[str, np.ndarray]:
    """P and S times at whole kilometres: [distance, depth]."""
    d = np.arange(max_km + 1, dtype=float)
    return {p: np.stack([travel_times(model, d, float(z), p) for z in range(max_depth + 1)], 1) for p in "PS"}


_STORED: dict = {}


def table_rows(spark: SparkSession, model: Model, max_km: int = 3000, max_depth: int = 100) -> DataFrame:
    """model, phase_class, d_bin, z_bin, t; (max_km + 1) (max_depth + 1) 2 rows, made by tasks of one depth each and kept as a table of the session."""
    key = (spark.sparkContext.applicationId, model, max_km, max_depth)
    if key not in _STORED:
        d = np.arange(max_km + 1)

        def run(batches):
            for batch in batches:
                for k in batch["id"].to_pylist():
                    phase, z = "PS"[k % 2], k // 2
                    t = travel_times(model, d.astype(float), float(z), phase)
                    yield pa.RecordBatch.from_pydict({"model": [model.name] * len(d), "phase_class": [phase] * len(d), "d_bin": d.astype(np.int32), "z_bin": np.full(len(d), z, np.int32), "t": t})

        parts = spark.range(0, 2 * (max_depth + 1), 1, min(2 * (max_depth + 1), 4 * spark.sparkContext.defaultParallelism))
        _STORED[key] = written(parts.mapInArrow(run, "model string, phase_class string, d_bin int, z_bin int, t double"), "travel-times", session=True)
    return _STORED[key]


def straight_rows(spark: SparkSession, vp: float, vs: float, name: str = "straight", max_km: int = 3000, max_depth: int = 100) -> DataFrame:
    """The same table for straight rays in a half-space, made where it is used."""
    d, z = F.floor(F.col("id") / (max_depth + 1)).cast("int"), (F.col("id") % (max_depth + 1)).cast("int")
    points = spark.range((max_km + 1) * (max_depth + 1)).select(d.alias("d_bin"), z.alias("z_bin"))
    velocity = F.explode(F.array(*(F.struct(F.lit(p).alias("phase_class"), F.lit(float(v)).alias("v")) for p, v in (("P", vp), ("S", vs))))).alias("p")
    rows = points.select("d_bin", "z_bin", velocity).select(F.lit(name).alias("model"), "p.*", "d_bin", "z_bin")
    return rows.withColumn("t", straight_ray("d_bin", "z_bin", "v")).select("model", "phase_class", "d_bin", "z_bin", "t")


def lookup(rows: DataFrame, times: DataFrame, distance: str, depth: str, phase: str, out: str = "tt", max_km: int = 3000, max_depth: int = 100) -> DataFrame:
    """Adds the time of the whole kilometre below a row's distance and depth; times is any table as ``table_rows`` has.

    times is one model's table; its size is fixed by max_km and max_depth, so
    Spark may broadcast it.
    """
    keys = {"d_bin": F.least(F.floor(distance).cast("int"), F.lit(max_km)), "z_bin": F.least(F.greatest(F.floor(depth).cast("int"), F.lit(0)), F.lit(max_depth)), "phase_class": phase_class(phase)}
    named = rows.withColumns({f"_{k}": v for k, v in keys.items()})
    other = times.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("t").alias(out))
    return named.join(other, [f"_{k}" for k in keys], "left").drop(*(f"_{k}" for k in keys))


def layer_rows(spark: SparkSession, models: list[Model]) -> DataFrame:
    return spark.createDataFrame([(m.name, *r[:5], 500.0, 250.0) for m in models for r in m.layers], LAYERS)


def by_depth(layers: DataFrame) -> DataFrame:
    """model, layers: each model's layers as one array by depth; a model has a few."""
    fields = ("top_depth", "thickness", "vp", "vs", "density", "qp", "qs")
    return layers.groupBy("model").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("layers"))


def velocity_at(layers: Column | str, depth, phase: str = "vp") -> Column:
    """Of an array of layer structs by depth: the first that holds the depth, else the last."""
    layers, z = col(layers), col(depth)
    held = F.filter(layers, lambda r: (r["top_depth"] <= z) & (z < F.when(r["thickness"] > 0, r["top_depth"] + r["thickness"]).otherwise(r["top_depth"] + 1e9)))
    return F.when(F.size(layers) == 0, NO_LAYER["P" if phase == "vp" else "S"]).otherwise(F.coalesce(F.get(held, F.lit(0))[phase], F.element_at(layers, -1)[phase]))


def vp_vs(vp, vs) -> Column:
    return F.when(col(vs) > 0, col(vp) / col(vs)).otherwise(1.73)


def poisson(vp, vs) -> Column:
    r2 = F.pow(vp_vs(vp, vs), 2)
    return (r2 - 2) / (2 * (r2 - 1))


def straight_ray(distance_km, depth_km, velocity) -> Column:
    return F.hypot(col(distance_km), col(depth_km)) / col(velocity)
