"""Pickers by name, and those that need kernels: several bands, autoregression, detectors.

A kernel picker takes segments with arrays (by..., start_us, sample_rate,
samples) and gives a row for each pick.  A detector is anything with
``predict(samples, rate)``; models come in through ``register_backend``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from . import triggers

PICK = "idx long, phase string, snr double, confidence double, band string"


class Backend(Protocol):
    """What a detector offers."""

    name: str

    def predict(self, samples: np.ndarray, rate: float) -> list[tuple[int, str, float]]: ...


class BuiltIn:
    """Kurtosis for P, the envelope for S."""

    name = "builtin"

    def __init__(self, min_probability: float = 0.5, gap_s: float = 0.5) -> None:
        self.min_probability, self.gap_s = min_probability, gap_s

    def predict(self, samples: np.ndarray, rate: float) -> list[tuple[int, str, float]]:
        return kernels.ml_backend(samples, rate, self.min_probability, self.gap_s)


BACKENDS: dict[str, Callable[..., Backend]] = {"builtin": BuiltIn}


def register_backend(name: str, make: Callable[..., Backend]) -> None:
    BACKENDS[name.lower()] = make


def backend(name: str, **options) -> Backend:
    if name.lower() not in BACKENDS:
        raise ValueError(f"unknown detector {name!r}; known are {', '.join(BACKENDS)}")
    return BACKENDS[name.lower()](**options)


def ratio_triggers(ratio: np.ndarray, on: float, off: float) -> list[tuple[int, int, float]]:
    """(first, end, peak) of hysteresis triggers that end."""
    out, at, peak = [], None, 0.0
    for i in np.flatnonzero((ratio >= on) | (ratio < off)).tolist():
        if at is None and ratio[i] >= on:
            at = i
        elif at is not None and ratio[i] < off:
            out.append((at, i, float(ratio[at:i].max())))
            at = None
    return out


def energy_ratio(x: np.ndarray, sta: int, lta: int) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(x * x)))
    i = np.arange(len(x))
    mean = lambda n: (sums[i + 1] - sums[np.maximum(i + 1 - n, 0)]) / n
    long = mean(lta)
    return np.where((i >= lta) & (long > 1e-10), mean(sta) / np.maximum(long, 1e-300), 0.0)


def aic_onset(x: np.ndarray, at: int, reach: int) -> int:
    """The AIC minimum within reach of a sample."""
    lo, hi = max(0, at - reach), min(len(x), at + reach)
    w = x[lo:hi]
    n = len(w)
    if n < 12:
        return at
    k = np.arange(1, n - 1)
    s, q = np.cumsum(w), np.cumsum(w * w)
    left = np.maximum(q[k - 1] / k - (s[k - 1] / k) ** 2, 1e-20)
    right = np.maximum((q[-1] - q[k - 1]) / (n - k) - ((s[-1] - s[k - 1]) / (n - k)) ** 2, 1e-20)
    aic = k * np.log(left) + (n - k - 1) * np.log(right)
    inner = (k >= 5) & (k < n - 5)
    return lo + int(k[inner][aic[inner].argmin()])


def _run(segments: DataFrame, by: list[str], f: Callable[[np.ndarray, float], list[tuple]]) -> DataFrame:
    """by..., start_us, sample_rate, time_us and the picks of f."""
    keep = [*by, "start_us", "sample_rate"]
    schema = T.StructType([*segments.select(*keep).schema.fields, *T.StructType.fromDDL(PICK).fields])
    names = [x.name for x in schema.fields]

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                head = [getattr(r, k) for k in keep]
                x = np.asarray(r.samples if r.samples is not None else [], float)
                rows += [(*head, *p) for p in f(x, float(r.sample_rate))]
            yield pd.DataFrame(rows, columns=names)

    found = segments.select(*keep, "samples").mapInPandas(run, schema)
    return found.withColumn("time_us", F.col("start_us") + (F.col("idx") * 1e6 / F.col("sample_rate")).cast("long"))


def multi_band(segments: DataFrame, by: list[str], bands: tuple[tuple[float, float], ...] = ((1.0, 2.0), (2.0, 4.0), (4.0, 8.0), (8.0, 16.0)), sta_s: float = 0.5, lta_s: float = 10.0, trigger: float = 3.0, detrigger: float = 1.5, join_s: float = 1.0) -> DataFrame:
    """STA/LTA in every band below the Nyquist frequency; picks of several bands within join_s are one, of the best band."""

    def f(x: np.ndarray, rate: float) -> list[tuple]:
        sta, lta = max(1, int(sta_s * rate)), max(2, int(lta_s * rate))
        if len(x) <= lta:
            return []
        found = []
        for lo, hi in bands:
            if hi < 0.8 * rate / 2:
                y = kernels.bandpass(x - x.mean(), rate, lo, hi)
                found += [(aic_onset(y, a, int(0.5 * rate)), p, f"{lo:g}-{hi:g}") for a, _, p in ratio_triggers(energy_ratio(y, sta, lta), trigger, detrigger)]
        out: list[list] = []
        for at, snr, band in sorted(found):
            if out and at - out[-1][0] < join_s * rate:
                if snr > out[-1][2]:
                    out[-1][2:] = [snr, min(1.0, snr / 10), band]
            else:
                out.append([at, "P", snr, min(1.0, snr / 10), band])
        return [tuple(o) for o in out]

    return _run(segments, by, f)


def autoregressive(segments: DataFrame, by: list[str], sta_s: float = 0.3, lta_s: float = 5.0, trigger: float = 5.0, detrigger: float = 1.5) -> DataFrame:
    """STA/LTA of the prediction error."""

    def f(x: np.ndarray, rate: float) -> list[tuple]:
        sta, lta = max(1, int(sta_s * rate)), max(2, int(lta_s * rate))
        if len(x) <= lta:
            return []
        e = kernels.ar_error(x - x.mean())
        return [(a, "P", p, min(1.0, p / 10), "") for a, _, p in ratio_triggers(energy_ratio(e, sta, lta), trigger, detrigger)]

    return _run(segments, by, f)


def detector(segments: DataFrame, by: list[str], name: str = "builtin", **options) -> DataFrame:
    """Picks of a registered detector; its probability is a tenth of snr."""
    model = backend(name, **options)
    return _run(segments, by, lambda x, rate: [(i, phase, 10 * p, p, "") for i, phase, p in model.predict(x, rate)])


#: Pickers over samples in rows (rows) and over segments (arrays).
PICKERS = {"stalta": ("rows", triggers.stalta_picks), "aic": ("rows", triggers.aic_picks), "polarization": ("rows", triggers.polarization_picks), "multiband": ("arrays", multi_band), "ar": ("arrays", autoregressive), "ml": ("arrays", detector)}


def picker(name: str) -> tuple[str, Callable]:
    if name.lower() not in PICKERS:
        raise ValueError(f"unknown picker {name!r}; known are {', '.join(PICKERS)}")
    return PICKERS[name.lower()]
