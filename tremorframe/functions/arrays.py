"""Whole-signal functions on array columns (higher-order functions, no Python)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row; inside of a lambda over samples it would be for each of them."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(x) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda s, v: s + v)


def mean(x) -> Column:
    return F.when(F.size(col(x)) > 0, total(x) / F.size(col(x))).otherwise(0.0)


def std(x) -> Column:
    """Sample standard deviation; 0 for less than two samples."""
    squares = once(mean(x), lambda m: F.aggregate(F.transform(col(x), lambda v: F.pow(v - m, 2)), F.lit(0.0), lambda s, v: s + v))
    return F.when(F.size(col(x)) > 1, F.sqrt(squares / (F.size(col(x)) - 1))).otherwise(0.0)


def abs_max(x) -> Column:
    return F.coalesce(F.array_max(F.transform(col(x), lambda v: F.abs(v))), F.lit(0.0))


def demean(x) -> Column:
    return once(mean(x), lambda m: F.transform(col(x), lambda v: v - m))


def detrend(x) -> Column:
    """Takes the least-squares line off."""
    n = F.size(col(x)).cast("double")
    products = F.aggregate(F.transform(col(x), lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)
    si, sii = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    slope = (n * products - si * total(x)) / (n * sii - si * si)
    start = (total(x) - slope * si) / n
    line = F.struct(start.alias("start"), slope.alias("slope"))
    return F.when(F.size(col(x)) < 2, col(x)).otherwise(once(line, lambda l: F.transform(col(x), lambda v, i: v - (l["start"] + l["slope"] * i))))


def normalize(x) -> Column:
    scaled = lambda x, m: F.when(m > 0, F.transform(x, lambda v: v / m)).otherwise(x)
    return once(col(x), lambda x: once(abs_max(x), lambda m: scaled(x, m)))


def prepared(x) -> Column:
    """What a detector is given: the mean off, the loudest sample 1."""
    return normalize(demean(x))


def taper(x, share: float = 0.05) -> Column:
    """Half a cosine over a share of the samples (one at least) at both ends."""
    n = F.size(col(x))
    m = F.greatest(F.floor(n * share).cast("int"), F.lit(1))
    gain = lambda i: 0.5 * (1 - F.cos(math.pi * i / m))
    left = lambda v, i: F.when(i < m, v * gain(i)).otherwise(v)
    right = lambda v, i: F.when(n - 1 - i < m, left(v, i) * gain(n - 1 - i)).otherwise(left(v, i))
    return F.transform(col(x), right)


def integrate(x, rate) -> Column:
    """Running sums: the first sample stays, the others add x / rate."""
    step = lambda a, v: F.when(F.size(a) == 0, F.array(v)).otherwise(F.concat(a, F.array(F.element_at(a, -1) + v / rate)))
    return F.aggregate(col(x), F.array().cast("array<double>"), step)


def differentiate(x, rate) -> Column:
    x = col(x)
    d = F.transform(x, lambda v, i: F.when(i > 0, (v - F.get(x, i - 1)) * rate).otherwise(F.when(F.size(x) > 1, (F.get(x, F.lit(1)) - v) * rate).otherwise(F.lit(0.0))))
    return d


def resample(x, ratio: float) -> Column:
    """Linear interpolation at every ``ratio``-th place (old rate / new rate)."""
    x = col(x)
    n = F.floor(F.size(x) / ratio).cast("int")

    def at(i):
        place = i * F.lit(float(ratio))
        low = F.floor(place).cast("int")
        inside = F.get(x, low) * (1 - (place - low)) + F.get(x, low + 1) * (place - low)
        return F.when(low + 1 < F.size(x), inside).otherwise(F.get(x, F.size(x) - 1))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def time_slice(x, first, last) -> Column:
    """Samples [first, last) as far as there are any."""
    x = col(x)
    lo = F.greatest(col(first).cast("int"), F.lit(0))
    hi = F.least(col(last).cast("int"), F.size(x))
    return F.when(hi > lo, F.slice(x, lo + 1, hi - lo)).otherwise(F.array().cast("array<double>"))
