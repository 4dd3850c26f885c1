"""Sliding operators over samples in rows: (stream..., idx, value).

``Stream`` names the columns; all frames are row frames of one stream, in the
order of idx.  The expressions here sum each frame by itself, which costs a
frame's length a sample and loses nothing to cancellation; ``frames`` has sums
and moments whose cost does not grow with the frame, and deals a stream out in
blocks of samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Below these, energies and variances count as zero.
TINY_LTA, TINY_PREFIX, TINY_MOMENT, TINY_AIC = 1e-10, 1e-20, 1e-20, 1e-20


@dataclass(frozen=True)
class Stream:
    by: tuple[str, ...] = ("stream_id",)
    idx: str = "idx"
    value: str = "value"

    @property
    def window(self):
        return Window.partitionBy(*self.by).orderBy(self.idx)

    @property
    def whole(self):
        return Window.partitionBy(*self.by)

    def rows(self, first: int, last: int):
        return self.window.rowsBetween(first, last)

    @property
    def x(self) -> Column:
        return F.col(self.value)

    @property
    def i(self) -> Column:
        return F.col(self.idx)

    def sum(self, x: Column, first: int, last: int) -> Column:
        """Sum over the rows first to last around each row."""
        return F.coalesce(F.sum(x).over(self.rows(first, last)), F.lit(0.0))


def sta_lta(s: Stream, sta: int, lta: int, value: Column | None = None, tiny: float = TINY_LTA) -> Column:
    """Mean energy of the last sta samples over that of the last lta; 0 before sample lta."""
    sta, x = max(1, sta), s.x if value is None else value
    lta = max(sta + 1, lta)
    short, long = s.sum(x * x, -(sta - 1), 0) / sta, s.sum(x * x, -(lta - 1), 0) / lta
    return F.when((s.i >= lta) & (long > tiny), short / long).otherwise(0.0)


def demeaned(s: Stream) -> Column:
    return s.x - F.avg(s.x).over(s.whole)


def energy_ratio(s: Stream, w: int, tiny: float = TINY_PREFIX) -> Column:
    """Energy of the w samples before over that of the w before these."""
    near, far = s.sum(s.x * s.x, -w, -1), s.sum(s.x * s.x, -2 * w, -w - 1)
    return F.when((s.i >= 2 * w) & (far > tiny), near / far).otherwise(0.0)


def polarization_amplitude(s: Stream, z: str, n: str, e: str, w: int) -> Column:
    """Root of the trace of the (uncentred) covariance of the last w samples."""
    power = sum((s.sum(F.col(c) * F.col(c), -w, -1) for c in (n, e)), s.sum(F.col(z) * F.col(z), -w, -1))
    return F.when(s.i >= w, F.sqrt(power / w)).otherwise(0.0)


def rectilinearity(s: Stream, z: str, n: str, e: str, w: int) -> Column:
    """1 - 2 sqrt(I2) / I1 of the centred covariance of the w samples before, in [0, 1]."""
    c = {k: F.col(k) for k in (z, n, e)}
    mean = {k: s.sum(v, -w, -1) / w for k, v in c.items()}
    cov = lambda a, b: s.sum(c[a] * c[b], -w, -1) / w - mean[a] * mean[b]
    zz, nn, ee, zn, ze, ne = cov(z, z), cov(n, n), cov(e, e), cov(z, n), cov(z, e), cov(n, e)
    i1 = zz + nn + ee
    i2 = zz * nn + zz * ee + nn * ee - zn * zn - ze * ze - ne * ne
    value = 1.0 - 2.0 * F.sqrt(F.greatest(i2, F.lit(0.0))) / i1
    return F.when((s.i >= w) & (i1 > TINY_MOMENT), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.0)


def moving_envelope(s: Stream, n: int = 10) -> Column:
    return F.avg(F.abs(s.x)).over(s.rows(-(n - 1), 0))


def aic(s: Stream, tiny: float = TINY_AIC) -> Column:
    """k ln var[0, k) + (n - k - 1) ln var[k, n); 0 at both ends."""
    before = s.window.rowsBetween(Window.unboundedPreceding, -1)
    n, k = F.count("*").over(s.whole), s.i
    s1, s2 = F.sum(s.x).over(before), F.sum(s.x * s.x).over(before)
    r1, r2, m = F.sum(s.x).over(s.whole) - s1, F.sum(s.x * s.x).over(s.whole) - s2, n - k
    left = F.greatest(s2 / k - F.pow(s1 / k, 2), F.lit(tiny))
    right = F.greatest(r2 / m - F.pow(r1 / m, 2), F.lit(tiny))
    return F.when((k > 0) & (k < n - 1), k * F.ln(left) + (m - 1) * F.ln(right)).otherwise(0.0)


def argmin(df: DataFrame, s: Stream, column: str, first: Column | int = 0, last: Column | None = None) -> DataFrame:
    """The first row of least value in [first, last) of each stream."""
    rows = df.where(s.i >= first)
    rows = rows if last is None else rows.where(s.i < last)
    return rows.groupBy(*s.by).agg(F.min_by(s.i, F.struct(F.col(column), s.i)).alias("idx"), F.min(column).alias(column))


def pick_amplitude(s: Stream, n: int) -> Column:
    """Largest absolute sample of the n from each one on."""
    return F.max(F.abs(s.x)).over(s.rows(0, max(0, n - 1)))
