"""Times: epochs, ordinal dates, SEED times, and samples' times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def epoch_micros(ts) -> Column:
    """Microseconds since 1970; a timestamp without zone counts as UTC (the session's zone is UTC)."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def epoch_seconds(ts) -> Column:
    return epoch_micros(ts) / 1e6


def from_micros(us) -> Column:
    return F.timestamp_micros(_c(us))


def jdate(ts) -> Column:
    """YYYYDDD."""
    return (F.year(_c(ts)) * 1000 + F.dayofyear(_c(ts))).cast("int")


def btime(year, day, hour, minute, second, ticks) -> Column:
    """A SEED time: ordinal day, and ticks of 0.1 ms; as epoch microseconds."""
    days = F.datediff(F.date_add(F.make_date(_c(year), F.lit(1), F.lit(1)), _c(day) - 1), F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 86_400 + _c(hour) * 3_600 + _c(minute) * 60 + _c(second)) * 1_000_000 + _c(ticks) * 100


def time_at(start_us, index, rate) -> Column:
    """Epoch microseconds of a sample, cut to whole ones."""
    return _c(start_us) + (_c(index) * 1e6 / _c(rate)).cast("long")


def index_at(start_us, at_us, rate) -> Column:
    return F.floor((_c(at_us) - _c(start_us)) / 1e6 * _c(rate)).cast("long")


def end_time(start_us, n, rate) -> Column:
    """Time of the last sample."""
    return time_at(start_us, _c(n) - 1, rate)


def duration(n, rate) -> Column:
    return _c(n) / _c(rate)


def utc_text(ts) -> Column:
    return F.concat(F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
