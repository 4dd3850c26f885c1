"""Cells of latitude and longitude, so that places near each other meet in an equi-join.

A place is in one cell of so many degrees; a circle or a box covers some.  What
is inside of a circle or box is in one of its cells, so a join on cells with a
test after it finds all pairs and compares few others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import EARTH_RADIUS_KM, col

#: Sizes in degrees; all divide the circle.
SIZES = (1, 2, 3, 5, 6, 10, 15, 20, 30, 60)
#: Half of the Earth's circumference, rounded up.
FARTHEST_KM = 20_016.0
_ROW = 10_000
#: What rounding may move a border by, in degrees.
_EPSILON = 1e-9


def size_for(km: float) -> int:
    """The least size that a circle of the radius does not cover many cells of."""
    degrees = km / (EARTH_RADIUS_KM * 3.141592653589793 / 180)
    return next((s for s in SIZES if s >= degrees), SIZES[-1])


def of(lat, lon, size: int) -> Column:
    """The cell of a place; longitudes a turn apart are the same."""
    row = F.floor((F.greatest(F.least(col(lat), F.lit(90.0)), F.lit(-90.0)) + 90) / size)
    return (row * _ROW + F.floor(F.pmod(col(lon) + 180, F.lit(360.0)) / size)).cast("long")


def _grid(low: Column, high: Column, west: Column, east: Column, turn: int | None) -> Column:
    """The cells of rows low to high and columns west to east, these a turn of so many columns."""
    columns = F.sequence(west, east)
    wrapped = F.array_distinct(F.transform(columns, lambda c: F.pmod(c, F.lit(turn)))) if turn else columns
    return F.flatten(F.transform(F.sequence(low, high), lambda r: F.transform(wrapped, lambda c: r * _ROW + c)))


def _circle(lat, lon, km, size: int) -> tuple[Column, Column, Column, Column]:
    """Lowest and highest row, first and last column of a circle's cells; columns are not turned back into the circle yet."""
    lat, lon = F.greatest(F.least(col(lat), F.lit(90.0)), F.lit(-90.0)), col(lon)
    high = F.degrees(col(km) / EARTH_RADIUS_KM) + _EPSILON
    pole = F.abs(lat) + high >= 90
    wide = F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(high)) / F.cos(F.radians(lat)))))) + _EPSILON
    row = lambda x: F.floor((F.greatest(F.least(x, F.lit(90.0)), F.lit(-90.0)) + 90) / size).cast("long")
    column = lambda x: F.floor((x + 180) / size).cast("long")
    return row(lat - high), row(lat + high), column(lon - wide), column(lon + wide)


def of_circle(lat, lon, km, size: int) -> Column:
    """Array of the cells that hold places within km of (lat, lon)."""
    return _grid(*_circle(lat, lon, km, size), 360 // size)


def with_circle(df: DataFrame, name: str, lat, lon, km, size: int) -> DataFrame:
    """df with a row for each cell of ``of_circle``, which is name."""
    turn, (low, high, west, east) = 360 // size, _circle(lat, lon, km, size)
    # Rows and columns one after the other: functions over arrays are not compiled.
    rows = df.withColumns({"_west": west, "_east": F.least(east, west + turn - 1), "_row": F.explode(F.sequence(low, high))})
    rows = rows.withColumn("_column", F.explode(F.sequence("_west", "_east")))
    return rows.withColumn(name, F.col("_row") * _ROW + F.pmod("_column", F.lit(turn))).drop("_west", "_east", "_row", "_column")


def flat(lat, lon, size: int) -> Column:
    """The cell of a place on a map without a seam: longitudes a turn apart differ, as they do for boxes."""
    row, column = (F.floor((F.greatest(F.least(col(x), F.lit(b)), F.lit(-b)) + b) / size) for x, b in ((lat, 90.0), (lon, 540.0)))
    return (row * _ROW + column).cast("long")


def of_box(min_lat, max_lat, min_lon, max_lon, size: int) -> Column:
    """Array of the ``flat`` cells of a box; none if it is upside down."""
    edge = lambda x, b: F.floor((F.greatest(F.least(col(x), F.lit(b)), F.lit(-b)) + b) / size).cast("long")
    low, high, west, east = edge(min_lat, 90.0), edge(max_lat, 90.0), edge(min_lon, 540.0), edge(max_lon, 540.0)
    return F.when((low <= high) & (west <= east), _grid(low, F.greatest(low, high), west, F.greatest(west, east), None)).otherwise(F.array().cast("array<bigint>"))
