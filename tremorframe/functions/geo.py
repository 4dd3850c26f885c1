"""Geodesy as column expressions: distances, azimuths, offsets, regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth's radius and kilometres of a degree.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.195
KM_PER_DEGREE_FLAT = 111.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def azimuth_deg(lat1, lon1, lat2, lon2) -> Column:
    """From the first point to the second, clockwise from north, in [0, 360)."""
    lat1, lon1, lat2, lon2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def km_to_deg(km) -> Column:
    return col(km) / KM_PER_DEGREE


def deg_to_km(degrees) -> Column:
    return col(degrees) * KM_PER_DEGREE


def offset_lat(lat, north_km) -> Column:
    return col(lat) + col(north_km) / KM_PER_DEGREE_FLAT


def offset_lon(lat, lon, east_km) -> Column:
    return col(lon) + col(east_km) / (KM_PER_DEGREE_FLAT * F.cos(F.radians(col(lat))))


def hypocentral_km(distance_km, depth_km) -> Column:
    return F.hypot(col(distance_km), col(depth_km))


def within_km(lat, lon, centre_lat, centre_lon, radius_km) -> Column:
    """Within a radius (inclusive); the latitude band comes first, as it reaches the scan."""
    lat, centre, radius = col(lat), col(centre_lat), col(radius_km)
    band = radius / KM_PER_DEGREE_FLAT
    return lat.between(centre - band, centre + band) & (haversine_km(centre_lat, centre_lon, lat, lon) <= radius)


def circle_box(lat, lon, radius_km) -> Column:
    """min_lat, max_lat, min_lon, max_lon round a circle."""
    dlat = col(radius_km) / KM_PER_DEGREE_FLAT
    dlon = col(radius_km) / (KM_PER_DEGREE_FLAT * F.cos(F.radians(col(lat))))
    return F.struct((col(lat) - dlat).alias("min_lat"), (col(lat) + dlat).alias("max_lat"), (col(lon) - dlon).alias("min_lon"), (col(lon) + dlon).alias("max_lon"))


def polygon_box(vertices) -> Column:
    """The same round an array of struct(lat, lon)."""
    v = col(vertices)
    lat, lon = F.transform(v, lambda p: p["lat"]), F.transform(v, lambda p: p["lon"])
    return F.struct(F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"), F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"))


def in_polygon(lat, lon, vertices) -> Column:
    """Parity of the edges that a ray crosses; an edge's upper end does not count."""
    lat, lon, v = col(lat), col(lon), col(vertices)
    previous = F.concat(F.slice(v, F.size(v), F.lit(1)), F.slice(v, F.lit(1), F.size(v) - 1))
    edges = F.zip_with(v, previous, lambda a, b: F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]), 1).otherwise(0))
    return F.when(F.size(v) >= 3, F.aggregate(edges, F.lit(0), lambda s, e: s + e) % 2 == 1).otherwise(False)


def strictly_in_polygon(lat, lon, vertices) -> Column:
    """Parity of the edges north of a point; a point on an edge is outside."""
    lat, lon, v = col(lat), col(lon), col(vertices)
    previous = F.concat(F.slice(v, F.size(v), F.lit(1)), F.slice(v, F.lit(1), F.size(v) - 1))
    # The point moved along the edge to its upper end; null for an edge along a meridian.
    moved = lambda a, b: lat - (lon - F.when(a["lat"] > b["lat"], a["lon"]).otherwise(b["lon"])) * (b["lat"] - a["lat"]) / F.nullif(b["lon"] - a["lon"], F.lit(0.0))
    north = F.zip_with(v, previous, lambda a, b: F.when(((a["lon"] > lon) != (b["lon"] > lon)) & (moved(a, b) < F.greatest(a["lat"], b["lat"])), 1).otherwise(0))
    beside = lambda a, b: lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
    touched = F.exists(F.zip_with(v, previous, lambda a, b: beside(a, b) & F.coalesce(moved(a, b) == F.greatest(a["lat"], b["lat"]), F.lit(True))), lambda x: x)
    return F.when(F.size(v) >= 3, (F.aggregate(north, F.lit(0), lambda s, e: s + e) % 2 == 1) & ~touched).otherwise(False)


def in_bounds(lat, lon, depth, b: str) -> Column:
    """Whether a point is inside the bounds in the columns b.* (see regions.BOUNDS)."""
    c = lambda name: F.col(f"{b}.{name}" if b else name)
    box = col(lat).between(c("min_lat"), c("max_lat")) & col(lon).between(c("min_lon"), c("max_lon"))
    deep = col(depth).between(c("min_depth"), c("max_depth"))
    shape = F.when(c("bounds_type") == "circle", haversine_km(c("center_lat"), c("center_lon"), lat, lon) <= c("radius_km")).when(c("bounds_type") == "polygon", in_polygon(lat, lon, c("vertices"))).otherwise(True)
    return box & deep & shape
