"""Regional models: which bounds hold a point, by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.geo import in_bounds

BOUNDS = "name string, bounds_type string, min_lat double, max_lat double, min_lon double, max_lon double, min_depth double, max_depth double, center_lat double, center_lon double, radius_km double, vertices array<struct<lat:double,lon:double>>, priority int, description string"
#: Named regions with their bounds and priority.
REGIONS = [
    ("socal", "box:32.0,36.0,-121.0,-114.0", 10, "south of California"),
    ("nocal", "box:36.0,42.0,-125.0,-119.0", 10, "north of California"),
    ("cascadia", "polygon:42.0,-125.0;42.0,-120.0;49.0,-120.0;49.0,-125.0", 10, "Cascadia"),
    ("alaska", "box:55.0,72.0,-170.0,-130.0", 5, "Alaska"),
    ("hawaii", "circle:19.5,-155.5,200.0", 20, "round Hawaii"),
    ("japan", "box:30.0,46.0,128.0,146.0", 10, "Japan"),
    ("mediterranean", "polygon:30.0,-10.0;30.0,40.0;48.0,40.0;48.0,-10.0", 5, "Mediterranean Sea and its coasts"),
    ("korea", "box:33.0,43.0,124.0,132.0", 15, "Korea"),
]
DEFAULT = "default"
#: Degrees of the cells in which places and regions meet.
CELL = 10


def parsed_bounds(text: Column) -> Column:
    """box:..., circle:... or polygon:...; anything else is the whole globe."""
    kind, body = F.regexp_extract(text, "^(box|circle|polygon):", 1), F.regexp_replace(text, "^[a-z]+:", "")
    n = F.transform(F.split(body, ","), lambda x: F.trim(x).try_cast("double"))
    points = F.transform(F.split(body, ";"), lambda p: F.struct(F.get(F.split(p, ","), F.lit(0)).try_cast("double").alias("lat"), F.get(F.split(p, ","), F.lit(1)).try_cast("double").alias("lon")))
    at = lambda i: F.get(n, F.lit(i))
    lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    dlat, dlon = at(2) / 111.0, at(2) / (111.0 * F.cos(F.radians(at(0))))
    pick = lambda box, circle, polygon, world: F.when(kind == "box", box).when(kind == "circle", circle).when(kind == "polygon", polygon).otherwise(F.lit(world))
    return F.struct(
        F.when(kind == "", "box").otherwise(kind).alias("bounds_type"),
        pick(at(0), at(0) - dlat, F.array_min(lat), -90.0).alias("min_lat"), pick(at(1), at(0) + dlat, F.array_max(lat), 90.0).alias("max_lat"),
        pick(at(2), at(1) - dlon, F.array_min(lon), -180.0).alias("min_lon"), pick(at(3), at(1) + dlon, F.array_max(lon), 180.0).alias("max_lon"),
        F.lit(-10.0).alias("min_depth"), F.lit(1000.0).alias("max_depth"),
        F.when(kind == "circle", at(0)).alias("center_lat"), F.when(kind == "circle", at(1)).alias("center_lon"), F.when(kind == "circle", at(2)).alias("radius_km"),
        F.when(kind == "polygon", points).alias("vertices"),
    )


def bounds_text(b: str = "") -> Column:
    """The text that parsed_bounds reads, from the columns of BOUNDS."""
    c = lambda name: F.col(f"{b}.{name}" if b else name)
    corners = F.array_join(F.transform(c("vertices"), lambda p: F.concat_ws(",", p["lat"], p["lon"])), ";")
    return F.when(c("bounds_type") == "circle", F.concat(F.lit("circle:"), F.concat_ws(",", c("center_lat"), c("center_lon"), c("radius_km")))).when(c("bounds_type") == "polygon", F.concat(F.lit("polygon:"), corners)).otherwise(F.concat(F.lit("box:"), F.concat_ws(",", c("min_lat"), c("max_lat"), c("min_lon"), c("max_lon"))))


def regions(spark: SparkSession, rows=None) -> DataFrame:
    made = spark.createDataFrame(rows or REGIONS, "name string, bounds string, priority int, description string")
    return made.withColumn("b", parsed_bounds(F.col("bounds"))).select("name", "b.*", F.coalesce("priority", F.lit(0)).alias("priority"), "description")


def all_matches(points: DataFrame, regions: DataFrame, lat: str = "lat", lon: str = "lon", depth: str = "depth") -> DataFrame:
    """points with every region that holds them; any number of either.

    A region is in the cells of its box, a place in one; both meet there and the
    region's shape is tested.
    """
    held = regions.select(F.struct(*regions.columns).alias("_r"), F.explode(cells.of_box("min_lat", "max_lat", "min_lon", "max_lon", CELL)).alias("_cell"))
    both = points.withColumn("_cell", cells.flat(lat, lon, CELL)).join(held, "_cell").where(in_bounds(lat, lon, depth, "_r"))
    return both.withColumn("region", F.col("_r.name")).withColumn("priority", F.col("_r.priority")).drop("_r", "_cell")


def first_match(points: DataFrame, regions: DataFrame, key: str, lat: str = "lat", lon: str = "lon", depth: str = "depth") -> DataFrame:
    """points with the region of most priority (then least name), or the default.

    The best region of a point comes from an aggregate of the matches alone.
    """
    found = all_matches(points.select(key, lat, lon, depth), regions, lat, lon, depth)
    best = found.groupBy(key).agg(F.min_by("region", F.struct(-F.col("priority"), F.col("region"))).alias("region"))
    return points.join(best, key, "left").withColumn("region", F.coalesce("region", F.lit(DEFAULT)))


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of rows with equal keys the last one in the order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
