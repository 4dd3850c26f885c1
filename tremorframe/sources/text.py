"""Text formats: station inventories, velocity models, regions, settings, picks.

All are read with Spark's text or CSV readers and parsed by column expressions.
Line order inside a file, where it matters, comes from reading the file whole
and numbering its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.regions import parsed_bounds
from ..operators.velocity import Model

#: Fixed value: P over S velocity where a file has no S.
VP_VS = 1.73


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, no, line: numbered from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)


def fields(line: Column | str = "line") -> Column:
    return F.split(F.trim(F.regexp_replace(line, "\\s+", " ")), " ")


def number(parts: Column, i: int, default: float | None = None) -> Column:
    value = F.get(parts, F.lit(i)).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def _content(rows: DataFrame) -> DataFrame:
    return rows.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))


def parse_stations(rows: DataFrame) -> DataFrame:
    """net, sta, lat, lon, elev_m, depth_km, channels (code, rate, azimuth, dip) of inventory lines; the last line of a station counts.

    After the elevation come channels as quadruples, or one list of codes with commas.
    """
    p = F.col("p")
    quads = F.transform(F.sequence(F.lit(5), F.size(p) - 4, F.lit(4)), lambda i: F.struct(F.get(p, i).alias("code"), F.get(p, i + 1).try_cast("double").alias("rate"), F.get(p, i + 2).try_cast("double").alias("azimuth"), F.get(p, i + 3).try_cast("double").alias("dip")))
    codes = F.transform(F.split(F.get(p, F.lit(5)), ","), lambda c: F.struct(c.alias("code"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("double").alias("azimuth"), F.lit(None).cast("double").alias("dip")))
    kind = "array<struct<code:string,rate:double,azimuth:double,dip:double>>"
    channels = F.when(F.size(p) >= 9, quads.cast(kind)).when(F.size(p) == 6, codes.cast(kind)).otherwise(F.array().cast(kind))
    got = _content(rows).select("file", "no", fields().alias("p")).select("file", "no", F.get(p, F.lit(0)).alias("net"), F.get(p, F.lit(1)).alias("sta"), number(p, 2).alias("lat"), number(p, 3).alias("lon"), number(p, 4, 0.0).alias("elev_m"), channels.alias("channels"))
    got = got.where("lat is not null and lon is not null")
    last = Window.partitionBy("net", "sta").orderBy(F.desc("file"), F.desc("no"))
    got = got.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return got.select("net", "sta", "lat", "lon", "elev_m", (-F.col("elev_m") / 1000).alias("depth_km"), "channels")


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return parse_stations(lines(spark, path))


LAYER = ["file", "top_depth", "thickness", "vp", "vs", "density"]


def parse_native(rows: DataFrame) -> DataFrame:
    """depth thickness vp vs [density]."""
    p = F.col("p")
    got = _content(rows).select("file", fields().alias("p"))
    return got.select("file", number(p, 0).alias("top_depth"), number(p, 1).alias("thickness"), number(p, 2).alias("vp"), number(p, 3).alias("vs"), number(p, 4, 2.7).alias("density")).where("top_depth is not null and thickness is not null and vp is not null and vs is not null")


def _with_thickness(rows: DataFrame) -> DataFrame:
    """A layer reaches down to the next one; the last has no end."""
    below = F.lead("top_depth").over(Window.partitionBy("file").orderBy("top_depth"))
    return rows.withColumn("thickness", F.coalesce(below - F.col("top_depth"), F.lit(0.0))).select(*LAYER)


def parse_hypo71(rows: DataFrame) -> DataFrame:
    """velocity depth; a line of one number is the ratio of P to S velocity."""
    p = F.col("p")
    got = _content(rows).select("file", "no", fields().alias("p"))
    ratio = F.max(F.when(F.size(p) == 1, number(p, 0))).over(Window.partitionBy("file"))
    got = got.withColumn("ratio", F.coalesce(ratio, F.lit(VP_VS))).where((F.size(p) >= 2) & number(p, 0).isNotNull() & number(p, 1).isNotNull())
    return _with_thickness(got.select("file", number(p, 1).alias("top_depth"), number(p, 0).alias("vp"), (number(p, 0) / F.col("ratio")).alias("vs"), F.lit(2.7).alias("density")))


def parse_velest(rows: DataFrame) -> DataFrame:
    """Sections P-VELOCITY and S-VELOCITY of velocity and depth lines; a P layer without S gets one."""
    p, up = F.col("p"), F.upper("line")
    mark = F.when(up.contains("P-VELOCITY"), "P").when(up.contains("S-VELOCITY"), "S")
    section = F.last(mark, ignorenulls=True).over(Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    got = rows.withColumn("section", section).where(mark.isNull()).select("file", "no", "section", fields().alias("p"))
    got = got.where(F.col("section").isNotNull() & number(p, 0).isNotNull() & number(p, 1).isNotNull())
    place = F.row_number().over(Window.partitionBy("file", "section").orderBy("no"))
    got = got.select("file", "section", place.alias("place"), number(p, 0).alias("v"), number(p, 1).alias("top_depth"))
    s = got.where("section = 'S'").select("file", "place", F.col("v").alias("s"))
    both = got.where("section = 'P'").join(s, ["file", "place"], "left")
    return _with_thickness(both.select("file", "top_depth", F.col("v").alias("vp"), F.coalesce("s", F.col("v") / VP_VS).alias("vs"), F.lit(2.7).alias("density")))


def parse_nonlinloc(rows: DataFrame) -> DataFrame:
    """LAYER depth vp gradient vs gradient density gradient; gradients are not used."""
    p = F.col("p")
    got = rows.where(F.trim("line").startswith("LAYER")).select("file", fields().alias("p"))
    return _with_thickness(got.select("file", number(p, 1).alias("top_depth"), number(p, 2).alias("vp"), number(p, 4).alias("vs"), number(p, 6, 2.7).alias("density")))


PARSERS = {"hyp": parse_hypo71, "hypo71": parse_hypo71, "mod": parse_velest, "velest": parse_velest, "nll": parse_nonlinloc}


def read_velocity(spark: SparkSession, path: str) -> DataFrame:
    """Layers of a model file, by the format its name's ending says."""
    return PARSERS.get(path.rsplit(".", 1)[-1].lower(), parse_native)(lines(spark, path))


def load_model(spark: SparkSession, path: str) -> Model:
    """A model as a driver value; it has a few layers."""
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return Model(name, tuple(sorted(tuple(r)[1:] for r in read_velocity(spark, path).select(*LAYER).collect())))


def parse_settings(rows: DataFrame) -> DataFrame:
    """section, key, value, no of an INI file; the last of a key counts for ``settings``."""
    head = F.regexp_extract(F.trim("line"), "^\\[([^\\]]*)\\]", 1)
    section = F.last(F.when(head != "", head), ignorenulls=True).over(Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    got = rows.withColumn("section", F.coalesce(section, F.lit(""))).where(F.col("line").contains("=") & ~F.trim("line").rlike("^[#;\\[]"))
    at = F.locate("=", F.col("line"))
    return got.select("file", "no", "section", F.trim(F.expr("substring(line, 1, locate('=', line) - 1)")).alias("key"), F.trim(F.substring(F.col("line"), at + 1, F.length("line"))).alias("value"))


class Settings(dict):
    """section.key -> text, with typed readers that fall back to a default."""

    def _read(self, key, default, kind):
        try:
            return kind(self[key])
        except (KeyError, ValueError):
            return default

    def integer(self, key: str, default: int = 0) -> int:
        return self._read(key, default, int)

    def real(self, key: str, default: float = 0.0) -> float:
        return self._read(key, default, float)

    def flag(self, key: str, default: bool = False) -> bool:
        return self[key].lower() in ("true", "yes", "1", "on") if key in self else default

    def words(self, key: str) -> list[str]:
        return [w for x in self.get(key, "").split(",") if (w := x.strip())]


def settings(spark: SparkSession, path: str) -> Settings:
    """A settings file as a driver value."""
    rows = parse_settings(lines(spark, path)).orderBy("file", "no").collect()
    return Settings({f"{r['section']}.{r['key']}" if r["section"] else r["key"]: r["value"] for r in rows})


def parse_regions(rows: DataFrame) -> DataFrame:
    """name, bounds columns, priority, description, model_file of a regions file; priority 0 if none."""
    wide = parse_settings(rows).where("section <> ''").groupBy(F.col("section").alias("name")).pivot("key", ["model_file", "bounds_type", "bounds", "priority", "description"]).agg(F.last("value"))
    text = F.when(F.col("bounds").rlike("^(box|circle|polygon):"), F.col("bounds")).otherwise(F.concat_ws(":", "bounds_type", "bounds"))
    return wide.withColumn("b", parsed_bounds(text)).select("name", "b.*", F.coalesce(F.col("priority").try_cast("int"), F.lit(0)).alias("priority"), "description", "model_file")


PICKS = "station string, phase string, travel_time_s double, snr double, quality int, distance_km double, method string"


def read_picks(spark: SparkSession, path: str, origin_us: int, impulsive_snr: float = 5.0) -> DataFrame:
    """External picks with absolute times: net, sta, phase, time_us, quality, snr, method."""
    rows = spark.read.csv(path, header=True, schema=PICKS)
    parts = F.split("station", "\\.")
    return rows.select(
        F.get(parts, F.lit(0)).alias("net"), F.get(parts, F.lit(1)).alias("sta"), "phase", (F.lit(origin_us) + (F.col("travel_time_s") * 1e6).cast("long")).alias("time_us"), F.when(F.col("snr") >= impulsive_snr, 0).otherwise(1).alias("quality"), "snr", "method", "travel_time_s", "distance_km"
    )


def with_distances(picks: DataFrame, listed: DataFrame) -> DataFrame:
    """Picks (net, sta) with the distance that a list (station as NET.STA, distance) has for them, null if none."""
    named = listed.select("station", "distance").dropDuplicates(["station"])
    return picks.withColumn("station", F.concat_ws(".", "net", "sta")).join(named, "station", "left").drop("station")


def station_lines(stations: DataFrame) -> DataFrame:
    """value: lines that parse_stations reads."""
    channel = F.array_join(F.transform("channels", lambda c: F.concat_ws(" ", c["code"], c["rate"].cast("string"), c["azimuth"].cast("string"), c["dip"].cast("string"))), " ")
    return stations.select(F.trim(F.concat_ws(" ", "net", "sta", F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("elev_m").cast("string"), channel)).alias("value"))


def layer_lines(layers: DataFrame) -> DataFrame:
    return layers.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in LAYER[1:])).alias("value"))


def setting_lines(rows: DataFrame) -> DataFrame:
    """value, in order: lines that parse_settings reads, of (section, key, value, no)."""
    w = Window.partitionBy("section").orderBy("no")
    line = F.concat(F.col("key"), F.lit(" = "), F.col("value"))
    head = F.when((F.row_number().over(w) == 1) & (F.col("section") != ""), F.concat(F.lit("["), F.col("section"), F.lit("]\n"))).otherwise("")
    first = F.min("no").over(Window.partitionBy("section"))
    return rows.select(first.alias("_s"), "no", F.concat(head, line).alias("value")).orderBy("_s", "no").select("value")


def region_lines(regions: DataFrame) -> DataFrame:
    """value: sections that parse_regions reads, from the columns of BOUNDS and model_file."""
    from ..operators.regions import bounds_text

    return regions.select(F.concat_ws("\n", F.concat(F.lit("["), "name", F.lit("]")), F.concat(F.lit("model_file = "), "model_file"), F.concat(F.lit("bounds = "), bounds_text()), F.concat(F.lit("priority = "), F.col("priority").cast("string")), F.concat(F.lit("description = "), "description")).alias("value"))


def read_regions(spark: SparkSession, directory: str, config: str = "velocity_models.conf") -> DataFrame:
    """Regions of a folder: from its list if it has one, else a region for each model file with a ``.bounds`` text beside it."""
    listed = lines(spark, directory + "/*")
    stem = F.regexp_extract("file", "([^/]+?)\\.[^./]+$", 1)
    ours = listed.where(F.col("file").endswith("/" + config))
    if not ours.isEmpty():
        return parse_regions(ours)
    beside = listed.where(F.col("file").endswith(".bounds") & (F.trim("line") != "")).groupBy(stem.alias("name")).agg(F.min_by("line", "no").alias("bounds"))
    models = listed.where(F.col("file").rlike("\\.(vel|mod|txt)$")).select(stem.alias("name"), F.regexp_extract("file", "([^/]+)$", 1).alias("model_file")).distinct()
    made = models.join(beside, "name", "left").withColumn("b", parsed_bounds(F.coalesce("bounds", F.lit(""))))
    return made.select("name", "b.*", F.lit(0).alias("priority"), F.lit("").alias("description"), "model_file")
