"""CSV reports and demonstration rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import is_vertical
from ..functions.geo import haversine_km
from ..operators.associate import nearest_stations

#: Columns of the reports.
REPORTS = {
    "stations": ["network", "station", "latitude", "longitude", "elevation", "distance_km"],
    "velocity_model": ["depth_km", "vp_km_s", "vs_km_s"],
    "picks": ["station", "phase", "travel_time_s", "snr", "quality", "distance_km"],
    "arrivals": ["station", "phase", "distance_km", "azimuth", "residual_s", "weight", "used"],
    "stalta": ["station", "distance_km", "sample", "ratio"],
    "waveforms": ["station", "distance_km", "time_s", "amplitude"],
    "summary": ["parameter", "computed", "truth", "error"],
    "comparison": ["config", "latitude", "longitude", "depth_km", "rms_s", "error_km", "num_picks", "magnitude"],
}


def write(rows: DataFrame, name: str, directory: str) -> None:
    rows.select(*REPORTS[name]).write.mode("overwrite").csv(f"{directory}/{name}", header=True)


def station_report(stations: DataFrame, lat: float, lon: float) -> DataFrame:
    d = haversine_km(lat, lon, "lat", "lon")
    return stations.select(F.col("net").alias("network"), F.col("sta").alias("station"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("elev_m").alias("elevation"), d.alias("distance_km"))


def velocity_report(spark: SparkSession, model, depths: tuple[float, ...] = (0, 1, 5, 10, 16, 20, 25, 30, 32, 35, 40, 50)) -> DataFrame:
    """A model's velocities at a few depths."""
    rows = [(float(d), float(model.velocity(d, "P")), float(model.velocity(d, "S"))) for d in depths]
    return spark.createDataFrame(rows, "depth_km double, vp_km_s double, vs_km_s double")


def waveform_report(segments: DataFrame, stations: DataFrame, lat: float, lon: float, origin_us: int, nearest: int = 12, before_s: float = 5.0, after_s: float = 55.0, every: int = 2) -> DataFrame:
    """Every other sample of the nearest stations' vertical segments round an origin; the count is the feature."""
    place = stations.select("net", "sta", haversine_km(lat, lon, "lat", "lon").alias("distance_km"))
    rows = segments.where(is_vertical("chan")).join(place, ["net", "sta"])
    first = rows.select("net", "sta", "distance_km").distinct().orderBy("distance_km", "net", "sta").limit(nearest)
    offset = (F.col("start_us") - F.lit(origin_us)) / 1e6
    each = rows.join(first.select("net", "sta"), ["net", "sta"], "left_semi").select(F.concat_ws(".", "net", "sta").alias("station"), "distance_km", offset.alias("_at"), "sample_rate", F.posexplode("samples").alias("_i", "amplitude"))
    low = F.greatest(F.ceil((-F.col("_at") - before_s) * F.col("sample_rate")), F.lit(0))
    inside = (F.col("_i") >= low) & (F.col("_i") < (-F.col("_at") + after_s) * F.col("sample_rate")) & ((F.col("_i") - low) % every == 0)
    return each.where(inside).select("station", "distance_km", (F.col("_at") + F.col("_i") / F.col("sample_rate")).alias("time_s"), "amplitude")


def ratio_report(ratios: DataFrame, station: str = "station") -> DataFrame:
    """STA/LTA traces (station, distance_km, idx, ratio)."""
    return ratios.select(F.col(station).alias("station"), "distance_km", F.col("idx").alias("sample"), "ratio")


def comparison_report(compared: DataFrame, magnitudes: DataFrame | None = None) -> DataFrame:
    """What ``pipeline.ensemble`` gives, with an event's magnitude where there is one."""
    rows = compared if magnitudes is None else compared.join(magnitudes.select("event_id", "magnitude"), "event_id", "left")
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None).cast("double")).alias(c) for c in REPORTS["comparison"])).orderBy("error_km", "config")


def arrival_report(arrivals: DataFrame) -> DataFrame:
    return arrivals.select(F.concat_ws(".", "net", "sta").alias("station"), "phase", F.col("distance").alias("distance_km"), "azimuth", F.col("residual").alias("residual_s"), "weight", F.col("used").cast("int").alias("used"))


def summary_report(origins: DataFrame, truth: dict[str, float]) -> DataFrame:
    """parameter, computed, truth, error of located events; the epicentral error has no truth of its own."""
    error = haversine_km("lat", "lon", truth["lat"], truth["lon"])
    rows = [("latitude", F.col("lat"), truth["lat"]), ("longitude", F.col("lon"), truth["lon"]), ("depth", F.col("depth"), truth.get("depth")), ("epicentral_error_km", error, None), ("rms_s", F.col("rms"), None), ("gap_deg", F.col("gap"), None), ("num_phases", F.col("phase_count"), None)]
    each = F.array(*(F.struct(F.lit(n).alias("parameter"), c.cast("double").alias("computed"), F.lit(t).cast("double").alias("truth"), (c.cast("double") - F.lit(t)).cast("double").alias("error")) for n, c, t in rows))
    return origins.select("event_id", F.explode(each).alias("r")).select("event_id", "r.*")


def demo_picks(stations: DataFrame, events: DataFrame, nearest: int = 12, seed: int = 7) -> DataFrame:
    """Synthetic P times of the nearest stations of each event (event_id, time_us, lat, lon): distance / 6 and noise of 0.3 s."""
    # Stations get a number for the ranking, from their names.
    numbered = stations.select("net", "sta", "lat", "lon").withColumn("station_id", F.xxhash64("net", "sta"))
    near = nearest_stations(events, numbered.select("station_id", "sta", "lat", "lon"), nearest)
    rows = near.drop("sta").join(numbered.select("station_id", "net", "sta", F.col("lat").alias("slat"), F.col("lon").alias("slon")), "station_id")
    noise = F.pmod(F.xxhash64("event_id", "net", "sta", F.lit(seed)), F.lit(1000)) / 1000.0 - 0.5
    seconds = haversine_km("lat", "lon", "slat", "slon") / 6.0 + noise * 1.04
    return rows.select("event_id", "net", "sta", "slat", "slon", F.lit("P").alias("phase"), F.lit(1).alias("quality"), (F.col("time_us") + (seconds * 1e6).cast("long")).alias("time_us"))


def synthetic_segments(spark: SparkSession, arrivals: DataFrame, rate: float = 100.0, seconds: int = 120, channels: tuple[str, ...] = ("BHZ", "BHN", "BHE")) -> DataFrame:
    """Noise with a P and a twice as strong S wavelet for rows (net, sta, start_us, p_s, s_s)."""
    import numpy as np
    import pandas as pd

    def one(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for k, c in enumerate(channels):
                    rng = np.random.default_rng(list(f"{r.net}.{r.sta}.{k}.{r.start_us}".encode()))
                    t = np.arange(int(seconds * rate)) / rate
                    x = rng.normal(0, 1, len(t))
                    for at, size, hz in ((r.p_s, 20.0, 5.0), (r.s_s, 40.0, 3.0)):
                        d = t - at
                        x += np.where(d >= 0, size * np.exp(-np.maximum(d, 0) / 2) * np.sin(2 * np.pi * hz * d), 0.0)
                    out.append((r.net, r.sta, "", c, int(r.start_us), rate, x.tolist()))
            yield pd.DataFrame(out, columns=["net", "sta", "loc", "chan", "start_us", "sample_rate", "samples"])

    return arrivals.mapInPandas(one, "net string, sta string, loc string, chan string, start_us long, sample_rate double, samples array<double>")
