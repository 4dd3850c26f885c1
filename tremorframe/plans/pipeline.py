"""From waveforms to a stored catalog, and comparisons of whole configurations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, kernels
from ..functions.codes import is_vertical, snr_quality
from ..functions.geo import haversine_km
from ..operators import associate, catalog, locate, magnitude, regions, trial, triggers, velocity
from ..operators.signal import Stream
from ..scratch import written


@dataclass(frozen=True)
class Settings:
    """Every parameter of the pipeline; unknown names are refused by the constructor."""

    sta_s: float = 0.5
    lta_s: float = 10.0
    trigger: float = 3.0
    detrigger: float = 1.5
    max_residual: float = 3.0
    min_stations: int = 3
    min_phases: int = 4
    bucket_s: float = 0.0
    band: tuple[float, float] | None = None
    model: str = "iasp91"
    method: str = "grid+geiger"
    locator: dict = field(default_factory=dict)
    magnitudes: tuple[str, ...] = ("ML", "Mw")
    mw_from: float = 3.0


def filtered(samples: str, rate: float, low: float, high: float):
    """Segments of over 100 samples without their mean, between two frequencies; shorter ones only without their mean."""
    high = min(high, 0.4 * rate)

    def f(x):
        x = x - x.mean(-1, keepdims=True) if x.shape[-1] else x
        return kernels.bandpass(x, rate, low, high) if x.shape[-1] > 100 else x

    return kernels.per_segment(f, samples, rows=True)


def pick(segments: DataFrame, s: Settings) -> DataFrame:
    """Picks of vertical channels: pick_id, net, sta, chan, time_us, phase, quality, snr, amplitude.

    All segments of one rate are samples in rows, blocks of which are window
    partitions.  band: filtered first, up to four fifths of the Nyquist frequency.
    """
    vertical = segments.where(is_vertical("chan"))
    rates = [r[0] for r in vertical.select("sample_rate").distinct().collect()]
    out = None
    by = ("net", "sta", "chan", "start_us")
    for rate in sorted(rates):
        own = vertical.where(F.col("sample_rate") == rate)
        if s.band is not None and min(s.band[1], 0.4 * rate) > s.band[0]:
            own = own.withColumn("samples", filtered("samples", rate, *s.band))
        rows = own.select(*by, F.posexplode("samples").alias("idx", "value")).withColumn("idx", F.col("idx").cast("long"))
        found = triggers.stalta_picks(rows, Stream(by), rate, s.sta_s, s.lta_s, s.trigger, s.detrigger)
        found = found.select("net", "sta", "chan", (F.col("start_us") + (F.col("pick_idx") * 1e6 / rate).cast("long")).alias("time_us"), "phase", snr_quality("snr").alias("quality"), "snr", "amplitude")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("there is no vertical channel")
    return catalog.numbered(out, "pick_id", ["time_us", "net", "sta", "chan"])


def assemble(picks: DataFrame, stations: DataFrame, times: DataFrame, s: Settings) -> DataFrame:
    """Picks with event_id: candidates resolved greedily."""
    kept = written(associate.chosen(picks, stations, times, s.max_residual, s.min_stations, s.min_phases), "kept")
    rows = associate.members(picks, stations, times, kept, max_residual=s.max_residual, bucket_s=s.bucket_s)
    chosen = rows.select(F.col("seed_id").alias("event_id"), "pick_id").distinct()
    return associate.with_stations(picks, stations).join(chosen, "pick_id")


def _by_model(picks: DataFrame, named: DataFrame, models: dict[str, velocity.Model], s: Settings) -> DataFrame:
    """Origins of events, each with the model that ``named`` (event_id, model) says."""
    out = None
    for name, model in models.items():
        own = picks.join(named.where(F.col("model") == name).select("event_id"), "event_id", "left_semi")
        rows = locate.locate(own, model, s.method, **s.locator).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def locate_by_region(picks: DataFrame, regional: DataFrame, models: dict[str, velocity.Model], s: Settings) -> DataFrame:
    """Origins with the model of their region: first of the earliest station's, then, where the place found has another one, with that.

    models: by region's name, with regions.DEFAULT for all other places.
    """

    def named(places: DataFrame) -> DataFrame:
        of = regions.first_match(places, regional, "event_id")
        known = F.when(F.col("region").isin(*models), F.col("region")).otherwise(regions.DEFAULT)
        return of.select("event_id", known.alias("model"))

    begin = trial.earliest_station(picks, ("event_id",), codes.PHASES)
    first = written(_by_model(picks, named(begin.select("event_id", F.col("slat").alias("lat"), F.col("slon").alias("lon"), F.lit(associate.SEED_DEPTH_KM).alias("depth"))), models, s), "located")
    final = named(first.where("converged").select("event_id", "lat", "lon", "depth"))
    moved = written(final.join(first.select("event_id", F.col("model").alias("_old")), "event_id").where("model <> _old").select("event_id", "model"), "moved")
    again = _by_model(picks.join(moved.select("event_id"), "event_id", "left_semi"), moved, models, s)
    return first.join(moved.select("event_id"), "event_id", "left_anti").unionByName(again)


def run(segments: DataFrame, stations: DataFrame, s: Settings = Settings(), regional: DataFrame | None = None, models: dict[str, velocity.Model] | None = None, store: catalog.Catalog | None = None) -> dict[str, DataFrame]:
    """picks, event picks, origins, arrivals, station and network magnitudes; Mw only of events over mw_from.

    regional and models: regions and their models, see ``locate_by_region``.
    store: a catalog that gets all of it in one commit.
    """
    spark = segments.sparkSession
    model = velocity.Model.named(s.model)
    models = {regions.DEFAULT: model, **(models or {})}
    # Picks, members and origins are small beside the waveforms and are used by several plans each.
    picks = written(pick(segments, s), "picks")
    members = written(assemble(picks, stations, velocity.table_rows(spark, model), s), "event-picks")
    if regional is None:
        origins = locate.locate(members, model, s.method, **s.locator).withColumn("model", F.lit(regions.DEFAULT))
    else:
        origins = locate_by_region(members, regional, models, s)
    origins = origins.where("converged").withColumn("orid", F.col("event_id")).withColumn("fixed", F.lit(s.locator.get("fixed_depth") is not None))
    origins = written(origins, "origins")
    each, net = magnitude.event_magnitudes(origins, segments, stations, s.magnitudes)
    each, net = written(each, "station-magnitudes"), written(net, "magnitudes")
    big = net.where((F.col("magtype") == "ML") & (F.col("magnitude") > s.mw_from)).select("event_id")
    net = net.where("magtype <> 'Mw'").unionByName(net.where("magtype = 'Mw'").join(big, "event_id", "left_semi"))
    seen = None
    for name, own in models.items():
        rows = locate.arrivals(members, origins.where(F.col("model") == name), own).withColumn("model", F.lit(own.name))
        seen = rows if seen is None else seen.unionByName(rows)
    out = {"picks": picks, "members": members, "origins": origins, "arrivals": written(seen, "arrivals"), "station_magnitudes": each, "magnitudes": net}
    if store is not None:
        store_events(out, store)
    return out


def store_events(found: dict[str, DataFrame], store: catalog.Catalog, mark: tuple[str, int] | None = None) -> bool:
    """What ``run`` gives as rows of the catalog, numbered after what is there, in one commit."""
    first = {t: store.next_id(t) for t in ("event", "origin", "arrival", "netmag")}
    numbers = catalog.numbered(found["origins"].select("event_id", "time_us"), "evid", ["time_us", "event_id"], first["event"]).select(F.col("event_id").alias("_event"), "evid", (F.col("evid") + (first["origin"] - first["event"])).alias("_orid"))
    numbers = written(numbers, "event-numbers")

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.drop("orid").join(numbers, F.col("event_id") == F.col("_event")).drop("event_id", "_event").withColumnsRenamed({"evid": "event_id", "_orid": "orid"})

    arid = F.col("pick_id") + (first["arrival"] - 1)
    net = catalog.numbered(renamed(found["magnitudes"]).drop("orid"), "magid", ["event_id", "magtype"], first["netmag"])
    own = found["picks"].join(found["arrivals"].select("pick_id").distinct(), "pick_id", "left_semi")
    lacking = {"uncertainty": F.lit(None).cast("double"), "period": F.lit(None).cast("double")}
    own = own.withColumn("pick_id", arid).withColumns({c: v for c, v in lacking.items() if c not in own.columns})
    rows = catalog.complete_event(renamed(found["origins"]), renamed(found["arrivals"]).withColumn("arid", arid), own, net, renamed(found["station_magnitudes"]).drop("orid"), regions.DEFAULT)
    return store.store(rows, mark)


def ensemble(picks: DataFrame, configurations: list[dict], truth: tuple[float, float]) -> DataFrame:
    """One row for each configuration (name, model, method, options) and event: place, rms, error; best first."""
    out = None
    for c in configurations:
        rows = locate.locate(picks, velocity.Model.named(c.get("model", "iasp91")), c.get("method", "grid"), **c.get("options", {}))
        rows = rows.select(F.lit(c["name"]).alias("config"), "event_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("depth").alias("depth_km"), F.col("rms").alias("rms_s"), F.coalesce(haversine_km("lat", "lon", truth[0], truth[1]), F.lit(-1.0)).alias("error_km"), F.col("phase_count").alias("num_picks"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("error_km", "config")
