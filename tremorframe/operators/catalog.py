"""The relational catalog: tables as Parquet folders, its queries and checks.

Nulls are nulls inside; ``with_sentinels`` puts the flat format's values for
them at the border.  Identifiers are row numbers after the largest one stored,
in a stated order, never numbers that depend on partitions.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.geo import km_to_deg
from ..functions.timeutil import epoch_seconds, jdate
from ..scratch import file_system, written
from ..schemas import CATALOG, KEYS, NULL_INT, NULL_REAL, NULL_TEXT, NULL_TIME, REFERENCES, columns, schema
from .regions import latest_by_key

SCHEMA_VERSION = "3.0"
AUTHOR = "tremorframe"
#: A log entry that was begun and is not there after so many seconds may be begun anew.
LOCK_S = 600
IDS = {"event": "evid", "origin": "orid", "arrival": "arid", "netmag": "magid", "sitechan": "chanid", "wfdisc": "wfid", "remark": "commid"}


class Conflict(RuntimeError):
    """Another writer committed first."""


class Transaction:
    """Changes that become visible together on commit, and not at all after rollback or an error.

    Rows are written to folders of their own at once; only a commit's log entry
    makes readers see them.
    """

    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self.number, self.state = catalog.latest()
        self.tables = {t: list(parts) for t, parts in self.state["tables"].items()}
        self.marks, self.made, self.open = dict(self.state["marks"]), [], True

    def _write(self, name: str, rows: DataFrame) -> str:
        if not self.open:
            raise RuntimeError("the transaction has ended")
        part = f"{name}/{uuid.uuid4().hex}"
        self.made.append(part)
        conformed(rows, name).write.parquet(f"{self.catalog.path}/{part}")
        return part

    def table(self, name: str) -> DataFrame:
        """The table as this transaction sees it."""
        return self.catalog.read(name, self.tables.get(name, []))

    def append(self, name: str, rows: DataFrame) -> None:
        self.tables.setdefault(name, []).append(self._write(name, rows))

    def replace(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = [self._write(name, rows)]

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows with a stored key take its place."""
        old = self.table(name).withColumn("_seq", F.lit(0))
        new = conformed(rows, name).withColumn("_seq", F.lit(1))
        self.replace(name, latest_by_key(old.unionByName(new), KEYS[name], "_seq").drop("_seq"))

    def commit(self) -> None:
        """Conflict if another commit came between and no append alone would do."""
        for _ in range(20):
            number, now = self.catalog.latest()
            if number != self.number:
                replaced = [t for t, parts in self.tables.items() if parts[: len(self.state["tables"].get(t, []))] != self.state["tables"].get(t, [])]
                stale = [t for t in replaced if now["tables"].get(t, []) != self.state["tables"].get(t, [])]
                if stale or any(now["marks"].get(k) != self.state["marks"].get(k) for k in self.marks if self.marks[k] != self.state["marks"].get(k)):
                    self.rollback()
                    raise Conflict(f"another commit changed {', '.join(stale) or 'a mark'}")
                added = {t: parts[len(self.state["tables"].get(t, [])) :] for t, parts in self.tables.items() if t not in replaced}
                self.tables = {**{t: [*now["tables"].get(t, []), *added.get(t, [])] for t in {*now["tables"], *added}}, **{t: self.tables[t] for t in replaced}}
                self.marks, self.number, self.state = {**now["marks"], **{k: v for k, v in self.marks.items() if v != self.state["marks"].get(k)}}, number, now
            if self.catalog.publish(self.number + 1, {"tables": self.tables, "marks": self.marks}):
                self.open = False
                return
            time.sleep(0.05)
        self.rollback()
        raise Conflict("the log is written to without end")

    def rollback(self) -> None:
        for part in self.made:
            where, system = file_system(self.catalog.spark, f"{self.catalog.path}/{part}")
            system.delete(where, True)
        self.made, self.open = [], False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.commit() if kind is None else self.rollback()


class Catalog:
    """A folder with a folder for each table, and a log of commits.

    A table is a list of Parquet folders; entry n of the log has the lists after
    commit n.  An entry appears as a whole and only once, so readers see all of
    a commit or nothing, and a failure between two tables leaves no half event.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list[str]:
        where, system = file_system(self.spark, f"{self.path}/_log")
        if not system.exists(where):
            return []
        return sorted(f.getPath().getName() for f in system.listStatus(where) if f.getPath().getName().endswith(".json"))

    def latest(self) -> tuple[int, dict]:
        """Number and content of the last commit."""
        names = self._log()
        if not names:
            return 0, {"tables": {}, "marks": {}}
        where, system = file_system(self.spark, f"{self.path}/_log/{names[-1]}")
        stream = system.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(names[-1].split(".")[0]), json.loads(text)

    def publish(self, number: int, state: dict) -> bool:
        """Adds an entry to the log, unless one of that number is there: written aside, then moved as a whole."""
        final, system = file_system(self.spark, f"{self.path}/_log/{number:012d}.json")
        lock, _ = file_system(self.spark, f"{self.path}/_log/{number:012d}.taken")
        if system.exists(final):
            return False
        if not system.createNewFile(lock):
            # Of a writer that died before it moved its entry.
            if time.time() - system.getFileStatus(lock).getModificationTime() / 1000 > LOCK_S:
                system.delete(lock, False)
            return False
        beside, _ = file_system(self.spark, f"{self.path}/_log/{uuid.uuid4().hex}.tmp")
        stream = system.create(beside)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        return bool(system.rename(beside, final))

    def transaction(self) -> Transaction:
        return Transaction(self)

    def create(self) -> None:
        """All tables, empty, and the schema's version; what is there stays."""
        if self._log():
            return
        with self.transaction() as t:
            t.tables = {name: [] for name in CATALOG}
            t.append("css30_meta", self.spark.createDataFrame([("schema_version", SCHEMA_VERSION), ("created", "")], schema("css30_meta")))

    def drop(self) -> None:
        with self.transaction() as t:
            t.tables, t.marks = {name: [] for name in CATALOG}, {}
            t.state = {"tables": {}, "marks": {}}

    def read(self, name: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema(name))
        return self.spark.read.schema(schema(name)).parquet(*(f"{self.path}/{p}" for p in parts))

    def table(self, name: str) -> DataFrame:
        """The table as of now."""
        return self.read(name, self.latest()[1]["tables"].get(name, []))

    def views(self) -> None:
        for t in CATALOG:
            self.table(t).createOrReplaceTempView(t)

    def append(self, name: str, rows: DataFrame) -> None:
        self.store({name: rows})

    def store(self, tables: dict[str, DataFrame], mark: tuple[str, int] | None = None) -> bool:
        """All tables or none.  mark: (name, number); what has the number of an earlier store under that name is not stored again."""
        with self.transaction() as t:
            if mark and t.marks.get(mark[0], -1) >= mark[1]:
                t.rollback()
                return False
            for name, rows in tables.items():
                t.append(name, rows)
            if mark:
                t.marks[mark[0]] = mark[1]
        return True

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows with a stored key take its place."""
        with self.transaction() as t:
            t.upsert(name, rows)

    def compact(self, name: str) -> None:
        """Many small folders of a table become one."""
        with self.transaction() as t:
            t.replace(name, t.table(name))

    def next_id(self, name: str) -> int:
        return next_ids(self.table(name), IDS[name]).first()["next_id"]

    def version(self) -> str | None:
        row = self.table("css30_meta").where("key = 'schema_version'").first()
        return row and row["value"]


def conformed(rows: DataFrame, name: str) -> DataFrame:
    """The table's columns in order; those that are lacking are null."""
    kinds = {"i": "long", "r": "double", "t": "string"}
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[k]).alias(c) for c, k in columns(name)))


def with_sentinels(rows: DataFrame, name: str) -> DataFrame:
    fill = {"i": NULL_INT, "r": NULL_REAL, "t": NULL_TEXT}
    return rows.select(*(F.coalesce(c, F.lit(NULL_TIME if c in ("time", "endtime") else fill[k])).alias(c) for c, k in columns(name) if c in rows.columns))


def next_ids(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.coalesce(F.max(column) + 1, F.lit(1)).cast("long").alias("next_id"))


def numbered(rows: DataFrame, column: str, order: list, start: int = 1) -> DataFrame:
    """Row numbers from start, in a stated order, by counts of key ranges (no single task sees all rows).

    The rows are written with the number of their range, so that counting and
    numbering read the same ranges.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("count"))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each range.
    offsets = counts.select("_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_n", inside).join(F.broadcast(offsets), "_part").withColumn(column, F.col("_n") + F.col("_before") + (start - 1)).drop("_n", "_part", "_before")


def duplicate_keys(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, other: DataFrame, table: str, column: str) -> DataFrame:
    """Rows whose reference is not there."""
    _, target = REFERENCES[(table, column)]
    return rows.where(F.col(column).isNotNull()).join(other.select(F.col(target).alias(column)).distinct(), column, "left_anti")


# Queries


def preferred(event: DataFrame, origin: DataFrame) -> DataFrame:
    return event.select("evid", "evname", "prefor").join(origin.withColumnRenamed("evid", "_evid"), F.col("prefor") == F.col("orid")).drop("_evid")


def query_events(event: DataFrame, origin: DataFrame, start: float | None = None, end: float | None = None, lat: tuple | None = None, lon: tuple | None = None, magnitude: tuple | None = None, netmag: DataFrame | None = None) -> DataFrame:
    """Events whose preferred origin is inside; any magnitude of the origin may be."""
    o = origin
    for column, bounds in (("time", (start, end)), ("lat", lat), ("lon", lon)):
        if bounds and bounds[0] is not None:
            o = o.where(F.col(column).between(*bounds))
    if magnitude:
        inside = netmag.where(F.col("magnitude").between(*magnitude)).select("orid").distinct()
        o = o.join(inside, "orid", "left_semi")
    return preferred(event, o)


def query_origins(origin: DataFrame, evid) -> DataFrame:
    return origin.where(F.col("evid") == evid).orderBy("orid")


def query_arrivals(arrival: DataFrame, assoc: DataFrame, orid) -> DataFrame:
    return arrival.join(assoc.where(F.col("orid") == orid).select("arid"), "arid", "left_semi").orderBy("time", "arid")


def query_associations(assoc: DataFrame, orid) -> DataFrame:
    return assoc.where(F.col("orid") == orid)


def query_magnitudes(netmag: DataFrame, orid) -> DataFrame:
    return netmag.where(F.col("orid") == orid)


def preferred_origin(event: DataFrame, origin: DataFrame, evid) -> DataFrame:
    return preferred(event.where(F.col("evid") == evid), origin)


def preferred_magnitude(netmag: DataFrame, by: str = "evid") -> DataFrame:
    """by, magtype, magnitude: by the order of types, then the earliest id."""
    best = F.min_by(F.struct("magtype", "magnitude"), F.struct(codes.magnitude_rank("magtype"), F.col("magid")))
    return netmag.groupBy(by).agg(best.alias("m")).select(by, "m.*")


def latest_origin(origin: DataFrame) -> DataFrame:
    """evid, prefor: the origin stored last."""
    return origin.groupBy("evid").agg(F.max("orid").alias("prefor"))


def counts(event: DataFrame, origin: DataFrame, arrival: DataFrame, site: DataFrame | None = None) -> DataFrame:
    """One row of totals; each is one aggregate, and four rows are pivoted into one."""
    each = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, t in (("events", event), ("origins", origin), ("arrivals", arrival), *((("stations", site),) if site is not None else ()))]
    out = each[0]
    for e in each[1:]:
        out = out.union(e)
    names = ["events", "origins", "arrivals", *(["stations"] if site is not None else [])]
    return out.agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in names))


def time_range(origin: DataFrame) -> DataFrame:
    return origin.agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def recent_events(event: DataFrame, origin: DataFrame, arrival: DataFrame, assoc: DataFrame, netmag: DataFrame, limit: int = 100) -> DataFrame:
    """The latest preferred origins with their magnitude and a list of arrivals, as one plan.

    The limit is the feature; the other tables are joined to its few rows.
    """
    top = preferred(event, origin).orderBy(F.desc("time"), F.desc("orid")).limit(limit)
    chosen = top.select("orid")
    mags = preferred_magnitude(netmag.join(chosen, "orid", "left_semi"), "orid")
    seen = assoc.join(chosen, "orid", "left_semi").select("orid", "arid", "delta", "timeres").join(arrival.select("arid", "sta", "iphase", F.col("time").alias("atime")), "arid")
    nested = seen.groupBy("orid").agg(F.array_sort(F.collect_list(F.struct("atime", "arid", "sta", "iphase", "delta", "timeres"))).alias("arrivals"))
    return top.join(mags, "orid", "left").join(nested, "orid", "left")


# From events to rows


def origin_rows(origins: DataFrame) -> DataFrame:
    """catalog.origin of located events (event_id, orid, time_us, lat, lon, depth, phase_count, fixed)."""
    t = F.timestamp_micros("time_us")
    return origins.select("lat", "lon", "depth", epoch_seconds(t).alias("time"), "orid", F.col("event_id").alias("evid"), jdate(t).alias("jdate"), F.col("phase_count").alias("nass"), F.col("phase_count").alias("ndef"), F.lit("eq").alias("etype"), F.when(F.col("fixed"), "g").otherwise("f").alias("dtype"), "algorithm", F.lit(AUTHOR).alias("auth"))


def origerr_rows(origins: DataFrame) -> DataFrame:
    lat, lon = F.col("lat_err"), F.col("lon_err")
    return origins.select("orid", (lon * lon).alias("sxx"), (lat * lat).alias("syy"), (F.col("depth_err") * F.col("depth_err")).alias("szz"), (F.col("time_err") * F.col("time_err")).alias("stt"), F.col("rms").alias("sdobs"), F.greatest(lat, lon).alias("smajax"), F.least(lat, lon).alias("sminax"), F.when(lon >= lat, 90.0).otherwise(0.0).alias("strike"), F.col("depth_err").alias("sdepth"), F.col("time_err").alias("stime"), F.lit(0.9).alias("conf"))


def assoc_rows(arrivals: DataFrame, model: str) -> DataFrame:
    """catalog.assoc of arrivals (arid, orid, sta, phase, distance km, azimuth, residual, weight, used); their own model, if they have one."""
    return arrivals.select("arid", "orid", "sta", "phase", km_to_deg("distance").alias("delta"), F.col("azimuth").alias("seaz"), F.pmod(F.col("azimuth") + 180.0, F.lit(360.0)).alias("esaz"), F.col("residual").alias("timeres"), F.when(F.col("used"), "d").otherwise("n").alias("timedef"), F.col("weight").alias("wgt"), (F.col("model") if "model" in arrivals.columns else F.lit(model)).alias("vmodel"))


def arrival_rows(picks: DataFrame) -> DataFrame:
    t = F.timestamp_micros("time_us")
    return picks.select("sta", epoch_seconds(t).alias("time"), F.col("pick_id").alias("arid"), jdate(t).alias("jdate"), "chan", F.col("phase").alias("iphase"), F.col("uncertainty").alias("deltim"), F.col("amplitude").alias("amp"), F.col("period").alias("per"), "snr", codes.css_quality("quality").alias("qual"), F.lit(AUTHOR).alias("auth"))


def site_rows(stations: DataFrame) -> DataFrame:
    return stations.select("sta", F.lit(-1).alias("ondate"), "lat", "lon", (F.col("elev_m") / 1000).alias("elev"), F.col("sta").alias("staname"), F.lit("ss").alias("statype"))


def sitechan_rows(stations: DataFrame) -> DataFrame:
    each = stations.select("sta", F.explode("channels").alias("c"))
    return numbered(each.select("sta", F.col("c.code").alias("chan"), F.lit(-1).alias("ondate"), F.col("c.azimuth").alias("hang"), (F.col("c.dip") + 90).alias("vang")), "chanid", ["sta", "chan"])


def wfdisc_rows(segments: DataFrame) -> DataFrame:
    start = F.col("start_us") / 1e6
    rows = segments.select("sta", "chan", start.alias("time"), jdate(F.timestamp_micros("start_us")).alias("jdate"), (start + (F.size("samples") - 1) / F.col("sample_rate")).alias("endtime"), F.size("samples").cast("long").alias("nsamp"), F.col("sample_rate").alias("samprate"))
    return numbered(rows, "wfid", ["sta", "chan", "time"])


def complete_event(origins: DataFrame, arrivals: DataFrame, picks: DataFrame, magnitudes: DataFrame, station_magnitudes: DataFrame, model: str) -> dict[str, DataFrame]:
    """All tables of located events at once; magnitudes hang on the event's last origin."""
    last = latest_origin(origins.select(F.col("event_id").alias("evid"), "orid"))
    mags = magnitudes.join(last.select(F.col("evid").alias("event_id"), F.col("prefor").alias("orid")), "event_id")
    mags = mags.select("magid", "orid", F.col("event_id").alias("evid"), "magtype", "nsta", "magnitude", "uncertainty", F.lit(AUTHOR).alias("auth"))
    each = station_magnitudes.join(mags.select("magid", F.col("evid").alias("event_id"), "orid", "magtype"), ["event_id", "magtype"]).select("magid", "sta", "orid", F.col("event_id").alias("evid"), km_to_deg("distance").alias("delta"), "magtype", "magnitude", F.lit(AUTHOR).alias("auth"))
    event = last.withColumn("evname", F.concat(F.lit(AUTHOR), F.col("evid").cast("string"))).withColumn("auth", F.lit(AUTHOR))
    return {"event": event, "origin": origin_rows(origins), "origerr": origerr_rows(origins), "arrival": arrival_rows(picks), "assoc": assoc_rows(arrivals, model), "netmag": mags, "stamag": each}


# Flat files


def _fixed(kind: str, width: int, column: str) -> Column:
    c = F.col(column)
    if kind == "r":
        return F.lpad(F.format_string("%.5f" if "time" in column else "%.4f", c.cast("double")), width, " ")
    return F.lpad(F.coalesce(c.cast("string"), F.lit(NULL_TEXT if kind == "t" else str(NULL_INT))), width, " ")


#: Columns and widths of the flat files.
FLAT = {
    "event": (("evid", 8), ("evname", 32), ("prefor", 8), ("auth", 15)),
    "origin": (("lat", 9), ("lon", 10), ("depth", 9), ("time", 17), ("orid", 8), ("evid", 8)),
    "origerr": (("orid", 8), ("sxx", 15), ("syy", 15), ("szz", 15), ("stt", 15), ("sdobs", 9)),
    "arrival": (("sta", 6), ("time", 17), ("arid", 8), ("jdate", 8), ("chan", 8), ("iphase", 8)),
    "assoc": (("arid", 8), ("orid", 8), ("sta", 6), ("phase", 8), ("delta", 8), ("timeres", 8)),
    "netmag": (("magid", 8), ("orid", 8), ("evid", 8), ("magtype", 6), ("magnitude", 7)),
}


def flat_lines(rows: DataFrame, name: str) -> DataFrame:
    """value: lines of fixed width."""
    kinds = dict(columns(name))
    filled = with_sentinels(conformed(rows, name), name)
    return filled.select(F.concat_ws(" ", *(_fixed(kinds[c], w, c) for c, w in FLAT[name])).alias("value"))


def export(catalog: Catalog, directory: str, start: float | None = None, end: float | None = None) -> None:
    """All flat files; with a window, what belongs to origins inside it."""
    origin = catalog.table("origin")
    if start is not None:
        origin = origin.where(F.col("time").between(start, end))
    orids = origin.select("orid")
    assoc = catalog.table("assoc").join(orids, "orid", "left_semi")
    parts = {
        "event": catalog.table("event").join(orids.withColumnRenamed("orid", "prefor"), "prefor", "left_semi"), "origin": origin, "origerr": catalog.table("origerr").join(orids, "orid", "left_semi"),
        "arrival": catalog.table("arrival").join(assoc.select("arid"), "arid", "left_semi"), "assoc": assoc, "netmag": catalog.table("netmag").join(orids, "orid", "left_semi"),
    }
    for name, rows in parts.items():
        flat_lines(rows, name).write.mode("overwrite").text(f"{directory}/{name}")


def summary_text(rows: DataFrame) -> DataFrame:
    """One line for each preferred event."""
    return rows.select(F.format_string("%d %s lat %.4f lon %.4f depth %.2f km", F.col("evid"), F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd HH:mm:ss"), F.col("lat"), F.col("lon"), F.col("depth")).alias("value"))
