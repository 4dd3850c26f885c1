"""Association of a stream of picks: what waits, what becomes an event, what comes too late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import associate
from ..scratch import file_system, passing, written


class PendingAssociation:
    """Picks that no event has yet wait in a folder; every micro-batch joins them to its own and looks for events.

    Picks of events are taken out.  A pick that is over twice the window older
    than the newest pick so far (event time) goes to ``on_late`` instead of
    waiting on.  Batch n reads the folder of the batch before it and writes its
    own, so a batch that comes again gives the same; the callbacks get its number
    and can use it to store once (see ``Catalog.store``).
    """

    def __init__(self, path: str, stations: DataFrame, times: DataFrame, on_events: Callable[[DataFrame, int], None], on_late: Callable[[DataFrame, int], None] = lambda rows, number: None, window_s: float = 60.0, max_residual: float = 3.0, min_stations: int = 3, min_phases: int = 4) -> None:
        self.path, self.stations, self.times = path.rstrip("/"), stations, times
        self.on_events, self.on_late = on_events, on_late
        self.window_us, self.max_residual = int(window_s * 1e6), max_residual
        self.needed = {"min_stations": min_stations, "min_phases": min_phases}

    def _before(self, spark, number: int) -> int | None:
        """The last batch before this one that has left a folder with its clock, which is written last."""
        where, system = file_system(spark, f"{self.path}/clock")
        if not system.exists(where):
            return None
        done = [int(f.getPath().getName()) for f in system.listStatus(where) if f.isDirectory()]
        return max((n for n in done if n < number), default=None)

    def _forget(self, spark, number: int) -> None:
        for name in ("pending", "clock"):
            where, system = file_system(spark, f"{self.path}/{name}/{number}")
            system.delete(where, True)

    def batch(self, rows: DataFrame, number: int) -> None:
        """rows: pick_id, net, sta, phase, time_us and whatever else events shall have.

        All tables between the steps go with the batch, so what the callbacks get is theirs until they return.
        """
        with passing(rows.sparkSession):
            self._batch(rows, number)

    def _batch(self, rows: DataFrame, number: int) -> None:
        spark, last = rows.sparkSession, self._before(rows.sparkSession, number)
        pending, clock = rows, 0
        if last is not None:
            pending = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{self.path}/pending/{last}"))
            clock = spark.read.schema("us long").parquet(f"{self.path}/clock/{last}").first()["us"]
        pending = written(pending.dropDuplicates(["pick_id"]), "picks")
        now = max(clock, pending.agg(F.max("time_us")).first()[0] or 0)
        kept = written(associate.chosen(pending, self.stations, self.times, max_residual=self.max_residual, **self.needed), "kept")
        chosen = associate.members(pending, self.stations, self.times, kept, max_residual=self.max_residual).select(F.col("seed_id").alias("event_id"), "pick_id").distinct()
        events = written(chosen.join(pending, "pick_id"), "events")
        left = written(associate.unassociated(pending, events), "left")
        late = F.col("time_us") < now - 2 * self.window_us
        if not events.isEmpty():
            self.on_events(events, number)
        gone = left.where(late)
        if not gone.isEmpty():
            self.on_late(gone, number)
        left.where(~late).write.mode("overwrite").parquet(f"{self.path}/pending/{number}")
        spark.createDataFrame([(now,)], "us long").write.mode("overwrite").parquet(f"{self.path}/clock/{number}")
        if last is not None and (older := self._before(spark, last)) is not None:
            self._forget(spark, older)

    def start(self, picks: DataFrame, every: str = "100 milliseconds") -> DataStreamWriter:
        return picks.writeStream.foreachBatch(self.batch).trigger(processingTime=every)
