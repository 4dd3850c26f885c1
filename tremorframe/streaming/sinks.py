"""Micro-batches into the catalog, and callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def store_events(origins: DataFrame, tables: Callable[[DataFrame], dict[str, DataFrame]], catalog, name: str = "events") -> DataStreamWriter:
    """Each batch's events become catalog rows in one commit; a batch that comes again is not stored twice."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            catalog.store(tables(rows), (name, number))

    return origins.writeStream.foreachBatch(batch)


def on_event(rows: DataFrame, callback: Callable[[dict], None]) -> DataStreamWriter:
    """Calls back on the driver for every event, a partition at a time."""
    return rows.writeStream.foreachBatch(lambda batch, _: [callback(r.asDict(True)) for r in batch.toLocalIterator()])
