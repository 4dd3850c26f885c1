"""Helpers that all operators share: shared-folder tables and Arrow streams."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import file_system, fresh

#: What modules want to be called when a task ends.
CLEARED: list[Callable[[], None]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again.

    The table goes when the driver's JVM ends, or earlier through ``dropped``.
    """
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``written`` made and nothing will read again."""
    for t in tables:
        where, system = file_system(t.sparkSession, t._written)
        system.delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bounds the Arrow batches by rows and bytes, as texts may be very long.

    The session's settings are only ever lowered.  Plans are made when a frame
    runs, so the bounds have to outlive this call.
    """
    jvm = spark._jvm.org.apache.spark.network.util.JavaUtils
    for key, bound in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        now = int(now) if now.lstrip("-").isdigit() else jvm.byteStringAsBytes(now)
        if now <= 0 or now > bound:
            spark.conf.set(key, str(bound))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches; spare memory goes back when a task ends."""
    small_batches(df.sparkSession)

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns memory that caches, Arrow and the C library keep for later; workers stay alive between tasks."""
    for clear in CLEARED:
        clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def remainder(doc_id, by: int = 5):
    """crc32 of the id's decimal text, modulo by; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema and after it the fields of the DDL string."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
