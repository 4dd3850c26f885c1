"""Tables and folders between steps, where the driver and all executors see them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: The paths that ``passing`` deletes at its end.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where that is unset, a session whose executors are threads of the driver
    gets a folder of its own; on a cluster it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _LOCAL.get("dir")
        if where is None:
            where = _LOCAL["dir"] = tempfile.mkdtemp(prefix="tremorframe-")
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``written`` makes inside of this goes at its end, but for what is kept for the session.

    For work that comes again and again, as a stream's batches do.
    """
    paths: list[str] = []
    token = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            where, system = file_system(spark, path)
            system.delete(where, True)
            system.cancelDeleteOnExit(where)


def fresh(spark: SparkSession, name: str, session: bool = False) -> str:
    """A path that nothing has yet; what is put there goes when the driver's JVM ends, or with ``passing`` unless it is the session's."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where, system = file_system(spark, path)
    system.deleteOnExit(where)
    if not session and (paths := _PASSING.get()) is not None:
        paths.append(path)
    return path


def written(rows: DataFrame, name: str, session: bool = False) -> DataFrame:
    """Cuts the lineage: rows as a table in the shared folder."""
    path = fresh(rows.sparkSession, name, session)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
