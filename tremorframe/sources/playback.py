"""Segments played in the order of their starts, as fast as wanted."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import numbered
from ..scratch import written


def play(segments: DataFrame, sink: Callable[[DataFrame, int], None], speed: float = 0.0, every: int = 10, sleep: Callable[[float], None] = time.sleep, start: int = 0) -> int:
    """Gives ``every`` segments at a time to the sink, with the number of the first; returns how many there were.

    speed: seconds of data in a second, 0 for no pauses.  start: the number of
    the first part to play, so that who keeps the last one that a sink has taken
    goes on after it.  Segments are numbered and written in their order once;
    a part is read by its numbers, which files and row groups are sorted by.
    """
    names = [c for c in ("net", "sta", "loc", "chan", "stream_id") if c in segments.columns]
    ordered = numbered(segments, "play_number", ["start_us", *names], 0)
    ordered = written(ordered.repartitionByRange("play_number").sortWithinPartitions("play_number"), "playback")
    heads = ordered.where((F.col("play_number") % every == 0) & (F.col("play_number") >= start)).select("play_number", "start_us").orderBy("play_number")
    began, first, count = time.monotonic(), None, ordered.count()
    # A row for each part; its segments stay where they are.
    for head in heads.toLocalIterator():
        first = head["start_us"] if first is None else first
        if speed > 0:
            sleep(max(0.0, (head["start_us"] - first) / 1e6 / speed - (time.monotonic() - began)))
        part = F.col("play_number").between(head["play_number"], head["play_number"] + every - 1)
        sink(ordered.where(part).orderBy("play_number").drop("play_number"), head["play_number"])
    return count
