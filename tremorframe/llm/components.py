"""Connected components of a table of links, by large and small stars.

Rounds of two aggregations with joins until nothing changes or so few links are
left that one task joins them; the number of rounds grows with the logarithm of
the longest path.  Links stay distributed; every round is cut off by a table in
the shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, map_arrow, written

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


#: Up to so many links one task joins them at once; beyond, a round's links go to as many tasks as this needs.
TASK_ROWS = 200_000


def _at_once(batches):
    """Disjoint sets over all links of the task."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := up.setdefault(i, i)) != i:
            up[i] = i = up[j]
        return i

    for batch in batches:
        for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(i) for i in list(up)], pa.int64())], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """id, component: the least id reachable, a row for every id that a link (a, b) with a != b names, the least ones included."""
    now = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    n, seen, last = links.count(), None, None
    for _ in range(MAX_ROUNDS):
        if n <= TASK_ROWS:
            return written(map_arrow(now.coalesce(1), _at_once, "id long, component long"), "components")
        now = written(_small_star(_large_star(now)).distinct().coalesce(1 + n // TASK_ROWS), "links")
        if last is not None:
            dropped(last)
        last = now
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            # Only stars are left: every row names a root, and no root has a row of its own.
            roots = now.select("v").distinct().select("v", "v")
            return now.union(roots).toDF("id", "component")
        seen, n = state, state[0]
    raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} rounds")
