"""Mixing sources to target weights by Poisson replication.

Every source has a target weight; its mean repetition rate is weight x rows of
the output / rows of the source.  A row's count is the Poisson quantile of a
number in [0, 1) made from the md5 of its id and text and the seed, so a rerun
or a lost executor gives the same counts.  Rows are exploded by their counts
and dealt out by a hash of id and copy, each partition sorted by that hash,
which is a global shuffle that needs no driver.

Nulls: a null source is a source of its own, null ids and texts are hashed as
empty.  Repeated rows, and rows that tie in id and text, have the same number
and so the same count.  Sources without a target weight get none; with no
targets given, a source of n rows weighs n ** temperature.  An empty table gives
no rows.  Texts of any length are hashed and copied whole.  Columns of docs that
have the name of one of the operator's own (``OWN``) stay, as input_<name>.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SEED = "mix-1"
TEMPERATURE = 0.5
#: Columns that the operator adds.
OWN = ("mix_rate", "mix_copies", "mix_copy")
#: Over this mean rate the quantile's sum starts below the bulk, as exp(-rate) nears the least double.
DIRECT_RATE = 512.0
#: Copies of a row that one array holds.
CHUNK = 4096
#: Sources up to this many are broadcast (some 60 bytes each); more are joined.
BROADCAST_SOURCES = 10_000


def uniform(*columns: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an md5."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns), F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def _first_p(rate: Column, k: Column) -> Column:
    """The chance of k by Stirling's series, which is exact to a double from k = 200 on."""
    return F.exp((k - rate) + k * F.log1p((rate - k) / k) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k))


def poisson_quantile(u: Column, rate: Column) -> Column:
    """The least k whose cumulative probability is over u; the work of a row grows with the root of a large rate."""
    # Counts outside of this have a chance under 1e-26.
    spread = 12 * F.sqrt(rate) + 16
    first, last = F.when(rate > DIRECT_RATE, F.floor(rate - spread)).otherwise(0).cast("int"), F.ceil(rate + spread).cast("int")
    p = F.when(rate > DIRECT_RATE, _first_p(rate, F.floor(rate - spread).cast("double"))).otherwise(F.exp(-rate))
    start = F.struct(p.alias("p"), p.alias("c"), F.when(p > u, first).otherwise(-1).alias("k"))
    # A double for p and c, and k once it is found; the sum stops to grow after that.
    step = lambda a, i: F.when(a["k"] >= 0, a).otherwise(F.struct((a["p"] * rate / i).alias("p"), (a["c"] + a["p"] * rate / i).alias("c"), F.when((a["c"] + a["p"] * rate / i > u) | (i == last), i).otherwise(-1).alias("k")))
    return F.aggregate(F.sequence(first + 1, last), start, step, lambda a: a["k"])


def rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, size: float | None = None) -> DataFrame:
    """source, n, rate: size is the rows of the output, as many as docs has if not given."""
    counted = docs.groupBy("source").agg(F.count("*").alias("n"))
    if targets is None:
        weighed = counted.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = F.create_map(*(F.lit(x) for k, v in targets.items() for x in (k, float(v)))) if targets else F.create_map().cast("map<string,double>")
        weighed = counted.withColumn("weight", F.coalesce(F.try_element_at(given, "source"), F.lit(0.0)))
    total = weighed.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()
    rows, weights = float(total["rows"] or 0), float(total["weights"] or 0.0)
    if not rows or not weights:
        return weighed.select("source", "n", F.lit(0.0).alias("rate"))
    return weighed.select("source", "n", F.round(F.col("weight") / weights * (rows if size is None else float(size)) / F.col("n"), 9).alias("rate"))


def replicate(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, size: float | None = None, seed: str = SEED, partitions: int | None = None) -> DataFrame:
    """All columns of docs, then mix_rate, mix_copies, mix_copy; shuffled globally.

    The mean rate of a source may be of any size; a row's work grows with its root.
    """
    # A table of its own, so that a join with many sources can split a hot one.
    table = written(rates(docs, targets, temperature, size).select("source", F.col("rate").alias("mix_rate")), "rates")
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    # The input's columns travel under other names, so none of theirs can clash.
    hidden = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*hidden.values())
    rows = rows.join(table, F.col(hidden["source"]).eqNullSafe(F.col("source"))).drop("source")
    rows = rows.withColumn("mix_copies", poisson_quantile(uniform(hidden["doc_id"], hidden["text"], seed=seed), F.col("mix_rate")))
    # In two steps, so that no array is longer than CHUNK.
    rows = rows.where("mix_copies > 0").withColumn("first", F.explode(F.sequence(F.lit(1), F.col("mix_copies"), F.lit(CHUNK))))
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.col("first"), F.least(F.col("mix_copies"), F.col("first") + (CHUNK - 1)))))
    rows = rows.withColumn("key", F.xxhash64(hidden["doc_id"], "mix_copy", F.lit(seed), hidden["text"]))
    rows = (rows.repartition(partitions, "key") if partitions else rows.repartition("key")).sortWithinPartitions("key")
    return rows.select(*(F.col(h).alias(_free(c, docs.columns)) for c, h in hidden.items()), *OWN)


def _free(name: str, columns: list[str]) -> str:
    """The name, or one after input_ that nothing else has."""
    out = name
    while out in OWN or out != name and out in columns:
        out = f"input_{out}"
    return out
