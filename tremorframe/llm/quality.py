"""Quality rules: thresholds that adapt to each language and source.

Each row counts four kinds of event with built-in functions alone: symbols,
repeated lines, words in repeated windows, capitals.  How often an event comes
in a text of so many words (lines, characters) is known only roughly, so each
rate gets a low and a high estimate, one root of the count to either side; words
repeat in clumps of six, two windows of three, and count as such.  A row is
refused only if its low estimate is over what high estimates usual in its group
reach.  A row without an event has a low estimate of 0 and always passes,
whatever its length.

A sketch of the high estimates is kept for every (lang, source) over the rows
that pass the base rules: counts of logarithmic bins, as in a DDSketch, so
sketches merge by adding counts, do not depend on the order of rows or on
partitions, and a quantile read from them is within GAMMA of the exact one.  A
group's limit is the UPPER hundredth of its sketch, or REACH times its median if
that is less: junk in more than a hundredth of a group moves the first, and up
to half of a group's rows may be junk without moving the second far.  A small
group leans on its language: PRIOR rows of the language's sketch are mixed into
each group's, and PRIOR rows of all rows' into the language's, by adding counts,
whatever the sizes.  The limits are then joined to the rows, which decides
``kept``.

Nulls: a null text has no words; null lang or source form groups of their own.
Ids are never used to decide, so repeated rows are judged alike.  Ties: a rate
equal to its limit passes.  A group of which no row passes the base rules has no
limits, and none of its rows is kept; an empty table gives no rows.  A text's
words and windows are arrays of its own row, so its length is bounded by a
task's memory only.  Columns besides text, lang, source and those kept are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

WHITE = "[\\x20\\x09-\\x0D]"
#: Each rate: the events, what they are counted in, and how many of them come at once.
RATES = {"symbol_rate": ("n_symbols", "n_words", 1), "dup_line_rate": ("n_dup_lines", "_n_lines", 1), "repeat_rate": ("n_repeat_words", "n_words", 6), "upper_rate": ("_upper", "word_chars", 1)}
#: The quantile in hundredths, and how many times the median, that bound a group's usual rates.
UPPER, REACH = 99, 20
#: Rows' worth of the parent's sketch in each sketch.
PRIOR = 10
GAMMA = 1.005
#: The bins' unit; a high estimate is 1 / (words + 1) at least.
UNIT = 1e-6
COUNT = "decimal(38,0)"


def measures(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., the counts of the contract, and <rate>_low and <rate>_high for each rate."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.select(*keep, text.alias("_text"))
    df = df.withColumn("_words", F.filter(F.split("_text", WHITE + "+"), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("_lines", lines)
    count = lambda pattern: F.length(F.regexp_replace("_text", pattern, ""))
    # Every three-word window as (96 bits of hashes, place), sorted so that equal windows meet.
    at = lambda i: [F.get("_words", i + k) for k in range(3)]
    window = lambda i: F.struct(F.xxhash64(*at(i)).alias("h"), F.hash(*at(i)).alias("g"), i.alias("p"))
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(F.array().cast("array<struct<h:bigint,g:int,p:int>>"))
    df = df.select(
        *keep,
        "n_words",
        count(WHITE).cast("long").alias("word_chars"),
        (F.length("_text") - count("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length("_text") - count("[A-Z]")).cast("long").alias("_upper"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("_windows"),
    )
    same = lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])
    twice = F.filter("_windows", lambda x, i: same(F.get("_windows", i - 1), x) | F.coalesce(same(F.get("_windows", i + 1), x), F.lit(False)))
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["p"])))
    # Words covered by the windows at these places, each word once.
    covered = F.aggregate("_places", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])
    n = F.col("n_words")

    def estimates(rate: str) -> list[Column]:
        count, of, clump = RATES[rate]
        spread = F.sqrt(F.col(count) * float(clump))
        return [(F.greatest(F.col(count) - spread, F.lit(0.0)) / (F.col(of) + 1)).alias(f"{rate}_low"), ((F.col(count) + spread + clump) / (F.col(of) + 1)).alias(f"{rate}_high")]

    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "_upper", "_n_lines"
    ).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        *(e for r in RATES for e in estimates(r)),
    )


def bin_of(value: Column) -> Column:
    return F.floor(F.ln(value / UNIT) / F.ln(F.lit(GAMMA))).cast("int")


def bin_top(number: Column) -> Column:
    return UNIT * F.pow(F.lit(GAMMA), number + 1)


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """groups..., rate, bin, n of the high estimates: mergeable by adding n."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), bin_of(F.col(f"{r}_high")).alias("bin")) for r in RATES)))
    return measured.select(*groups, each.alias("_r")).groupBy(*groups, F.col("_r.rate").alias("rate"), F.col("_r.bin").alias("bin")).agg(F.count("*").cast(COUNT).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "rate", "bin").agg(F.sum("n").cast(COUNT).alias("n"))


def gathered(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """groups..., rate, size, bins: a sketch's bins as one array of (bin, n), a few thousand at most."""
    return sketch.groupBy(*groups, "rate").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").cast(COUNT).alias("size"))


def leaning(own: DataFrame, parent: DataFrame, on: list[str], prior: int = PRIOR) -> DataFrame:
    """own (gathered) with ``prior`` rows' worth of its parent's bins mixed in; counts become n * the parent's size + prior * the parent's n, which are whole."""
    wide = parent.select(*(F.col(c).alias(f"_{c}") for c in on), F.col("rate").alias("_rate"), F.col("bins").alias("_bins"), F.col("size").alias("_size"))
    same = F.col("rate") == F.col("_rate")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    scaled = lambda bins, by: F.transform(bins, lambda x: F.struct(x["bin"].alias("bin"), (x["n"] * by).cast(COUNT).alias("n")))
    both = F.sort_array(F.concat(scaled("bins", F.col("_size")), scaled("_bins", F.lit(prior))))
    size = (F.col("size") * F.col("_size")).cast(COUNT) + (F.col("_size") * prior).cast(COUNT)
    names = [c for c in own.columns if c not in ("bins", "size")]
    return own.join(wide, same).select(*names, both.alias("bins"), size.cast(COUNT).alias("size"))


def quantile(q: int) -> Column:
    """The top of the first bin at which a gathered sketch has q hundredths of its rows."""
    start = F.struct(F.lit(0).cast(COUNT).alias("seen"), F.lit(None).cast("int").alias("bin"))
    step = lambda a, x: F.struct((a["seen"] + x["n"]).cast(COUNT).alias("seen"), F.when(a["bin"].isNull() & (100 * (a["seen"] + x["n"]) >= q * F.col("size")), x["bin"]).otherwise(a["bin"]).alias("bin"))
    return bin_top(F.aggregate("bins", start, step, lambda a: a["bin"]))


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source, then a limit for each rate."""
    sketch = sketches(measured.where(~F.col("base_failed")), ["lang", "source"])
    language = merged(sketch, ["lang"])
    wide = leaning(gathered(language, ["lang"]), gathered(merged(language, []), []), [])
    own = leaning(gathered(sketch, ["lang", "source"]), wide, ["lang"])
    limit = own.select("lang", "source", "rate", F.least(quantile(UPPER), REACH * quantile(50)).alias("limit"))
    return limit.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == r, F.col("limit"))).alias(f"{r}_limit") for r in RATES))


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with its counts, rates, limits and kept."""
    more = [c for c in keep if c not in ("lang", "source")]
    measured = written(measures(docs.select("text", "lang", "source", *more), ["lang", "source", *more]), "quality")
    # A row for each language and source, as a table of its own: Spark broadcasts it if it is small, else the join can split hot keys.
    limit = written(thresholds(measured).withColumnsRenamed({"lang": "_lang", "source": "_source"}), "limits")
    rows = measured.join(limit, measured.lang.eqNullSafe(F.col("_lang")) & measured.source.eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    good = ~F.col("base_failed")
    for r in RATES:
        good = good & F.coalesce(F.col(f"{r}_low") <= F.col(f"{r}_limit"), F.lit(False))
    return rows.withColumn("kept", good)
