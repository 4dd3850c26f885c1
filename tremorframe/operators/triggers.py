"""Hysteresis triggers as islands of rows, and pickers made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import signal
from .frames import BLOCK, aic_candidates, dealt, frame_sums, in_blocks, kept, loudest_ahead, minimum_gap
from .signal import Stream

__all__ = ["BLOCK", "in_blocks"]


def _state(mark: Column | str, over) -> Column:
    return F.last(mark, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))


def hysteresis(df: DataFrame, s: Stream, on: Column, off: Column, peak: Column, keep_open: bool = False, block: int | None = None) -> DataFrame:
    """by..., on_idx, off_idx, peak: on and off must never hold in the same row.

    A row's state is its last marker.  Triggers that are still on at the end of
    the stream are left out, unless keep_open.  block: so many samples are one
    window partition; a few rows for each block carry the state and the number
    of triggers over from block to block, so a stream of any length is dealt out.
    """
    marked = df.select(*s.by, s.idx, peak.alias("_peak"), F.when(on, 1).when(off, 0).alias("_mark"))
    marked = marked.withColumn("_block", F.floor(s.i / block) if block else F.lit(0).cast("long"))
    inside = Window.partitionBy(*s.by, "_block").orderBy(s.idx)
    along = Window.partitionBy(*s.by).orderBy("_block")
    marked = marked.withColumn("_own", _state("_mark", inside))
    # The state at a block's end: its last marker, or what it began with.
    ends = marked.groupBy(*s.by, "_block").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(s.idx))).alias("_last"))
    carried = F.coalesce(F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = ends.select(*s.by, "_block", carried.alias("_carry"))
    rows = marked.join(begins, [*s.by, "_block"]).withColumn("_state", F.coalesce("_own", "_carry"))
    before = F.coalesce(F.lag("_state").over(inside), F.col("_carry"))
    rows = rows.withColumn("_begins", F.when((F.col("_state") == 1) & (before == 0), 1).otherwise(0)).withColumn("_ends", (F.col("_state") == 0) & (before == 1))
    rows = rows.withColumn("_number", F.sum("_begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # A trigger's part in a block: its number there, 0 for one that was on before.
    parts = rows.where((F.col("_state") == 1) | F.col("_ends")).groupBy(*s.by, "_block", "_number").agg(
        F.min(s.idx).alias("on_idx"), F.max(F.when(F.col("_ends"), F.col(s.idx))).alias("off_idx"), F.max(F.when(F.col("_state") == 1, F.col("_peak"))).alias("peak")
    )
    fresh = F.when(F.col("_number") > 0, 1).otherwise(0)
    island = F.sum(fresh).over(Window.partitionBy(*s.by).orderBy("_block", "_number").rowsBetween(Window.unboundedPreceding, 0))
    found = parts.withColumn("_island", island).groupBy(*s.by, "_island").agg(F.min("on_idx").alias("on_idx"), F.max("off_idx").alias("off_idx"), F.max("peak").alias("peak"))
    return (found if keep_open else found.where("off_idx is not null")).drop("_island")


def threshold_triggers(df: DataFrame, s: Stream, column: str, trigger: float, detrigger: float, block: int | None = None) -> DataFrame:
    """On at trigger or more, off under detrigger."""
    if detrigger > trigger:
        raise ValueError("detrigger must not be over trigger")
    c = F.col(column)
    return hysteresis(df, s, c >= trigger, c < detrigger, c, block=block)


def block_ratios(df: DataFrame, s: Stream, sta: int, lta: int, tiny: float = signal.TINY_LTA, block: int = BLOCK) -> DataFrame:
    """by..., idx, ratio: STA/LTA of the demeaned stream, a block of samples at a time; the mean comes from one aggregate."""
    sta = max(1, sta)
    lta = max(sta + 1, lta)
    mean = df.groupBy(*s.by).agg(F.avg(s.x).alias("_mean"))
    rows = df.join(mean, list(s.by)).select(*s.by, s.i.alias(s.idx), (s.x - F.col("_mean")).alias("_d"))
    rows = dealt(rows, s, lta, block)
    own = Stream((*s.by, "_block"), s.idx, "_d")
    energy = F.col("_d") * F.col("_d")
    rows = frame_sums(rows.withColumn("_short", own.sum(energy, -(sta - 1), 0)), own, {"_long": (energy, lta)})
    short, long = F.col("_short") / sta, F.col("_long") / lta
    ratio = F.when((s.i >= lta) & (long > tiny), short / long).otherwise(0.0)
    return kept(rows, s, block).select(*s.by, s.idx, ratio.alias("ratio"))


def stalta_triggers(df: DataFrame, s: Stream, sta: int, lta: int, trigger: float, detrigger: float, tiny: float = signal.TINY_LTA, block: int = BLOCK) -> DataFrame:
    """Demean, STA/LTA, hysteresis: a row for each trigger that ended; idx counts a stream's samples from 0."""
    return threshold_triggers(block_ratios(df, s, sta, lta, tiny, block), s, "ratio", trigger, detrigger, block)


def polarization_triggers(df: DataFrame, s: Stream, coupled: str, rect: str, trigger: float, detrigger: float, theta: float, block: int | None = None) -> DataFrame:
    """On where both measures are high enough, off where one of them is low."""
    on = (F.col(coupled) >= trigger) & (F.col(rect) >= theta)
    off = (F.col(coupled) < detrigger) | (F.col(rect) < theta / 2)
    return hysteresis(df, s, on, off, F.col(coupled), block=block)


def near_samples(df: DataFrame, s: Stream, picks: DataFrame, first: Column, stop: Column, width: int = 4096) -> DataFrame:
    """Picks with _i and _x of each sample from first up to stop; picks and samples meet in buckets of so many samples, not by whole streams."""
    wanted = picks.withColumn("_first", first).withColumn("_stop", stop)
    wanted = wanted.where("_stop > _first").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_first") / width), F.floor((F.col("_stop") - 1) / width))))
    rows = df.select(*s.by, s.i.alias("_i"), s.x.alias("_x"), F.floor(s.i / width).alias("_bucket"))
    return rows.join(wanted, [*s.by, "_bucket"]).where((F.col("_i") >= F.col("_first")) & (F.col("_i") < F.col("_stop"))).drop("_first", "_stop", "_bucket")


def aic_refined(df: DataFrame, s: Stream, picks: DataFrame, at: str, reach: int, margin: int = 5) -> DataFrame:
    """picks with refined_idx: the AIC minimum of the samples within reach of ``at``."""
    keyed = picks.withColumn("_at", F.col(at))
    near = near_samples(df, s, keyed, F.col("_at") - reach, F.col("_at") + reach)
    w = Window.partitionBy(*s.by, "_at").orderBy("_i")
    near = near.withColumn("_k", F.row_number().over(w) - 1)
    own = Stream((*s.by, "_at"), "_k", "_x")
    n = F.count("*").over(own.whole)
    scored = near.select("*", signal.aic(own).alias("_aic"), n.alias("_n"))
    inner = scored.where((F.col("_k") >= margin) & (F.col("_k") < F.col("_n") - margin))
    best = inner.groupBy(*s.by, "_at").agg(F.min_by("_i", F.struct("_aic", "_k")).alias("refined_idx"))
    return keyed.join(best, [*s.by, "_at"], "left").withColumn("refined_idx", F.coalesce("refined_idx", F.col(at))).drop("_at")


def stalta_picks(df: DataFrame, s: Stream, rate: float, sta_s: float = 0.5, lta_s: float = 10.0, trigger: float = 3.0, detrigger: float = 1.5, refine: int = 50) -> DataFrame:
    """STA/LTA picker: by..., pick_idx, on_idx, off_idx, snr, confidence, amplitude, phase."""
    found = stalta_triggers(df, s, int(sta_s * rate), int(lta_s * rate), trigger, detrigger).withColumnRenamed("peak", "snr")
    return _finished(df, s, found, rate, refine)


def aic_picks(df: DataFrame, s: Stream, rate: float, before_s: float = 2.0, min_snr: float = 3.0, distinct: bool = True) -> DataFrame:
    """AIC picker: candidates where energy rises, each moved to its AIC minimum."""
    w = max(4, int(before_s * rate))
    found = aic_candidates(df, s, w, min_snr).select(*s.by, s.i.alias("candidate"), F.sqrt("energy_ratio").alias("snr"))
    found = aic_refined(df, s, found, "candidate", w // 2).withColumnRenamed("refined_idx", "pick_idx")
    if distinct:
        found = found.groupBy(*s.by, "pick_idx").agg(F.max("snr").alias("snr"), F.min("candidate").alias("candidate"))
    return found.withColumn("confidence", F.least(F.lit(1.0), F.col("snr") / 10.0)).withColumn("phase", F.lit("P"))


def polarization_picks(df: DataFrame, s: Stream, rate: float, sta_s: float = 0.3, lta_s: float = 8.0, trigger: float = 1.5, detrigger: float = 0.5, pol_s: float = 0.5, theta: float = 0.2) -> DataFrame:
    """Three-component picker over columns z, n, e: STA/LTA of z times rectilinearity."""
    z = Stream(s.by, s.idx, "z")
    sta, lta, pol = int(sta_s * rate), int(lta_s * rate), max(2, int(pol_s * rate))
    both = lambda o: {"ratio": signal.sta_lta(o, sta, lta, F.col("z"), signal.TINY_PREFIX), "rect": signal.rectilinearity(o, "z", "n", "e", pol)}
    rows = in_blocks(df, z, max(sta + 1, lta, pol), both).withColumn("coupled", F.col("ratio") * F.col("rect"))
    found = polarization_triggers(rows, z, "coupled", "rect", trigger, detrigger, theta, BLOCK).withColumnRenamed("peak", "snr")
    return aic_refined(df, z, found, "on_idx", int(rate)).withColumnRenamed("refined_idx", "pick_idx").withColumn("phase", F.lit("P"))


def one_component_triggers(df: DataFrame, s: Stream, sta: int, lta: int, trigger: float, detrigger: float) -> DataFrame:
    """Where horizontals are lacking: triggers of the demeaned vertical alone."""
    return stalta_triggers(df, s, sta, lta, trigger, detrigger, signal.TINY_PREFIX)


def one_component_picks(df: DataFrame, s: Stream, rate: float, sta_s: float = 0.3, lta_s: float = 8.0, trigger: float = 1.5, detrigger: float = 0.5, refine: int = 50) -> DataFrame:
    """The polarization picker's way with one component: by..., pick_idx, on_idx, off_idx, snr, confidence, amplitude, phase."""
    found = one_component_triggers(df, s, int(sta_s * rate), int(lta_s * rate), trigger, detrigger).withColumnRenamed("peak", "snr")
    return _finished(df, s, found, rate, refine)


def _finished(df: DataFrame, s: Stream, found: DataFrame, rate: float, refine: int) -> DataFrame:
    """Triggers with the refined onset, the loudest sample of the second from there, and a confidence."""
    found = aic_refined(df, s, found, "on_idx", refine).withColumnRenamed("refined_idx", "pick_idx")
    at = found.select(*s.by, "pick_idx").distinct()
    loud = near_samples(df, s, at, F.col("pick_idx"), F.col("pick_idx") + max(1, int(rate))).groupBy(*s.by, "pick_idx").agg(F.max(F.abs("_x")).alias("amplitude"))
    found = found.join(loud, [*s.by, "pick_idx"], "left")
    return found.withColumn("confidence", F.least(F.lit(1.0), F.col("snr") / 10.0)).withColumn("phase", F.lit("P"))


def three_components(segments: DataFrame, by: tuple[str, ...] = ("net", "sta")) -> DataFrame:
    """by..., start_us, sample_rate, z, n, e of segments whose BHZ, BHN or BH1, and BHE or BH2 begin together."""
    kind = F.when(F.col("chan") == "BHZ", "z").when(F.col("chan").isin("BHN", "BH1"), "n").when(F.col("chan").isin("BHE", "BH2"), "e")
    rows = segments.withColumn("_c", kind).where("_c is not null")
    of = lambda c: F.max(F.when(F.col("_c") == c, F.col("samples"))).alias(c)
    return rows.groupBy(*by, "start_us", "sample_rate").agg(of("z"), of("n"), of("e")).where("z is not null and n is not null and e is not null")


def pick_windows(picks: DataFrame, segments: DataFrame, by: tuple[str, ...], before_s: float = -10.0, after_s: float = 60.0, bucket_s: float = 3600.0) -> DataFrame:
    """Segments' columns with each pick (pick_id, by..., time_us) near them: first_idx and the samples from before_s to after_s of the pick.

    A pick and a segment meet once, in the first time bucket that both touch.
    """
    width, us = int(bucket_s * 1e6), F.col("time_us")
    lo, hi = us + int(before_s * 1e6), us + int(after_s * 1e6)
    near = picks.select("pick_id", *by, "time_us", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))).alias("_b"), F.floor(lo / width).alias("_p"))
    end = F.col("start_us") + F.ceil(F.size("samples") * 1e6 / F.col("sample_rate")).cast("long")
    parts = segments.withColumn("_s", F.floor(F.col("start_us") / width)).withColumn("_b", F.explode(F.sequence(F.col("_s"), F.floor(end / width))))
    both = near.join(parts, [*by, "_b"]).where(F.col("_b") == F.greatest("_p", "_s")).drop("_b", "_p", "_s")
    at = lambda seconds: F.floor((us + int(seconds * 1e6) - F.col("start_us")) / 1e6 * F.col("sample_rate")).cast("int")
    first, stop = F.greatest(at(before_s), F.lit(0)), F.least(at(after_s), F.size("samples"))
    return both.withColumn("first_idx", first).withColumn("samples", F.when(stop > first, F.slice("samples", first + 1, stop - first))).where("samples is not null")


def latest(segments: DataFrame, seconds: float) -> DataFrame:
    """Segments cut to their last seconds."""
    n = F.least(F.floor(seconds * F.col("sample_rate")).cast("int"), F.size("samples"))
    skipped = F.size("samples") - n
    start = F.col("start_us") + F.floor(skipped * 1e6 / F.col("sample_rate")).cast("long")
    return segments.withColumns({"start_us": start, "samples": F.when(n > 0, F.slice("samples", skipped + 1, n)).otherwise(F.slice("samples", 1, 0))})


def trimmed(segments: DataFrame, earliest_us: int) -> DataFrame:
    """Segments without what comes before a time; one that ends before it stays whole."""
    i = F.floor((F.lit(earliest_us) - F.col("start_us")) / 1e6 * F.col("sample_rate")).cast("int")
    cut = (i > 0) & (i < F.size("samples"))
    start = F.when(cut, F.lit(earliest_us)).otherwise(F.col("start_us")).cast("long")
    return segments.withColumns({"start_us": start, "samples": F.when(cut, F.slice("samples", i + 1, F.size("samples") - i)).otherwise(F.col("samples"))})


def spaced(picks: DataFrame, by: tuple[str, ...], gap_s: float = 2.0, min_snr: float = 3.0) -> DataFrame:
    """by..., time_us of picks at least a gap after the last one kept, a week of picks at a time."""
    return minimum_gap(picks.where(F.col("snr") >= min_snr), by, "time_us", int(gap_s * 1e6), 7 * 86_400_000_000)


def played(segments: DataFrame, by: tuple[str, ...] = ("stream_id",), order: tuple[str, ...] = ("start_us",)) -> DataFrame:
    """Segments with k, their place in the order in which a stream is played."""
    return segments.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def coda_duration(df: DataFrame, s: Stream, rate: float, p_idx: Column, noise_s: float = 5.0, factor: float = 1.5) -> DataFrame:
    """by..., duration_s: from P to the first half-second hop whose next second is quieter than the noise."""
    rows = df.withColumn("_p", p_idx)
    noise = F.sqrt(F.avg(F.when((s.i >= F.col("_p") - int(noise_s * rate)) & (s.i < F.col("_p")), s.x * s.x)))
    facts = rows.groupBy(*s.by).agg(noise.alias("_noise"), F.first("_p").alias("_p"))
    rows = loudest_ahead(df, s, max(1, int(rate))).join(facts, list(s.by))
    hop = max(1, int(0.5 * rate))
    quiet = rows.where((s.i >= F.col("_p") + int(rate)) & ((s.i - F.col("_p")) % hop == 0) & (F.col("loud") < factor * F.col("_noise")))
    return quiet.groupBy(*s.by).agg(((F.min(s.i) - F.min("_p")) / rate).alias("duration_s"))


def gap_segments(segments: DataFrame, by: tuple[str, ...] = ("stream_id",), tolerance: float = 0.5) -> DataFrame:
    """segments (start_us, sample_rate, n) with segment_id: a new one where samples are missing or overlap by over tolerance of a sample."""
    w = Window.partitionBy(*by).orderBy("start_us")
    expected = F.col("start_us") + F.round(F.col("n") * 1e6 / F.col("sample_rate")).cast("long")
    rows = segments.withColumn("_next", F.lag(expected).over(w))
    apart = F.abs(F.col("start_us") - F.col("_next")) > tolerance * 1e6 / F.col("sample_rate")
    fresh = F.when(F.col("_next").isNull() | apart, 1).otherwise(0)
    return rows.withColumn("_fresh", fresh).withColumn("segment_id", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_next", "_fresh")


def merged_segments(segments: DataFrame, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """One row for each run without gaps: by..., segment_id, start_us, sample_rate, samples."""
    rows = gap_segments(segments, by)
    ordered = F.array_sort(F.collect_list(F.struct("start_us", "samples")))
    return rows.groupBy(*by, "segment_id").agg(F.min("start_us").alias("start_us"), F.first("sample_rate").alias("sample_rate"), F.flatten(F.transform(ordered, lambda r: r["samples"])).alias("samples"))
