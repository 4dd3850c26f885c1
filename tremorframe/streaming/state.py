"""Stateful operators: pickers and buffers whose frames span packets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRIGGERS = "stream_id string, on_us long, off_us long, peak double"
_STATE = "energy array<double>, seen long, on_us long, peak double"


class Trigger:
    """STA/LTA with hysteresis of one stream, packet by packet.

    It remembers the energies of the last lta samples and whether it is on, so
    the result does not depend on how the samples are cut into packets.
    """

    def __init__(self, sta: int, lta: int, trigger: float, detrigger: float) -> None:
        if detrigger > trigger:
            raise ValueError("detrigger must not be over trigger")
        self.sta, self.lta, self.trigger, self.detrigger = sta, max(lta, sta + 1), trigger, detrigger

    def feed(self, state: tuple, times: np.ndarray, values: np.ndarray) -> tuple[tuple, list[tuple]]:
        held, seen, on_us, peak = state
        e = np.concatenate((np.asarray(held, float), values * values))
        sums = np.concatenate(([0.0], np.cumsum(e)))
        i = np.arange(len(held), len(e))
        number = seen + np.arange(len(values))
        full = number >= self.lta
        short = (sums[i + 1] - sums[np.maximum(i + 1 - self.sta, 0)]) / self.sta
        long = (sums[i + 1] - sums[np.maximum(i + 1 - self.lta, 0)]) / self.lta
        ratio = np.where(full & (long > 1e-10), short / np.maximum(long, 1e-300), 0.0)
        out = []
        for k in np.flatnonzero((ratio >= self.trigger) | (ratio < self.detrigger) | (on_us is not None)) if on_us is None else range(len(ratio)):
            if on_us is None and ratio[k] >= self.trigger:
                on_us, peak = int(times[k]), float(ratio[k])
            elif on_us is not None:
                if ratio[k] < self.detrigger:
                    out.append((on_us, int(times[k]), peak))
                    on_us, peak = None, 0.0
                else:
                    peak = max(peak, float(ratio[k]))
        if on_us is not None:
            after = ratio[times > on_us]
            peak = max(peak, float(after.max())) if len(after) else peak
        return (e[-self.lta :].tolist(), seen + len(values), on_us, peak), out


def stalta_stream(samples: DataFrame, sta: int, lta: int, trigger: float, detrigger: float, idle: str = "10 minutes") -> DataFrame:
    """Triggers of a stream of (stream_id, ts, value); state of a silent stream goes after ``idle``."""
    own = Trigger(sta, lta, trigger, detrigger)
    micros = pd.Timedelta(idle) // pd.Timedelta("1us")

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        now = state.get if state.exists else ([], 0, None, 0.0)
        times = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        now, out = own.feed(now, times, rows["value"].to_numpy(float))
        state.update(now)
        mark = max(int(times.max() + micros) // 1000, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(mark)
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["stream_id", "on_us", "off_us", "peak"])

    return samples.withWatermark("ts", idle).groupBy("stream_id").applyInPandasWithState(run, TRIGGERS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


BUFFER = "stream_id string, start_us long, n long, mean double, latest_us long, latest array<double>"


def ring_buffer(packets: DataFrame, seconds: float = 300.0, idle: str = "10 minutes", latest_s: float = 0.0) -> DataFrame:
    """The last seconds of each stream after every batch: stream_id, start_us, n, mean of what is held, and the samples of the last latest_s seconds.

    The state of a stream without packets goes when the watermark has passed it.
    """
    keep, tail = int(seconds * 1e6), int(latest_s * 1e6)

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        times, values = state.get if state.exists else ([], [])
        times = np.concatenate((np.asarray(times, np.int64), rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()))
        values = np.concatenate((np.asarray(values, float), rows["value"].to_numpy(float)))
        # Packets may come late; the buffer is in the order of time.
        order = np.argsort(times, kind="stable")
        times, values = times[order], values[order]
        held = times > times[-1] - keep
        times, values = times[held], values[held]
        state.update((times.tolist(), values.tolist()))
        state.setTimeoutTimestamp(max(int(times.max()) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        last = times > times[-1] - tail
        yield pd.DataFrame([(key[0], int(times[0]), len(times), float(values.mean()), int(times[last][0]) if last.any() else None, values[last].tolist())], columns=[c.split()[0] for c in BUFFER.split(", ")])

    return packets.withWatermark("ts", idle).groupBy("stream_id").applyInPandasWithState(run, BUFFER, "times array<long>, values array<double>", "update", GroupStateTimeout.EventTimeTimeout)


def spaced_picks(picks: DataFrame, gap_s: float = 2.0, min_snr: float = 3.0, idle: str = "10 minutes") -> DataFrame:
    """Picks (stream_id, ts, snr) that come at least a gap after the last one kept."""
    gap = int(gap_s * 1e6)

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        last, out = (state.get[0] if state.exists else -(1 << 60)), []
        for t, snr in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["snr"], strict=True):
            if snr >= min_snr and t - last >= gap:
                out.append((key[0], int(t), float(snr)))
                last = int(t)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000) + gap // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "time_us", "snr"])

    return picks.withWatermark("ts", idle).groupBy("stream_id").applyInPandasWithState(run, "stream_id string, time_us long, snr double", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def rates(samples: DataFrame, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Counts and means of each stream and window; late rows go."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "stream_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("stream_id", F.col("w.start").alias("start"), "n", "mean")
