"""Numpy kernels for what column expressions cannot say, and their Arrow forms.

Filters, spectra, analytic signals, autoregression, and spectral fits work on
one segment's samples; ``per_segment`` applies any of them to an array column.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
WA_GAIN, WA_BAND, WA_RATE = 2800.0, (0.5, 10.0), 100.0
AR_ORDER, AR_TRAIN = 6, 1000
SPECTRUM_MIN = 64


def _polynomial(roots: np.ndarray) -> np.ndarray:
    out = np.array([1.0 + 0j])
    for r in roots:
        out = np.convolve(out, [1.0, -r])
    return out


def _analog(order: int, rate: float, low: float | None, high: float | None) -> tuple[np.ndarray, float, complex]:
    """Poles (z-plane), the zero(s) of each pole and a point of gain 1, of the band that low and high say."""
    nyquist = rate / 2
    if (low is None and high is None) or not all(0 < f < nyquist for f in (low, high) if f is not None) or (low and high and low >= high):
        raise ValueError(f"band {low} to {high} Hz at {rate} Hz")
    theta = np.pi * (2 * np.arange(order) + 1) / (2 * order) + np.pi / 2
    proto = np.exp(1j * theta)
    warp = lambda f: math.tan(math.pi * f / rate)
    if low is None:
        poles, zero, at = proto * warp(high), -1.0, 1.0
    elif high is None:
        poles, zero, at = warp(low) / proto, 1.0, -1.0
    else:
        wl, wh = warp(low), warp(high)
        half, centre = proto * (wh - wl) / 2, math.sqrt(wl * wh)
        root = np.sqrt(half * half - centre * centre)
        poles, zero = np.concatenate((half + root, half - root)), 0.0
        at = np.exp(2j * math.atan(centre))
    return (1 + poles) / (1 - poles), zero, at


def sections(order: int, rate: float, low: float | None = None, high: float | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The filter as a chain of sections of two poles (or one), each with gain 1 in the pass band.

    Poles of the whole polynomial lie close together for low bands, where its
    coefficients no longer tell them apart; those of a section do.
    """
    poles, zero, at = _analog(order, rate, low, high)
    real = np.sort(poles.real[np.abs(poles.imag) < 1e-12])
    groups = [np.array([p, p.conjugate()]) for p in poles[poles.imag >= 1e-12]] + [real[i : i + 2] for i in range(0, len(real), 2)]
    out = []
    for own in groups:
        # A band's zeros are one at each end for every two poles.
        b = np.array([1.0, 0.0, -1.0]) if not zero else _polynomial(np.full(len(own), zero)).real
        a = _polynomial(own).real
        out.append((b * np.abs(np.polyval(a, at) / np.polyval(b, at)), a))
    return out


def butterworth(order: int, rate: float, low: float | None = None, high: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """b and a (descending powers of z) of a lowpass (high), highpass (low) or bandpass filter; gain 1 in the pass band."""
    poles, zero, at = _analog(order, rate, low, high)
    zeros = np.full(order, zero) if zero else np.concatenate((np.ones(order), -np.ones(order)))
    b, a = _polynomial(zeros).real, _polynomial(poles).real
    return b * np.abs(np.polyval(a, at) / np.polyval(b, at)), a


#: Samples that a filter advances at once.
FILTER_BLOCK = 128


def _step_by_step(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form II transposed, a sample of all rows at a time: for orders over two, whose powers lose digits."""
    state, out = np.zeros((*x.shape[:-1], len(a))), np.empty_like(x)
    for i in range(x.shape[-1]):
        v = x[..., i]
        y = out[..., i] = b[0] * v + state[..., 0]
        state[..., :-1] = state[..., 1:] + v[..., None] * b[1:] - y[..., None] * a[1:]
    return out


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter from rest, along the last axis; rows are filtered together.

    The recursion of a section is a state space (direct form II transposed),
    taken a block at a time: within a block the output is a product with the
    impulse response and with what the state at its begin rings on to; only
    states go from block to block one by one.
    """
    x = np.asarray(x, float)
    order, n = max(len(a), len(b)) - 1, x.shape[-1]
    b, a = np.pad(b, (0, order + 1 - len(b))) / a[0], np.pad(a, (0, order + 1 - len(a))) / a[0]
    if not order or not n:
        return b[0] * x
    if order > 2:
        return _step_by_step(b, a, x)
    size = min(FILTER_BLOCK, n)
    move = np.eye(order, k=1)
    move[:, 0] -= a[1:]
    enter = b[1:] - a[1:] * b[0]
    # ring[i]: what the state adds to the output i samples on; into[:, j]: what sample j leaves in the state after the block.
    ring, into, row, column = np.empty((size, order)), np.empty((order, size)), np.eye(order)[0], enter
    for i in range(size):
        ring[i], into[:, size - 1 - i] = row, column
        row, column = row @ move, move @ column
    response = np.concatenate(([b[0]], ring[:-1] @ enter))
    lag = np.subtract.outer(np.arange(size), np.arange(size))
    inside = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    leap = np.linalg.matrix_power(move, size)
    blocks = -(-n // size)
    padded = np.zeros((*x.shape[:-1], blocks * size))
    padded[..., :n] = x
    parts = padded.reshape(*x.shape[:-1], blocks, size)
    out, left = parts @ inside.T, parts @ into.T
    state = np.zeros((*x.shape[:-1], order))
    for k in range(blocks):
        out[..., k, :] += state @ ring.T
        state = state @ leap.T + left[..., k, :]
    return out.reshape(padded.shape)[..., :n]


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and back, without padding."""
    return lfilter(b, a, lfilter(b, a, x)[..., ::-1])[..., ::-1]


def bandpass(x: np.ndarray, rate: float, low: float, high: float, order: int = 2) -> np.ndarray:
    chain, x = sections(order, rate, low, min(high, 0.99 * rate / 2)), np.asarray(x, float)
    for _ in range(2):
        for b, a in chain:
            x = lfilter(b, a, x)
        x = x[..., ::-1]
    return x


def filter_bank(x: np.ndarray, rate: float, bands: list[tuple[float, float]], order: int = 2) -> np.ndarray:
    """A row for each band (the first axis)."""
    return np.stack([bandpass(x, rate, lo, hi, order) for lo, hi in bands])


def combined_envelope(banded: np.ndarray) -> np.ndarray:
    return np.sqrt((banded**2).sum(0))


def line_off(x: np.ndarray) -> np.ndarray:
    """Without the least-squares line of each row."""
    i = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
    return x - x.mean(-1, keepdims=True) - i * ((x * i).sum(-1, keepdims=True) / max((i * i).sum(), 1e-300))


def next_pow2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def fft(x: np.ndarray) -> np.ndarray:
    """Padded with zeros to a power of two."""
    return np.fft.fft(x, next_pow2(len(x))) if len(x) else np.zeros(0, complex)


def ifft(x: np.ndarray) -> np.ndarray:
    return np.fft.ifft(x)


def amplitude_spectrum(x: np.ndarray) -> np.ndarray:
    return np.abs(fft(x))[: next_pow2(len(x)) // 2] if len(x) else np.zeros(0)


def power_spectrum(x: np.ndarray) -> np.ndarray:
    return amplitude_spectrum(x) ** 2


def frequencies(n: int, rate: float) -> np.ndarray:
    m = next_pow2(n)
    return np.arange(m // 2) * rate / m


def dominant_frequency(x: np.ndarray, rate: float) -> float:
    p = power_spectrum(np.asarray(x, float))
    return float(frequencies(len(x), rate)[1 + p[1:].argmax()]) if len(p) > 1 else 0.0


def analytic(x: np.ndarray) -> np.ndarray:
    """The complex analytic signal, along the last axis."""
    n, m = x.shape[-1], next_pow2(x.shape[-1])
    s = np.fft.fft(x, m)
    s[..., 1 : m // 2] *= 2
    s[..., m // 2 + 1 :] = 0
    return np.fft.ifft(s)[..., :n]


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(analytic(x))


def phase(x: np.ndarray) -> np.ndarray:
    return np.angle(analytic(x))


def instantaneous_frequency(x: np.ndarray, rate: float) -> np.ndarray:
    d = np.diff(np.unwrap(phase(x))) * rate / (2 * math.pi)
    return np.concatenate((d[:1], d)) if len(d) else np.zeros(len(x))


def carl_sta_trig(x: np.ndarray, sta: int, lta: int) -> np.ndarray:
    """(sta - lta) / lta of the envelope."""
    sums = np.concatenate(([0.0], np.cumsum(envelope(x))))
    i = np.arange(len(x))
    mean = lambda n: (sums[i + 1] - sums[np.maximum(i + 1 - n, 0)]) / n
    short, long = mean(sta), mean(lta)
    return np.where((i >= lta) & (long > 1e-10), (short - long) / np.maximum(long, 1e-10), 0.0)


def burg(x: np.ndarray, order: int = AR_ORDER) -> np.ndarray:
    """Autoregressive coefficients by reflection, without the leading 1."""
    a, f, b = np.ones(1), np.asarray(x, float), np.asarray(x, float)
    for _ in range(order):
        f, b = f[1:], b[:-1]
        power = (f * f + b * b).sum()
        k = -2 * (f * b).sum() / power if power > 0 else 0.0
        a = np.append(a, 0.0) + k * np.append(a, 0.0)[::-1]
        f, b = f + k * b, b + k * f
    return a[1:]


def ar_error(x: np.ndarray, order: int = AR_ORDER) -> np.ndarray:
    """Absolute prediction error; the model comes from the first quarter."""
    x = np.asarray(x, float)
    if len(x) <= order:
        return np.zeros(len(x))
    a = burg(x[: min(len(x) // 4, AR_TRAIN)], order)
    full = np.convolve(x, np.concatenate(([1.0], a)))[: len(x)]
    full[:order] = 0
    return np.abs(full)


def wood_anderson(x: np.ndarray, rate: float = WA_RATE, compat: bool = False) -> np.ndarray:
    """Demean, detrend, band and gain of the instrument; compat: as for 100 Hz at any rate."""
    x = np.asarray(x, float)
    if x.shape[-1] < 2:
        return x * WA_GAIN
    return WA_GAIN * bandpass(line_off(x), WA_RATE if compat else rate, *WA_BAND)


def spectral_fit(x: np.ndarray, rate: float, distance_m: float, f_min: float = 0.5, f_max: float = 20.0, q: float = 200.0, velocity: float = 3500.0) -> tuple[float, float, float]:
    """Plateau, corner frequency and misfit of the attenuation-corrected spectrum to a Brune source; zeros under 64 samples."""
    x = np.asarray(x, float)
    if len(x) < SPECTRUM_MIN:
        return 0.0, 0.0, 1e10
    x, m = x - x.mean(), len(x) // 20
    w = 0.5 * (1 - np.cos(np.pi * np.arange(m) / m))
    x[:m] *= w
    x[len(x) - m :] *= w[::-1]
    f = frequencies(len(x), rate)
    amp = amplitude_spectrum(x) * np.exp(np.pi * f * (distance_m / velocity) / q)
    low = (f >= f_min) & (f <= 2 * f_min)
    omega = float(amp[low].mean()) if low.any() else 0.0
    drop = np.flatnonzero((f > 2 * f_min) & (amp < omega / math.sqrt(2)))
    corner = float(f[drop[0]]) if len(drop) else (f_min + f_max) / 2
    use = (f >= f_min) & (f <= f_max)
    diff = np.log10(amp[use] + 1e-10) - np.log10(omega / (1 + (f[use] / corner) ** 2) + 1e-10)
    return omega, corner, float(np.sqrt((diff**2).mean())) if use.any() else 1e10


def spectral_fits(x: np.ndarray, rate: float, distance_m: np.ndarray, f_min: float = 0.5, f_max: float = 20.0, q: float = 200.0, velocity: float = 3500.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spectral_fit`` of the rows of a matrix, each at its own distance."""
    rows, n = x.shape
    if n < SPECTRUM_MIN:
        return np.zeros(rows), np.zeros(rows), np.full(rows, 1e10)
    x, m = x - x.mean(1, keepdims=True), n // 20
    w = 0.5 * (1 - np.cos(np.pi * np.arange(m) / m))
    x[:, :m] *= w
    x[:, n - m :] *= w[::-1]
    f, half = frequencies(n, rate), next_pow2(n) // 2
    amp = np.abs(np.fft.fft(x, next_pow2(n)))[:, :half] * np.exp(np.pi * f * (distance_m[:, None] / velocity) / q)
    low, high = (f >= f_min) & (f <= 2 * f_min), f > 2 * f_min
    omega = amp[:, low].mean(1) if low.any() else np.zeros(rows)
    drop = high & (amp < omega[:, None] / math.sqrt(2))
    corner = np.where(drop.any(1), f[drop.argmax(1)], (f_min + f_max) / 2)
    use = (f >= f_min) & (f <= f_max)
    if not use.any():
        return omega, corner, np.full(rows, 1e10)
    diff = np.log10(amp[:, use] + 1e-10) - np.log10(omega[:, None] / (1 + (f[use] / corner[:, None]) ** 2) + 1e-10)
    return omega, corner, np.sqrt((diff**2).mean(1))


def ml_backend(x: np.ndarray, rate: float, min_probability: float = 0.5, gap_s: float = 0.5) -> list[tuple[int, str, float]]:
    """The built-in detector: (sample, phase, probability) by kurtosis and envelope, apart by a gap."""
    x = np.asarray(x, float)
    x = x - x.mean() if len(x) else x
    x = x / np.abs(x).max() if len(x) and np.abs(x).max() > 0 else x
    w = max(4, int(0.5 * rate))
    if len(x) <= 2 * w:
        return []
    i = np.arange(w, len(x))
    kurt = np.zeros(len(i))
    # Each frame by itself, a few thousand frames at a time.
    for a in range(0, len(i), 1 << 13):
        own = np.lib.stride_tricks.sliding_window_view(x[a : min(a + (1 << 13), len(i)) + w - 1], w)
        own = own - own.mean(1, keepdims=True)
        var, fourth = (own**2).mean(1), (own**4).mean(1)
        kurt[a : a + len(own)] = np.where(var > 1e-10, fourth / np.maximum(var, 1e-10) ** 2 - 3, 0.0)
    env = np.convolve(np.abs(x), np.ones(10) / 10)[: len(x)][i]
    z = (env - env.mean()) / env.std() if env.std() > 0 else env * 0
    out, last = [], -(1 << 60)
    for k in range(len(i)):
        kind, p = ("P", min(1.0, kurt[k] / 10)) if kurt[k] > 5 else ("S", min(1.0, z[k] / 10) * 0.8) if z[k] > 3 else (None, 0.0)
        if kind and p >= min_probability and i[k] - last >= gap_s * rate:
            out.append((int(i[k]), kind, float(p)))
            last = i[k]
    return out


def per_segment(f: Callable[[np.ndarray], np.ndarray], samples: str | Column, returns: str = "array<double>", rows: bool = False) -> Column:
    """f over each row's samples, in Arrow batches; null rows stay null.

    rows: f takes a matrix, and segments of one length go through it together.
    """

    @F.pandas_udf(returns)
    def run(column: pd.Series) -> pd.Series:
        if not rows:
            return column.map(lambda v: None if v is None else f(np.asarray(v, float)))
        out = pd.Series([None] * len(column), index=column.index, dtype=object)
        there = column.dropna()
        for _, same in there.groupby(there.map(len)):
            for key, y in zip(same.index, f(np.stack([np.asarray(v, float) for v in same])), strict=True):
                out[key] = y
        return out

    return run(samples)
