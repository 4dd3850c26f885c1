from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremorframe.functions import kernels as K


def tone(hz, rate=100.0, n=1024):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


def test_fft_round_trip_and_peaks():
    x = np.random.default_rng(1).normal(size=200)
    assert np.allclose(K.ifft(K.fft(x)).real[:200], x, atol=1e-10)
    assert K.dominant_frequency(tone(5), 100) == pytest.approx(5, abs=0.5)
    assert K.frequencies(1000, 100)[K.power_spectrum(tone(10)).argmax()] == pytest.approx(10, abs=1)
    assert K.next_pow2(1) == 1 and K.next_pow2(5) == 8


@pytest.mark.parametrize("low,high,passed,stopped", [(1.0, 5.0, 2.5, 20.0), (None, 5.0, 1.0, 25.0), (5.0, None, 20.0, 0.5)])
def test_filters_pass_and_stop(low, high, passed, stopped):
    b, a = K.butterworth(4, 100.0, low, high)
    assert np.abs(np.roots(a)).max() < 1
    gain = lambda f: np.abs(np.polyval(b, z := np.exp(2j * np.pi * f / 100)) / np.polyval(a, z))
    assert gain(passed) == pytest.approx(1, abs=0.05) and gain(stopped) < 0.05
    y = K.filtfilt(b, a, tone(passed))
    assert np.abs(y[300:700]).max() == pytest.approx(1, abs=0.1)


def test_filter_refuses_bad_bands():
    with pytest.raises(ValueError):
        K.butterworth(2, 10.0, 1.0, 6.0)


def test_envelope_and_frequency():
    x = tone(6.25)
    assert K.envelope(x)[100:900].mean() == pytest.approx(1, abs=0.2)
    assert np.median(K.instantaneous_frequency(x, 100)) == pytest.approx(6.25, abs=0.1)


def test_autoregression_sees_a_change():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(0, 0.1, 500), rng.normal(0, 2, 200)))
    e = K.ar_error(x)
    assert e[500:].mean() > 5 * e[100:500].mean()
    assert len(K.burg(x)) == 6 and (K.ar_error(x[:4]) == 0).all()


def test_spectral_fit_of_a_brune_pulse():
    assert K.spectral_fit(np.ones(10), 100, 1e4) == (0.0, 0.0, 1e10)
    t = np.arange(512) / 100
    x = t * np.exp(-2 * np.pi * 3 * t)
    omega, corner, misfit = K.spectral_fit(x, 100, 1.0)
    assert omega > 0 and 0.5 < corner < 10 and misfit < 1.5


def test_ml_backend_finds_an_onset():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.05, 2000)
    x[1200:1260] += tone(8, n=60) * 5
    found = K.ml_backend(x, 100, 0.3)
    assert any(abs(i - 1200) < 80 for i, _, _ in found)
    assert all(b[0] - a[0] >= 50 for a, b in zip(found, found[1:], strict=False))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=80))
def test_filter_is_linear(values):
    b, a = K.butterworth(2, 100.0, 1.0, 10.0)
    x = np.array(values)
    assert np.allclose(K.lfilter(b, a, 2 * x), 2 * K.lfilter(b, a, x), atol=1e-6)


def plain_filter(b, a, x):
    out = []
    for i in range(len(x)):
        out.append(sum(b[k] * x[i - k] for k in range(len(b)) if k <= i) - sum(a[k] * out[i - k] for k in range(1, len(a)) if k <= i))
    return np.array(out)


@pytest.mark.parametrize("low,high,order", [(1.0, 5.0, 2), (None, 5.0, 3), (5.0, None, 1), (0.04, 0.07, 3), (0.5, 10.0, 5)])
def test_filters_are_the_plain_recursion(low, high, order):
    """Blocks, rows together, sections and the whole polynomial give what the difference equation gives."""
    x = np.random.default_rng(7).normal(size=(3, 700))
    chain, y = K.sections(order, 100.0, low, high), x
    for b, a in chain:
        want = np.stack([plain_filter(b, a, v) for v in y])
        got = K.lfilter(b, a, y)
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
        assert np.allclose(K.lfilter(b, a, y[1]), got[1], atol=1e-9 * np.abs(want).max())
        y = got
    b, a = K.butterworth(order, 100.0, low, high)
    whole = np.array([1.0])
    for _, own in chain:
        whole = np.convolve(whole, own)
    assert np.allclose(whole, a, atol=1e-9)
    assert all(np.abs(np.roots(own)).max() < 1 for _, own in chain)
    if (low or 1) >= 0.5:
        # Of lower bands the whole polynomial's own roots leave the unit circle by rounding.
        assert np.abs(np.roots(a)).max() < 1
        assert np.allclose(K.lfilter(b, a, x), y, atol=1e-6 * np.abs(y).max())


def test_filters_of_short_segments():
    b, a = K.sections(2, 20.0, 1.0, 5.0)[0]
    for n in (0, 1, 2, 127, 128, 129):
        x = np.arange(float(n))
        assert np.allclose(K.lfilter(b, a, x), plain_filter(b, a, x) if n else x)
