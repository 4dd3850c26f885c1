"""Magnitude formulas and spectra as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

#: Coefficients of the scales.
ML_A, ML_B, ML_C = 1.0, 0.00301, 3.0
DENSITY, VELOCITY, RADIATION, FREE_SURFACE = 2700.0, 3500.0, 0.6, 2.0
#: Up to this distance (degrees): constant and slope of the body-wave attenuation.
MB_Q = ((20.0, 5.9, 0.05), (100.0, 6.9, 0.0015), (None, 7.0, 0.0))


def ml(amplitude_nm, distance_km, a: float = ML_A, b: float = ML_B, c: float = ML_C, correction=0.0) -> Column:
    """log10 of the amplitude (mm) and a distance correction; null where a logarithm has no value."""
    amp, d = col(amplitude_nm), col(distance_km)
    value = F.log10(amp * 1e-6) + a * F.log10(d / 100.0) + b * (d - 100.0) + c + col(correction)
    return F.when((amp > 0) & (d > 0), value)


def md(seconds, distance_km) -> Column:
    return F.when(col(seconds) > 0, -1.0 + 2.0 * F.log10(col(seconds)) + 0.0035 * col(distance_km))


def moment(omega0, distance_km, density: float = DENSITY, velocity: float = VELOCITY) -> Column:
    """Seismic moment in N m of a spectral plateau in m s."""
    return 4.0 * math.pi * density * velocity**3 * (col(distance_km) * 1000.0) * col(omega0) / (FREE_SURFACE * RADIATION)


def mw(moment_nm) -> Column:
    return F.when(col(moment_nm) > 0, 2.0 / 3.0 * F.log10(col(moment_nm) * 1e7) - 10.7)


def mb_attenuation(distance_deg, depth_km) -> Column:
    d, out = col(distance_deg), None
    for most, constant, slope in MB_Q[:-1]:
        value = constant + slope * d
        out = F.when(d < most, value) if out is None else out.when(d < most, value)
    return out.otherwise(MB_Q[-1][1]) - 0.005 * (col(depth_km) - 33.0)


def mb(amplitude_nm, distance_deg, depth_km, period: float = 1.0) -> Column:
    return F.when(col(amplitude_nm) > 0, F.log10(col(amplitude_nm) / 1000.0 / period) + mb_attenuation(distance_deg, depth_km))


def ms(amplitude_nm, distance_deg) -> Column:
    return F.when((col(amplitude_nm) > 0) & (col(distance_deg) > 0), F.log10(col(amplitude_nm) / 1000.0 / 20.0) + 1.66 * F.log10(col(distance_deg)) + 3.3)


def brune(omega0, corner_hz, f) -> Column:
    return col(omega0) / (1.0 + F.pow(col(f) / col(corner_hz), 2))


def attenuation(f, seconds, q) -> Column:
    return F.exp(math.pi * col(f) * col(seconds) / col(q))


def expected_pn(distance_km, crust: float = 6.0, mantle: float = 8.0, moho_km: float = 33.0) -> Column:
    """P time at a surface station: straight below 150 km, else two crustal legs and the Moho."""
    d, critical = col(distance_km), math.asin(crust / mantle)
    along = d - 2 * moho_km * math.tan(critical)
    refracted = 2 * moho_km / (crust * math.cos(critical)) + along / mantle
    return F.when(d < 150, d / crust).when(along > 0, refracted).otherwise(d / 6.5)
