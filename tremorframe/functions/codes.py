"""Codes of phases, magnitudes, qualities and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

#: Fixed values.
PHASES = ("P", "S", "Pn", "Sn", "Pg", "Sg", "Lg")
P_PHASES = ("P", "Pn", "Pg")
MAGNITUDE_TYPES = ("ML", "Mw", "Mb", "Ms", "Md")
MAGNITUDE_ORDER = ("Mw", "ML", "Mb", "Ms", "Md")
SNR_CLASSES = {"service": ((10.0, 0), (5.0, 1)), "simulator": ((8.0, 0),), "case_study": ((15.0, 0), (6.0, 1))}
SNR_WORST = {"service": 2, "simulator": 1, "case_study": 2}


def phase(x) -> Column:
    """The phase's name, or "?" for one that is not known."""
    return F.when(col(x).isin(*PHASES), col(x)).otherwise("?")


def magnitude_type(x) -> Column:
    return F.when(col(x).isin(*MAGNITUDE_TYPES), col(x)).otherwise("M?")


def phase_class(x) -> Column:
    """Which travel times a phase uses: P for P, Pn and Pg, else S."""
    return F.when(col(x).isin(*P_PHASES), "P").otherwise("S")


def is_p(x) -> Column:
    return col(x).isin(*P_PHASES)


def snr_quality(snr, rule: str = "service") -> Column:
    """0 impulsive ... by the thresholds of a rule; the simulator's are strict."""
    out = None
    for least, q in SNR_CLASSES[rule]:
        hit = col(snr) > least if rule == "simulator" else col(snr) >= least
        out = F.when(hit, q) if out is None else out.when(hit, q)
    return out.otherwise(SNR_WORST[rule])


def location_weight(quality) -> Column:
    """(1 - q/4)^2 for the classes 0 to 4."""
    return F.pow(1.0 - F.least(F.greatest(col(quality), F.lit(0)), F.lit(4)) / 4.0, F.lit(2.0))


def css_quality(quality) -> Column:
    return F.when(col(quality) == 0, "i").when(col(quality) == 1, "e").otherwise("?")


def origin_quality(gap, phases, rms) -> Column:
    gap, n, rms = col(gap), col(phases), col(rms)
    return F.when((gap < 90) & (n >= 8) & (rms < 0.5), "A").when((gap < 135) & (n >= 6) & (rms < 1.0), "B").when((gap < 180) & (n >= 4) & (rms < 2.0), "C").when((gap < 270) & (n >= 3), "D").otherwise("E")


def magnitude_rank(kind) -> Column:
    """0 is preferred most."""
    out = None
    for i, m in enumerate(MAGNITUDE_ORDER):
        out = F.when(col(kind) == m, i) if out is None else out.when(col(kind) == m, i)
    return out.otherwise(len(MAGNITUDE_ORDER))


def stream_id(net, sta, loc, chan, sep: str = ".") -> Column:
    return F.concat_ws(sep, *(F.coalesce(col(x), F.lit("")) for x in (net, sta, loc, chan)))


def selector_matches(selector: str, name) -> Column:
    """? stands for one character, * for any number."""
    out = "".join("." if c == "?" else ".*" if c == "*" else "\\" + c if not c.isalnum() else c for c in selector)
    return col(name).rlike(f"^{out}$")


def is_vertical(channel) -> Column:
    return (col(channel) == "BHZ") | col(channel).endswith("Z")


def dip_is_vertical(dip) -> Column:
    return (col(dip) < -60) | (col(dip) > 60)


def dip_is_horizontal(dip) -> Column:
    return F.abs(col(dip)) < 30


def magnitude_class(m) -> Column:
    """Names of magnitude ranges for display."""
    return F.when(col(m) >= 7, "major").when(col(m) >= 6, "strong").when(col(m) >= 5, "moderate").when(col(m) >= 4, "light").when(col(m) >= 3, "minor").otherwise("micro")
