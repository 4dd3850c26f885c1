"""Stations and picks of a real event, and models, as fixed values."""

from __future__ import annotations

import pandas as pd

#: net, sta, lat, lon, elevation (m)
STATIONS = [
    ("IU", "INCN", 37.4777, 126.6244, 55.0), ("IC", "BJT", 40.0191, 116.1716, 220.0), ("IC", "MDJ", 44.6176, 129.5934, 290.0), ("IC", "SSE", 31.0946, 121.1886, 20.0),
    ("IU", "MAJO", 36.5457, 138.2041, 405.0), ("IU", "YSS", 46.9587, 142.7604, 150.0), ("II", "ERM", 42.0150, 143.1572, 40.0), ("KS", "BUS2", 35.2486, 129.1125, 89.0),
    ("KS", "SEO2", 37.4939, 126.9171, 85.0), ("IU", "ULN", 47.8651, 107.0532, 1610.0), ("IU", "ADK", 51.8823, -176.6842, 130.0), ("IU", "TATO", 24.9735, 121.4971, 160.0),
    ("JP", "JTU", 34.5275, 129.3963, 70.0), ("JP", "JMM", 37.8690, 140.7897, 100.0), ("JP", "JTM", 40.7895, 141.0647, 130.0),
]
#: station, seconds after the origin, signal to noise
PICKS = [
    ("IC.BJT", 143.4195, 4.5016), ("IC.MDJ", 53.3195, 2.7719), ("IC.SSE", 172.0195, 2.7856), ("II.ERM", 154.1195, 2.5052), ("IU.INCN", 65.9195, 4.1792), ("IU.MAJO", 126.5195, 2.8331), ("IU.TATO", 229.6695, 2.6460),
    ("IU.ULN", 238.9695, 2.7327), ("IU.YSS", 165.4999, 2.7671), ("JP.JMM", 141.3000, 2.5930), ("JP.JTM", 131.8000, 2.6464), ("JP.JTU", 100.7500, 3.0593), ("KS.BUS2", 90.9195, 4.6759), ("KS.SEO2", 64.5695, 7.4744),
]
ORIGIN_US = 1504409401600000


def event_picks() -> pd.DataFrame:
    place = {f"{n}.{s}": (lat, lon) for n, s, lat, lon, _ in STATIONS}
    rows = [(1, *k.split("."), *place[k], ORIGIN_US + int(t * 1e6), "P", 0 if snr >= 5 else 1, i) for i, (k, t, snr) in enumerate(PICKS)]
    return pd.DataFrame(rows, columns=["event_id", "net", "sta", "slat", "slon", "time_us", "phase", "quality", "pick_order"])
