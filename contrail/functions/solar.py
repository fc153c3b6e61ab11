"""Solar altitude by the usual low-precision almanac series, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def solar_altitude_deg(ts: Column, lat: Column, lon: Column) -> Column:
    """ts: epoch seconds (UTC)."""
    t = (ts / 86400.0 + 2440587.5 - 2451545.0) / 36525.0
    mean_lon = F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0))
    anomaly = F.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    eccentricity = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = F.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * t) + F.sin(3 * anomaly) * 0.000289
    node = F.radians(125.04 - 1934.136 * t)
    apparent = F.radians(mean_lon + centre - 0.00569 - 0.00478 * F.sin(node))
    mean_tilt = 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60
    tilt = F.radians(mean_tilt + 0.00256 * F.cos(node))
    declination = F.asin(F.sin(tilt) * F.sin(apparent))
    y, l0 = F.pow(F.tan(tilt / 2), 2), F.radians(mean_lon)
    equation = 4 * F.degrees(
        y * F.sin(2 * l0) - 2 * eccentricity * F.sin(anomaly) + 4 * eccentricity * y * F.sin(anomaly) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * eccentricity * eccentricity * F.sin(2 * anomaly)
    )
    minutes = F.pmod(F.pmod(ts, F.lit(86400.0)) / 60 + equation + 4 * lon, F.lit(1440.0))
    hour = F.radians(minutes / 4 - 180)
    phi = F.radians(lat)
    up = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour)
    return 90 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))))


def is_night(ts: Column, lat: Column, lon: Column, below_deg: float = -6) -> Column:
    """Whether the sun is below ``below_deg``, on a grid of 0.1 degrees and five minutes, half rounded to even."""
    q = lambda x: F.rint(x / 0.1) * 0.1
    return solar_altitude_deg(F.floor(ts / 300) * 300.0, q(lat), q(lon)) < below_deg
