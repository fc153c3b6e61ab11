"""Spherical geometry in degrees, metres and kilometres."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would make a null 1


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def smallest_angle_deg(a: Column, b: Column) -> Column:
    """Angle between two directions in [0, 180]."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d)


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    a, t, d = F.radians(lat), F.radians(bearing), metres / EARTH_M
    end = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    east = F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(end))
    return F.degrees(end), F.pmod(lon + F.degrees(east) + 540, F.lit(360.0)) - 180


def circular_mean_deg(angle: Column) -> Column:
    """Aggregate: mean direction in [0, 360)."""
    return direction_deg(F.sum(F.sin(F.radians(angle))), F.sum(F.cos(F.radians(angle))))


def direction_deg(y: Column, x: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def exact_turn(angle: Column) -> Column:
    """Sine and cosine of degrees, as the C library has them.

    The virtual machine's differ from it in the last bit at some angles (183 and 297 degrees), and the mean of directions that cancel, which
    SQL takes by the C library, is made of last bits alone.
    """

    def turn(radians: pa.Array) -> pa.Array:
        each = [(None, None) if x is None or math.isinf(x) else (math.sin(x), math.cos(x)) for x in radians.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in each], pa.float64()) for i in (0, 1)], ["sin", "cos"])

    return F.arrow_udf(turn, "struct<sin: double, cos: double>")(F.radians(angle))


def lerp(value: Column, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high``, clamped; the ends may be in either order; null stays null."""
    x = (value - low) / (high - low)
    return F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x)
