"""Column expressions for positions on the sphere. Missing values are NULL."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: mean Earth radius in metres.
EARTH_RADIUS_M = 6371008.8


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(t) -> Column:
    return F.unix_micros(col(t))


def seconds_between(earlier, later) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def missing(c, sentinel: float | None = None) -> Column:
    """NaN (and an optional sentinel) become NULL."""
    out = F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
    return out if sentinel is None else F.nullif(out, F.lit(float(sentinel)))


def position_valid(lon, lat) -> Column:
    lon, lat = missing(lon), missing(lat)
    inside = (F.abs(lon) <= 180) & (F.abs(lat) <= 90)
    return F.coalesce(inside, F.lit(False))


def analysis_valid(position_ok, drogue_ok, time) -> Column:
    return col(position_ok) & col(drogue_ok) & col(time).isNotNull()


def haversine(lon1, lat1, lon2, lat2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(col(lon2) - col(lon1)) / 2)
    h = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    h = F.when(h < 0, 0.0).when(h > 1, 1.0).otherwise(h)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def wrap_longitude(lon) -> Column:
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial great-circle bearing in radians, clockwise from north."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    d = F.radians(wrap_longitude(col(lon2) - col(lon1)))
    return F.atan2(
        F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    )


def speed_over(distance, dt) -> Column:
    return F.when(col(dt) > 0, col(distance) / col(dt))


def velocity_between(lon1, lat1, lon2, lat2, dt) -> tuple[Column, Column]:
    """East and north components of the haversine speed of one edge."""
    v = speed_over(haversine(lon1, lat1, lon2, lat2), dt)
    b = bearing(lon1, lat1, lon2, lat2)
    return v * F.sin(b), v * F.cos(b)


def unit(lon, lat) -> list[Column]:
    a, b = F.radians(col(lon)), F.radians(col(lat))
    return [F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)]


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"]))
def unit_vector(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    """Unit vector of a fix with the C library's sine and cosine; NULL without a finite position.

    Arcs of some metres hang on the last bit of these: the JVM's functions round a few of them the other way,
    and the arc cosine of a dot product next to one then moves by a whole angle or by the rounding of its metres.
    """
    out = []
    for a, b in zip(lon, lat):
        if math.isfinite(a) and math.isfinite(b):
            a, b = math.radians(a), math.radians(b)
            out.append((math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)))
        else:
            out.append((None, None, None))
    return pd.DataFrame(out, columns=["x", "y", "z"], dtype="float64")


def axes(v) -> list[Column]:
    """The components of a :func:`unit_vector`."""
    return [F.nanvl(F.col(f"{v}.{c}"), F.lit(None).cast("double")) for c in "xyz"]


def dot(p, q) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, float(low)).when(c > high, float(high)).otherwise(c)


def interpolation_residual(a, b, c, fraction) -> Column:
    """Metres between B and the point at ``fraction`` of the chord A-C put back on the sphere.

    ``a``, ``b``, ``c`` are (lon, lat) pairs or the three components of unit vectors; the arc is acos of the dot product.
    """
    f = col(fraction)
    ua, ub, uc = (unit(*p) if len(p) == 2 else p for p in (a, b, c))
    mix = [(F.lit(1.0) - f) * p + f * q for p, q in zip(ua, uc)]
    norm = F.sqrt(dot(mix, mix))
    cosine = F.when(norm > 1e-12, dot(ub, mix) / norm)
    return F.lit(EARTH_RADIUS_M) * F.acos(clamp(cosine, -1, 1))


def turning_angle(a, b, c) -> Column:
    """Degrees between the tangents into and out of B: 0 straight on, 180 reversal; arguments as above."""
    ua, ub, uc = (unit(*p) if len(p) == 2 else p for p in (a, b, c))
    ab, bc = dot(ub, ua), dot(ub, uc)
    come = [p * ab - q for p, q in zip(ub, ua)]
    leave = [q - p * bc for p, q in zip(ub, uc)]
    size = F.sqrt(dot(come, come)) * F.sqrt(dot(leave, leave))
    # Below this both edges are what rounding leaves of no movement (1e-16 each).
    return F.when(size > 1e-24, F.degrees(F.acos(clamp(dot(come, leave) / size, -1, 1))))


def circular_mean_longitude(lon1, lon2) -> Column:
    a, b = F.radians(col(lon1)), F.radians(col(lon2))
    s, c = F.sin(a) + F.sin(b), F.cos(a) + F.cos(b)
    return F.when(F.sqrt(s * s + c * c) > 1e-12, F.degrees(F.atan2(s, c)))


def spherical_mean(lon="lon", lat="lat") -> tuple[Column, Column]:
    """Aggregate expressions of the mean direction; NULL when the mean vector vanishes."""
    x, y, z = (F.avg(c) for c in unit(lon, lat))
    ok = F.sqrt(x * x + y * y + z * z) > 1e-12
    return (
        F.when(ok, F.degrees(F.atan2(y, x))),
        F.when(ok, F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))),
    )
