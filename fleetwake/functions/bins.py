"""Bin edges and bin numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetwake.functions.geo import col


def geometric_edges(low: float, high: float, ratio: float, anchor: float) -> list[float]:
    """anchor·ratio^k inside [low, high]; the anchor itself is exact."""
    if not (0 < low <= anchor <= high and ratio > 1):
        raise ValueError("need 0 < low <= anchor <= high and ratio > 1")
    down = math.floor(math.log(anchor / low, ratio) + 1e-12)
    up = math.floor(math.log(high / anchor, ratio) + 1e-12)
    edges = [anchor if k == 0 else anchor * ratio**k for k in range(-down, up + 1)]
    # An end that meets the configured bound takes its exact value.
    for i, bound in ((0, low), (-1, high)):
        if math.isclose(edges[i], bound, rel_tol=1e-12):
            edges[i] = float(bound)
    if len(edges) < 2:
        raise ValueError("the range holds fewer than two edges")
    return edges


def linear_edges(low: float, high: float, width: float) -> list[float]:
    n = round((high - low) / width)
    if n < 1 or abs(low + n * width - high) > 1e-9 * max(1.0, abs(high)):
        raise ValueError("the range must be a whole number of widths")
    return [low + i * width for i in range(n)] + [float(high)]


def symmetric_log_edges(largest: float, linear: float, per_decade: int) -> list[float]:
    """Mirrored logarithmic edges around one central linear bin."""
    if not 0 < linear < largest or per_decade < 1:
        raise ValueError("need 0 < linear < largest and per_decade >= 1")
    n = max(1, math.ceil(math.log10(largest / linear) * per_decade))
    up = [linear * (largest / linear) ** (i / n) for i in range(n)] + [float(largest)]
    return [-e for e in reversed(up)] + up


def bin_index(value, edges: list[float]) -> Column:
    """Left-closed bins, the last edge closed: -1 below, -2 missing, len(edges)-1 above."""
    v = col(value)
    at = sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(-1))
    last = len(edges) - 2
    return F.when(v.isNull() | F.isnan(v), -2).when(v == edges[-1], last).otherwise(at).cast("int")


def bin_table(spark, edges: list[float], centers: list[float] | None = None):
    """The bins as a table of a few dozen rows."""
    mids = centers or [(a + b) / 2 for a, b in zip(edges, edges[1:])]
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(edges, edges[1:], mids))]
    return spark.createDataFrame(rows, "bin int, lower double, upper double, center double")
