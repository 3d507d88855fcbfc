"""Geodesics on the WGS84 ellipsoid as columns (Vincenty's published series).

Both functions add a chain of plain columns, each used by the next ones, so that every value is
computed once and all of it stays in generated code. Java does not compile methods beyond a size, so
it is cut off from what surrounds it (``END_OF_METHOD``). The number of steps is fixed; pairs that they do
not settle (near the antipode) take a slower branch of their row.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the ellipsoid.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
SEMI_MINOR_M = SEMI_MAJOR_M * (1 - FLATTENING)
SECOND_ECCENTRICITY_2 = (SEMI_MAJOR_M**2 - SEMI_MINOR_M**2) / SEMI_MINOR_M**2
#: Steps of the longitude and of the arc; more would not fit a method that is compiled.
INVERSE_STEPS, DIRECT_STEPS = 4, 4
#: Radians by which the last step may move the longitude: less than a tenth of a millimetre.
SETTLED = 1e-11
BISECTIONS = 60


def _given(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Inputs ``__w_…`` without nulls and NaN, and ``__w_usable``: whether all of them are there."""
    columns = {k: F.nanvl((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(None).cast("double")) for k, c in columns.items()}
    there = functools.reduce(lambda a, b: a & b, [c.isNotNull() for c in columns.values()])
    return df.select("*", *[F.coalesce(c, F.lit(0.0)).alias(f"__w_{k}") for k, c in columns.items()], there.alias("__w_usable"))


def _chain(df: DataFrame, *lines: str) -> DataFrame:
    """Further columns, one for each line ``name = expression`` that may use those of the lines before it.

    In the lines, ``name`` stands for the column ``__w_name``. The analyser makes the chain of
    projections in which every column is computed once.
    """
    found = [line.split(" = ", 1) for line in lines]
    names = {n for n, _ in found} | {c.removeprefix("__w_") for c in df.columns if c.startswith("__w_")}
    marked = lambda text: re.sub(r"\b[a-z][a-z0-9_]*\b(?!\()", lambda m: f"__w_{m[0]}" if m[0] in names else m[0], text)
    return df.selectExpr("*", *[f"{marked(e)} AS __w_{n}" for n, e in found])


def _finish(df: DataFrame, out: str, **fields: Column) -> DataFrame:
    # An expression that is not deterministic keeps filters on the result above the chain; pushed
    # into it, they would write out every column again wherever it is used.
    usable = F.col("__w_usable") & (F.spark_partition_id() >= 0)
    kept = [F.col(f"`{c}`") for c in df.columns if not c.startswith("__w_") and c != out]
    return df.select(*kept, F.struct(*[F.when(usable, v).alias(k) for k, v in fields.items()]).alias(out))


#: Texts of the series, with the numbers of the ellipsoid in place.
REDUCED = f"atan({1 - FLATTENING!r}D * tan(radians({{}})))"
Q = f"(1D - sa * sa) * {SECOND_ECCENTRICITY_2!r}D"
BIG_A = "1D + q / 16384D * (4096D + q * (-768D + q * (320D - 175D * q)))"
BIG_B = "q / 1024D * (256D + q * (-128D + q * (74D - 47D * q)))"
CORRECTION = f"{FLATTENING / 16!r}D * (1D - sa * sa) * (4D + {FLATTENING!r}D * (4D - 3D * (1D - sa * sa)))"
DELTA = "b * ss{i} * (mid{i} + b / 4D * (cs{i} * (2D * mid{i} * mid{i} - 1D) - b / 6D * mid{i} * (4D * ss{i} * ss{i} - 3D) * (4D * mid{i} * mid{i} - 3D)))"
#: A lambda is not part of the code of a stage, so it ends a generated method.
END_OF_METHOD = "get(transform(array({}), v -> v), 0)"


def with_inverse(df: DataFrame, out: str, lon1, lat1, lon2, lat2, *, steps: int = INVERSE_STEPS) -> DataFrame:
    """``df`` with a struct ``out`` of the distance ``s`` in metres and the forward azimuth ``az`` in degrees.

    Both are NULL where a coordinate is missing. The longitude difference on the auxiliary sphere
    is found by ``steps`` fixed-point steps, elsewhere by bisection of the azimuth (:func:`_bisected`).
    """
    lines = ["span = radians(pmod(lon2 - lon1 + 180D, 360D) - 180D)", f"u1 = {REDUCED.format('lat1')}", f"u2 = {REDUCED.format('lat2')}",
             "s1 = sin(u1)", "c1 = cos(u1)", "s2 = sin(u2)", "c2 = cos(u2)",
             # The first guess holds what the flattening does to short lines.
             f"guess = span * (1D + {FLATTENING!r}D * c1 * c2)", f"lam0 = {END_OF_METHOD.format('guess')}"]
    for i in range(steps):
        c, way = f"cor{i}", f"(atan2(ss{i}, cs{i}) + cor{i} * ss{i} * (mid{i} + cor{i} * cs{i} * (2D * mid{i} * mid{i} - 1D)))"
        lines += [
            f"sl{i} = sin(lam{i})", f"cl{i} = cos(lam{i})",
            f"north{i} = c1 * s2 - s1 * c2 * cl{i}", f"cs{i} = s1 * s2 + c1 * c2 * cl{i}", f"ss{i} = sqrt(c2 * sl{i} * c2 * sl{i} + (c1 * s2 - s1 * c2 * cl{i}) * (c1 * s2 - s1 * c2 * cl{i}))",
            f"sa{i} = if(ss{i} > 0D, c1 * c2 * sl{i} / ss{i}, 0D)",
            f"mid{i} = if(1D - sa{i} * sa{i} > 1e-15D, cs{i} - 2D * s1 * s2 / (1D - sa{i} * sa{i}), 0D)", f"{c} = {CORRECTION.replace('sa', f'sa{i}')}",
            f"lam{i + 1} = span + (1D - {c}) * {FLATTENING!r}D * sa{i} * {way}",
        ]
    n = steps - 1
    lines += [f"q = {Q.replace('sa', f'sa{n}')}", f"b = {BIG_B}"]
    lines += [f"near_s = {SEMI_MINOR_M!r}D * ({BIG_A}) * (atan2(ss{n}, cs{n}) - {DELTA.format(i=n)})", f"near_az = degrees(atan2(c2 * sl{n}, north{n}))",
              f"unsettled = usable AND (abs(lam{steps} - lam{n}) > {SETTLED!r}D OR abs(lam{steps}) > pi())"]
    d = _chain(_given(df, lon1=lon1, lat1=lat1, lon2=lon2, lat2=lat2), *lines)
    far = F.expr(f"if(__w_unsettled, {_bisected('__w_span', '__w_u1', '__w_u2')}, NULL)").alias("__w_far")
    kept = [f"`{c}`" for c in d.columns if not c.startswith("__w_") or c in ("__w_usable", "__w_near_s", "__w_near_az")]
    d = d.select(*kept, far)
    return _finish(d, out, **{k: F.when(F.col("__w_far").isNull(), F.col(f"__w_near_{k}")).otherwise(F.col(f"__w_far.{k}")) for k in ("s", "az")})


def _let(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` is a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _reach(alpha: str, body: str) -> str:
    """``body`` of what the geodesic ``a`` of this azimuth from ``p`` has at the other latitude."""
    arcs = "named_struct('s0', sin({0}) * p.c1, 'g1', atan2(p.s1, cos({0}) * p.c1), 'k', sqrt(greatest(0D, p.c2 * p.c2 - p.c1 * p.c1 + cos({0}) * p.c1 * cos({0}) * p.c1)))".format(alpha)
    ends = ("named_struct('sa', e.s0, 'c2', e.k / p.c2, 'sg', atan2(p.s2, e.k) - e.g1, 'mid', cos(atan2(p.s2, e.k) + e.g1), "
            "'turn', atan2(e.s0 * sin(atan2(p.s2, e.k)), cos(atan2(p.s2, e.k))) - atan2(e.s0 * sin(e.g1), cos(e.g1)))")
    return _let(_let(arcs, "e", ends), "a", body)


def _bisected(span: str, u1: str, u2: str) -> str:
    """SQL of a struct (s, az) by bisection of the azimuth, for any pair of points.

    Points are turned so that the start is the southern one of the larger reduced latitude and the
    longitude grows; then the longitude at which a geodesic reaches the other latitude grows with
    its azimuth from 0 to half a turn.
    """
    ends = (f"named_struct('swapped', abs({u1}) < abs({u2}), 'b1', if(abs({u1}) < abs({u2}), {u2}, {u1}), 'b2', if(abs({u1}) < abs({u2}), {u1}, {u2}), "
            f"'wanted', abs({span}), 'east', if({span} < 0, -1D, 1D))")
    turned = "named_struct('swapped', t.swapped, 'wanted', t.wanted, 'east', t.east, 'flip', if(t.b1 > 0, -1D, 1D), 'b1', least(-abs(t.b1), -1e-18D), 'b2', if(t.b1 > 0, -t.b2, t.b2))"
    known = "named_struct('swapped', t.swapped, 'wanted', t.wanted, 'east', t.east, 'flip', t.flip, 's1', sin(t.b1), 'c1', cos(t.b1), 's2', sin(t.b2), 'c2', cos(t.b2))"
    c = CORRECTION.replace("sa", "a.sa")
    longitude = f"a.turn - (1D - {c}) * {FLATTENING!r}D * a.sa * (a.sg + {c} * sin(a.sg) * (a.mid + {c} * cos(a.sg) * (2D * a.mid * a.mid - 1D)))"
    middle = "((h.low + h.high) / 2D)"
    half = _let(f"{_reach(middle, longitude)} < p.wanted", "short", f"named_struct('low', if(short, {middle}, h.low), 'high', if(short, h.high, {middle}))")
    alpha = f"aggregate(sequence(1, {BISECTIONS}), named_struct('low', 0D, 'high', pi()), (h, i) -> {half}, h -> {middle})"
    arc = _let(Q.replace("sa", "a.sa"), "q", _let(BIG_B, "b", f"{SEMI_MINOR_M!r}D * ({BIG_A}) * (a.sg - {DELTA.replace('ss{i}', 'sin(a.sg)').replace('cs{i}', 'cos(a.sg)').replace('mid{i}', 'a.mid')})"))
    # Back to the given points: swapped ends run the other way, mirrored ones north for south.
    sine, cosine = "if(p.swapped, greatest(-1D, least(1D, a.sa / p.c2)), sin(alpha))", "if(p.swapped, -a.c2, cos(alpha))"
    line = _reach("alpha", f"named_struct('s', {arc}, 'az', degrees(atan2({sine} * p.east, {cosine} * p.flip)))")
    return _let(_let(_let(ends, "t", turned), "t", known), "p", _let(alpha, "alpha", line))


def with_direct(df: DataFrame, out: str, lon, lat, az, s, *, steps: int = DIRECT_STEPS) -> DataFrame:
    """``df`` with a struct ``out`` of the end point (``lon``, ``lat``) reached along an azimuth; NULL where an input is missing."""
    lines = [f"u1 = {REDUCED.format('lat')}", "sin1 = sin(radians(az))", "cos1 = cos(radians(az))", "su = sin(u1)", "cu = cos(u1)",
             "m1 = 2D * atan2(tan(u1), cos1)", "sa = cu * sin1", f"q = {Q}", f"b = {BIG_B}", f"base = s / ({SEMI_MINOR_M!r}D * ({BIG_A}))", f"sg0 = {END_OF_METHOD.format('base')}"]
    for i in range(steps + 1):
        lines += [f"ss{i} = sin(sg{i})", f"cs{i} = cos(sg{i})", f"mid{i} = cos(m1 + sg{i})"]
        if i < steps:
            lines.append(f"sg{i + 1} = sg0 + {DELTA.format(i=i)}")
    n = steps
    way = f"(sg{n} + cor * ss{n} * (mid{n} + cor * cs{n} * (2D * mid{n} * mid{n} - 1D)))"
    lines += [
        f"cor = {CORRECTION}", f"back = su * ss{n} - cu * cs{n} * cos1",
        f"end_lat = degrees(atan2(su * cs{n} + cu * ss{n} * cos1, {1 - FLATTENING!r}D * sqrt(sa * sa + back * back)))",
        f"turn = atan2(ss{n} * sin1, cu * cs{n} - su * ss{n} * cos1) - (1D - cor) * {FLATTENING!r}D * sa * {way}",
        "end_lon = pmod(lon + degrees(turn) + 180D, 360D) - 180D",
    ]
    d = _chain(_given(df, lon=lon, lat=lat, az=az, s=s), *lines)
    return _finish(d, out, lon=F.col("__w_end_lon"), lat=F.col("__w_end_lat"))
