"""Statistics of clusters through time (CS rows)."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.operators import frames

KEY = "platform_id"
GROUP = ("array_id", "cluster_id")
# Relative isotropy tolerance and factor on the machine epsilon.
ISOTROPY = 1e-10
EPS = sys.float_info.epsilon * 64


def active_counts(grid: DataFrame, group=GROUP) -> DataFrame:
    return grid.groupBy(*group, "time").agg(F.count_if(F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).alias("active"))


def membership(grid: DataFrame, sizes: DataFrame, *, stop_on_loss: bool = True, group=GROUP) -> DataFrame:
    """Admitted interval of each cluster: from the first complete time to before the first loss after it."""
    g = list(group)
    n = active_counts(grid, group).join(sizes, g)
    start = n.where(F.col("active") == F.col("cluster_size")).groupBy(*g).agg(F.min("time").alias("start"))
    j = n.join(start, g).where(F.col("time") >= F.col("start"))
    lost = F.min(F.when(F.col("active") < F.col("cluster_size"), F.col("time")))
    ends = j.groupBy(*g).agg(F.first("start").alias("start"), lost.alias("lost"), F.max("time").alias("last"))
    if not stop_on_loss:
        ends = ends.withColumn("lost", F.lit(None).cast("timestamp"))
    return ends.select(*g, "start", "lost", F.when(F.col("lost").isNull(), F.col("last")).alias("end_if_complete"))


def admit(grid: DataFrame, interval: DataFrame, group=GROUP) -> DataFrame:
    j = grid.join(interval.select(*group, "start", "lost"), list(group))
    inside = (F.col("time") >= F.col("start")) & (F.col("lost").isNull() | (F.col("time") < F.col("lost")))
    return j.where(inside & F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).drop("start", "lost")


def eigen(xx: Column, xy: Column, yy: Column) -> dict[str, Column]:
    """Closed-form eigenvalues and major axis of a symmetric 2×2 matrix."""
    half, diff = (xx + yy) / 2, (xx - yy) / 2
    root = F.hypot(diff, xy)
    return {"major": half + root, "minor": F.greatest(F.lit(0.0), half - root), "angle": F.pmod(F.degrees(F.atan2(xy * 2, xx - yy) / 2), F.lit(180.0))}


def geometry(points: DataFrame, group=GROUP) -> DataFrame:
    """Centroid, population covariance, principal scales, aspect, orientation and gyration radius per time."""
    g = [*group, "time"]
    s = points.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x_m").alias("cx"), F.avg("y_m").alias("cy"),
        F.var_pop("x_m").alias("xx"), F.covar_pop("x_m", "y_m").alias("xy"), F.var_pop("y_m").alias("yy"))
    many = F.col("n") >= 2
    s = s.withColumns({c: F.when(many, F.col(c)) for c in ("xx", "xy", "yy")})
    e = eigen(F.col("xx"), F.col("xy"), F.col("yy"))
    s = s.withColumns({"lambda_major": e["major"], "lambda_minor": F.when(many, e["minor"]), "__angle": e["angle"]})
    tol = EPS * F.greatest(F.lit(1.0), F.abs("xx"), F.abs("xy"), F.abs("yy"))
    ratio = F.when(F.col("lambda_major") > tol, F.least(F.lit(1.0), F.col("lambda_minor") / F.col("lambda_major")))
    clear = (F.col("lambda_major") > tol) & (F.col("lambda_major") - F.col("lambda_minor") > F.greatest(tol, ISOTROPY * F.col("lambda_major")))
    return s.withColumns({
        "major_m": F.sqrt("lambda_major"), "minor_m": F.sqrt("lambda_minor"), "aspect": F.sqrt(ratio),
        "orientation_deg": F.when(clear, F.col("__angle")), "gyration_m": F.sqrt(F.col("xx") + F.col("yy")),
    }).drop("__angle")


def centroid_displacement(shape: DataFrame, group=GROUP) -> DataFrame:
    first = shape.groupBy(*group).agg(F.min_by(F.struct("cx", "cy"), "time").alias("__f"))
    return shape.join(first, list(group)).withColumn(
        "centroid_displacement_m", F.hypot(F.col("cx") - F.col("__f.cx"), F.col("cy") - F.col("__f.cy"))).drop("__f")


#: Directions of the extreme points that bound the inside of a cluster, in turn.
COMPASS = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))
HULL_ROWS = 4096


def _ring(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in turn (fewer than three where the points lie on a line)."""
    pts = sorted(set(zip(x.tolist(), y.tolist())))

    def side(seq):
        out = []
        for q in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(side(pts) + side(pts[::-1]) if len(pts) > 2 else pts).reshape(-1, 2)


def outer_points(points: DataFrame, g: list[str]) -> DataFrame:
    """Points that can be corners of the hull of their group, with its number of points ``n``.

    The extreme points in eight directions span a polygon inside the hull; what lies strictly inside of
    it is dropped. They are aggregates, so a large group is reduced before it is shuffled.
    """
    p = F.struct(F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    ends = points.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), *[F.max_by(p, F.struct(F.lit(i) * F.col("x_m") + F.lit(j) * F.col("y_m"), p)).alias(f"__e{k}") for k, (i, j) in enumerate(COMPASS)])
    j = points.join(ends, g)
    inside = F.lit(True)
    for k in range(len(COMPASS)):
        a, b = F.col(f"__e{k}"), F.col(f"__e{(k + 1) % len(COMPASS)}")
        turn = (b["x"] - a["x"]) * (F.col("y_m") - a["y"]) - (b["y"] - a["y"]) * (F.col("x_m") - a["x"])
        inside &= (a == b) | (turn > 0)
    flat = F.size(F.array_distinct(F.array(*[F.col(f"__e{k}") for k in range(len(COMPASS))]))) < 3
    return j.where(flat | ~inside).drop(*[f"__e{k}" for k in range(len(COMPASS))])


def hull_area(points: DataFrame, group=GROUP, rows: int = HULL_ROWS) -> DataFrame:
    """Area of the convex hull per (cluster, time) and its ratio to the cluster's first finite hull.

    Inner points go first (:func:`outer_points`). A cluster that still has more than ``rows`` points at one time is
    cut into shares by hash; the hull of the corners of their hulls is its hull, so no task holds it whole.
    """
    g = [*group, "time"]
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    types = ", ".join(f"{c} {kinds[c]}" for c in g)
    outer = frames.cut(outer_points(points.select(*g, "x_m", "y_m").where("x_m IS NOT NULL AND y_m IS NOT NULL"), g))
    left = outer.groupBy(*g).agg(F.count(F.lit(1)).alias("__left"))
    outer = outer.join(left, g)
    crowded = outer.where(F.col("__left") > rows).withColumn("__share", F.pmod(F.xxhash64("x_m", "y_m"), F.ceil(F.col("__left") / rows)))

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = _ring(pdf["x_m"].to_numpy(), pdf["y_m"].to_numpy())
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in (*g, "n")}, "x_m": ring[:, 0], "y_m": ring[:, 1]})

    some = crowded.groupBy(*g, "__share").applyInPandas(corners, f"{types}, n long, x_m double, y_m double")
    whole = outer.where(F.col("__left") <= rows).select(*g, "n", "x_m", "y_m").unionByName(some.select(*g, "n", "x_m", "y_m"))

    def area_of(part: pd.DataFrame) -> dict:
        ring = _ring(part["x_m"].to_numpy(), part["y_m"].to_numpy())
        x, y = (ring - ring[0]).T
        area = abs(float(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1)))) / 2 if len(ring) > 2 else 0.0
        return {"n": part["n"].to_numpy()[:1], "hull_m2": [area if area > 0 else np.nan]}

    # Most clusters have a few points at a time: many of them share a call.
    areas = frames.cut(frames.in_lots(whole, g, ["x_m", "y_m"], area_of, f"{types}, n long, hull_m2 double"))
    first = areas.where("hull_m2 IS NOT NULL").groupBy(*group).agg(F.min_by("hull_m2", "time").alias("__f"))
    return areas.join(first, list(group), "left").withColumn("hull_ratio", F.col("hull_m2") / F.col("__f")).drop("__f")


def _percents(name: str, values, ps) -> list[Column]:
    return [F.avg(values).alias(f"{name}_mean")] + [F.percentile(values, F.lit(p / 100)).alias(f"{name}_p{p}") for p in ps]


def absolute_displacement(points: DataFrame, ps=(10, 50, 90), group=GROUP) -> DataFrame:
    """Distance of every member from its first admitted point, summarised per time."""
    first = points.groupBy(*group, KEY).agg(F.min_by(F.struct("x_m", "y_m"), "time").alias("__f"))
    d = points.join(first, [*group, KEY]).withColumn("d", F.hypot(F.col("x_m") - F.col("__f.x_m"), F.col("y_m") - F.col("__f.y_m")))
    return d.groupBy(*group, "time").agg(*_percents("displacement", F.col("d"), ps))


def speeds(points: DataFrame, ps=(10, 50, 90), group=GROUP) -> DataFrame:
    """Speed and speed relative to the mean velocity of the members, summarised per time."""
    v = points.where("u IS NOT NULL AND v IS NOT NULL")
    mean = v.groupBy(*group, "time").agg(F.avg("u").alias("__u"), F.avg("v").alias("__v"))
    j = v.join(mean, [*group, "time"]).withColumns({"s": F.hypot("u", "v"), "i": F.hypot(F.col("u") - F.col("__u"), F.col("v") - F.col("__v"))})
    return j.groupBy(*group, "time").agg(*_percents("speed", F.col("s"), ps), *_percents("internal_speed", F.col("i"), ps))


def pair_dispersion(points: DataFrame, ps=(10, 50, 90), group=GROUP, spread: int = 1) -> DataFrame:
    """Pair separation and squared change of the separation vector since the pair's first common time."""
    g = list(group)
    p = frames.salted_pairs(points.select(*g, "time", KEY, "x_m", "y_m"), [*g, "time"], KEY, spread=spread)
    p = p.select(*g, f"{KEY}_1", f"{KEY}_2", "time", (F.col("x_m_2") - F.col("x_m_1")).alias("dx"), (F.col("y_m_2") - F.col("y_m_1")).alias("dy"))
    first = p.groupBy(*g, f"{KEY}_1", f"{KEY}_2").agg(F.min_by(F.struct("dx", "dy"), "time").alias("__f"))
    j = p.join(first, [*g, f"{KEY}_1", f"{KEY}_2"])
    ex, ey = F.col("dx") - F.col("__f.dx"), F.col("dy") - F.col("__f.dy")
    j = j.withColumns({"sep": F.hypot("dx", "dy"), "d2": ex * ex + ey * ey})
    return j.groupBy(*g, "time").agg(F.count(F.lit(1)).alias("pairs"), *_percents("separation", F.col("sep"), ps), F.avg("d2").alias("dispersion_m2"))


def summarize(series: DataFrame, metrics: list[str], ps=(10, 50, 90), group=GROUP) -> DataFrame:
    """Mean and percentiles over time of every metric, one row per cluster and metric."""
    q = frames.quantiles(series, list(group), {m: F.col(m) for m in metrics}, {f"p{p}": p / 100 for p in ps})
    mean = series.groupBy(*group).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics])
    j = mean.join(q, list(group), "left")
    pack = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_n").alias("n"), F.col(f"{m}_mean").alias("mean"), *[F.col(f"{m}_p{p}").alias(f"p{p}") for p in ps]) for m in metrics])
    return j.select(*group, F.explode(pack).alias("s")).select(*group, "s.*")
