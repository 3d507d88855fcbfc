"""Velocities on regular grids and what they support (KN rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.functions import geo, wgs84
from fleetwake.operators import frames

KEY = "platform_id"


def stored_velocity_in_plane(grid: DataFrame, max_gap_min: float, speed_mask: float | None = None, key=KEY) -> DataFrame:
    """Stored forward velocities turned into the array plane by a one-second geodesic step.

    ``grid``: lon, lat, x_m, y_m, u_east, v_north, dt_s, source_gap_min, lon0, lat0.
    """
    g = frames.scan(grid, key, "time", lead={"__gap": F.col("source_gap_min")})
    yes = lambda c: F.coalesce(c, F.lit(False))
    have = F.col("u_east").isNotNull() & F.col("v_north").isNotNull()
    base = have & F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("x_m").isNotNull() & F.col("y_m").isNotNull() & yes(F.col("dt_s") > 0)
    held = base & yes(F.col("source_gap_min") <= max_gap_min) & yes(F.col("__gap") <= max_gap_min)
    g = g.withColumns({"__speed": F.hypot("u_east", "v_north"), "__held": held, "__have": have})
    fast = F.lit(False) if speed_mask is None else yes(F.col("__speed") > speed_mask)
    g = g.withColumn("__ok", F.col("__held") & ~fast)
    az = F.degrees(F.atan2("u_east", "v_north"))
    only = lambda c: F.when(F.col("__ok"), c)
    g = wgs84.with_direct(g, "__d", only(F.col("lon")), only(F.col("lat")), only(az), only(F.col("__speed")))
    g = wgs84.with_inverse(g, "__q", only(F.col("lon0")), only(F.col("lat0")), "__d.lon", "__d.lat")
    a = F.radians("__q.az")
    g = g.withColumns({"u": F.col("__q.s") * F.sin(a) - F.col("x_m"), "v": F.col("__q.s") * F.cos(a) - F.col("y_m")})
    reason = (
        F.when(F.col("__held") & ~F.col("__ok"), "speed_mask_exceeded").when(F.col("__ok") & F.col("u").isNull(), "nonfinite_velocity")
        .when(F.col("__ok"), "valid").when(F.col("__have"), "missing_forward_endpoint_support").otherwise("missing_stored_forward_velocity")
    )
    return g.withColumn("reason", reason).withColumn("valid", F.col("reason") == "valid").drop("__gap", "__speed", "__held", "__have", "__ok", "__d", "__q")


def centred_velocity(grid: DataFrame, *, cadence_s: float, span_s: float, max_gap_min: float, speed_mask: float | None = None,
                     full_support: bool = True, key=KEY) -> DataFrame:
    """Difference over ``span_s`` centred on each cell of a regular grid, with ranked reasons.

    Rows are dense (one per cell). With full support every cell of the stencil needs a position
    and a source gap within the limit; otherwise only the two ends count.
    """
    k = round(span_s / 2 / cadence_s)
    if k < 1 or abs(k * 2 * cadence_s - span_s) > 1e-9:
        raise ValueError("half the span must be a whole number of cells")
    b = frames.blocks(grid, key, "time", halo=k)
    w = frames.block_window(key)
    f = w.rowsBetween(-k, k)
    here = F.col("x_m").isNotNull() & F.col("y_m").isNotNull()
    left, right = F.lag(F.struct("x_m", "y_m"), k).over(w), F.lead(F.struct("x_m", "y_m"), k).over(w)
    cols = {"__l": left, "__r": right}
    if full_support:
        cols |= {"__pos": F.min(here).over(f), "__gapped": F.min(F.col("source_gap_min").isNotNull()).over(f), "__gap": F.max("source_gap_min").over(f)}
    b = frames.core(b.withColumns(cols))
    ends = F.col("__l.x_m").isNotNull() & F.col("__l.y_m").isNotNull() & F.col("__r.x_m").isNotNull() & F.col("__r.y_m").isNotNull()
    pos = F.col("__pos") if full_support else ends
    outside = F.col("__l").isNull() | F.col("__r").isNull()
    b = b.withColumns({"u": (F.col("__r.x_m") - F.col("__l.x_m")) / span_s, "v": (F.col("__r.y_m") - F.col("__l.y_m")) / span_s})
    reason = F.when(outside, "outside_centered_stencil").when(~pos, "nonfinite_position_in_stencil")
    if full_support:
        reason = reason.when(~F.col("__gapped"), "missing_source_support_in_stencil").when(F.col("__gap") > max_gap_min, "source_gap_exceeded_in_stencil")
    if speed_mask is not None:
        reason = reason.when(F.hypot("u", "v") > speed_mask, "speed_mask_exceeded")
    b = b.withColumn("reason", reason.otherwise("valid")).withColumn("valid", F.col("reason") == "valid")
    return b.withColumns({"u": F.when(F.col("valid"), F.col("u")), "v": F.when(F.col("valid"), F.col("v"))}).drop("__l", "__r", "__pos", "__gapped", "__gap")


def exact_span_velocity(grid: DataFrame, *, cadence_s: float, span_s: float, included="included", key=KEY) -> DataFrame:
    """Centred where the span fits inside the admitted interval, one-sided next to its borders.

    ``included`` marks the admitted cells (the same for all members of a cluster at one time).
    """
    n = round(span_s / cadence_s)
    half = n // 2 if n % 2 == 0 else None
    inc = F.col(included)
    k = frames.keys(key)
    span = grid.where(inc).groupBy(*k).agg(F.min("time").alias("__a"), F.max("time").alias("__z"))
    b = frames.blocks(grid, key, "time", halo=n)
    w = frames.block_window(key)
    ok = F.col("x_m").isNotNull() & F.col("y_m").isNotNull()
    fix = F.struct("x_m", "y_m", inc.alias("i"))
    offs = sorted({-n, n} | ({-half, half} if half else set()))
    cols = {f"__o{o + n}": (F.lag(fix, -o) if o < 0 else F.lead(fix, o)).over(w) for o in offs}
    for name, lo, hi in (("c", -(half or 0), half or 0), ("f", 0, n), ("b", -n, 0)):
        cols[f"__v{name}"] = F.min(ok).over(w.rowsBetween(lo, hi))
    b = frames.core(b.withColumns(cols)).join(span, k, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    at = lambda o: F.col(f"__o{o + n}")
    centred = F.lit(False)
    if half:
        centred = yes(at(-half)["i"] & at(half)["i"])
    left_edge = (F.unix_micros("time") - F.unix_micros("__a")) * 2 < round(span_s * 1e6)
    right_edge = (F.unix_micros("__z") - F.unix_micros("time")) * 2 < round(span_s * 1e6)
    kind = F.when(inc & centred, "c").when(inc & left_edge & yes(at(n)["i"]), "f").when(inc & right_edge & yes(at(-n)["i"]), "b")
    b = b.withColumn("stencil", kind)
    s = F.col("stencil")

    def diff(c: str):
        mid = (at(half)[c] - at(-half)[c]) if half else F.lit(None).cast("double")
        d = F.when((s == "c") & F.col("__vc"), mid).when((s == "f") & F.col("__vf"), at(n)[c] - F.col(c)).when((s == "b") & F.col("__vb"), F.col(c) - at(-n)[c])
        return d / span_s

    return b.withColumns({"u": diff("x_m"), "v": diff("y_m")}).drop("__a", "__z", *cols)


def platform_diagnostics(grid: DataFrame, activations: DataFrame, population=("array_id", "cluster_id")) -> DataFrame:
    """Ages, validity and the number of active members at each time."""
    on = list(population)
    active = grid.groupBy(*on, "time").agg(F.count_if("valid").alias("active_members"))
    return grid.join(active, [*on, "time"]).join(activations, on, "left").withColumn(
        "age_h", geo.seconds_between("activation_time", "time") / 3600)


def velocity_observations(grid: DataFrame) -> DataFrame:
    return grid.where("valid AND u IS NOT NULL AND v IS NOT NULL").withColumn("speed", F.hypot("u", "v"))
