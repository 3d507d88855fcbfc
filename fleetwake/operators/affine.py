"""Affine deformation of clusters between two times (AF rows)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.functions import geo
from fleetwake.operators import clusters as cl
from fleetwake.operators import frames, grid

KEY = "platform_id"


@dataclass(frozen=True)
class Quality:
    # Fixed default values.
    rank_tolerance: float = 1e-12
    min_aspect: float = 0.1
    isotropy: float = 1e-3
    collapse: float = 0.0
    min_radius_m: float | None = None
    max_residual: float | None = None


def schedule(bounds: DataFrame, hours: float) -> DataFrame:
    """Complete intervals of ``hours`` phased to midnight inside [start, end]; keeps the other columns."""
    step = round(hours * 3600e6)
    day = F.unix_micros(F.date_trunc("day", F.col("start")))
    first = day + F.ceil((F.unix_micros("start") - day) / step).cast("long") * step
    last = F.unix_micros("end") - step
    k = F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<bigint>"))
    b = bounds.withColumn("__t", F.explode(k))
    return b.select(*[c for c in bounds.columns if c not in ("start", "end")], F.timestamp_micros("__t").alias("fit_start"), F.timestamp_micros(F.col("__t") + step).alias("fit_end"))


def endpoints(track: DataFrame, targets: DataFrame, max_gap_min: float, cutoff=None, key=KEY) -> DataFrame:
    """Positions at the target times by interpolation between usable rows.

    The effective gap is the bracket's width or the larger inherited source gap.
    ``targets``: key, time. ``track``: key, time, lon, lat, source_gap_min.
    """
    usable = F.col("lon").isNotNull() & F.col("lat").isNotNull() & (F.col("source_gap_min") >= 0) & (F.col("source_gap_min") <= max_gap_min)
    if cutoff is not None:
        usable = usable & (F.col("time") <= F.lit(cutoff).cast("timestamp"))
    ok = track.where(F.coalesce(usable, F.lit(False)))
    b = grid.brackets(ok, targets, ["lon", "lat", "source_gap_min"], key)
    k = frames.keys(key)
    have = ok.select(*k).distinct().withColumn("__any", F.lit(True))
    b = b.join(have, k, "left")
    exact = F.coalesce(F.col("p.time") == F.col("time"), F.lit(False))
    span = (F.unix_micros("n.time") - F.unix_micros("p.time")) / F.lit(60e6)
    gap = F.when(exact, F.col("p.source_gap_min")).when(F.col("p").isNotNull() & F.col("n").isNotNull(), F.greatest(span, F.col("p.source_gap_min"), F.col("n.source_gap_min")))
    f = (F.unix_micros("time") - F.unix_micros("p.time")) / (F.unix_micros("n.time") - F.unix_micros("p.time"))
    b = b.withColumns({"effective_gap_min": gap, "__x": exact, "__f": f})
    good = F.col("effective_gap_min") <= max_gap_min
    turn = geo.wrap_longitude(F.col("n.lon") - F.col("p.lon"))
    lon = F.when(F.col("__x"), F.col("p.lon")).otherwise(geo.wrap_longitude(F.col("p.lon") + turn * F.col("__f")))
    lat = F.when(F.col("__x"), F.col("p.lat")).otherwise(F.col("p.lat") + (F.col("n.lat") - F.col("p.lat")) * F.col("__f"))
    why = (F.when(F.col("__any").isNull(), "no_usable_positions").when(F.col("effective_gap_min").isNull(), "endpoint_outside_usable_trajectory")
           .when(good, "valid").otherwise("endpoint_gap_exceeds_threshold"))
    return b.withColumns({"lon": F.when(good, lon), "lat": F.when(good, lat), "reason": why}).drop("p", "n", "__x", "__f", "__any")


def catalogue(track: DataFrame, platforms: DataFrame, max_gap_min: float) -> DataFrame:
    """Activation (all members), lifetime end (first member to end) and eligibility per cluster.

    ``platforms``: platform_id, array_id, cluster_id, cluster_size.
    """
    ok = track.where(F.coalesce(F.col("lon").isNotNull() & F.col("lat").isNotNull() & (F.col("source_gap_min") >= 0) & (F.col("source_gap_min") <= max_gap_min), F.lit(False)))
    rows = ok.select(KEY, "time").join(platforms.select(KEY, "array_id", "cluster_id"), KEY)
    n = platforms.groupBy("array_id", "cluster_id").agg(F.count(F.lit(1)).alias("members"), F.first("cluster_size").alias("declared"))
    g = ["array_id", "cluster_id"]
    full = rows.groupBy(*g, "time").agg(F.count(F.lit(1)).alias("c")).join(n, g).where("c = members").groupBy(*g).agg(F.min("time").alias("activation"))
    last = rows.groupBy(*g, KEY).agg(F.max("time").alias("z")).groupBy(*g).agg(F.min("z").alias("lifetime_end"), F.count(F.lit(1)).alias("seen"))
    j = n.join(full, g, "left").join(last, g, "left")
    return j.select(
        *g, "members", "activation", F.when(F.col("seen") == F.col("members"), F.col("lifetime_end")).alias("lifetime_end"),
        F.when(F.col("members") < 3, "fewer_than_three_original_members").when(F.col("activation").isNull(), "complete_cluster_never_available").otherwise("eligible").alias("eligibility"),
        (F.col("members") == F.col("declared")).alias("size_ok"))


def fits(positions: DataFrame, by: list[str], hours: float, quality: Quality = Quality()) -> DataFrame:
    """Least-squares X·Fᵀ = Y per group with stretches, rates, residuals and flags.

    ``positions``: by, platform_id, x0, y0, x1, y1. The 2×2 solution comes from a two-pass
    Gram–Schmidt factorisation of the centred start positions, so the rank test is on X itself.
    """
    c = positions.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("x0").isNull() | F.col("y0").isNull() | F.col("x1").isNull() | F.col("y1").isNull()).alias("missing"),
                                  *[F.avg(v).alias(f"m_{v}") for v in ("x0", "y0", "x1", "y1")])
    p = positions.join(frames.cut_if_shuffled(c), by).withColumns({v: F.col(v) - F.col(f"m_{v}") for v in ("x0", "y0", "x1", "y1")})
    p = frames.cut(p)
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    q1 = p.groupBy(*by).agg(F.sqrt(s("x0", "x0")).alias("r11"), s("x0", "y0").alias("__xy"), s("x0", "x0").alias("sxx"), s("y0", "y0").alias("syy"))
    q1 = q1.withColumn("r12", F.when(F.col("r11") > 0, F.col("__xy") / F.col("r11")).otherwise(0.0))
    e1 = F.when(F.col("r11") > 0, F.col("x0") / F.col("r11")).otherwise(0.0)
    z = p.join(q1, by).withColumn("e1", e1).withColumn("w", F.col("y0") - F.col("e1") * F.col("r12"))
    q2 = z.groupBy(*by).agg(
        F.first("r11").alias("r11"), F.first("r12").alias("r12"), F.sqrt(s("w", "w")).alias("r22"), F.first("sxx").alias("sxx"), F.first("syy").alias("syy"), F.first("__xy").alias("sxy"),
        s("e1", "x1").alias("a1"), s("e1", "y1").alias("b1"), s("w", "x1").alias("wa"), s("w", "y1").alias("wb"), (s("x1", "x1") + s("y1", "y1")).alias("ss1"))
    # Singular values of X are those of the triangle R = [[r11, r12], [0, r22]].
    t = F.col("r11") * F.col("r11") + F.col("r12") * F.col("r12") + F.col("r22") * F.col("r22")
    d = F.col("r11") * F.col("r22")
    q2 = q2.withColumns({"__t": t, "__d": F.abs(d)})
    q2 = q2.withColumn("sv1", F.sqrt((F.col("__t") + F.sqrt(F.greatest(F.lit(0.0), F.col("__t") * F.col("__t") - 4 * F.col("__d") * F.col("__d")))) / 2))
    q2 = q2.withColumn("sv2", F.when(F.col("sv1") > 0, F.col("__d") / F.col("sv1")).otherwise(0.0))
    full = (F.col("sv1") > 0) & (F.col("sv2") > quality.rank_tolerance * F.col("sv1"))
    q2 = q2.withColumn("rank", F.when(full, 2).when(F.col("sv1") > 0, 1).otherwise(0))
    good = F.col("rank") == 2
    fx2, fy2 = F.col("wa") / (F.col("r22") * F.col("r22")), F.col("wb") / (F.col("r22") * F.col("r22"))
    q2 = q2.withColumns({"f12": F.when(good, fx2), "f22": F.when(good, fy2)})
    q2 = q2.withColumns({"f11": F.when(good, (F.col("a1") - F.col("r12") * F.col("f12")) / F.col("r11")), "f21": F.when(good, (F.col("b1") - F.col("r12") * F.col("f22")) / F.col("r11"))})
    q2 = frames.cut(q2)
    ex = F.col("x1") - F.col("f11") * F.col("x0") - F.col("f12") * F.col("y0")
    ey = F.col("y1") - F.col("f21") * F.col("x0") - F.col("f22") * F.col("y0")
    rss = p.join(q2.select(*by, "f11", "f12", "f21", "f22"), by).groupBy(*by).agg(F.sum(ex * ex + ey * ey).alias("rss"))
    ring = frames.salted_pairs(p.select(*by, KEY, "x0", "y0"), by, KEY)
    wide = ring.groupBy(*by).agg(F.max(F.hypot(F.col("x0_2") - F.col("x0_1"), F.col("y0_2") - F.col("y0_1"))).alias("diameter_m"))
    j = c.join(q2, by).join(rss, by).join(wide, by, "left")
    xx = F.col("f11") * F.col("f11") + F.col("f21") * F.col("f21")
    xy = F.col("f11") * F.col("f12") + F.col("f21") * F.col("f22")
    yy = F.col("f12") * F.col("f12") + F.col("f22") * F.col("f22")
    j = j.withColumns({"c11": xx, "c12": xy, "c22": yy})
    e = cl.eigen(F.col("c11"), F.col("c12"), F.col("c22"))
    j = j.withColumns({"det": F.col("f11") * F.col("f22") - F.col("f12") * F.col("f21"), "eig1": e["major"], "__ang": F.radians(e["angle"])})
    # The smaller eigenvalue is det² / larger: no cancellation near collapse.
    j = j.withColumn("eig2", F.when(F.col("eig1") > 0, F.col("det") * F.col("det") / F.col("eig1")).when(F.col("eig1") == 0, F.lit(0.0)))
    j = j.withColumns({"stretch1": F.sqrt("eig1"), "stretch2": F.sqrt("eig2")})
    n = F.col("members")
    rate = lambda v: F.when(F.col(v) > 0, F.log(v) / hours).when(F.col(v) == 0, F.lit(float("-inf")))
    j = j.withColumns({
        "rate1": rate("stretch1"), "rate2": rate("stretch2"), "aspect": F.when(F.col("sv1") > 0, F.col("sv2") / F.col("sv1")).otherwise(0.0),
        "initial_radius_m": F.sqrt((F.col("sxx") + F.col("syy")) / n), "final_radius_m": F.sqrt(F.col("ss1") / n), "rmse_m": F.when(F.col("rank") == 2, F.sqrt(F.col("rss") / n)),
        "centroid_displacement_m": F.hypot(F.col("m_x1") - F.col("m_x0"), F.col("m_y1") - F.col("m_y0")),
        "separation": F.when(F.col("eig1") > 0, (F.col("eig1") - F.col("eig2")) / F.col("eig1")),
        "axis1_x": F.cos("__ang"), "axis1_y": F.sin("__ang")})
    j = j.withColumn("normalized_residual", F.when(F.col("final_radius_m") > 0, F.col("rmse_m") / F.col("final_radius_m")))
    iso = F.coalesce(F.col("separation") <= quality.isotropy, F.lit(False))
    flag = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    never = F.lit(False)
    flags = F.filter(F.array(
        flag(F.col("aspect") < quality.min_aspect, "poor_initial_geometry"), flag(n == 3, "three_members_no_residual_degrees_of_freedom"),
        flag(F.col("det") < 0, "orientation_reversal"), flag((F.col("det") == 0) | (F.col("stretch2") <= quality.collapse), "collapse_or_near_collapse"),
        flag(iso, "near_isotropic_axes"), flag(never if quality.min_radius_m is None else F.col("initial_radius_m") < quality.min_radius_m, "below_configured_size"),
        flag(never if quality.max_residual is None else F.col("normalized_residual") > quality.max_residual, "above_configured_residual")), lambda x: x.isNotNull())
    reason = (F.when(n < 3, "fewer_than_three_original_members").when(F.col("missing") > 0, "missing_endpoint_positions")
              .when(F.col("rank") < 2, "rank_deficient_initial_geometry").otherwise(""))
    j = j.withColumn("reason", reason).withColumn("quality_flags", F.when(F.col("reason") == "", flags).otherwise(F.array().cast("array<string>")))
    ok = F.col("reason") == ""
    solo = F.array_except("quality_flags", F.array(F.lit("three_members_no_residual_degrees_of_freedom")))
    status = F.when(~ok, "invalid").when(F.size("quality_flags") > 0, "flagged").otherwise("valid")
    keep = ("f11", "f12", "f21", "f22", "det", "eig1", "eig2", "stretch1", "stretch2", "rate1", "rate2", "rss", "rmse_m", "normalized_residual", "separation", "axis1_x", "axis1_y")
    j = j.withColumns({k: F.when(ok, F.col(k)) for k in keep})
    return j.select(*by, "members", status.alias("status"), "reason", "quality_flags", (ok & (F.size(solo) == 0)).alias("axis_displayable"), "rank", "sv1", "sv2", "aspect",
                    "initial_radius_m", "final_radius_m", "diameter_m", "centroid_displacement_m", *keep)


def attempts(catalog: DataFrame, intervals: DataFrame, ends: DataFrame, fitted: DataFrame) -> DataFrame:
    """Every scheduled interval of every cluster with one reason or its fit.

    ``ends``: array_id, cluster_id, fit_start, valid_initial, valid_final, worst (sorted reasons).
    """
    g = ["array_id", "cluster_id"]
    j = catalog.join(intervals, "array_id").join(ends, [*g, "fit_start"], "left").join(fitted.drop("members"), [*g, "fit_start"], "left")
    short = (F.coalesce("valid_initial", F.lit(0)) < F.col("members")) | (F.coalesce("valid_final", F.lit(0)) < F.col("members"))
    why = (
        F.when(F.col("eligibility") != "eligible", F.col("eligibility")).when(F.col("fit_start") < F.col("activation"), "before_cluster_activation")
        .when(F.col("fit_end") > F.col("lifetime_end"), "original_member_usable_trajectory_ended").when(short, F.coalesce("worst", F.lit("no_usable_positions")))
        .otherwise(F.coalesce("reason", F.lit("missing_endpoint_positions")))
    )
    return j.withColumn("attempt_reason", why).withColumn("attempt_status", F.when(F.col("attempt_reason") == "", F.col("status")).otherwise("invalid"))
