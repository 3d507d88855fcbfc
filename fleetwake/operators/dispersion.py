"""Dispersion, memory and structure functions of arrays (PJ rows)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwake.functions.bins import bin_index, bin_table, linear_edges
from fleetwake.operators import frames
from fleetwake.operators.thirdorder import FOUR_FIFTHS, moments

KEY = "platform_id"
P1, P2 = f"{KEY}_1", f"{KEY}_2"
PAIR_BLOCK = 4096  # resampled pairs of one matrix product


def bootstrap_mean(values: DataFrame, by: list[str], *, replicates: int, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentiles of the mean over resampled pairs, the same pairs at every time.

    ``values``: by, pair_id, time, value. Draws are hashes of (seed, replicate, slot) over the
    numbered pairs; the count of a pair in a replicate is its weight.
    """
    def hashed(*of) -> Column:
        """The first 13 hexadecimal digits of an MD5 as a number."""
        return F.conv(F.substring(F.md5(F.concat_ws("|", *[x.cast("string") for x in of])), 1, 13), 16, 10).cast("long")

    keyed = values.select(*by, "pair_id").distinct().withColumn("__k", hashed(F.col("pair_id")))
    pairs = frames.cut(frames.number(keyed, by, ["__k", "pair_id"], width=2**40, out="n").drop("__k"))
    size = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    # A replicate has as many draws as pairs: slots are the pairs themselves, one task's share each.
    draws = pairs.join(size, by).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn(
        "hit", hashed(F.lit(seed), *[F.col(c) for c in by], F.col("rep"), F.col("n")) % F.col("size"))
    w = draws.groupBy(*by, "rep", F.col("hit").alias("n")).agg(F.count(F.lit(1)).alias("w"))
    # Blocks of pairs: one matrix product (times x pairs) (pairs x replicates) each, then sums over blocks.
    block = F.floor(F.col("n") / PAIR_BLOCK)
    v = values.where("value IS NOT NULL").join(pairs, [*by, "pair_id"]).select(*by, block.alias("__b"), "n", "time", F.col("value").cast("double").alias("value"))
    w = w.withColumn("__b", block)
    schema = T.StructType([*[values.schema[c] for c in by], T.StructField("time", values.schema["time"].dataType), T.StructField("rep", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("c", T.DoubleType())])

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        times, t = np.unique(left["time"].to_numpy(), return_inverse=True)
        members, n = np.unique(np.concatenate([left["n"].to_numpy(), right["n"].to_numpy()]), return_inverse=True)
        weight = np.zeros((len(members), replicates))
        np.add.at(weight, (n[len(left) :], right["rep"].to_numpy()), right["w"].to_numpy())
        x, there = np.zeros((len(times), len(members))), np.zeros((len(times), len(members)))
        np.add.at(x, (t, n[: len(left)]), left["value"].to_numpy())
        np.add.at(there, (t, n[: len(left)]), 1.0)
        sums, counts = x @ weight, there @ weight
        at, rep = np.nonzero(counts)
        keys = [left[c].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(at), int))) for c in by] if len(left) else [pa.nulls(0, left.schema.field(c).type) for c in by]
        stamps = pa.array(times[at]).cast(left.schema.field("time").type)
        return pa.table([*keys, stamps, pa.array(rep), pa.array(sums[at, rep]), pa.array(counts[at, rep])], names=[*by, "time", "rep", "s", "c"])

    parts = v.groupBy(*by, "__b").cogroup(w.select(*by, "__b", "n", F.col("rep").cast("long").alias("rep"), F.col("w").cast("double").alias("w")).groupBy(*by, "__b")).applyInArrow(product, schema)
    m = parts.groupBy(*by, "time", "rep").agg((F.sum("s") / F.sum("c")).alias("m"))
    a = (1 - level) / 2
    return m.groupBy(*by, "time").agg(*[F.percentile("m", F.lit(p)).alias(n) for n, p in (("lower", a), ("median", 0.5), ("upper", 1 - a))])


def absolute_dispersion(points: DataFrame, by: list[str]) -> DataFrame:
    """RMS displacement from the position at age 0."""
    anchor = points.where("age_h = 0 AND x_m IS NOT NULL").select(*by, KEY, F.col("x_m").alias("__x"), F.col("y_m").alias("__y"))
    d = points.where("x_m IS NOT NULL AND age_h >= 0").join(anchor, [*by, KEY])
    dx, dy = F.col("x_m") - F.col("__x"), F.col("y_m") - F.col("__y")
    return d.groupBy(*by, "time", "age_h").agg(F.count(F.lit(1)).alias("platforms"), F.avg(dx * dx + dy * dy).alias("msd_m2")).withColumn("rms_m", F.sqrt("msd_m2"))


def close_pairs(points: DataFrame, by: list[str], max_m: float) -> DataFrame:
    """Pairs nearer than ``max_m`` at age 0, found through square cells instead of all pairs."""
    a = points.where("age_h = 0 AND x_m IS NOT NULL AND y_m IS NOT NULL").select(*by, KEY, "x_m", "y_m")
    cx, cy = F.floor(F.col("x_m") / max_m), F.floor(F.col("y_m") / max_m)
    left = a.select(*by, F.col(KEY).alias(P1), F.col("x_m").alias("x1"), F.col("y_m").alias("y1"), cx.alias("cx"), cy.alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = a.withColumn("__o", F.explode(around)).select(*by, F.col(KEY).alias(P2), F.col("x_m").alias("x2"), F.col("y_m").alias("y2"), (cx + F.col("__o.i")).alias("cx"), (cy + F.col("__o.j")).alias("cy"))
    r = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    m = left.join(right, [*by, "cx", "cy"]).where(F.col(P1) < F.col(P2)).withColumn("r0", r).where(F.col("r0") < max_m)
    return m.select(*by, P1, P2, F.concat_ws("|", P1, P2).alias("pair_id"), "r0")


def pair_separations(points: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    rows = points.where("x_m IS NOT NULL AND y_m IS NOT NULL AND age_h >= 0").select(*by, KEY, "time", "age_h", "x_m", "y_m")
    a = pairs.join(rows.withColumnsRenamed({KEY: P1, "x_m": "x1", "y_m": "y1"}), [*by, P1])
    b = rows.select(*by, F.col(KEY).alias(P2), "time", F.col("x_m").alias("x2"), F.col("y_m").alias("y2"))
    return a.join(b, [*by, P2, "time"]).withColumn("r", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))


def relative_dispersion(separations: DataFrame, by: list[str]) -> DataFrame:
    """Mean squared radial change of the close pairs per time."""
    d = F.col("r") - F.col("r0")
    return separations.groupBy(*by, "time", "age_h").agg(F.count(F.lit(1)).alias("pairs"), F.avg(d * d).alias("dispersion_m2"))


def regime_coefficients(absolute: DataFrame, relative: DataFrame, by: list[str], *, ballistic_end_h: float = 12.0, start_d: float = 2.0, end_d: float = 8.0) -> DataFrame:
    """Median ballistic and cubic coefficients and the free log-log fit of the relative dispersion."""
    s = F.col("age_h") * 3600
    b = absolute.where((F.col("age_h") > 0) & (F.col("age_h") <= ballistic_end_h) & (F.col("msd_m2") > 0)).groupBy(*by).agg(F.median(F.col("msd_m2") / (s * s)).alias("ballistic_v2"))
    in_range = (F.col("age_h") / 24 >= start_d) & (F.col("age_h") / 24 <= end_d) & (F.col("dispersion_m2") > 0)
    x, y = F.log(s), F.log("dispersion_m2")
    r = relative.where(in_range).groupBy(*by).agg(
        F.median(F.col("dispersion_m2") / (s * s * s)).alias("cubic_coefficient"), F.count(F.lit(1)).alias("fit_points"),
        F.regr_slope(y, x).alias("exponent"), F.exp(F.regr_intercept(y, x)).alias("coefficient"))
    many = F.col("fit_points") >= 2
    return b.join(r, by, "full_outer").withColumns({c: F.when(many, F.col(c)) for c in ("exponent", "coefficient")})


def _gram(points: DataFrame, by: list[str], windows: list[tuple[str, float, float]], pairs_per_block: int, spread: int) -> DataFrame:
    """``by…, t, s, n, d, pairs``: sums over pairs of r(t)·r(s) and r(t)² and their number, for s ≤ t and t in a window.

    ``points``: by, member, age_h, x_m, y_m. The members of a group are dealt into shares of some √pairs_per_block, and two
    shares make a block: their positions, not their pairs, are shuffled, small blocks many to a call. A block is a
    matrix of pairs by times, its sums are matrix products.
    """
    side = max(1, math.isqrt(pairs_per_block))
    points = frames.cut(points)
    size = points.groupBy(*by).agg(F.count_distinct(KEY).alias("__m")).where("__m > 1").select(
        *by, F.greatest(F.lit(spread), F.ceil(F.col("__m") / side)).cast("long").alias("__k"))
    rows = points.join(size, by).withColumn("__h", F.pmod(F.xxhash64(KEY), F.col("__k")))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    rows = rows.select(*by, F.least("__h", "__o").alias("__i"), F.greatest("__h", "__o").alias("__j"), "__h", KEY, "age_h", "x_m", "y_m")
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in by)

    def products(pdf: pd.DataFrame) -> dict:
        member, _ = pd.factorize(pdf[KEY])
        ages, col = np.unique(pdf["age_h"].to_numpy(), return_inverse=True)
        late = np.flatnonzero(np.logical_or.reduce([(ages / 24 >= a) & (ages / 24 < b) for _, a, b in windows]))
        shape = (member.max() + 1, len(ages))
        x, y, there = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        x[member, col], y[member, col], there[member, col] = pdf["x_m"].to_numpy(), pdf["y_m"].to_numpy(), 1.0
        i, j = pdf["__i"].iloc[0], pdf["__j"].iloc[0]
        if i == j:
            one, two = np.triu_indices(shape[0], 1)
        else:
            share = np.zeros(shape[0], dtype=np.int64)
            share[member] = pdf["__h"].to_numpy()
            one, two = (g.ravel() for g in np.meshgrid(np.flatnonzero(share == i), np.flatnonzero(share == j)))
        here = there[one] * there[two]
        r = np.where(here > 0, np.hypot(x[two] - x[one], y[two] - y[one]), 0.0)
        count = here[:, late].T @ here
        t, s = np.nonzero((count > 0) & (np.arange(len(ages))[None, :] <= late[:, None]))
        return {"t": ages[late[t]], "s": ages[s], "n": (r[:, late].T @ r)[t, s], "d": ((r * r)[:, late].T @ here)[t, s], "pairs": count[t, s].astype(np.int64)}

    sums = frames.in_lots(rows, [*by, "__i", "__j"], [], products, f"{kinds}, t double, s double, n double, d double, pairs long")
    return sums.groupBy(*by, "t", "s").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("pairs").alias("pairs"))


def separation_memory(points: DataFrame, by: list[str], windows: list[tuple[str, float, float]], bins: int, spread: int = 1, pairs_per_block: int = 512) -> DataFrame:
    """Correlation of current and past separations of all pairs, binned by lag over age.

    Targets are the times inside the windows (days); the sums over pairs for every target and past
    time are triangular matrix products of blocks of pairs (:func:`_gram`). ``spread`` is the least number of shares of a group.
    """
    rows = points.where("x_m IS NOT NULL AND y_m IS NOT NULL AND age_h >= 0").where(F.col("age_h") / 24 < max(b for _, _, b in windows)).select(*by, KEY, "age_h", "x_m", "y_m")
    table = F.array(*[F.struct(F.lit(n).alias("group"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, a, b in windows])
    c = _gram(rows, by, windows, pairs_per_block, spread).where("d > 0")
    c = c.withColumn("__g", F.explode(F.filter(table, lambda w: (F.col("t") / 24 >= w["a"]) & (F.col("t") / 24 < w["b"])))).withColumn("group", F.col("__g.group")).drop("__g")
    c = c.withColumns({"correlation": F.col("n") / F.col("d"), "lag": (F.col("s") - F.col("t")) / F.col("t")})
    at = F.least(F.floor((F.col("lag") + 1) * bins), F.lit(bins - 1)).cast("int")
    c = c.withColumn("bin", at)
    got = c.groupBy(*by, "group", "bin").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("t").alias("targets"), F.avg("pairs").alias("mean_pairs"),
        F.avg("correlation").alias("correlation"), F.stddev_samp("correlation").alias("deviation"))
    dense = points.select(*by).distinct().withColumn("group", F.explode(F.array(*[F.lit(n) for n, _, _ in windows]))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return dense.join(got, [*by, "group", "bin"], "left").na.fill(0, ["samples", "targets"]).withColumn("center", (F.col("bin") + 0.5) / bins - 1)


def lagrangian_structure(points: DataFrame, by: list[str], constant: float = 6.5) -> tuple[DataFrame, DataFrame]:
    """(second-order structure function and ε proxy per time, peak per group)."""
    v = points.where("u IS NOT NULL AND v IS NOT NULL AND age_h >= 0")
    a = v.where("age_h = 0").select(*by, KEY, F.col("u").alias("__u"), F.col("v").alias("__v"))
    du, dv = F.col("u") - F.col("__u"), F.col("v") - F.col("__v")
    s = v.join(a, [*by, KEY]).groupBy(*by, "time", "age_h").agg(F.count(F.lit(1)).alias("platforms"), F.avg(du * du + dv * dv).alias("d2"))
    s = s.withColumn("epsilon_proxy", F.when(F.col("age_h") > 0, F.col("d2") / (F.lit(constant) * F.col("age_h") * 3600)))
    peak = s.groupBy(*by).agg(F.max_by(F.struct("age_h", "epsilon_proxy"), F.struct("epsilon_proxy", -F.col("age_h"))).alias("p")).select(*by, F.col("p.age_h").alias("peak_age_h"), F.col("p.epsilon_proxy").alias("peak_epsilon"))
    return s, peak


def increments(pairs: DataFrame, edges: list[float], centers: list[float], scales: list[float], by: list[str], *, limit: float, bins: int, tolerance: float = 0.2):
    """(moments per scale, dense histogram of increments over their deviation)."""
    picked = []
    for s in scales:
        i = int(np.argmin(np.abs(np.array(centers) - s)))
        if abs(centers[i] - s) / s > tolerance or i in picked:
            raise ValueError(f"no separate bin near scale {s:g}")
        picked.append(i)
    b = pairs.where("dul IS NOT NULL").withColumn("bin", bin_index("r_m", edges)).where(F.col("bin").isin(picked)).select(*by, "bin", "dul")
    b = frames.cut_if_shuffled(b)
    g = [*by, "bin"]
    m = moments(b, g, "dul", "dul").withColumn("sigma", F.sqrt("var_dul"))
    m = frames.cut(m)
    h = linear_edges(-limit, limit, 2 * limit / bins)
    z = b.join(m.where("sigma > 0").select(*g, "sigma", "n_dul"), g).withColumn("z", F.col("dul") / F.col("sigma"))
    c = z.groupBy(*g, bin_index("z", h).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    cells = bin_table(pairs.sparkSession, h).select(F.col("bin").alias("h"), F.col("center").alias("z"))
    d = m.where("sigma > 0").select(*g, "sigma", "mean_dul", "n_dul").crossJoin(F.broadcast(cells)).join(c, [*g, "h"], "left").na.fill(0, ["n"])
    mean = F.col("mean_dul") / F.col("sigma")
    d = d.withColumns({"density": F.col("n") / F.col("n_dul") / F.lit(2 * limit / bins),
                       "gaussian": F.exp(-0.5 * (F.col("z") - mean) * (F.col("z") - mean)) / F.lit((2 * np.pi) ** 0.5), "norm_mean": mean})
    return m, d


FIT = "amplitude double, location double, width double, rmse double, area double, status string"


def gaussian_core(histogram: DataFrame, by: list[str], core: float, limit: float) -> DataFrame:
    """Bounded least-squares Gaussian of the histogram core; a group is one histogram (a few dozen bins)."""
    g = [*by, "bin"]
    kinds = {f.name: f.dataType.simpleString() for f in histogram.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in g) + ", " + FIT

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["z"].to_numpy(), pdf["density"].to_numpy()
        lo, hi = np.array([0.0, -core, 0.01]), np.array([np.inf, core, limit])
        q = np.clip(np.array([y.max(), pdf["norm_mean"].iloc[0], 0.75]), lo, hi)
        model = lambda q: q[0] * np.exp(-0.5 * ((x - q[1]) / q[2]) ** 2)
        cost, damp = np.sum((y - model(q)) ** 2), 1e-3
        for _ in range(500):
            e = np.exp(-0.5 * ((x - q[1]) / q[2]) ** 2)
            j = np.column_stack([e, q[0] * e * (x - q[1]) / q[2] ** 2, q[0] * e * (x - q[1]) ** 2 / q[2] ** 3])
            a = j.T @ j
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ (y - model(q)), rcond=None)[0]
            trial = np.clip(q + step, lo, hi)
            fresh = np.sum((y - model(trial)) ** 2)
            if fresh < cost:
                done = cost - fresh < 1e-14 * max(cost, 1e-300)
                q, cost, damp = trial, fresh, max(damp / 5, 1e-12)
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        ok = len(x) >= 3 and np.all(np.isfinite(q))
        row = [pdf[c].iloc[0] for c in g] + ([*q, np.sqrt(cost / len(x)), q[0] * np.sqrt(2 * np.pi) * q[2], "success"] if ok else [None] * 5 + ["fit_failed"])
        return pd.DataFrame([row], columns=[*g, "amplitude", "location", "width", "rmse", "area", "status"])

    return histogram.where(F.abs("z") <= core).select(*g, "z", "density", "norm_mean").groupBy(*g).applyInPandas(fit, schema)


def structure_functions(summary: DataFrame, pairs: DataFrame, edges: list[float], by: list[str]) -> DataFrame:
    """S2, S3, mixed third order, both ε relations and the identity error per bin of an EP summary."""
    b = pairs.withColumn("bin", bin_index("r_m", edges)).groupBy(*by, "bin").agg(F.avg("mixed3").alias("mixed"))
    j = summary.join(b, [*by, "bin"], "left")
    again = F.when(F.col("mean_r") > 0, FOUR_FIFTHS * F.col("raw3_dul") / F.col("mean_r"))
    return j.withColumns({
        "s2": F.col("raw2_dul"), "s3": F.col("raw3_dul"),
        "epsilon_mixed": F.when(F.col("mean_r") > 0, -(F.col("raw3_dul") + F.col("mixed")) / (2 * F.col("mean_r"))),
        "identity_error": F.abs(F.col("epsilon") - again),
        "rossby_again": F.when((F.col("coriolis") != 0) & (F.col("mean_r") > 0), F.sqrt("raw2_dul") / (F.abs("coriolis") * F.col("mean_r")))})


def scaling_fits(table: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Free log-log slope of S2 with its standard error and the fixed 2/3 coefficient."""
    ok = table.where(F.col("support_ok") & (F.col("mean_r") >= low) & (F.col("mean_r") <= high) & (F.col("s2") > 0))
    x, y = F.log("mean_r"), F.log("s2")
    a = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bins"), F.regr_slope(y, x).alias("exponent"), F.regr_intercept(y, x).alias("__i"),
        F.regr_sxx(y, x).alias("__sxx"), F.regr_syy(y, x).alias("__syy"), F.regr_sxy(y, x).alias("__sxy"), F.avg(y - x * (2 / 3)).alias("__k"))
    sse = F.greatest(F.lit(0.0), F.col("__syy") - F.try_divide(F.col("__sxy") * F.col("__sxy"), F.col("__sxx")))
    many = F.col("bins") >= 3
    return a.select(*by, "bins", F.when(many, F.col("exponent")).alias("exponent"), F.when(many, F.exp("__i")).alias("coefficient"),
                    F.when(many, F.sqrt(F.try_divide(sse / (F.col("bins") - 2), F.col("__sxx")))).alias("exponent_se"), F.when(many, F.exp("__k")).alias("two_thirds_coefficient"))


THIN_ROWS = 262_144


def log_thin(df: DataFrame, by: list[str], value: str, count: int, order: str) -> DataFrame:
    """At most ``count`` rows nearest to log-spaced targets between the first and last positive value."""
    ok = frames.cut(df.where(F.col(value) > 0))
    # One cut by group serves all joins, and its parts hold some THIN_ROWS rows however many there are.
    parts = max(-(-ok.count() // THIN_ROWS), int(ok.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ok = ok.repartition(parts, *by)
    lim = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min_by(value, order).alias("__a"), F.max_by(value, order).alias("__z"))
    # Rows meet their limits once, not once for every target; least distances and orders are plain numbers, which hash aggregates hold.
    targets = range(count)
    goal = [F.col("__a") * F.pow(F.col("__z") / F.col("__a"), F.lit(i) / (count - 1)) for i in targets]
    off = [F.abs(F.col(value) - t) for t in goal]
    rows = ok.select(*by, order, value).join(lim.where(F.col("__n") > count), by)
    least = rows.groupBy(*by).agg(*[F.min(d).alias(f"__d{i}") for i, d in enumerate(off)])
    first = rows.join(least, by).groupBy(*by).agg(*[F.min(F.when(d == F.col(f"__d{i}"), F.col(order))).alias(f"__o{i}") for i, d in enumerate(off)])
    kept = first.select(*by, F.array(*[F.col(f"__o{i}") for i in targets]).alias("__kept"))
    named = ok.dropna(subset=[*by, order])
    out = named.join(kept, by, "left").where(F.col("__kept").isNull() | F.array_contains("__kept", F.col(order)))
    return out.select(*df.columns)
