"""Regular grids, resampling and forward velocities (RG rows)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.functions import geo, wgs84
from fleetwake.operators import frames

KEY = "platform_id"
MINUTE_US = 60_000_000
# Product name, source, cadence and largest source gap in minutes.
PRODUCTS = (("raw_5min", "raw", 5, 30), ("qc_5min", "qc", 5, 30), ("qc_15min", "qc", 15, 60), ("qc_30min", "qc", 30, 120))
# Fixed value: degrees a spline may leave the envelope of its fixes.
OVERSHOOT_DEG = 1e-10


def regular_grid(spans: DataFrame, cadence_min: float, anchor="anchor", start="start", end="end", keep=(KEY,)) -> DataFrame:
    """Cells at whole cadences from the anchor: first at or after the start, last at or before the end."""
    step = round(cadence_min * MINUTE_US)
    a = F.unix_micros(anchor)
    lo = F.ceil((F.unix_micros(start) - a) / step).cast("long")
    hi = F.floor((F.unix_micros(end) - a) / step).cast("long")
    cells = spans.withColumns({"__lo": lo, "__hi": hi, "__a": a}).where("__hi >= __lo")
    return cells.select(*keep, "__a", F.explode(F.sequence("__lo", "__hi")).alias("cell")).select(
        *keep, "cell", F.timestamp_micros(F.col("__a") + F.col("cell") * step).alias("time"))


def common_grid(fixes: DataFrame, cadence_min: float) -> DataFrame:
    """One grid for all tracks: from the floor of the first fix to the ceiling of the last."""
    step = round(cadence_min * MINUTE_US)
    t = F.unix_micros("time")
    lim = fixes.agg(F.min(t).alias("a"), F.max(t).alias("z")).where("a IS NOT NULL")
    return lim.select(F.explode(F.sequence(F.floor(F.col("a") / step).cast("long"), F.ceil(F.col("z") / step).cast("long"))).alias("cell")).select(
        "cell", F.timestamp_micros(F.col("cell") * step).alias("time"))


def brackets(fixes: DataFrame, cells: DataFrame, columns: list[str], key=KEY, *, width: int = frames.CHUNK_US) -> DataFrame:
    """Nearest fix at or before (``p``) and after (``n``) every cell: one union and one ordered pass, no range join."""
    key = frames.keys(key)
    extra = [c for c in cells.columns if c not in key + ["time"]]
    f = fixes.select(*key, "time", F.lit(0).alias("__kind"), F.struct("time", *columns).alias("__fix"))
    c = cells.select(*key, "time", F.lit(1).alias("__kind"), *extra)
    both = f.unionByName(c, allowMissingColumns=True)
    out = frames.scan(both, key, ["time", "__kind"], width=width, last={"p": F.col("__fix")}, first={"n": F.col("__fix")})
    return out.where("__kind = 1").drop("__kind", "__fix")


def _gap_and_share() -> tuple[Column, Column]:
    t, a, b = F.unix_micros("time"), F.unix_micros("p.time"), F.unix_micros("n.time")
    exact = a == t
    gap = F.when(exact, 0.0).when(F.col("p").isNotNull() & F.col("n").isNotNull(), (b - a) / F.lit(float(MINUTE_US)))
    return gap, F.when(exact, 0.0).otherwise((t - a) / (b - a))


def resample_series(fixes: DataFrame, cells: DataFrame, value: str, max_gap_min: float | None = None, key=KEY) -> DataFrame:
    """Linear values and source gap on the cells; nothing outside the fixes, wide gaps masked."""
    b = brackets(fixes, cells, [value], key)
    gap, share = _gap_and_share()
    b = b.withColumns({"source_gap_min": gap, "__f": share})
    v = F.when(F.col("__f") == 0, F.col(f"p.{value}")).otherwise(
        F.col(f"p.{value}") + (F.col(f"n.{value}") - F.col(f"p.{value}")) * F.col("__f"))
    ok = F.col("source_gap_min").isNotNull() & (F.lit(True) if max_gap_min is None else F.col("source_gap_min") <= max_gap_min)
    return b.withColumn(value, F.when(ok, v)).drop("p", "n", "__f")


def resample_track(fixes: DataFrame, cells: DataFrame, max_gap_min: float | None = None, key=KEY, coverage: DataFrame | None = None) -> DataFrame:
    """Linear positions on the cells, safe across the date line.

    ``coverage`` (key, coverage_start, coverage_end) limits the cells that get a value.
    """
    b = brackets(fixes, cells, ["lon", "lat"], key)
    if coverage is not None:
        b = b.join(coverage, frames.keys(key), "left")
        inside = F.col("time").between(F.col("coverage_start"), F.col("coverage_end"))
    else:
        inside = F.lit(True)
    gap, share = _gap_and_share()
    b = b.withColumns({"source_gap_min": F.when(inside, gap), "__f": share})
    ok = F.col("source_gap_min").isNotNull() & (F.lit(True) if max_gap_min is None else F.col("source_gap_min") <= max_gap_min)
    turn = geo.wrap_longitude(F.col("n.lon") - F.col("p.lon"))
    lon = F.when(F.col("__f") == 0, geo.wrap_longitude("p.lon")).otherwise(geo.wrap_longitude(F.col("p.lon") + turn * F.col("__f")))
    lat = F.when(F.col("__f") == 0, F.col("p.lat")).otherwise(F.col("p.lat") + (F.col("n.lat") - F.col("p.lat")) * F.col("__f"))
    return b.withColumns({"lon": F.when(ok, lon), "lat": F.when(ok, lat)}).drop("p", "n", "__f", "coverage_start", "coverage_end")


def forward_velocity(grid: DataFrame, key=KEY) -> DataFrame:
    """Geodesic velocity to the next row, stored on the earlier one; missing positions are not bridged."""
    n = frames.scan(grid, key, "time", lead={"__n": F.struct("time", "lon", "lat", geo.position_valid("lon", "lat").alias("ok"))})
    dt = geo.seconds_between("time", "__n.time")
    usable = F.coalesce(geo.position_valid("lon", "lat") & F.col("__n.ok") & (dt > 0), F.lit(False))
    n = wgs84.with_inverse(n, "__g", *[F.when(usable, F.col(c)) for c in ("lon", "lat", "__n.lon", "__n.lat")])
    n = n.withColumn("dt_s", F.when(usable, dt)).withColumn("speed", F.col("__g.s") / F.col("dt_s"))
    az = F.radians("__g.az")
    return n.withColumns({"u": F.col("speed") * F.sin(az), "v": F.col("speed") * F.cos(az)}).drop("__n", "__g")


def regular_product(fixes: DataFrame, cells: DataFrame, max_gap_min: float, coverage: DataFrame | None = None) -> DataFrame:
    return forward_velocity(resample_track(fixes, cells, max_gap_min, coverage=coverage))


def standard_products(raw: DataFrame, qc: DataFrame, spans: DataFrame, specs=PRODUCTS) -> DataFrame:
    """All products in long form; ``spans``: platform_id, anchor, start, end."""
    sources = {"raw": raw, "qc": qc}
    out = None
    for name, source, cadence, gap in specs:
        one = regular_product(sources[source], regular_grid(spans, cadence), gap).withColumn("product", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def build_report(fixes: DataFrame, grid: DataFrame, thresholds_min=(30, 60, 120)) -> DataFrame:
    """Per platform: gap quantiles, gaps over thresholds, exact and interpolated cells, warning."""
    g = frames.scan(fixes, KEY, "time", lag={"__p": F.col("time")}).withColumn("gap_min", geo.seconds_between("__p", "time") / 60)
    g = frames.cut(g.select(KEY, "gap_min"))
    q = frames.quantiles(g, KEY, {"gap": F.col("gap_min")}, {"p50": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0})
    over = g.groupBy(KEY).agg(*[F.count_if(F.col("gap_min") > t).alias(f"gaps_over_{t}") for t in thresholds_min])
    cells = grid.groupBy(KEY).agg(
        F.count_if((F.col("source_gap_min") == 0) & F.col("lon").isNotNull()).alias("exact_cells"),
        F.count_if((F.col("source_gap_min") > 0) & F.col("lon").isNotNull()).alias("interpolated_cells"),
        F.count_if(F.col("lon").isNull()).alias("missing_cells"))
    j = over.join(q, KEY, "left").join(cells, KEY, "left")
    return j.withColumn("warning", F.when(F.col("exact_cells") + F.col("interpolated_cells") == 0, "no_grid_cells").when(F.col(f"gaps_over_{thresholds_min[-1]}") > 0, "long_gaps").otherwise(""))


def snap_times(df: DataFrame, cadence_min: float, tolerance_s: float, anchor_us: int = 0, key=KEY) -> DataFrame:
    """Nearest grid cell of every supplied time and the verdict per key.

    ``verdict``: cadence_off, snapped, phase (one stable offset, kept) or unstable.
    """
    step = round(cadence_min * MINUTE_US)
    d = F.unix_micros("time") - anchor_us
    snapped = anchor_us + F.floor((d + step / 2) / step).cast("long") * step
    s = frames.scan(df, key, "time", lag={"__p": F.unix_micros("time")})
    s = s.withColumn("snap_us", snapped).withColumns({
        "offset_us": F.unix_micros("time") - F.col("snap_us"),
        "__step": F.abs((F.unix_micros("time") - F.col("__p")) - step)})
    s = frames.cut(s.drop("__p"))
    k = frames.keys(key)
    tol = tolerance_s * 1e6
    facts = s.groupBy(*k).agg(F.max(F.abs("offset_us")).alias("worst"), F.coalesce(F.max("__step"), F.lit(0)).alias("jitter"))
    med = frames.quantiles(s, key, {"off": F.col("offset_us")}, {"p50": 0.5})
    facts = facts.join(med.select(*k, F.round("off_p50").cast("long").alias("phase_us")), k)
    spread = s.join(facts, k).groupBy(*k).agg(F.max(F.abs(F.col("offset_us") - F.col("phase_us"))).alias("spread"))
    facts = facts.join(spread, k).withColumn(
        "verdict", F.when(F.col("jitter") > tol, "cadence_off").when(F.col("worst") <= tol, "snapped")
        .when(F.col("spread") <= tol, "phase").otherwise("unstable"))
    out = s.join(facts.select(*k, "verdict", "phase_us"), k)
    us = F.when(F.col("verdict") == "snapped", F.col("snap_us")).when(F.col("verdict") == "phase", F.col("snap_us") + F.col("phase_us"))
    return out.withColumn("aligned_us", us).drop("__step")


def support_gap(axis: DataFrame, cells: DataFrame, key=KEY) -> DataFrame:
    """Width of the other axis's interval around every cell, 0 on a sample."""
    b = brackets(axis, cells, [], key)
    gap, _ = _gap_and_share()
    return b.withColumn("support_gap_min", gap).drop("p", "n")


def align_supplied(supplied: DataFrame, cells: DataFrame, max_gap_min: float) -> DataFrame:
    """A supplied product moved to other cells piece by piece; rows without a position end a piece."""
    ok = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    s = frames.scan(supplied, KEY, "time", lag={"__b": F.lit(True)}, total={"piece": (~ok).cast("long")})
    good = s.where(ok).drop("__b")
    b = brackets(good, cells, ["lon", "lat", "piece"])
    gap, share = _gap_and_share()
    b = b.withColumns({"source_gap_min": gap, "__f": share})
    same = (F.col("source_gap_min") == 0) | (F.col("p.piece") == F.col("n.piece"))
    fine = F.coalesce(same & (F.col("source_gap_min") <= max_gap_min), F.lit(False))
    turn = geo.wrap_longitude(F.col("n.lon") - F.col("p.lon"))
    lon = F.when(F.col("__f") == 0, F.col("p.lon")).otherwise(geo.wrap_longitude(F.col("p.lon") + turn * F.col("__f")))
    lat = F.when(F.col("__f") == 0, F.col("p.lat")).otherwise(F.col("p.lat") + (F.col("n.lat") - F.col("p.lat")) * F.col("__f"))
    return b.withColumns({"lon": F.when(fine, lon), "lat": F.when(fine, lat), "source_gap_min": F.when(fine, F.col("source_gap_min"))}).drop("p", "n", "__f")


def coverage_end(tracks: DataFrame, *, policy: str = "drogue", buffer_h: float = 24.0) -> DataFrame:
    """``tracks``: platform_id, start, end, loss_time. Adds ``coverage_end`` and a problem, if any."""
    if policy == "record_end":
        return tracks.withColumns({"coverage_end": F.col("end"), "problem": F.lit(None).cast("string")})
    cutoff = F.timestamp_micros(F.unix_micros("loss_time") - round(buffer_h * 3600e6))
    end = F.when(F.col("loss_time").isNull(), F.col("end")).otherwise(F.least("end", cutoff))
    t = tracks.withColumn("coverage_end", end)
    return t.withColumn("problem", F.when(F.col("loss_time").isNull(), "unknown_loss").when(F.col("coverage_end") <= F.col("start"), "cutoff_before_start"))


def sample_phase(grid: DataFrame, cadence_min: float, anchor) -> DataFrame:
    """Rows at whole cadences from the anchor."""
    a = F.unix_micros(anchor) if isinstance(anchor, (str, Column)) else F.lit(int(anchor))
    return grid.where(F.pmod(F.unix_micros("time") - a, F.lit(round(cadence_min * MINUTE_US))) == 0)


def _natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y) by one tridiagonal elimination for all columns of y."""
    h, n = np.diff(x), len(x)
    slope = np.diff(y, axis=0) / h[:, None]
    m = np.zeros_like(y)
    # The elimination is a chain of scalars, which plain floats run several times faster than array elements.
    step, diag, upper = h.tolist(), (2 * (h[:-1] + h[1:])).tolist(), h[1:].tolist()
    share = [0.0] * (n - 2)
    for i in range(1, n - 2):
        share[i] = w = step[i] / diag[i - 1]
        diag[i] -= w * upper[i - 1]
    for c, rhs in enumerate((6 * np.diff(slope, axis=0)).T.tolist()):
        for i in range(1, n - 2):
            rhs[i] -= share[i] * rhs[i - 1]
        after = 0.0
        for i in range(n - 3, -1, -1):
            rhs[i] = after = (rhs[i] - (upper[i] * after if i < n - 3 else 0)) / diag[i]
        m[1:-1, c] = rhs
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b, w = (x[k + 1] - at)[:, None], (at - x[k])[:, None], h[k][:, None]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * w) + (y[k] / w - m[k] * w / 6) * a + (y[k + 1] / w - m[k + 1] * w / 6) * b


SPLINE_SCHEMA = (
    "platform_id string, portion long, cell long, lon double, lat double, knots long, "
    "low_lon double, high_lon double, low_lat double, high_lat double"
)


def phase_spline(fixes: DataFrame, cells: DataFrame, *, cadence_min: float, period_min: float, long_gap_min: float, block: int = 4096) -> DataFrame:
    """Phase-averaged natural spline of one period with linear fallback.

    Portions between long gaps are solved in blocks: a knot 64 knots away weighs below 1e-36, so a
    block with that halo gives the same doubles as the whole portion. Adds ``fallback``:
    long_gap, insufficient, overshoot or empty.
    """
    steps = round(period_min / cadence_min)
    gap = F.coalesce(F.unix_micros("time") - F.col("__t") > round(long_gap_min * MINUTE_US), F.lit(False))
    f = frames.scan(fixes.select(KEY, "time", "lon", "lat"), KEY, "time", lag={"__t": F.unix_micros("time"), "__l": F.col("lon")})
    turn = F.round((geo.wrap_longitude(F.col("lon") - F.col("__l")) - (F.col("lon") - F.col("__l"))) / 360)
    f = frames.scan(f.withColumns({"__g": gap.cast("long"), "__w": F.coalesce(turn, F.lit(0.0))}).drop("__t", "__l"), KEY, "time",
                    total={"portion": F.col("__g"), "__turns": F.col("__w")})
    f = frames.cut(f.withColumn("lon", F.col("lon") + 360 * F.col("__turns")).drop("__g", "__w", "__turns"))
    b = brackets(f, cells, ["lon", "lat", "portion"])
    _, share = _gap_and_share()
    b = b.where(F.col("p").isNotNull() & (F.col("n").isNotNull() | (F.col("p.time") == F.col("time")))).withColumn("__f", share)
    lin = b.select(
        KEY, "cell", "time",
        F.when(F.col("__f") == 0, F.col("p.lon")).otherwise(F.col("p.lon") + (F.col("n.lon") - F.col("p.lon")) * F.col("__f")).alias("lon"),
        F.when(F.col("__f") == 0, F.col("p.lat")).otherwise(F.col("p.lat") + (F.col("n.lat") - F.col("p.lat")) * F.col("__f")).alias("lat"),
        F.when((F.col("__f") == 0) | (F.col("p.portion") == F.col("n.portion")), F.col("p.portion")).alias("portion"))
    lin = frames.cut(lin)
    ends = f.groupBy(KEY, "portion").agg(
        F.min_by(F.struct(F.unix_micros("time").alias("t"), "lon", "lat"), "time").alias("a"),
        F.max_by(F.struct(F.unix_micros("time").alias("t"), "lon", "lat"), "time").alias("z"),
        F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    cutup = frames.blocks(lin.where("portion IS NOT NULL"), [KEY, "portion"], "time", halo=64 * steps, size=max(block, 64 * steps + 1))
    cutup = cutup.join(ends, [KEY, "portion"])
    rows = cutup.select(KEY, "portion", "__block", "__core", "cell", F.unix_micros("time").alias("t_us"), "lon", "lat", "pos",
                        F.col("a.t").alias("at"), F.col("a.lon").alias("alon"), F.col("a.lat").alias("alat"),
                        F.col("z.t").alias("zt"), F.col("z.lon").alias("zlon"), F.col("z.lat").alias("zlat"))

    def work(pdf: pd.DataFrame) -> dict:
        t, cell, core = (pdf[c].to_numpy() for c in ("t_us", "cell", "__core"))
        xy = np.column_stack([pdf["lon"].to_numpy(), pdf["lat"].to_numpy()])
        one = {c: pdf[c].iat[0] for c in ("pos", "at", "alon", "alat", "zt", "zlon", "zlat")}
        at = (t[core] - t[0]) / 1e6
        tracks, least = [], 2**62
        for phase in range(steps):
            on = cell % steps == phase
            kt, ky = t[on], xy[on]
            # Portion ends are knots of every phase; only blocks at the ends see them.
            if one["pos"] == 0 and (not len(kt) or kt[0] != one["at"]):
                kt, ky = np.r_[one["at"], kt], np.vstack([[one["alon"], one["alat"]], ky])
            if kt[-1] != one["zt"] and not (~core[-64 * steps:]).all() or len(t) < 4 and kt[-1] != one["zt"]:
                kt, ky = np.r_[kt, one["zt"]], np.vstack([ky, [one["zlon"], one["zlat"]]])
            least = min(least, len(kt))
            if least < 4:
                break
            tracks.append(_natural_spline((kt - t[0]) / 1e6, ky, at))
        out = {"cell": cell[core], "knots": np.full(len(at), least)}
        if least < 4:
            return out | {c: np.full(len(at), np.nan) for c in ("lon", "lat", "low_lon", "high_lon", "low_lat", "high_lat")}
        cube = np.stack(tracks)
        mean, lo, hi = cube.mean(axis=0), cube.min(axis=0), cube.max(axis=0)
        return out | {"lon": mean[:, 0], "lat": mean[:, 1], "low_lon": lo[:, 0], "high_lon": hi[:, 0], "low_lat": lo[:, 1], "high_lat": hi[:, 1]}

    spl = frames.cut(frames.in_lots(rows, [KEY, "portion", "__block"], "t_us", work, SPLINE_SCHEMA))
    tol = OVERSHOOT_DEG
    state = spl.groupBy(KEY, "portion").agg(
        F.min("knots").alias("knots"), F.min("low_lon").alias("a"), F.max("high_lon").alias("b"),
        F.min("low_lat").alias("c"), F.max("high_lat").alias("d")).join(ends.select(KEY, "portion", "x0", "x1", "y0", "y1"), [KEY, "portion"])
    over = (F.col("a") < F.col("x0") - tol) | (F.col("b") > F.col("x1") + tol) | (F.col("c") < F.col("y0") - tol) | (F.col("d") > F.col("y1") + tol) | (F.col("c") < -90) | (F.col("d") > 90)
    state = state.select(KEY, "portion", F.when(F.col("knots") < 4, "insufficient").when(over, "overshoot").otherwise("").alias("__s"))
    got = spl.select(KEY, "cell", F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    out = lin.join(state, [KEY, "portion"], "left").join(got, [KEY, "cell"], "left")
    good = F.col("__s") == ""
    return out.select(
        KEY, "cell", "time", "portion", geo.wrap_longitude("lon").alias("linear_lon"), F.col("lat").alias("linear_lat"),
        geo.wrap_longitude(F.when(good, F.col("slon")).otherwise(F.col("lon"))).alias("lon"),
        F.when(good, F.col("slat")).otherwise(F.col("lat")).alias("lat"),
        F.coalesce("__s", F.lit("long_gap")).alias("fallback"))
