"""Spatial estimates of pair statistics in cells (SP rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwake.functions import geo, wgs84
from fleetwake.operators import frames, pairs as pr
from fleetwake.operators.thirdorder import FOUR_FIFTHS, support

KEY = "platform_id"
P1, P2 = f"{KEY}_1", f"{KEY}_2"


def pair_inventory(grid: DataFrame, group="array_id", max_first_m: float | None = None, spread: int = 1) -> DataFrame:
    """Every pair with a common position: first common distance, relation and whether it is admitted.

    The first common time comes from presence bits; only the positions at that time are joined, not every
    pair at every time. A platform counts once for each of its clusters.
    """
    rows = grid.where("x_m IS NOT NULL AND y_m IS NOT NULL").select(group, "time", F.struct(KEY, "cluster_id").alias(KEY), F.col("x_m").alias("lon"), F.col("y_m").alias("lat"))
    f = pr.first_common(rows, (group,), spread).withColumnRenamed("first_common", "time")
    for i in (1, 2):
        f = f.join(rows.select(group, "time", F.col(KEY).alias(f"{KEY}_{i}"), F.col("lon").alias(f"x_{i}"), F.col("lat").alias(f"y_{i}")), [group, "time", f"{KEY}_{i}"])
    f = f.select(group, F.col(f"{P1}.{KEY}").alias(P1), F.col(f"{P2}.{KEY}").alias(P2), F.col(f"{P1}.cluster_id").alias("cluster_id_1"), F.col(f"{P2}.cluster_id").alias("cluster_id_2"),
                 F.struct("time", F.hypot(F.col("x_2") - F.col("x_1"), F.col("y_2") - F.col("y_1")).alias("r")).alias("f"))
    within = F.col("cluster_id_1") == F.col("cluster_id_2")
    far = F.lit(False) if max_first_m is None else ~within & (F.col("f.r") > max_first_m)
    return f.select(group, P1, P2, "cluster_id_1", "cluster_id_2", F.when(within, "within_cluster").otherwise("between_clusters").alias("relation"),
                    F.col("f.time").alias("first_common"), F.col("f.r").alias("first_m"), (~far).alias("selected"),
                    F.when(far, "above_maximum_initial_distance").otherwise("selected").alias("selection_status"))


def observations(moving: DataFrame, inventory: DataFrame, group="array_id", *, low_m: float = 0.0, high_m: float = float("inf"), spread: int = 1) -> DataFrame:
    """Pair kinematics of admitted pairs inside a separation range."""
    o = pr.pair_observations(moving, (group,), within_m=high_m if high_m < float("inf") else None, spread=spread, listed=inventory.where("selected"))
    return o.where((F.col("r_m") > 0) & (F.col("r_m") >= low_m) & (F.col("r_m") <= high_m) & F.col("q").isNotNull())


def daily_windows(start_h: float, end_h: float, hours: float) -> list[tuple[str, float, float]]:
    """Consecutive half-open windows; the last may be short."""
    n = (end_h - start_h) / hours
    n = round(n) if abs(n - round(n)) < 1e-12 else int(n) + 1
    return [(f"day_{i + 1:03d}", start_h + i * hours, min(start_h + (i + 1) * hours, end_h)) for i in range(max(n, 1))]


def bands(edges: list[float], factor: float | None = None, manual=None) -> list[tuple[int, float, float | None, float]]:
    """(number, lower, upper, cell size): size = factor × lower edge (first positive edge for the first band) or manual."""
    bounds = [0.0, *edges, None]
    out = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        ref = a if a > 0 else b
        if manual is not None:
            size = manual[i] if isinstance(manual, (list, tuple)) else manual
        elif ref is None:
            raise ValueError("one comprehensive band needs a manual cell size")
        else:
            size = factor * ref
        out.append((i, a, b, float(size)))
    return out


def _apart(spans) -> bool:
    """Whether no two half-open spans overlap."""
    held = sorted((a, b) for a, b in spans if b > a)
    return all(b <= c for (_, b), (c, _) in zip(held, held[1:]))


def _within(df: DataFrame, value: str, spans: list[tuple[float, float, Column]], out: str) -> DataFrame:
    """Rows once for each half-open span that holds ``value``, with its struct ``out``; a plain CASE where spans do not overlap."""
    hit = lambda a, b: (F.col(value) >= a) & (F.col(value) < b)
    if _apart([(a, b) for a, b, _ in spans]):
        return df.withColumn(out, F.coalesce(*[F.when(hit(a, b), s) for a, b, s in spans])).where(F.col(out).isNotNull())
    return df.withColumn(out, F.explode(F.array(*[F.when(hit(a, b), s) for a, b, s in spans]))).where(F.col(out).isNotNull())


def _celled(obs: DataFrame, windows, bands_) -> DataFrame:
    o = _within(obs, "age_h", [(float(a), float(b), F.struct(F.lit(n).alias("id"))) for n, a, b in windows], "__w")
    s = [(float(a), float("inf") if b is None else float(b), F.struct(F.lit(i).alias("i"), F.lit(z).alias("z"))) for i, a, b, z in bands_]
    o = _within(o, "r_m", s, "__s")
    return o.select(
        *obs.columns, F.col("__w.id").alias("window"), F.col("__s.i").alias("band"), F.col("__s.z").alias("cell_m"),
        F.floor(F.col("mid_x") / F.col("__s.z")).cast("long").alias("cx"), F.floor(F.col("mid_y") / F.col("__s.z")).cast("long").alias("cy"))


def cells(obs: DataFrame, windows, bands_, by: list[str], *, need=(12, 3, 3, 12), enforce: bool = True) -> tuple[DataFrame, DataFrame]:
    """(estimates of the occupied cells, cluster shares with half a weight per endpoint).

    The rows are summed by pair in every cell; sums, shares and support follow from these sums.
    """
    g = [*by, "window", "band", "cx", "cy"]
    o = frames.cut(_celled(obs, windows, bands_).select(*g, "cell_m", P1, P2, "cluster_id_1", "cluster_id_2", "time", "r_m", "dul3"))
    each = frames.cut(o.groupBy(*g, "cell_m", P1, P2, "cluster_id_1", "cluster_id_2").agg(
        F.count(F.lit(1)).alias("n"), F.sum("r_m").alias("r_sum"), F.sum("dul3").alias("cube_sum")))
    a = each.groupBy(*g, "cell_m").agg(F.sum("r_sum").alias("r_sum"), F.sum("cube_sum").alias("cube_sum"))
    shares = each.select(*g, "n", F.explode(F.array("cluster_id_1", "cluster_id_2")).alias("cluster_id")).groupBy(*g, "cluster_id").agg((F.sum("n") / 2).alias("weight"))
    s = support(o, g, each)
    top = shares.groupBy(*g).agg(F.count(F.lit(1)).alias("clusters"), F.max("weight").alias("__m"))
    j = a.join(s, g).join(top, g)
    low = F.concat_ws(",", F.when(F.col("observations") < need[0], "observations"), F.when(F.col("pairs") < need[1], "unique_pairs"),
                      F.when(F.col("platforms") < need[2], "platforms"), F.when(F.col("utc") < need[3], "unique_utc"))
    j = j.withColumns({"dominant_fraction": F.col("__m") / F.col("observations"), "mean_r": F.col("r_sum") / F.col("observations"), "__low": low})
    j = j.withColumn("support_ok", F.col("__low") == "")
    shown = F.col("support_ok") if enforce else F.lit(True)
    j = j.withColumns({"epsilon": F.when(shown, FOUR_FIFTHS * F.col("cube_sum") / F.col("r_sum")),
                       "support_status": F.when(F.col("support_ok"), "supported").otherwise(F.concat(F.lit("below_minimum:"), F.col("__low")))}).drop("__m", "__low")
    part = shares.join(s.select(*g, "observations"), g).withColumn("fraction", F.col("weight") / F.col("observations")).drop("observations")
    return j, part


def occupied(obs: DataFrame, windows, bands_, by: list[str]) -> DataFrame:
    """The cells of :func:`cells` alone, without their estimates."""
    return _celled(obs, windows, bands_).select(*by, "window", "band", "cx", "cy", "cell_m").distinct()


def polygons(cells_: DataFrame) -> DataFrame:
    """Corners of every cell in geographic coordinates; needs lon0, lat0, cell_m, cx, cy."""
    corners = F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("cx") + i) * F.col("cell_m")).alias("x"), ((F.col("cy") + j) * F.col("cell_m")).alias("y")) for k, (i, j) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    c = cells_.withColumn("__c", F.explode(corners))
    x, y = F.col("__c.x"), F.col("__c.y")
    c = wgs84.with_direct(c, "__g", "lon0", "lat0", F.degrees(F.atan2(x, y)), F.hypot(x, y))
    keep = [n for n in cells_.columns]
    ring = F.array_sort(F.collect_list(F.struct(F.col("__c.k").alias("k"), F.col("__g.lon").alias("lon"), F.col("__g.lat").alias("lat"))))
    return c.groupBy(*keep).agg(ring.alias("__r")).withColumn("corners", F.transform("__r", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))).drop("__r")


def extent(polys: DataFrame, by: list[str], pad: float = 0.05) -> DataFrame:
    """Padded bounding box of all corners."""
    p = polys.select(*by, F.explode("corners").alias("c"))
    e = p.groupBy(*by).agg(F.min("c.lon").alias("w"), F.max("c.lon").alias("e"), F.min("c.lat").alias("s"), F.max("c.lat").alias("n"))
    dx, dy = (F.col("e") - F.col("w")) * pad, (F.col("n") - F.col("s")) * pad
    return e.select(*by, (F.col("w") - dx).alias("west"), (F.col("e") + dx).alias("east"), (F.col("s") - dy).alias("south"), (F.col("n") + dy).alias("north"))
