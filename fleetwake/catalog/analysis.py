"""Queries of separation bins, cells, first passages, dispersion, deformation and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwake.catalog.base import query, rnd, us
from fleetwake.catalog.gridded import GRID, MOVE, PAIRS, cells as grid_cells, fixes, moving, plane
from fleetwake.catalog.inputs import OBS, destination, events, geodesic
from fleetwake.functions import bins
from fleetwake.operators import affine, audit, dispersion, frames, grid, pairs, passage, raster, spatial, thirdorder

EDGES = bins.linear_edges(0.0, 40000.0, 4000.0)
T0 = 1704412800000000  # 2024-01-05, age zero of every array
BY = ["array_id"]
TOP = len(EDGES) - 2


def observed(spark, sf, within: float | None = EDGES[-1]):
    """Pair kinematics of every array with the age since T0, written once per query; pairs beyond the bins are not formed."""
    return paired(moving(spark, sf), within)


def paired(m, within: float | None = EDGES[-1]):
    """What a bin needs of a pair is written; what follows from it (powers, pair id, age) is derived on reading."""
    p = pairs.pair_observations(m, within_m=within)
    p = frames.cut(p.select("array_id", "time", pairs.P1, pairs.P2, "r_m", "dul", "dut", "mid_lat"))
    return pairs.derived(p).withColumn("age_h", (us("time") - T0) / F.lit(3600e6))


EP = f"""{PAIRS}, ep AS (SELECT *, (t - {T0})/3600e6 AS age, dul*dul*dul AS c, -1.25*dul*dul*dul/r AS q, CASE WHEN r = 40000 THEN {TOP} ELSE CAST(floor(r/4000) AS INTEGER) END AS bin FROM pr WHERE r > 0),
eb AS (SELECT * FROM ep WHERE r <= 40000)"""


@query("ep01_ep02_bin_index", f"WITH {EP} SELECT array_id, CASE WHEN r > 40000 THEN {TOP + 1} ELSE bin END AS bin, count(*) AS n FROM ep GROUP BY 1, 2")
def _(spark, sf):
    m = moving(spark, sf)
    near = paired(m)
    n = near.where("r_m > 0").withColumn("bin", bins.bin_index("r_m", EDGES)).groupBy("array_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    far = thirdorder.range_counts(near, EDGES, BY, pairs.possible_pairs(m)).where("over > 0")
    return n.unionByName(far.select("array_id", F.lit(TOP + 1).alias("bin"), F.col("over").alias("n")))


@query("ep01_geometric_bins", """SELECT event_id, CAST(CASE WHEN value < 1 THEN -1 WHEN value > 256 THEN 8 WHEN value = 256 THEN 7 ELSE floor(log2(value)) END AS INTEGER) AS bin FROM events""")
def _(spark, sf):
    return events(spark, sf).select(F.col("obs_index").alias("event_id"), bins.bin_index("value", bins.geometric_edges(1.0, 256.0, 2.0, 1.0)).alias("bin"))


@query("ep03_estimator", f"""WITH {EP} SELECT array_id, bin, count(*) AS n, round(avg(r), 3) AS mean_r, round(-1.25*sum(c)/sum(r)*1e15, 3) + 0.0 AS epsilon_e15, round(sum(r*q)/sum(r)*1e15, 3) + 0.0 AS weighted_q_e15 FROM eb GROUP BY 1, 2""")
def _(spark, sf):
    e = thirdorder.epsilon(thirdorder.binned(observed(spark, sf), EDGES), ["array_id", "bin"])
    return e.select("array_id", "bin", "n", rnd("mean_r", 3).alias("mean_r"), rnd(F.col("epsilon") * 1e15, 3).alias("epsilon_e15"), rnd(F.col("weighted_q") * 1e15, 3).alias("weighted_q_e15"))


@query("ep04_moments", f"""WITH {EP}, m AS (SELECT array_id, bin, avg(dul) AS m FROM eb GROUP BY 1, 2)
SELECT array_id, bin, round(any_value(m)*1e6, 4) + 0.0 AS mean_um, round(avg(dul*dul)*1e9, 4) AS raw2_e9, round(avg((dul-m)*(dul-m))*1e9, 4) AS var_e9,
 CASE WHEN avg((dul-m)*(dul-m)) > 0 THEN round(avg(pow(dul-m,3))/pow(avg((dul-m)*(dul-m)),1.5), 4) + 0.0 END AS skew, CASE WHEN avg((dul-m)*(dul-m)) > 0 THEN round(avg(pow(dul-m,4))/pow(avg((dul-m)*(dul-m)),2), 4) END AS flat FROM eb JOIN m USING (array_id, bin) GROUP BY 1, 2""")
def _(spark, sf):
    m = thirdorder.moments(thirdorder.binned(observed(spark, sf), EDGES), ["array_id", "bin"], "dul", "dul")
    return m.select("array_id", "bin", rnd(F.col("mean_dul") * 1e6, 4).alias("mean_um"), rnd(F.col("raw2_dul") * 1e9, 4).alias("raw2_e9"),
                    rnd(F.col("var_dul") * 1e9, 4).alias("var_e9"), rnd("skew_dul", 4).alias("skew"), rnd("flat_dul", 4).alias("flat"))


_DENSE = f"(SELECT DISTINCT array_id FROM ep) a CROSS JOIN (SELECT CAST(unnest(generate_series(0, {TOP})) AS INTEGER) AS bin) b"


@query("ep05_ep06_separation_bins", f"""WITH {EP}, s AS (SELECT array_id, bin, count(*) AS n, count(DISTINCT pair_id) AS np, count(DISTINCT t) AS nt, count(DISTINCT t // 3600000000) AS nh, avg(r) AS mr, -1.25*sum(c)/sum(r) AS e, max(abs(c))/sum(abs(c)) AS xf, abs(sum(c))/sum(abs(c)) AS can,
   pow(sum(abs(c)),2)/sum(c*c) AS eff, (max(t)-min(t))/3600e6 AS span, arg_max(c, abs(c)) AS xc, arg_max(r, abs(c)) AS xr, sum(c) AS sc, sum(r) AS sr, avg(mlat) AS ml, avg(dul*dul) AS s2 FROM eb GROUP BY 1, 2),
m AS (SELECT array_id, bin, count(DISTINCT p) AS pf FROM (SELECT array_id, bin, unnest([p1, p2]) AS p FROM eb) GROUP BY 1, 2),
t5 AS (SELECT array_id, bin, sum(x)/any_value(tot) AS f5 FROM (SELECT array_id, bin, abs(c) AS x, sum(abs(c)) OVER (PARTITION BY array_id, bin) AS tot, row_number() OVER (PARTITION BY array_id, bin ORDER BY abs(c) DESC) AS k FROM eb) WHERE k <= 5 GROUP BY 1, 2),
j AS (SELECT a.array_id, b.bin, s.* EXCLUDE (array_id, bin), pf, f5 FROM {_DENSE} LEFT JOIN s USING (array_id, bin) LEFT JOIN m USING (array_id, bin) LEFT JOIN t5 USING (array_id, bin))
SELECT array_id, bin, coalesce(n, 0) AS observations, coalesce(np, 0) AS pairs, coalesce(pf, 0) AS platforms, coalesce(nt, 0) AS utc, coalesce(nh, 0) AS occupied_hours, round(mr, 3) AS mean_r, round(e*1e15, 3) + 0.0 AS epsilon_e15,
 round(coalesce(xf, 0), 6) AS extreme_fraction, round(coalesce(f5, 0), 6) AS top_five_fraction, round(coalesce(can, 0), 6) AS cancellation, round(eff, 4) AS effective_count, round(span, 4) AS utc_span_h,
 round(CASE WHEN n > 1 THEN -1.25*(sc-xc)/(sr-xr)*1e15 END, 3) + 0.0 AS without_extreme_e15, round(sqrt(s2)/(abs(2*7.2921159e-5*sin(radians(ml)))*mr), 6) AS rossby,
 CASE WHEN n IS NULL THEN 'missing_no_observations' WHEN n >= 12 AND np >= 3 AND pf >= 3 AND nt >= 12 THEN 'supported' ELSE 'low_support_' || concat_ws('_', CASE WHEN n < 12 THEN 'observations' END, CASE WHEN np < 3 THEN 'pairs' END, CASE WHEN pf < 3 THEN 'platforms' END, CASE WHEN nt < 12 THEN 'utc' END) END AS support_status FROM j""")
def _(spark, sf):
    m = moving(spark, sf)
    s = thirdorder.separation_bins(paired(m), EDGES, BY, groups=pairs.possible_pairs(m))
    return s.select("array_id", "bin", "observations", "pairs", "platforms", "utc", "occupied_hours", rnd("mean_r", 3).alias("mean_r"), rnd(F.col("epsilon") * 1e15, 3).alias("epsilon_e15"),
                    rnd(F.coalesce("extreme_fraction", F.lit(0.0))).alias("extreme_fraction"), rnd(F.coalesce("top_five_fraction", F.lit(0.0))).alias("top_five_fraction"), rnd(F.coalesce("cancellation", F.lit(0.0))).alias("cancellation"),
                    rnd("effective_count", 4).alias("effective_count"), rnd("utc_span_h", 4).alias("utc_span_h"), rnd(F.col("epsilon_without_extreme") * 1e15, 3).alias("without_extreme_e15"), rnd("rossby").alias("rossby"), "support_status")


@query("ep07_range_counts", f"WITH {EP} SELECT array_id, count(*) AS total, count_if(r <= 40000) AS in_bins, 0::BIGINT AS under, count_if(r > 40000) AS over FROM ep GROUP BY 1")
def _(spark, sf):
    m = moving(spark, sf)
    return thirdorder.range_counts(paired(m), EDGES, BY, pairs.possible_pairs(m)).drop("invalid")


@query("ep08_distribution_summary", f"""WITH {EP}, l AS (SELECT 'r_m' AS metric, r AS v FROM ep UNION ALL SELECT 'dul_mm', dul*1e3 FROM ep)
SELECT metric, count(*) AS count, round(min(v), 4) AS minimum, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.5), 4) + 0.0 AS median, round(quantile_cont(v, 0.99), 4) AS p99, round(max(v), 4) AS maximum, round(stddev_pop(v), 4) AS standard_deviation FROM l GROUP BY 1""")
def _(spark, sf):
    p = pairs.pair_observations(moving(spark, sf)).where("r_m > 0")
    d = frames.cut(p.select("r_m", "dul")).withColumn("dul_mm", F.col("dul") * 1e3)
    s = thirdorder.distribution_summary(d, ["r_m", "dul_mm"])
    return s.select("metric", "count", *[rnd(c, 4).alias(c) for c in ("minimum", "p05", "median", "p99", "maximum", "standard_deviation")])


WIN = [("w0_48", 0.0, 48.0), ("w0_120", 0.0, 120.0), ("w120_240", 120.0, 240.0)]
_WINSQL = "(VALUES ('w0_48', 0, 48), ('w0_120', 0, 120), ('w120_240', 120, 240)) w(win, a, b)"


@query("ep09_windows_and_snapshot", f"""WITH {EP} SELECT win AS "window", array_id, count(*) AS n FROM ep JOIN {_WINSQL} ON age >= a AND age < b GROUP BY 1, 2
UNION ALL SELECT 'snapshot', array_id, count(*) FROM ep WHERE age = 0 GROUP BY 2 UNION ALL SELECT 'union', array_id, count(*) FROM ep WHERE age >= 0 AND age < 240 GROUP BY 2""")
def _(spark, sf):
    o = observed(spark, sf, None).where("r_m > 0")
    w, s = thirdorder.windowed(o, WIN), thirdorder.snapshot(o)
    u = thirdorder.union_once(w, s).withColumn("window", F.lit("union"))
    count = lambda d: d.groupBy("window", "array_id").agg(F.count(F.lit(1)).alias("n"))
    return count(w).unionByName(count(s)).unionByName(count(u))


QE = bins.symmetric_log_edges(1e-10, 1e-13, 1)


@query("ep10_ep11_q_histogram", f"""WITH {EP}, h AS (SELECT array_id, bin, q, CASE WHEN q < {QE[0]!r} THEN -1 WHEN q > {QE[-1]!r} THEN {len(QE) - 1} WHEN q = {QE[-1]!r} THEN {len(QE) - 2} ELSE {' + '.join(f'CASE WHEN q >= {e!r}::DOUBLE THEN 1 ELSE 0 END' for e in QE)} - 1 END AS qb FROM eb),
c AS (SELECT array_id, bin, qb, count(*) AS n FROM h GROUP BY 1, 2, 3), t AS (SELECT array_id, bin, count(*) AS column_n, count_if(qb >= 0 AND qb <= {len(QE) - 2}) AS ir FROM h GROUP BY 1, 2)
SELECT a.array_id, b.bin, qb.q_bin, coalesce(n, 0) AS n, coalesce(column_n, 0) AS column_n, CASE WHEN ir > 0 THEN round(coalesce(n, 0)/ir, 6) END AS mass
FROM {_DENSE} CROSS JOIN (SELECT CAST(unnest(generate_series(0, {len(QE) - 2})) AS INTEGER) AS q_bin) qb LEFT JOIN c ON c.array_id = a.array_id AND c.bin = b.bin AND c.qb = qb.q_bin LEFT JOIN t ON t.array_id = a.array_id AND t.bin = b.bin""")
def _(spark, sf):
    m = moving(spark, sf)
    h = thirdorder.q_histogram(paired(m).where("r_m > 0"), EDGES, QE, BY, groups=pairs.possible_pairs(m))
    return h.select("array_id", "bin", "q_bin", "n", "column_n", rnd("mass").alias("mass"))


@query("ep12_block_bootstrap")
def _(spark, sf):
    o = thirdorder.windowed(observed(spark, sf), [("w", 0.0, 240.0)])
    b = thirdorder.block_bootstrap(o, EDGES, BY, start_h=0, end_h=240, block_min=720, replicates=200, seed=7)
    return b.select("array_id", "bin", "contributing_blocks", "successful", rnd(F.col("ci_lower") * 1e15, 2).alias("lo_e15"), rnd(F.col("ci_upper") * 1e15, 2).alias("hi_e15"), "status")


LOPO = f"""{EP}, pl0 AS (SELECT DISTINCT array_id, bin, p FROM (SELECT array_id, bin, unnest([p1, p2]) AS p FROM eb)),
k AS (SELECT l.array_id, l.bin, l.p, e.* EXCLUDE (array_id, bin) FROM pl0 l LEFT JOIN eb e ON e.array_id = l.array_id AND e.bin = l.bin AND e.p1 <> l.p AND e.p2 <> l.p),
b0 AS (SELECT array_id, bin, -1.25*sum(c)/sum(r) AS base FROM eb GROUP BY 1, 2),
kp AS (SELECT array_id, bin, p, count(DISTINCT o) AS rp FROM (SELECT array_id, bin, p, unnest([p1, p2]) AS o FROM k) GROUP BY 1, 2, 3),
lo AS (SELECT k.array_id, k.bin, k.p, count(k.r) AS n, count(DISTINCT pair_id) AS np, count(DISTINCT t) AS nt, CASE WHEN count(k.r) > 0 THEN -1.25*sum(c)/sum(r) END AS e FROM k GROUP BY 1, 2, 3)"""


@query("ep13_leave_one_out", f"""WITH {LOPO} SELECT lo.array_id, lo.bin, lo.p AS removed_platform, round(base*1e15, 3) + 0.0 AS baseline_e15, round(e*1e15, 3) + 0.0 AS after_e15, n AS remaining_observations, np AS remaining_pairs, coalesce(rp, 0) AS remaining_platforms, nt AS remaining_utc,
 n >= 12 AND np >= 3 AND coalesce(rp, 0) >= 3 AND nt >= 12 AS support_ok FROM lo JOIN b0 USING (array_id, bin) LEFT JOIN kp ON kp.array_id = lo.array_id AND kp.bin = lo.bin AND kp.p = lo.p""")
def _(spark, sf):
    l = thirdorder.leave_one_out(observed(spark, sf), EDGES, BY)
    return l.select("array_id", "bin", "removed_platform", rnd(F.col("baseline") * 1e15, 3).alias("baseline_e15"), rnd(F.col("epsilon_after") * 1e15, 3).alias("after_e15"),
                    "remaining_observations", "remaining_pairs", "remaining_platforms", "remaining_utc", "support_ok")


@query("ep14_influence", f"""WITH {LOPO} SELECT lo.array_id, lo.bin, count(e) AS evaluable, round(max(abs(e - base))*1e15, 3) AS max_change_e15, coalesce(bool_or(sign(e) <> sign(base) AND e <> 0 AND base <> 0), false) AS any_sign_reversal FROM lo JOIN b0 USING (array_id, bin) GROUP BY 1, 2""")
def _(spark, sf):
    i = thirdorder.influence(thirdorder.leave_one_out(observed(spark, sf), EDGES, BY), BY)
    return i.select("array_id", "bin", "evaluable", rnd(F.col("max_change") * 1e15, 3).alias("max_change_e15"), "any_sign_reversal")


@query("ep15_time_contributions", f"""WITH {EP}, d AS (SELECT array_id, bin, sum(r) AS sr FROM eb GROUP BY 1, 2)
SELECT array_id, bin, t AS t_us, count(*) AS n, round(-1.25*sum(c)/any_value(sr)*1e15, 3) + 0.0 AS contribution_e15, round(sum(CASE WHEN c > 0 THEN c ELSE 0 END)*1e9, 3) + 0.0 AS positive_e9, round(sum(abs(c))*1e9, 3) AS absolute_e9, arg_max(pair_id, abs(c)) AS leading_pair FROM eb JOIN d USING (array_id, bin) GROUP BY 1, 2, 3""")
def _(spark, sf):
    c = thirdorder.time_contributions(observed(spark, sf), EDGES, BY)
    return c.select("array_id", "bin", us("time").alias("t_us"), "n", rnd(F.col("contribution") * 1e15, 3).alias("contribution_e15"), rnd(F.col("positive_sum") * 1e9, 3).alias("positive_e9"),
                    rnd(F.col("absolute_sum") * 1e9, 3).alias("absolute_e9"), "leading_pair")


@query("ep16_influence_audit", f"""WITH {LOPO}, s AS (SELECT array_id, bin, -1.25*sum(c)/sum(r) AS e, coalesce(max(abs(c))/nullif(sum(abs(c)), 0), 0) AS xf, CASE WHEN count(*) > 1 THEN -1.25*(sum(c) - arg_max(c, abs(c)))/nullif(sum(r) - arg_max(r, abs(c)), 0) END AS we,
  count(*) >= 12 AND count(DISTINCT pair_id) >= 3 AND count(DISTINCT t) >= 12 AS enough FROM eb GROUP BY 1, 2),
m AS (SELECT array_id, bin, count(DISTINCT p) >= 3 AS several FROM pl0 GROUP BY 1, 2),
d AS (SELECT array_id, bin, count(e) AS removals, count_if(sign(e) <> sign(base) AND e <> 0 AND base <> 0) AS reversals, max(abs(e - base))/abs(any_value(base)) AS mr FROM lo JOIN b0 USING (array_id, bin) GROUP BY 1, 2)
SELECT array_id, bin, CASE WHEN NOT (enough AND several) THEN 'low_support' WHEN we > 0 AND reversals > 0 THEN 'event_and_platform_sign_sensitive' WHEN we > 0 THEN 'event_sign_sensitive' WHEN reversals > 0 THEN 'platform_sign_sensitive'
  WHEN xf >= 0.1 AND mr >= 0.5 THEN 'observation_and_platform_concentrated' WHEN xf >= 0.1 THEN 'observation_concentrated' WHEN mr >= 0.5 THEN 'platform_sensitive_without_sign_reversal'
  WHEN we IS NOT NULL AND removals > 0 THEN 'persistent_negative_under_tested_removals' ELSE 'influence_test_incomplete' END AS classification, removals, reversals
FROM s JOIN m USING (array_id, bin) LEFT JOIN d USING (array_id, bin) WHERE e < 0 AND (bin + 0.5)*4000 <= 30000""")
def _(spark, sf):
    o = observed(spark, sf)
    s = frames.cut(thirdorder.separation_bins(o, EDGES, BY))
    d = frames.cut(thirdorder.leave_one_out(o, EDGES, BY))
    a = thirdorder.influence_audit(s, d, BY, small_scale_m=30000, dominant_observation=0.1, dominant_platform=0.5)
    return a.select("array_id", "bin", "classification", "removals", "reversals")


def _inventory(m):
    return spatial.pair_inventory(m, max_first_m=15000.0)


def _spatial(spark, sf):
    """Observations of the admitted pairs; every query reads them once."""
    m = moving(spark, sf)
    return spatial.observations(m, frames.cut(_inventory(m)), low_m=100.0, high_m=60000.0).withColumn("age_h", (us("time") - T0) / F.lit(3600e6))


BANDS = spatial.bands([5000.0, 15000.0], factor=1.0)
SPW = spatial.daily_windows(0.0, 500.0, 120.0)
SP = f"""{PAIRS}, fc AS (SELECT a.array_id, a.platform_id AS p1, b.platform_id AS p2, any_value(a.cluster_id) AS c1, any_value(b.cluster_id) AS c2, arg_min(sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)), a.t) AS r0 FROM mv a JOIN mv b ON a.array_id = b.array_id AND a.t = b.t AND a.platform_id < b.platform_id WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2, 3),
so AS (SELECT pr.*, dul*dul*dul AS c, (pr.t - {T0})/3600e6 AS age FROM pr JOIN fc USING (array_id, p1, p2) WHERE (fc.c1 = fc.c2 OR r0 <= 15000) AND r BETWEEN 100 AND 60000),
sw AS (SELECT so.*, 'day_' || lpad(CAST(CAST(floor(age/120) AS INTEGER) + 1 AS VARCHAR), 3, '0') AS win, CASE WHEN r < 5000 THEN 0 WHEN r < 15000 THEN 1 ELSE 2 END AS band, CASE WHEN r < 5000 THEN 5000 WHEN r < 15000 THEN 5000 ELSE 15000 END AS z FROM so WHERE age >= 0 AND age < 500),
sc AS (SELECT *, CAST(floor(mx/z) AS BIGINT) AS cx, CAST(floor(my/z) AS BIGINT) AS cy FROM sw)"""


@query("sp01_pair_inventory", f"WITH {SP} SELECT p1 AS platform_id_1, p2 AS platform_id_2, round(r0, 3) AS first_m, c1 = c2 OR r0 <= 15000 AS selected FROM fc")
def _(spark, sf):
    return _inventory(moving(spark, sf)).select("platform_id_1", "platform_id_2", rnd("first_m", 3).alias("first_m"), "selected")


@query("sp02_sp03_sp04_cells", f"""WITH {SP}, p AS (SELECT array_id, win, band, cx, cy, count(DISTINCT q) AS platforms FROM (SELECT array_id, win, band, cx, cy, unnest([p1, p2]) AS q FROM sc) GROUP BY ALL),
k AS (SELECT array_id, win, band, cx, cy, max(w) AS mw, count(*) AS clusters FROM (SELECT array_id, win, band, cx, cy, q, count(*)/2 AS w FROM (SELECT array_id, win, band, cx, cy, unnest([c1, c2]) AS q FROM sc) GROUP BY ALL) GROUP BY ALL)
SELECT sc.array_id, sc.win AS "window", sc.band, sc.cx, sc.cy, count(*) AS observations, count(DISTINCT pair_id) AS pairs, any_value(platforms) AS platforms, count(DISTINCT t) AS utc, any_value(clusters) AS clusters, round(any_value(mw)/count(*), 6) AS dominant_fraction,
 CASE WHEN count(*) >= 12 AND count(DISTINCT pair_id) >= 3 AND any_value(platforms) >= 3 AND count(DISTINCT t) >= 12 THEN round(-1.25*sum(c)/sum(r)*1e15, 3) + 0.0 END AS epsilon_e15
FROM sc JOIN p ON p.array_id = sc.array_id AND p.win = sc.win AND p.band = sc.band AND p.cx = sc.cx AND p.cy = sc.cy JOIN k ON k.array_id = sc.array_id AND k.win = sc.win AND k.band = sc.band AND k.cx = sc.cx AND k.cy = sc.cy GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    o = _spatial(spark, sf)
    c, _ = spatial.cells(o, SPW, BANDS, BY)
    return c.select("array_id", "window", "band", "cx", "cy", "observations", "pairs", "platforms", "utc", "clusters", rnd("dominant_fraction").alias("dominant_fraction"), rnd(F.col("epsilon") * 1e15, 3).alias("epsilon_e15"))


@query("sp05_cluster_contributions", f"""WITH {SP}, n AS (SELECT array_id, win, band, cx, cy, count(*) AS n FROM sc GROUP BY ALL),
u AS (SELECT array_id, win, band, cx, cy, q, count(*)/2 AS w FROM (SELECT array_id, win, band, cx, cy, unnest([c1, c2]) AS q FROM sc) GROUP BY ALL)
SELECT array_id, win AS "window", band, cx, cy, q AS cluster_id, w AS weight, round(w/n, 6) AS fraction FROM u JOIN n USING (array_id, win, band, cx, cy)""")
def _(spark, sf):
    o = _spatial(spark, sf)
    _, part = spatial.cells(o, SPW, BANDS, BY)
    return part.withColumn("fraction", rnd("fraction"))


@query("sp06_cell_extent", f"""WITH {SP}, cq AS (SELECT DISTINCT array_id, win, band, cx, cy, z FROM sc),
co AS (SELECT array_id, 130.0 AS lo0, 20.0 AS la0, degrees(atan2((cx + i)*z, (cy + j)*z)) AS az, sqrt(pow((cx + i)*z, 2) + pow((cy + j)*z, 2)) AS dist FROM cq, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
{destination("co")}, ex AS (SELECT array_id, min(lo) AS w, max(lo) AS e, min(la) AS s, max(la) AS n FROM dst GROUP BY 1)
SELECT array_id, round(w - (e - w)*0.05, 5) AS west, round(e + (e - w)*0.05, 5) AS east, round(s - (n - s)*0.05, 5) AS south, round(n + (n - s)*0.05, 5) AS north FROM ex""")
def _(spark, sf):
    c = spatial.occupied(_spatial(spark, sf), SPW, BANDS, BY)
    p = spatial.polygons(c.select("array_id", "window", "band", "cx", "cy", "cell_m").withColumns({"lon0": F.lit(130.0), "lat0": F.lit(20.0)}))
    e = spatial.extent(p, BY)
    return e.select("array_id", *[rnd(x, 5).alias(x) for x in ("west", "east", "south", "north")])


FE = bins.geometric_edges(1.0, 20.0, 1.1, 1.0)


def distances(spark, sf):
    """Distances of cluster pairs on the grid from their first common position; NULL where one is missing."""
    g = plane(spark, sf)
    p = frames.salted_pairs(g.select("array_id", "cluster_id", "time", "platform_id", "x_m", "y_m"), ["array_id", "cluster_id", "time"], "platform_id")
    p = p.select("array_id", "cluster_id", "time", F.concat_ws("|", "platform_id_1", "platform_id_2").alias("pair_id"),
                 (F.hypot(F.col("x_m_2") - F.col("x_m_1"), F.col("y_m_2") - F.col("y_m_1")) / 1000).alias("distance_km"))
    p = frames.cut(p)
    s = p.where("distance_km IS NOT NULL").groupBy("pair_id").agg(F.min("time").alias("s"))
    return frames.cut(p.join(s, "pair_id").where("time >= s").drop("s"))


FK = ("pair_id", "array_id", "cluster_id")
_SH = "(SELECT CAST(i - 1 AS INTEGER) AS shell, e[i] AS lo, e[i+1] AS hi FROM (SELECT [" + ", ".join(f"{x!r}::DOUBLE" for x in FE) + f"] AS e, unnest(generate_series(1, {len(FE) - 1})) AS i))"
FS = f"""{MOVE}, d0 AS (SELECT a.array_id, a.cluster_id, a.platform_id || '|' || b.platform_id AS pair_id, a.t, sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2))/1000 AS d FROM pl a JOIN pl b ON a.cluster_id = b.cluster_id AND a.t = b.t AND a.platform_id < b.platform_id),
ds AS (SELECT d0.* FROM d0 JOIN (SELECT pair_id, min(t) AS s FROM d0 WHERE d IS NOT NULL GROUP BY 1) USING (pair_id) WHERE t >= s),
bd AS (SELECT *, CASE WHEN d IS NULL THEN 'missing_coordinate_or_time' WHEN t - lag(t) OVER (PARTITION BY pair_id ORDER BY t) <> 21600000000 THEN 'time_step_mismatch' END AS bad FROM ds),
tm AS (SELECT pair_id, any_value(array_id) AS array_id, any_value(cluster_id) AS cluster_id, min(CASE WHEN bad IS NOT NULL THEN t END) AS stop, coalesce(arg_min(bad, t) FILTER (WHERE bad IS NOT NULL), 'track_end') AS why FROM bd GROUP BY 1),
okr AS (SELECT bd.* FROM bd JOIN tm USING (pair_id) WHERE stop IS NULL OR t < stop),
sh AS {_SH},
en AS (SELECT pair_id, shell, min(t) AS et, arg_min(d, t) AS ed FROM okr JOIN sh ON d >= lo AND d < hi GROUP BY 1, 2),
xt AS (SELECT en.pair_id, en.shell, min(t) AS xt, arg_min(d, t) AS xd FROM en JOIN sh USING (shell) JOIN okr ON okr.pair_id = en.pair_id AND t > et AND d > hi GROUP BY 1, 2),
fp AS (SELECT tm.pair_id, array_id, cluster_id, sh.shell, lo, hi, why, et, ed, xt, xd, CASE WHEN et IS NULL THEN CASE WHEN why = 'track_end' THEN 'not_observed_in_shell' ELSE 'not_observed_before_gap' END
  WHEN xt IS NULL THEN CASE WHEN why = 'track_end' THEN 'right_censored_track_end' ELSE 'right_censored_gap' END ELSE 'reached' END AS status, (xt - et)/86400e6 AS days, ln(xd/ed) AS growth
  FROM tm CROSS JOIN sh LEFT JOIN en ON en.pair_id = tm.pair_id AND en.shell = sh.shell LEFT JOIN xt ON xt.pair_id = tm.pair_id AND xt.shell = sh.shell)"""


@query("fs01_fs02_contiguous_prefix", f"WITH {FS} SELECT tm.pair_id, why AS termination_reason, count(*) AS n FROM tm JOIN okr USING (pair_id) GROUP BY 1, 2")
def _(spark, sf):
    ok, end = passage.contiguous(distances(spark, sf), 21600)
    return ok.join(end, "pair_id").groupBy("pair_id", "termination_reason").agg(F.count(F.lit(1)).alias("n"))


@query("fs03_first_passages", f"WITH {FS} SELECT pair_id, shell, status, why AS termination_reason, et AS entry_us, xt AS exit_us, round(ed, 5) AS entry_km, round(days, 5) AS passage_days, round(growth, 5) AS log_growth FROM fp")
def _(spark, sf):
    p = passage.first_passages(distances(spark, sf), FE, 21600, FK)
    return p.select("pair_id", "shell", "status", "termination_reason", us("entry_time").alias("entry_us"), us("exit_time").alias("exit_us"), rnd("entry_km", 5).alias("entry_km"),
                    rnd("passage_days", 5).alias("passage_days"), rnd("log_growth", 5).alias("log_growth"))


@query("fs04_observed_passages_strict", f"""WITH {FS}, v AS (SELECT *, lag(d) OVER w AS pd, lag(t) OVER w AS pt FROM ds WINDOW w AS (PARTITION BY pair_id ORDER BY t)),
e AS (SELECT pair_id, shell, min(t) AS et, arg_min(d, t) AS ed FROM v JOIN sh ON d >= lo AND d < hi AND ((pd < lo AND t - pt = 21600000000) OR (pt IS NULL AND d = lo)) GROUP BY 1, 2),
x AS (SELECT e.pair_id, e.shell, min(t) AS xt, arg_min(d, t) AS xd FROM e JOIN sh USING (shell) JOIN v ON v.pair_id = e.pair_id AND t > et AND d >= hi GROUP BY 1, 2),
f AS (SELECT e.pair_id, e.shell, min(CASE WHEN v.d IS NULL OR (t > et AND t - pt <> 21600000000) THEN t END) AS ft, arg_min(CASE WHEN v.d IS NULL THEN 'missing_pair_position' ELSE 'time_step_mismatch' END, t) FILTER (WHERE v.d IS NULL OR (t > et AND t - pt <> 21600000000)) AS why
  FROM e LEFT JOIN x USING (pair_id, shell) JOIN v ON v.pair_id = e.pair_id AND t >= et AND (xt IS NULL OR t <= xt) GROUP BY 1, 2)
SELECT p.pair_id, sh.shell, et AS entry_us, CASE WHEN et IS NULL THEN 'not_observed_entry' WHEN ft IS NOT NULL THEN 'right_censored_gap' WHEN xt IS NULL THEN 'right_censored_track_end' ELSE 'reached' END AS status,
 CASE WHEN et IS NULL THEN 'no_witnessed_entry' WHEN ft IS NOT NULL THEN f.why WHEN xt IS NULL THEN 'track_end' ELSE 'upper_threshold_reached' END AS termination_reason, CASE WHEN ft IS NULL AND xt IS NOT NULL THEN round(ln(xd/ed), 5) END AS log_growth
FROM (SELECT DISTINCT pair_id FROM ds) p CROSS JOIN sh LEFT JOIN e ON e.pair_id = p.pair_id AND e.shell = sh.shell LEFT JOIN x ON x.pair_id = p.pair_id AND x.shell = sh.shell LEFT JOIN f ON f.pair_id = p.pair_id AND f.shell = sh.shell""")
def _(spark, sf):
    p = passage.observed_passages(distances(spark, sf), FE, 21600, keys=FK)
    return p.select("pair_id", "shell", us("entry_time").alias("entry_us"), "status", "termination_reason", rnd("log_growth", 5).alias("log_growth"))


@query("fs04_observed_passages_bridging", f"""WITH {FS}, g0 AS (SELECT *, 360 + (t // 21600000000) % 29*100 AS gapm FROM ds),
v AS (SELECT *, d IS NOT NULL AND gapm > 2880 AS hard, d IS NOT NULL AND gapm <= 2880 AS ok FROM g0),
w AS (SELECT *, lag(d) OVER p AS pd, lag(t) OVER p AS pt, coalesce(lag(ok) OVER p, false) AS pok,
  CASE WHEN ok THEN (t - last_value(CASE WHEN ok THEN t END IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))/6e7 END AS gap
  FROM v WINDOW p AS (PARTITION BY pair_id ORDER BY t)),
e AS (SELECT pair_id, shell, min(t) AS et FROM w JOIN sh ON ok AND d >= lo AND d < hi AND ((pok AND pd < lo AND t - pt = 21600000000) OR (pt IS NULL AND d = lo)) GROUP BY 1, 2),
x AS (SELECT e.pair_id, e.shell, min(t) AS xt FROM e JOIN sh USING (shell) JOIN w ON w.pair_id = e.pair_id AND t > et AND ok AND d >= hi GROUP BY 1, 2),
sg AS (SELECT e.pair_id, e.shell, et, w.*, CASE WHEN hard THEN 'source_gap_limit' WHEN t > et AND gap > 2880 THEN 'elapsed_gap_limit' END AS fault
  FROM e LEFT JOIN x USING (pair_id, shell) JOIN w ON w.pair_id = e.pair_id AND t >= et AND (xt IS NULL OR t <= xt)),
f AS (SELECT pair_id, shell, arg_min(fault, t) FILTER (WHERE fault IS NOT NULL) AS why, count_if(NOT ok) AS missing, coalesce(max(gap) FILTER (WHERE t > et), 0) AS mg FROM sg GROUP BY 1, 2)
SELECT p.pair_id, sh.shell, CASE WHEN et IS NULL THEN 'not_observed_entry' WHEN why IS NOT NULL THEN 'right_censored_gap' WHEN xt IS NULL THEN 'right_censored_track_end' ELSE 'reached' END AS status,
 CASE WHEN et IS NULL THEN 'no_witnessed_entry' WHEN why IS NOT NULL THEN why WHEN xt IS NULL THEN 'track_end' ELSE 'upper_threshold_reached' END AS termination_reason, coalesce(missing, 0) AS missing_count, round(mg, 3) AS max_gap_min
FROM (SELECT DISTINCT pair_id FROM ds) p CROSS JOIN sh LEFT JOIN e ON e.pair_id = p.pair_id AND e.shell = sh.shell LEFT JOIN x ON x.pair_id = p.pair_id AND x.shell = sh.shell LEFT JOIN f ON f.pair_id = p.pair_id AND f.shell = sh.shell""")
def _(spark, sf):
    gap = 360 + F.floor(us("time") / F.lit(21_600_000_000)) % 29 * 100
    d = distances(spark, sf).withColumn("source_gap_min", gap.cast("double"))
    p = passage.observed_passages(d, FE, 21600, policy="bridge_missing", max_gap_min=2880.0, keys=FK)
    return p.select("pair_id", "shell", "status", "termination_reason", "missing_count", rnd("max_gap_min", 3).alias("max_gap_min"))


PICK = f"""{GRID}, g AS (SELECT platform_id, user_id // 20 AS array_id, user_id // 5 AS cluster_id, t, gap, lon, lat FROM gr WHERE lon IS NOT NULL),
pr AS (SELECT a.platform_id AS p1, b.platform_id AS p2, a.array_id, a.cluster_id AS k1, b.cluster_id AS k2, a.t, a.lon AS lo0, a.lat AS la0, b.lon AS lo1, b.lat AS la1, a.gap <= 1440 AND b.gap <= 1440 AS held
  FROM g a JOIN g b ON a.array_id = b.array_id AND a.t = b.t AND a.platform_id < b.platform_id), {geodesic("pr")},
mi AS (SELECT p1, p2, any_value(k1) AS k1, any_value(k2) AS k2, min(s) FILTER (WHERE held)/1000 AS md, arg_min(t, s) FILTER (WHERE held) AS mt, min(t) FILTER (WHERE held) AS f, max(t) AS e FROM geo GROUP BY 1, 2),
pk AS (SELECT *, CASE WHEN k1 = k2 THEN 'within_cluster' ELSE 'chance' END AS kind FROM mi WHERE md IS NOT NULL AND (k1 = k2 OR md <= 4))"""


def picked(spark, sf):
    return passage.pair_catalogue(plane(spark, sf), chance_km=4.0, max_gap_min=1440.0)


@query("fs05_pair_catalogue", f"""WITH {PICK} SELECT p1 || '|' || p2 AS pair_id, kind, round(md, 5) AS min_distance_km, CASE WHEN kind = 'chance' THEN mt ELSE f END AS start_us, e AS end_us FROM pk""")
def _(spark, sf):
    c = picked(spark, sf)
    return c.select("pair_id", "kind", rnd("min_distance_km", 5).alias("min_distance_km"), us("analysis_start").alias("start_us"), us("analysis_end").alias("end_us"))


SETS = [("pooled", ["array_id"]), ("cluster", ["array_id", "cluster_id"])]
_SPEC = """SELECT {scope} AS scope, array_id, {cl} AS cluster_id, shell, count_if(status = 'reached') AS reached, count_if(status IN ('reached', 'right_censored_track_end', 'right_censored_gap')) AS at_risk, avg(days) AS md, avg(growth) AS mg, avg(growth*growth/days) AS g2, median(days) AS med, any_value(lo) AS lo, any_value(hi) AS hi FROM fp GROUP BY array_id, {gcl} shell"""
SPEC = f"{FS}, sp0 AS ({_SPEC.format(scope=chr(39) + 'pooled' + chr(39), cl='NULL::BIGINT', gcl='')} UNION ALL {_SPEC.format(scope=chr(39) + 'cluster' + chr(39), cl='cluster_id', gcl='cluster_id, ')}), spx AS (SELECT *, mg/md AS fsle FROM sp0)"


@query("fs06_fs07_spectra", f"""WITH {SPEC} SELECT scope, array_id, cluster_id, shell, reached, at_risk, round(fsle, 5) AS fsle, round(CASE WHEN reached >= 2 THEN sqrt(greatest(0, g2/md - fsle*fsle)/reached) END, 4) AS fsle_se, round(med, 5) AS median_days FROM spx""")
def _(spark, sf):
    p = frames.cut(passage.first_passages(distances(spark, sf), FE, 21600, FK))
    s = passage.spectrum(p, FE, SETS)
    return s.select("scope", "array_id", "cluster_id", "shell", "reached", "at_risk", rnd("fsle", 5).alias("fsle"), rnd("fsle_se", 4).alias("fsle_se"), rnd("median_days", 5).alias("median_days"))


@query("fs08_power_fits", f"""WITH {SPEC}, e AS (SELECT scope, array_id, cluster_id, CASE WHEN reached >= 3 AND fsle > 0 AND lo >= 2*(1-1e-12) AND hi <= 16*(1+1e-12) THEN ln(fsle/86400) + 2/3.0*ln(lo*1000) END AS v FROM spx)
SELECT scope, array_id, count(v) AS shells, CASE WHEN count(v) >= 2 THEN round(avg(v), 5) END AS log_a, CASE WHEN count(v) >= 2 THEN round(sqrt(var_pop(v)), 5) END AS log_rmse FROM e WHERE scope = 'pooled' GROUP BY 1, 2""")
def _(spark, sf):
    p = frames.cut(passage.first_passages(distances(spark, sf), FE, 21600, FK))
    f = passage.power_fits(passage.spectrum(p, FE, SETS[:1]), [("richardson", -2 / 3, 2.0, 16.0)], ["scope", "array_id"])
    return f.select("scope", "array_id", "shells", rnd(F.log("coefficient"), 5).alias("log_a"), rnd("log_rmse", 5).alias("log_rmse"))


@query("fs09_cluster_inventory", f"""WITH {PICK}, n AS (SELECT user_id // 5 AS cluster_id, count(DISTINCT user_id) AS members FROM events GROUP BY 1),
w AS (SELECT k1 AS cluster_id, count(*) AS k FROM pk WHERE kind = 'within_cluster' GROUP BY 1)
SELECT cluster_id, members, members*(members-1)//2 AS possible_pairs, coalesce(k, 0) AS selected_pairs, members = 5 AS size_ok FROM n LEFT JOIN w USING (cluster_id)""")
def _(spark, sf):
    p = events(spark, sf).select("user_id").distinct().select(F.floor(F.col("user_id") / 5).cast("long").alias("cluster_id"), F.lit(5).alias("cluster_size"))
    return passage.cluster_inventory(p, picked(spark, sf)).select("cluster_id", "members", "possible_pairs", "selected_pairs", "size_ok")


def aged(spark, sf):
    m = moving(spark, sf)
    return frames.cut(m.withColumn("age_h", (us("time") - T0) / F.lit(3600e6)))


AGE = f"{MOVE}, ag0 AS (SELECT *, (t - {T0})/3600e6 AS age FROM mv)"
CLOSE = f"""{AGE}, an AS (SELECT * FROM ag0 WHERE age = 0 AND x IS NOT NULL),
cp AS (SELECT a.array_id, a.platform_id AS p1, b.platform_id AS p2, sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)) AS r0 FROM an a JOIN an b ON a.array_id = b.array_id AND a.platform_id < b.platform_id WHERE sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)) < 3000),
sr AS (SELECT cp.*, a.t, a.age, sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)) AS r FROM cp JOIN ag0 a ON a.platform_id = p1 AND a.age >= 0 JOIN ag0 b ON b.platform_id = p2 AND b.t = a.t WHERE a.x IS NOT NULL AND b.x IS NOT NULL)"""


@query("pj02_dispersion", f"""WITH {CLOSE}, ab AS (SELECT g.array_id, g.t, count(*) AS platforms, avg(pow(g.x-an.x,2)+pow(g.y-an.y,2)) AS msd FROM ag0 g JOIN an ON an.platform_id = g.platform_id WHERE g.age >= 0 AND g.x IS NOT NULL GROUP BY 1, 2),
re AS (SELECT array_id, t, count(*) AS pairs, avg(pow(r-r0,2)) AS d2 FROM sr GROUP BY 1, 2)
SELECT array_id, ab.t AS t_us, platforms, round(sqrt(msd), 3) AS rms_m, pairs, round(sqrt(d2), 3) AS relative_m FROM ab LEFT JOIN re USING (array_id, t)""")
def _(spark, sf):
    p = aged(spark, sf)
    a = dispersion.absolute_dispersion(p, BY)
    c = frames.cut(dispersion.close_pairs(p, BY, 3000.0))
    r = dispersion.relative_dispersion(dispersion.pair_separations(p, c, BY), BY).drop("age_h")
    return a.join(r, ["array_id", "time"], "left").select("array_id", us("time").alias("t_us"), "platforms", rnd("rms_m", 3).alias("rms_m"), "pairs", rnd(F.sqrt("dispersion_m2"), 3).alias("relative_m"))


_MD5 = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"


@query("pj01_bootstrap_mean", f"""WITH {CLOSE}, vv AS (SELECT array_id, p1 || '|' || p2 AS pair_id, t, (r - r0)*(r - r0) AS value FROM sr),
pn AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY {_MD5.format("pair_id")}, pair_id) - 1 AS n, count(*) OVER (PARTITION BY array_id) AS size FROM (SELECT DISTINCT array_id, pair_id FROM vv)),
dr AS (SELECT array_id, rep, {_MD5.format("'3|' || array_id || '|' || rep || '|' || n")} % size AS n, count(*) AS w FROM pn, (SELECT unnest(range(100)) AS rep) GROUP BY 1, 2, 3),
mm AS (SELECT vv.array_id, t, rep, sum(value*w)/sum(w) AS m FROM vv JOIN pn USING (array_id, pair_id) JOIN dr ON dr.array_id = pn.array_id AND dr.n = pn.n GROUP BY 1, 2, 3)
SELECT array_id, t AS t_us, round(sqrt(quantile_cont(m, 0.025)), 4) AS lower, round(sqrt(quantile_cont(m, 0.5)), 4) AS median, round(sqrt(quantile_cont(m, 0.975)), 4) AS upper FROM mm GROUP BY 1, 2""")
def _(spark, sf):
    p = aged(spark, sf)
    c = frames.cut(dispersion.close_pairs(p, BY, 3000.0))
    s = dispersion.pair_separations(p, c, BY)
    v = frames.cut(s.select("array_id", "pair_id", "time", ((F.col("r") - F.col("r0")) * (F.col("r") - F.col("r0"))).alias("value")))
    b = dispersion.bootstrap_mean(v, BY, replicates=100, seed=3)
    return b.select("array_id", us("time").alias("t_us"), *[rnd(F.sqrt(x), 4).alias(x) for x in ("lower", "median", "upper")])


@query("pj03_regimes", f"""WITH {CLOSE}, ab AS (SELECT g.array_id, g.age, avg(pow(g.x-an.x,2)+pow(g.y-an.y,2)) AS msd FROM ag0 g JOIN an ON an.platform_id = g.platform_id WHERE g.age >= 0 AND g.x IS NOT NULL GROUP BY 1, 2),
re AS (SELECT array_id, age, avg(pow(r-r0,2)) AS d2 FROM sr GROUP BY 1, 2),
b AS (SELECT array_id, median(msd/pow(age*3600,2)) AS v2 FROM ab WHERE age > 0 AND age <= 48 AND msd > 0 GROUP BY 1),
r AS (SELECT array_id, median(d2/pow(age*3600,3)) AS cu, count(*) AS n, regr_slope(ln(d2), ln(age*3600)) AS ex FROM re WHERE age/24 >= 2 AND age/24 <= 8 AND d2 > 0 GROUP BY 1)
SELECT array_id, round(v2*1e6, 5) AS ballistic_e6, round(cu*1e12, 5) AS cubic_e12, CASE WHEN n >= 2 THEN round(ex, 5) END AS exponent FROM b FULL JOIN r USING (array_id)""")
def _(spark, sf):
    p = aged(spark, sf)
    c = frames.cut(dispersion.close_pairs(p, BY, 3000.0))
    r = dispersion.relative_dispersion(dispersion.pair_separations(p, c, BY), BY)
    k = dispersion.regime_coefficients(dispersion.absolute_dispersion(p, BY), r, BY, ballistic_end_h=48.0)
    return k.select("array_id", rnd(F.col("ballistic_v2") * 1e6, 5).alias("ballistic_e6"), rnd(F.col("cubic_coefficient") * 1e12, 5).alias("cubic_e12"), rnd("exponent", 5).alias("exponent"))


MEM = [("early", 2.0, 4.0), ("late", 6.0, 8.0)]


@query("pj04_separation_memory", f"""WITH {AGE}, p AS (SELECT a.array_id, a.platform_id AS p1, b.platform_id AS p2, a.age, sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)) AS r FROM ag0 a JOIN ag0 b ON a.array_id = b.array_id AND a.t = b.t AND a.platform_id < b.platform_id WHERE a.age >= 0 AND a.age < 192 AND a.x IS NOT NULL AND b.x IS NOT NULL),
w AS (SELECT * FROM (VALUES ('early', 2, 4), ('late', 6, 8)) v(grp, a, b)),
c AS (SELECT p.array_id, grp, p.age AS t, q.age AS s, sum(p.r*q.r)/sum(p.r*p.r) AS k, count(*) AS n FROM p JOIN w ON p.age/24 >= a AND p.age/24 < b JOIN p q ON q.array_id = p.array_id AND q.p1 = p.p1 AND q.p2 = p.p2 AND q.age <= p.age GROUP BY 1, 2, 3, 4 HAVING sum(p.r*p.r) > 0),
g AS (SELECT array_id, grp, CAST(least(floor(((s-t)/t + 1)*10), 9) AS INTEGER) AS bin, count(*) AS samples, count(DISTINCT t) AS targets, round(avg(k), 5) AS correlation FROM c GROUP BY 1, 2, 3)
SELECT a.array_id, w.grp AS "group", k.bin, coalesce(samples, 0) AS samples, coalesce(targets, 0) AS targets, correlation
FROM (SELECT DISTINCT array_id FROM ag0) a CROSS JOIN w CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) k LEFT JOIN g ON g.array_id = a.array_id AND g.grp = w.grp AND g.bin = k.bin""")
def _(spark, sf):
    m = dispersion.separation_memory(aged(spark, sf), BY, MEM, 10)
    return m.select("array_id", "group", "bin", "samples", "targets", rnd("correlation", 5).alias("correlation"))


@query("pj05_lagrangian_structure", f"""WITH {AGE}, a AS (SELECT platform_id, u, v FROM ag0 WHERE age = 0 AND u IS NOT NULL)
SELECT array_id, t AS t_us, count(*) AS platforms, round(avg(pow(g.u-a.u,2)+pow(g.v-a.v,2))*1e6, 5) + 0.0 AS d2_e6, CASE WHEN any_value(age) > 0 THEN round(avg(pow(g.u-a.u,2)+pow(g.v-a.v,2))/(6.5*any_value(age)*3600)*1e12, 4) + 0.0 END AS proxy_e12 FROM ag0 g JOIN a USING (platform_id) WHERE g.age >= 0 AND g.u IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    s, _ = dispersion.lagrangian_structure(aged(spark, sf), BY)
    return s.select("array_id", us("time").alias("t_us"), "platforms", rnd(F.col("d2") * 1e6, 5).alias("d2_e6"), rnd(F.col("epsilon_proxy") * 1e12, 4).alias("proxy_e12"))


CENTERS = [(a + b) / 2 for a, b in zip(EDGES, EDGES[1:])]


@query("pj06_increment_histogram", f"""WITH {EP}, s AS (SELECT array_id, bin, dul FROM eb WHERE bin IN (1, 3)), m AS (SELECT array_id, bin, count(*) AS n, sqrt(var_pop(dul)) AS sg FROM s GROUP BY 1, 2 HAVING sqrt(var_pop(dul)) > 0),
h AS (SELECT array_id, bin, CAST(floor((dul/sg + 5)/0.5) AS INTEGER) AS h, count(*) AS c FROM s JOIN m USING (array_id, bin) WHERE abs(dul/sg) < 5 GROUP BY 1, 2, 3)
SELECT m.array_id, m.bin, k.h, coalesce(c, 0) AS n, round(coalesce(c, 0)/n/0.5, 6) AS density FROM m CROSS JOIN (SELECT CAST(unnest(generate_series(0, 19)) AS INTEGER) AS h) k LEFT JOIN h ON h.array_id = m.array_id AND h.bin = m.bin AND h.h = k.h""")
def _(spark, sf):
    _, h = dispersion.increments(observed(spark, sf).where("r_m > 0"), EDGES, CENTERS, [6000.0, 14000.0], BY, limit=5.0, bins=20)
    return h.select("array_id", "bin", "h", "n", rnd("density").alias("density"))


@query("pj07_gaussian_core")
def _(spark, sf):
    _, h = dispersion.increments(observed(spark, sf).where("r_m > 0"), EDGES, CENTERS, [6000.0, 14000.0], BY, limit=5.0, bins=20)
    g = dispersion.gaussian_core(h, BY, 1.5, 5.0)
    return g.select("array_id", "bin", rnd("amplitude", 4).alias("amplitude"), rnd("location", 4).alias("location"), rnd("width", 4).alias("width"), "status")


@query("pj08_structure_functions", f"""WITH {EP} SELECT array_id, bin, round(avg(dul*dul)*1e9, 4) AS s2_e9, round(avg(c)*1e12, 4) + 0.0 AS s3_e12, round(avg(dul*dut*dut)*1e12, 4) + 0.0 AS mixed_e12, round(-(avg(c) + avg(dul*dut*dut))/(2*avg(r))*1e15, 3) + 0.0 AS epsilon_mixed_e15 FROM {_DENSE} LEFT JOIN eb USING (array_id, bin) GROUP BY 1, 2""")
def _(spark, sf):
    m = moving(spark, sf)
    o = paired(m).where("r_m > 0")
    s = dispersion.structure_functions(thirdorder.separation_bins(o, EDGES, BY, groups=pairs.possible_pairs(m)), o, EDGES, BY)
    return s.select("array_id", "bin", rnd(F.col("s2") * 1e9, 4).alias("s2_e9"), rnd(F.col("s3") * 1e12, 4).alias("s3_e12"), rnd(F.col("mixed") * 1e12, 4).alias("mixed_e12"), rnd(F.col("epsilon_mixed") * 1e15, 3).alias("epsilon_mixed_e15"))


@query("pj09_scaling_fits", f"""WITH {EP}, pf AS (SELECT array_id, bin, count(DISTINCT p) AS pf FROM (SELECT array_id, bin, unnest([p1, p2]) AS p FROM eb) GROUP BY 1, 2),
s AS (SELECT array_id, bin, ln(avg(r)) AS x, ln(avg(dul*dul)) AS y FROM eb JOIN pf USING (array_id, bin) GROUP BY 1, 2 HAVING count(*) >= 12 AND count(DISTINCT pair_id) >= 3 AND any_value(pf) >= 3 AND count(DISTINCT t) >= 12 AND avg(r) BETWEEN 1000 AND 35000)
SELECT array_id, count(*) AS bins, CASE WHEN count(*) >= 3 THEN round(regr_slope(y, x), 5) + 0.0 END AS exponent, CASE WHEN count(*) >= 3 THEN round(sqrt(greatest(0, regr_syy(y, x) - pow(regr_sxy(y, x), 2)/nullif(regr_sxx(y, x), 0))/nullif(count(*) - 2, 0)/nullif(regr_sxx(y, x), 0)), 5) END AS exponent_se FROM s GROUP BY 1""")
def _(spark, sf):
    o = observed(spark, sf).where("r_m > 0")
    s = dispersion.structure_functions(thirdorder.separation_bins(o, EDGES, BY), o, EDGES, BY)
    f = dispersion.scaling_fits(s, BY, 1000.0, 35000.0)
    return f.select("array_id", "bins", rnd("exponent", 5).alias("exponent"), rnd("exponent_se", 5).alias("exponent_se"))


@query("pj10_log_thinning", """WITH e AS (SELECT user_id, event_id, event_id - min(event_id) OVER (PARTITION BY user_id) AS v FROM events), p AS (SELECT * FROM e WHERE v > 0),
l AS (SELECT user_id, min(v) AS a, max(v) AS z, count(*) AS n FROM p GROUP BY 1), t AS (SELECT user_id, a*pow(z/a::DOUBLE, i/7.0) AS t FROM l, (SELECT unnest(generate_series(0, 7)) AS i) WHERE n > 8),
b AS (SELECT DISTINCT user_id, event_id FROM (SELECT t.user_id, p.event_id, row_number() OVER (PARTITION BY t.user_id, t.t ORDER BY abs(v - t), p.event_id) AS r FROM t JOIN p ON p.user_id = t.user_id) WHERE r = 1)
SELECT user_id, count(*) AS kept FROM (SELECT * FROM b UNION ALL SELECT p.user_id, p.event_id FROM p JOIN l USING (user_id) WHERE n <= 8) GROUP BY 1""")
def _(spark, sf):
    e = events(spark, sf)
    m = e.groupBy("user_id").agg(F.min("obs_index").alias("m"))
    v = e.join(m, "user_id").withColumn("v", (F.col("obs_index") - F.col("m")).cast("double"))
    return dispersion.log_thin(v, ["user_id"], "v", 8, "obs_index").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("af01_schedule", """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS platform_id, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM events GROUP BY 1)
SELECT platform_id, unnest(generate_series(a // 86400000000 * 86400000000 + CAST(ceil((a % 86400000000)/21600e6) AS BIGINT)*21600000000, z - 21600000000, 21600000000)) AS start_us FROM s""")
def _(spark, sf):
    b = events(spark, sf).groupBy("platform_id").agg(F.min("time").alias("start"), F.max("time").alias("end"))
    return affine.schedule(b, 6.0).select("platform_id", us("fit_start").alias("start_us"))


@query("af02_endpoints", f"""WITH {MOVE}, ok AS (SELECT * FROM pl WHERE lon IS NOT NULL AND gap <= 900), tg AS (SELECT platform_id, t + 3*3600000000 AS t FROM pl),
b AS (SELECT tg.*, p.t AS pt, p.lon AS plon, p.gap AS pg, n.t AS nt, n.lon AS nlon, n.gap AS ng FROM tg ASOF LEFT JOIN ok p ON p.platform_id = tg.platform_id AND tg.t >= p.t ASOF LEFT JOIN ok n ON n.platform_id = tg.platform_id AND tg.t <= n.t),
g AS (SELECT *, CASE WHEN pt IS NOT NULL AND nt IS NOT NULL THEN greatest((nt - pt)/6e7, pg, ng) END AS eg FROM b)
SELECT platform_id, t AS t_us, CASE WHEN eg IS NULL THEN 'out' WHEN eg <= 900 THEN 'valid' ELSE 'gap' END AS reason, CASE WHEN eg <= 900 THEN round(plon + (nlon - plon)*(t - pt)/(nt - pt), 5) END AS lon FROM g""")
def _(spark, sf):
    p = frames.cut(plane(spark, sf))
    t = p.select("platform_id", F.timestamp_micros(us("time") + 3 * 3_600_000_000).alias("time"))
    e = affine.endpoints(p, t, 900.0)
    why = F.when(F.col("reason") == "valid", "valid").when(F.col("reason") == "endpoint_gap_exceeds_threshold", "gap").otherwise("out")
    return e.select("platform_id", us("time").alias("t_us"), why.alias("reason"), rnd("lon", 5).alias("lon"))


@query("af03_catalogue", f"""WITH {MOVE}, ok AS (SELECT * FROM pl WHERE lon IS NOT NULL AND gap <= 900), n AS (SELECT cluster_id, count(DISTINCT platform_id) AS members FROM pl GROUP BY 1),
a AS (SELECT cluster_id, min(t) AS a FROM (SELECT cluster_id, t, count(*) AS c FROM ok GROUP BY 1, 2) JOIN n USING (cluster_id) WHERE c = members GROUP BY 1),
l AS (SELECT cluster_id, min(z) AS z, count(*) AS k FROM (SELECT cluster_id, platform_id, max(t) AS z FROM ok GROUP BY 1, 2) GROUP BY 1)
SELECT n.cluster_id, members, a AS activation_us, CASE WHEN k = members THEN z END AS lifetime_end_us, CASE WHEN members < 3 THEN 'fewer_than_three_original_members' WHEN a IS NULL THEN 'complete_cluster_never_available' ELSE 'eligible' END AS eligibility FROM n LEFT JOIN a USING (cluster_id) LEFT JOIN l USING (cluster_id)""")
def _(spark, sf):
    p = frames.cut(plane(spark, sf))
    pl = p.select("platform_id", "array_id", "cluster_id").distinct().withColumn("cluster_size", F.lit(5))
    c = affine.catalogue(p, pl, 900.0)
    return c.select("cluster_id", "members", us("activation").alias("activation_us"), us("lifetime_end").alias("lifetime_end_us"), "eligibility")


def _affine_positions(spark, sf):
    p = plane(spark, sf).select("array_id", "cluster_id", "platform_id", "time", "x_m", "y_m")
    p = frames.cut(p)
    later = p.select("platform_id", F.timestamp_micros(us("time") - 86_400_000_000).alias("time"), F.col("x_m").alias("x1"), F.col("y_m").alias("y1"))
    j = p.withColumnsRenamed({"x_m": "x0", "y_m": "y0", "time": "fit_start"}).join(later.withColumnRenamed("time", "fit_start"), ["platform_id", "fit_start"])
    return j.where(us("fit_start") % 86_400_000_000 == 0)


@query("af04_affine_fits", f"""WITH {MOVE}, j AS (SELECT a.cluster_id, a.t, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM pl a JOIN pl b ON a.platform_id = b.platform_id AND b.t = a.t + 86400000000 WHERE a.t % 86400000000 = 0),
m AS (SELECT cluster_id, t, count(*) AS n, count_if(x0 IS NULL OR x1 IS NULL) AS miss, var_pop(x0)*count(x0) AS sxx, covar_pop(x0, y0)*count(x0) AS sxy, var_pop(y0)*count(x0) AS syy, covar_pop(x0, x1)*count(x0) AS ax, covar_pop(y0, x1)*count(x0) AS bx, covar_pop(x0, y1)*count(x0) AS ay, covar_pop(y0, y1)*count(x0) AS byy FROM j GROUP BY 1, 2),
f AS (SELECT *, (ax*syy - bx*sxy)/(sxx*syy - sxy*sxy) AS f11, (bx*sxx - ax*sxy)/(sxx*syy - sxy*sxy) AS f12, (ay*syy - byy*sxy)/(sxx*syy - sxy*sxy) AS f21, (byy*sxx - ay*sxy)/(sxx*syy - sxy*sxy) AS f22 FROM m WHERE n >= 3 AND miss = 0)
SELECT m.cluster_id, m.t AS t_us, CASE WHEN m.n < 3 THEN 'fewer_than_three_original_members' WHEN m.miss > 0 THEN 'missing_endpoint_positions' ELSE '' END AS reason, round(f11, 4) AS f11, round(f12, 4) + 0.0 AS f12, round(f21, 4) + 0.0 AS f21, round(f22, 4) AS f22, round(f11*f22 - f12*f21, 4) + 0.0 AS det FROM m LEFT JOIN f USING (cluster_id, t)""")
def _(spark, sf):
    f = affine.fits(_affine_positions(spark, sf), ["array_id", "cluster_id", "fit_start"], 24.0)
    return f.select("cluster_id", us("fit_start").alias("t_us"), "reason", *[rnd(c, 4).alias(c) for c in ("f11", "f12", "f21", "f22", "det")])


@query("af05_attempts")
def _(spark, sf):
    p = frames.cut(plane(spark, sf))
    pl = p.select("platform_id", "array_id", "cluster_id").distinct().withColumn("cluster_size", F.lit(5))
    cat = frames.cut(affine.catalogue(p, pl, 2880.0))
    iv = frames.cut(affine.schedule(p.groupBy("array_id").agg(F.min("time").alias("start"), F.max("time").alias("end")), 24.0))
    t = pl.join(iv, "array_id").select("platform_id", F.explode(F.array("fit_start", "fit_end")).alias("time")).distinct()
    e = frames.cut(affine.endpoints(p, t, 2880.0).select("platform_id", "time", "lon", "lat", "reason"))
    both = pl.join(iv, "array_id")
    a = e.select("platform_id", F.col("time").alias("fit_start"), F.col("lon").alias("lo0"), F.col("lat").alias("la0"), F.col("reason").alias("ra"))
    b = e.select("platform_id", F.col("time").alias("fit_end"), F.col("lon").alias("lo1"), F.col("lat").alias("la1"), F.col("reason").alias("rb"))
    j = frames.cut(both.join(a, ["platform_id", "fit_start"]).join(b, ["platform_id", "fit_end"]))
    g = ["array_id", "cluster_id", "fit_start"]
    bad = F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_set(F.array("ra", "rb")))), F.array(F.lit("valid"))))
    ends = j.groupBy(*g).agg(F.count("lo0").alias("valid_initial"), F.count("lo1").alias("valid_final"), F.array_join(bad, ";").alias("worst"))
    xy = j.select(*g, "platform_id", *[((F.col(lo) - 130) * 100000).alias(x) for lo, x in (("lo0", "x0"), ("lo1", "x1"))], *[((F.col(la) - 20) * 100000).alias(y) for la, y in (("la0", "y0"), ("la1", "y1"))])
    fit = affine.fits(xy, g, 24.0)
    at = affine.attempts(cat, iv, ends, fit)
    return at.select("cluster_id", us("fit_start").alias("t_us"), "attempt_status", "attempt_reason", rnd("stretch1", 4).alias("stretch1"), rnd("rate1", 5).alias("rate1"))


def _raster(spark, sf):
    e = events(spark, sf)
    i = F.col("obs_index")
    return e.where(F.dayofmonth("time") % 9 != 4).select(
        F.to_date("time").alias("day"), (20 + F.col("user_id") % 10 * 0.01).alias("lat"), (130 + F.floor(F.col("user_id") / 10) * 0.01).alias("lon"),
        (F.lit(273.15) + F.col("value") / 20).alias("value_k"), F.when(i % 13 != 5, F.when(i % 3 == 0, 5).when(i % 5 == 0, 2).otherwise(1)).alias("mask"), (i % 10 * 0.1).alias("error"))


@query("ra01_quality_mask", """WITH r AS (SELECT CAST(ts AS DATE) AS d, event_id AS i, user_id, value FROM events WHERE day(ts) % 9 <> 4),
g AS (SELECT d, count(*) AS n, count_if(i % 13 <> 5 AND i % 3 <> 0 AND i % 5 <> 0 AND i % 10 <= 5) AS valid, true AS present FROM r GROUP BY 1),
c AS (SELECT count(*) AS cells FROM (SELECT DISTINCT user_id % 10, user_id // 10 FROM r)), dd AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT strftime(dd.d, '%Y-%m-%d') AS day, coalesce(n, cells) AS n, coalesce(valid, 0) AS valid, coalesce(present, false) AS present FROM dd CROSS JOIN c LEFT JOIN g USING (d)""")
def _(spark, sf):
    m = raster.quality_mask(_raster(spark, sf), "2024-01-01", "2024-01-30", 0.55)
    return m.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"), F.bool_or("source_present").alias("present"))


@query("ra02_composite", """WITH b AS (SELECT epoch_us(ts) // 21600000000 * 21600000000 AS t, user_id % 10 AS la, user_id // 10 AS lo, CASE WHEN event_id % 7 = 2 THEN NULL ELSE value END AS v, event_id % 4 AS c FROM events)
SELECT t // 86400000000 * 86400000000 AS window_us, la, lo, round(avg(v), 5) AS value, count(v) AS contributing_bins, CAST(coalesce(sum(CASE WHEN v IS NOT NULL THEN c END), 0) AS BIGINT) AS observations FROM b WHERE lo BETWEEN 2 AND 12 GROUP BY 1, 2, 3""")
def _(spark, sf):
    e = events(spark, sf)
    b = e.select(F.timestamp_micros(F.floor(us("time") / 21600000000).cast("long") * 21600000000).alias("time"), (F.col("user_id") % 10).alias("lat"), F.floor(F.col("user_id") / 10).alias("lon"),
                 F.when(F.col("obs_index") % 7 != 2, F.col("value")).alias("value"), (F.col("obs_index") % 4).alias("observation_count"))
    c, _ = raster.composite(b, 24, 6, (2, 12, 0, 100))
    return c.select(us("window_start").alias("window_us"), F.col("lat").alias("la"), F.col("lon").alias("lo"), rnd("value", 5).alias("value"), "contributing_bins", "observations")


@query("sc11_sc16_projection_round_trip", f"""WITH {GRID},
ok AS (SELECT user_id // 20 AS array_id, platform_id, t, lon, lat FROM gr WHERE lon IS NOT NULL),
fp AS (SELECT array_id, platform_id, radians(arg_min(lon, t)) AS x, radians(arg_min(lat, t)) AS y FROM ok GROUP BY 1, 2),
og AS (SELECT array_id, degrees(atan2(avg(cos(y)*sin(x)), avg(cos(y)*cos(x)))) AS lo0, degrees(atan2(avg(sin(y)), sqrt(pow(avg(cos(y)*cos(x)), 2) + pow(avg(cos(y)*sin(x)), 2)))) AS la0 FROM fp GROUP BY 1),
pj AS (SELECT platform_id, t, lo0, la0, lon AS lo1, lat AS la1 FROM ok JOIN og USING (array_id)), {geodesic("pj")}
SELECT platform_id, t AS t_us, round(s*sin(radians(az)), 3) + 0.0 AS x_m, round(s*cos(radians(az)), 3) + 0.0 AS y_m, 0.0 AS lon_error FROM geo""")
def _(spark, sf):
    g = plane(spark, sf).drop("x_m", "y_m").where("lon IS NOT NULL")
    p = audit.project(frames.cut(g), audit.projection_origins(g))
    back = audit.unproject(p.withColumnsRenamed({"lon": "lon_in", "lat": "lat_in"}))
    return back.select("platform_id", us("time").alias("t_us"), rnd("x_m", 3).alias("x_m"), rnd("y_m", 3).alias("y_m"), rnd(F.abs(F.col("lon") - F.col("lon_in")), 8).alias("lon_error"))
