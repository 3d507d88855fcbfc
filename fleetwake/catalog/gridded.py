"""Queries of grids, groups, pairs, kinematics and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwake.catalog.base import query, rnd, us
from fleetwake.catalog.inputs import OBS, events, geodesic, hav, observations
from fleetwake.operators import audit, clusters, frames, grid, groups, kinematics, pairs
from fleetwake.sources import tables

H6 = 21_600_000_000


def fixes(spark, sf):
    return observations(spark, sf).select("platform_id", "obs_index", "time", "lon", "lat", "sst", "user_id")


def spans(f):
    s = f.groupBy("platform_id", "user_id").agg(F.min("time").alias("start"), F.max("time").alias("end"))
    return s.withColumn("anchor", F.timestamp_micros(F.lit(0)))


def cells(f, cadence=360.0):
    return grid.regular_grid(spans(f), cadence, keep=("platform_id", "user_id"))


def gridded(spark, sf, gap=2880.0):
    f = frames.cut(fixes(spark, sf))
    return grid.resample_track(f, cells(f), gap)


def plane(spark, sf):
    """Grid cells with groups (20 platforms per array, 5 per cluster), plane coordinates and velocity."""
    g = gridded(spark, sf)
    return g.select(
        "platform_id", "time", "lon", "lat", "source_gap_min", "user_id",
        F.floor(F.col("user_id") / 20).cast("long").alias("array_id"), F.floor(F.col("user_id") / 5).cast("long").alias("cluster_id"),
        ((F.col("lon") - 130) * 100000).alias("x_m"), ((F.col("lat") - 20) * 100000).alias("y_m"))


def moving(spark, sf):
    return frames.cut(kinematics.centred_velocity(plane(spark, sf), cadence_s=21600, span_s=43200, max_gap_min=2880))


GRID = f"""{OBS},
sp AS (SELECT platform_id, user_id, min(epoch_us(time)) AS a, max(epoch_us(time)) AS z FROM obs GROUP BY 1, 2),
ce AS (SELECT platform_id, user_id, unnest(generate_series(CAST(ceil(a/{H6}.0) AS BIGINT), z // {H6})) AS cell FROM sp),
cl AS (SELECT *, cell*{H6} AS t FROM ce),
fx AS (SELECT platform_id, epoch_us(time) AS t, lon, lat, sst FROM obs),
br AS (SELECT cl.*, p.t AS pt, p.lon AS plon, p.lat AS plat, p.sst AS psst, n.t AS nt, n.lon AS nlon, n.lat AS nlat, n.sst AS nsst
  FROM cl ASOF LEFT JOIN fx p ON cl.platform_id = p.platform_id AND cl.t >= p.t ASOF LEFT JOIN fx n ON cl.platform_id = n.platform_id AND cl.t <= n.t),
gr0 AS (SELECT *, CASE WHEN pt = t THEN 0 ELSE (nt - pt)/6e7 END AS gap, CASE WHEN pt = t THEN 0 ELSE (t - pt)/(nt - pt)::DOUBLE END AS f FROM br),
gr AS (SELECT platform_id, user_id, cell, t, gap, CASE WHEN gap <= 2880 THEN plon + (nlon - plon)*f END AS lon, CASE WHEN gap <= 2880 THEN plat + (nlat - plat)*f END AS lat, CASE WHEN gap <= 2880 THEN psst + (nsst - psst)*f END AS sst FROM gr0)"""
MOVE = f"""{GRID},
pl AS (SELECT platform_id, user_id, cell, t, gap, lon, lat, user_id // 20 AS array_id, user_id // 5 AS cluster_id, (lon - 130)*100000 AS x, (lat - 20)*100000 AS y FROM gr),
st AS (SELECT *, lag(x) OVER w AS x0, lead(x) OVER w AS x2, lag(y) OVER w AS y0, lead(y) OVER w AS y2, lag(t) OVER w AS t0, lead(t) OVER w AS t2,
  greatest(gap, coalesce(lag(gap) OVER w, 0), coalesce(lead(gap) OVER w, 0)) AS mg, x IS NOT NULL AND lag(x) OVER w IS NOT NULL AND lead(x) OVER w IS NOT NULL AS pos FROM pl WINDOW w AS (PARTITION BY platform_id ORDER BY t)),
mv AS (SELECT platform_id, user_id, cell, t, gap, lon, lat, array_id, cluster_id, x, y, CASE WHEN t0 IS NULL OR t2 IS NULL THEN 'outside_centered_stencil' WHEN NOT pos THEN 'nonfinite_position_in_stencil' WHEN mg > 2880 THEN 'source_gap_exceeded_in_stencil' ELSE 'valid' END AS reason,
  CASE WHEN pos AND mg <= 2880 THEN (x2 - x0)/43200 END AS u, CASE WHEN pos AND mg <= 2880 THEN (y2 - y0)/43200 END AS v FROM st)"""
PAIRS = f"""{MOVE},
pr0 AS (SELECT a.array_id, a.t, a.cell, a.platform_id AS p1, b.platform_id AS p2, a.cluster_id AS c1, b.cluster_id AS c2, b.x - a.x AS dx, b.y - a.y AS dy, b.u - a.u AS du, b.v - a.v AS dv,
  (a.x+b.x)/2 AS mx, (a.y+b.y)/2 AS my, (a.lat+b.lat)/2 AS mlat
  FROM mv a JOIN mv b ON a.array_id = b.array_id AND a.t = b.t AND a.platform_id < b.platform_id WHERE a.u IS NOT NULL AND b.u IS NOT NULL),
pr1 AS (SELECT *, sqrt(dx*dx + dy*dy) AS r FROM pr0),
pr AS (SELECT *, 'pair_' || substr(sha256('["' || p1 || '","' || p2 || '"]'), 1, 20) AS pair_id, CASE WHEN r > 0 THEN (du*dx + dv*dy)/r END AS dul, CASE WHEN r > 0 THEN (dv*dx - du*dy)/r END AS dut FROM pr1)"""


@query("rg01_regular_grid", f"WITH {GRID} SELECT platform_id, cell, t AS t_us FROM cl")
def _(spark, sf):
    return cells(fixes(spark, sf)).select("platform_id", "cell", us("time").alias("t_us"))


@query("rg02_common_grid", f"""WITH l AS (SELECT min(epoch_us(ts)) // {H6} AS a, CAST(ceil(max(epoch_us(ts))/{H6}.0) AS BIGINT) AS z FROM events)
SELECT unnest(generate_series(a, z)) AS cell FROM l""")
def _(spark, sf):
    return grid.common_grid(events(spark, sf), 360).select("cell")


@query("rg03_resample_series", f"WITH {GRID} SELECT platform_id, cell, round(sst, 6) + 0.0 AS sst, round(gap, 4) AS source_gap_min FROM gr")
def _(spark, sf):
    f = fixes(spark, sf)
    return grid.resample_series(f, cells(f), "sst", 2880).select("platform_id", "cell", rnd("sst").alias("sst"), rnd("source_gap_min", 4).alias("source_gap_min"))


@query("rg04_resample_track", f"WITH {GRID} SELECT platform_id, cell, round(lon, 6) AS lon, round(lat, 6) AS lat, round(gap, 4) AS source_gap_min FROM gr")
def _(spark, sf):
    return gridded(spark, sf).select("platform_id", "cell", rnd("lon").alias("lon"), rnd("lat").alias("lat"), rnd("source_gap_min", 4).alias("source_gap_min"))


@query("rg05_phase_spline")
def _(spark, sf):
    f = frames.cut(fixes(spark, sf))
    s = grid.phase_spline(f, cells(f), cadence_min=360, period_min=1080, long_gap_min=5760)
    return s.select("platform_id", "cell", rnd("linear_lon").alias("linear_lon"), rnd("lon").alias("lon"), rnd("lat").alias("lat"), "fallback")


@query("rg06_rg07_forward_velocity", f"""WITH {GRID}, n AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM gr WINDOW w AS (PARTITION BY platform_id ORDER BY t))
SELECT platform_id, cell, CASE WHEN lon IS NOT NULL AND lon2 IS NOT NULL THEN 21600.0 END AS dt_s FROM n""")
def _(spark, sf):
    f = frames.cut(fixes(spark, sf))
    return grid.regular_product(f, cells(f), 2880).select("platform_id", "cell", "dt_s")


_NEXT = "lag(1) OVER w AS one, lon AS lo0, lat AS la0, CASE WHEN lon IS NOT NULL THEN lead(lon) OVER w END AS lo1, CASE WHEN lon IS NOT NULL THEN lead(lat) OVER w END AS la1"


@query("rg07_velocity_values", f"""WITH {GRID}, nx AS (SELECT platform_id, cell, {_NEXT} FROM gr WINDOW w AS (PARTITION BY platform_id ORDER BY t)), {geodesic("nx")}
SELECT platform_id, cell, round(s/21600*sin(radians(az)), 6) + 0.0 AS u, round(s/21600*cos(radians(az)), 6) + 0.0 AS v, round(s/21600, 6) AS speed FROM geo""")
def _(spark, sf):
    f = frames.cut(fixes(spark, sf))
    return grid.regular_product(f, cells(f), 2880).select("platform_id", "cell", rnd("u").alias("u"), rnd("v").alias("v"), rnd("speed").alias("speed"))


def _product_sql(name: str, rows: str, cadence_min: int, gap_min: int) -> str:
    """CTEs of one product on its own grid; ends in ``{name}``: product, platform_id, t, lon, lat, dt."""
    us_ = cadence_min * 60_000_000
    return f"""{name}_c AS (SELECT platform_id, unnest(generate_series(CAST(ceil(a/{us_}.0) AS BIGINT), z // {us_}))*{us_} AS t FROM sp),
{name}_f AS (SELECT platform_id, epoch_us(time) AS t, lon, lat FROM obs WHERE {rows}),
{name}_b AS (SELECT c.*, p.t AS pt, p.lon AS plon, p.lat AS plat, n.t AS nt, n.lon AS nlon, n.lat AS nlat FROM {name}_c c
  ASOF LEFT JOIN {name}_f p ON c.platform_id = p.platform_id AND c.t >= p.t ASOF LEFT JOIN {name}_f n ON c.platform_id = n.platform_id AND c.t <= n.t),
{name}_g AS (SELECT *, CASE WHEN pt = t THEN 0 ELSE (nt - pt)/6e7 END <= {gap_min} AS ok, CASE WHEN pt = t THEN 0 ELSE (t - pt)/(nt - pt)::DOUBLE END AS f FROM {name}_b),
{name} AS (SELECT '{name}' AS product, platform_id, t, CASE WHEN ok THEN plon + (nlon - plon)*f END AS lon, CASE WHEN ok THEN plat + (nlat - plat)*f END AS lat, {cadence_min * 60}.0 AS dt FROM {name}_g)"""


@query("rg08_standard_products", f"""WITH {OBS},
sp AS (SELECT platform_id, min(epoch_us(time)) AS a, max(epoch_us(time)) AS z FROM obs GROUP BY 1),
{_product_sql("raw_360", "true", 360, 2880)}, {_product_sql("qc_360", "obs_index % 11 <> 4", 360, 1440)}, {_product_sql("qc_720", "obs_index % 11 <> 4", 720, 2880)},
al AS (SELECT * FROM raw_360 UNION ALL SELECT * FROM qc_360 UNION ALL SELECT * FROM qc_720),
nx AS (SELECT *, {_NEXT} FROM al WINDOW w AS (PARTITION BY product, platform_id ORDER BY t)), {geodesic("nx")}
SELECT product, platform_id, t AS t_us, round(lon, 6) AS lon, round(lat, 6) AS lat, round(s/dt, 6) AS speed FROM geo""")
def _(spark, sf):
    f = frames.cut(fixes(spark, sf))
    specs = (("raw_360", "raw", 360, 2880), ("qc_360", "qc", 360, 1440), ("qc_720", "qc", 720, 2880))
    p = grid.standard_products(f, f.where("obs_index % 11 <> 4"), spans(f), specs)
    return p.select("product", "platform_id", us("time").alias("t_us"), rnd("lon").alias("lon"), rnd("lat").alias("lat"), rnd("speed").alias("speed"))


@query("rg09_build_report", f"""WITH {GRID}, g AS (SELECT platform_id, (t - lag(t) OVER (PARTITION BY platform_id ORDER BY t))/6e7 AS g FROM fx),
q AS (SELECT platform_id, quantile_cont(g, 0.5) AS p50, quantile_cont(g, 0.95) AS p95, max(g) AS m, count_if(g > 720) AS o FROM g GROUP BY 1),
c AS (SELECT platform_id, count_if(lon IS NOT NULL AND gap > 0) AS i, count_if(lon IS NULL) AS m FROM gr GROUP BY 1)
SELECT q.platform_id, round(p50, 3) AS gap_p50, round(p95, 3) AS gap_p95, round(q.m, 3) AS gap_max, o AS gaps_over_720, i AS interpolated_cells, c.m AS missing_cells FROM q JOIN c USING (platform_id)""")
def _(spark, sf):
    f = frames.cut(fixes(spark, sf))
    r = grid.build_report(f, grid.resample_track(f, cells(f), 2880), (720, 1440))
    return r.select("platform_id", rnd("gap_p50", 3).alias("gap_p50"), rnd("gap_p95", 3).alias("gap_p95"), rnd("gap_max", 3).alias("gap_max"), "gaps_over_720", "interpolated_cells", "missing_cells")


@query("rg10_review_resample", f"""WITH {OBS}, f AS (SELECT platform_id, epoch_us(time) AS t, sst FROM obs WHERE obs_index % 4 <> 1), a AS (SELECT platform_id, min(t) AS a, max(t) AS z FROM f GROUP BY 1),
c AS (SELECT platform_id, a + unnest(generate_series(0, (z - a) // {H6}))*{H6} AS t FROM a),
b AS (SELECT c.*, p.t AS pt, p.sst AS ps, n.t AS nt, n.sst AS ns FROM c ASOF LEFT JOIN f p ON p.platform_id = c.platform_id AND c.t >= p.t ASOF LEFT JOIN f n ON n.platform_id = c.platform_id AND c.t <= n.t)
SELECT platform_id, t AS t_us, CASE WHEN pt = t THEN round(ps, 6) WHEN (nt - pt)/6e7 <= 1440 THEN round(ps + (ns - ps)*((t - pt)/(nt - pt)::DOUBLE), 6) END AS sst FROM b""")
def _(spark, sf):
    f = frames.cut(fixes(spark, sf).where("obs_index % 4 <> 1"))
    s = f.groupBy("platform_id").agg(F.min("time").alias("start"), F.max("time").alias("end"), F.min("time").alias("anchor"))
    return grid.resample_series(f, grid.regular_grid(s, 360), "sst", 1440).select("platform_id", us("time").alias("t_us"), rnd("sst").alias("sst"))


def _supplied(spark, sf):
    """Regular 6 h rows with jitter; a third of the platforms share a phase of 3 minutes, some are off."""
    f = fixes(spark, sf)
    k = F.col("user_id") % 3
    jitter = (F.col("cell") % 3 - 1) * 400_000
    shift = F.when(k == 1, 180_000_000).when((k == 2) & (F.col("cell") % 7 == 0), 90_000_000).otherwise(0)
    return cells(f).withColumn("time", F.timestamp_micros(us("time") + jitter + shift))


@query("rg11_snap_times", f"""WITH {GRID}, s AS (SELECT platform_id, user_id, t, t + ((cell % 3) - 1)*400000 + CASE WHEN user_id % 3 = 1 THEN 180000000 WHEN user_id % 3 = 2 AND cell % 7 = 0 THEN 90000000 ELSE 0 END AS tt FROM cl)
SELECT platform_id, tt AS t_us, t AS snap_us, CASE user_id % 3 WHEN 2 THEN 'cadence_off' WHEN 1 THEN 'phase' ELSE 'snapped' END AS verdict FROM s""")
def _(spark, sf):
    s = grid.snap_times(_supplied(spark, sf), 360, 1.0)
    return s.select("platform_id", us("time").alias("t_us"), "snap_us", "verdict")


@query("rg12_support_gap", f"WITH {GRID} SELECT platform_id, cell, round(gap, 4) AS support_gap_min FROM gr0")
def _(spark, sf):
    f = frames.cut(fixes(spark, sf))
    return grid.support_gap(f, cells(f)).select("platform_id", "cell", rnd("support_gap_min", 4).alias("support_gap_min"))


@query("rg13_align_supplied", f"""WITH {OBS}, s0 AS (SELECT platform_id, epoch_us(time) AS t, lon, lat, obs_index % 9 = 4 AS gone, sum(CASE WHEN obs_index % 9 = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY platform_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS piece FROM obs),
s AS (SELECT * FROM s0 WHERE NOT gone), sp AS (SELECT platform_id, min(epoch_us(time)) AS a, max(epoch_us(time)) AS z FROM obs GROUP BY 1),
cl AS (SELECT platform_id, unnest(generate_series(CAST(ceil(a/{H6}.0) AS BIGINT), z // {H6})) AS cell FROM sp),
b AS (SELECT cl.platform_id, cell, cell*{H6} AS t, p.t AS pt, p.lon AS plon, p.piece AS pp, n.t AS nt, n.lon AS nlon, n.piece AS np FROM cl ASOF LEFT JOIN s p ON p.platform_id = cl.platform_id AND cell*{H6} >= p.t ASOF LEFT JOIN s n ON n.platform_id = cl.platform_id AND cell*{H6} <= n.t)
SELECT platform_id, cell, CASE WHEN pp = np AND (nt - pt)/6e7 <= 2880 THEN round(plon + (nlon - plon)*((t - pt)/(nt - pt)::DOUBLE), 6) END AS lon FROM b""")
def _(spark, sf):
    f = frames.cut(fixes(spark, sf))
    s = f.withColumns({c: F.when(F.col("obs_index") % 9 != 4, F.col(c)) for c in ("lon", "lat")})
    return grid.align_supplied(s, cells(f), 2880).select("platform_id", "cell", rnd("lon").alias("lon"))


@query("rg14_coverage_end", """WITH s AS (SELECT user_id, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM events GROUP BY 1),
l AS (SELECT *, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN a + 3600000000 ELSE z - user_id*3600000000 END AS loss FROM s)
SELECT CAST(user_id AS VARCHAR) AS platform_id, coalesce(least(z, loss - 86400000000), z) AS end_us, CASE WHEN loss IS NULL THEN 'unknown_loss' WHEN least(z, loss - 86400000000) <= a THEN 'cutoff_before_start' END AS problem FROM l""")
def _(spark, sf):
    s = events(spark, sf).groupBy("user_id", "platform_id").agg(F.min("time").alias("start"), F.max("time").alias("end"))
    k = F.col("user_id") % 4
    loss = F.when(k == 1, us("start") + 3600000000).when(k != 0, us("end") - F.col("user_id") * 3600000000)
    return grid.coverage_end(s.withColumn("loss_time", F.timestamp_micros(loss))).select("platform_id", us("coverage_end").alias("end_us"), "problem")


@query("rg15_phase_sampling", f"WITH {GRID} SELECT platform_id, cell FROM cl WHERE (t - 1704067200000000) % 86400000000 = 0")
def _(spark, sf):
    return grid.sample_phase(cells(fixes(spark, sf)), 1440, 1704067200000000).select("platform_id", "cell")


def starts(spark, sf):
    """Starts spread over years so that several arrays form."""
    s = events(spark, sf).groupBy("user_id", "platform_id").agg(F.min("time").alias("t"))
    return s.select("platform_id", "user_id", F.timestamp_micros(us("t") + F.floor(F.col("user_id") / 10).cast("long") * 864_000_000_000).alias("start_time"))


STARTS = """st0 AS (SELECT CAST(user_id AS VARCHAR) AS platform_id, user_id, epoch_us(min(ts)) + (user_id // 10)*864000000000 AS s FROM events GROUP BY user_id),
ar AS (SELECT *, (s - lag(s) OVER w)/3600e6 AS gb, (lead(s) OVER w - s)/3600e6 AS ga FROM st0 WINDOW w AS (ORDER BY s, platform_id)),
aa AS (SELECT *, CAST(1 + sum(CASE WHEN gb > 48 THEN 1 ELSE 0 END) OVER (ORDER BY s, platform_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS array_id FROM ar)"""


@query("gr01_start_arrays", f"WITH {STARTS} SELECT platform_id, array_id, round(gb, 6) AS gap_before_h, round(ga, 6) AS gap_after_h FROM aa")
def _(spark, sf):
    return groups.start_arrays(starts(spark, sf), 48.0).select("platform_id", "array_id", rnd("gap_before_h").alias("gap_before_h"), rnd("gap_after_h").alias("gap_after_h"))


RULE = groups.ClusterRule(max_start_gap_s=40 * 3600.0, max_pair_m=7000.0, max_diameter_m=9000.0, max_members=6)
OVERRIDES = {2: groups.ClusterRule(1.0, 1.0, 1.0, None, "single_cluster"), 3: groups.ClusterRule(20 * 3600.0, 3000.0, 20000.0)}


def _metrics(spark, sf):
    o = frames.cut(fixes(spark, sf))
    first = o.groupBy("platform_id").agg(F.min_by(F.struct("lon", "lat"), "time").alias("p"))
    p = groups.start_arrays(starts(spark, sf), 48.0).join(first, "platform_id").select(
        "platform_id", "array_id", "start_time", F.col("p.lon").alias("start_lon"), F.col("p.lat").alias("start_lat"))
    p = frames.cut(p)
    g = grid.resample_track(o, cells(o), 2880).join(p.select("platform_id", "array_id"), "platform_id")
    return p, frames.cut(groups.pair_metrics(p, g, RULE, OVERRIDES))


METRICS = f"""{GRID}, {STARTS},
fp AS (SELECT platform_id, arg_min(lon, time) AS lo, arg_min(lat, time) AS la FROM obs GROUP BY 1),
rl AS (SELECT DISTINCT array_id, CASE array_id WHEN 2 THEN 1 WHEN 3 THEN 72000 ELSE 144000 END AS rgap, CASE array_id WHEN 2 THEN 1 WHEN 3 THEN 3000 ELSE 7000 END AS rpair,
  CASE array_id WHEN 2 THEN 1 WHEN 3 THEN 20000 ELSE 9000 END AS rdiam, CASE WHEN array_id IN (2, 3) THEN 1000000 ELSE 6 END AS rmem FROM aa),
pp AS (SELECT a.array_id, a.platform_id AS p1, b.platform_id AS p2, abs(b.s - a.s)/1e6 AS gap, x.lo AS lo0, x.la AS la0, y.lo AS lo1, y.la AS la1
  FROM aa a JOIN aa b ON a.array_id = b.array_id AND a.platform_id < b.platform_id JOIN fp x ON x.platform_id = a.platform_id JOIN fp y ON y.platform_id = b.platform_id),
cm AS (SELECT p1, p2, min(a.t) AS c FROM pp JOIN gr a ON a.platform_id = p1 JOIN gr b ON b.platform_id = p2 AND a.t = b.t WHERE a.lon IS NOT NULL AND b.lon IS NOT NULL GROUP BY 1, 2),
sr AS (SELECT 'o' AS kind, p1, p2, lo0, la0, lo1, la1 FROM pp
  UNION ALL SELECT 'c', p1, p2, a.lon, a.lat, b.lon, b.lat FROM cm JOIN gr a ON a.platform_id = p1 AND a.t = c JOIN gr b ON b.platform_id = p2 AND b.t = c),
{geodesic("sr")},
pm AS MATERIALIZED (SELECT pp.array_id, pp.p1, pp.p2, gap, c, o.s AS om, k.s AS km, gap <= rgap AND o.s <= rpair AS link
  FROM pp JOIN rl USING (array_id) LEFT JOIN cm USING (p1, p2) LEFT JOIN geo o ON o.kind = 'o' AND o.p1 = pp.p1 AND o.p2 = pp.p2 LEFT JOIN geo k ON k.kind = 'c' AND k.p1 = pp.p1 AND k.p2 = pp.p2)"""


@query("gr02_pair_metrics", f"""WITH {METRICS} SELECT array_id, p1 AS platform_1, p2 AS platform_2, round(gap, 6) AS start_gap_s, c AS first_common_us,
 round(om, 3) AS observed_m, round(km, 3) AS common_m, round(om, 3) AS distance_m, coalesce(link, false) AS link FROM pm""")
def _(spark, sf):
    _, m = _metrics(spark, sf)
    return m.select("array_id", "platform_1", "platform_2", rnd("start_gap_s").alias("start_gap_s"), us("first_common").alias("first_common_us"),
                    *[rnd(c, 3).alias(c) for c in ("observed_m", "common_m", "distance_m")], "link")


# One merge for each array at a time: the best of all that its rule allows.
CLUSTERS = METRICS + """,
sg AS (SELECT array_id, platform_id AS p, s, CASE WHEN array_id = 2 THEN min(platform_id) OVER (PARTITION BY array_id) ELSE platform_id END AS seed FROM aa),
st AS (
  SELECT array_id, p, s, seed, 0 AS it FROM sg
  UNION ALL
  (WITH pr AS (SELECT x.array_id, least(x.seed, y.seed) AS a, greatest(x.seed, y.seed) AS b, min(CASE WHEN link THEN om END) AS tie
      FROM st x JOIN st y ON x.array_id = y.array_id AND x.p < y.p AND x.seed <> y.seed JOIN pm ON p1 = x.p AND p2 = y.p GROUP BY 1, 2, 3),
   mg AS (SELECT pr.array_id, a, b, any_value(tie) AS tie, max(om) AS wide, count(*) FILTER (om IS NULL) AS lost
      FROM pr JOIN st x ON x.array_id = pr.array_id AND x.seed IN (a, b) JOIN st y ON y.array_id = pr.array_id AND y.seed IN (a, b) AND x.p < y.p JOIN pm ON p1 = x.p AND p2 = y.p WHERE tie IS NOT NULL GROUP BY 1, 2, 3),
   nm AS (SELECT pr.array_id, a, b, list(p ORDER BY p) AS names, (max(s) - min(s))/1e6 AS spread FROM pr JOIN st ON st.array_id = pr.array_id AND st.seed IN (a, b) GROUP BY 1, 2, 3),
   ch AS (SELECT mg.*, row_number() OVER (PARTITION BY mg.array_id ORDER BY tie, wide, spread, names) AS k FROM mg JOIN nm USING (array_id, a, b) JOIN rl USING (array_id)
      WHERE lost = 0 AND wide <= rdiam AND spread <= rgap AND len(names) <= rmem)
   SELECT st.array_id, st.p, st.s, CASE WHEN st.seed = ch.b THEN ch.a ELSE st.seed END, st.it + 1 FROM st JOIN ch ON ch.array_id = st.array_id AND ch.k = 1)),
lb AS (SELECT * FROM st QUALIFY it = max(it) OVER (PARTITION BY array_id)),
cn AS (SELECT *, count(*) OVER g AS size, row_number() OVER (PARTITION BY array_id, seed ORDER BY s, p) AS member, min((s, p)) OVER g AS f FROM lb WINDOW g AS (PARTITION BY array_id, seed)),
ca AS (SELECT *, 'array_' || lpad(CAST(array_id AS VARCHAR), 3, '0') || '__cluster_' || lpad(CAST(dense_rank() OVER (PARTITION BY array_id ORDER BY f) AS VARCHAR), 3, '0') AS cluster_id FROM cn)"""


@query("gr03_gr05_clusters", f"""WITH RECURSIVE {CLUSTERS} SELECT p AS platform_id, array_id, cluster_id, member AS member_id, size AS cluster_size,
 CASE WHEN array_id = 2 THEN 'configured_single_cluster' WHEN size = 1 THEN 'algorithmic_singleton' ELSE 'candidate_cluster' END AS status FROM ca""")
def _(spark, sf):
    p, m = _metrics(spark, sf)
    return groups.number_clusters(p, groups.agglomerate(p, m, RULE, OVERRIDES), RULE, OVERRIDES).drop("start_time")


@query("gr04_cluster_statistics", f"""WITH RECURSIVE {CLUSTERS}, pc AS (SELECT pm.*, x.cluster_id FROM pm JOIN ca x ON x.p = p1 JOIN ca y ON y.p = p2 WHERE x.cluster_id = y.cluster_id),
ps AS (SELECT cluster_id, count_if(link) AS links, max(om) AS xo, max(km) AS xk, count_if(om IS NULL) AS lo, count_if(km IS NULL) AS lk FROM pc GROUP BY 1)
SELECT any_value(array_id) AS array_id, cluster_id, count(*) AS members, round((max(s) - min(s))/1e6, 3) AS start_spread_s, coalesce(any_value(links), 0) AS links, coalesce(any_value(lo), 0) AS unavailable,
 coalesce(any_value(lk), 0) AS common_unavailable, round(CASE WHEN count(*) = 1 THEN 0 ELSE any_value(xo) END, 3) AS max_available_m, round(CASE WHEN count(*) = 1 THEN 0 WHEN any_value(lo) = 0 THEN any_value(xo) END, 3) AS diameter_m,
 round(CASE WHEN count(*) = 1 THEN 0 WHEN any_value(lo) = 0 THEN any_value(xo) END, 3) AS observed_diameter_m, round(CASE WHEN count(*) = 1 THEN 0 WHEN any_value(lk) = 0 THEN any_value(xk) END, 3) AS common_diameter_m
FROM ca LEFT JOIN ps USING (cluster_id) GROUP BY cluster_id""")
def _(spark, sf):
    p, m = _metrics(spark, sf)
    a = frames.cut(groups.number_clusters(p, groups.agglomerate(p, m, RULE, OVERRIDES), RULE, OVERRIDES))
    s = groups.cluster_statistics(a, m)
    return s.withColumns({c: rnd(c, 3) for c in ("start_spread_s", "max_available_m", "diameter_m", "observed_diameter_m", "common_diameter_m")})


@query("gr06_reference_assignments", """WITH s AS (SELECT user_id, min(ts) AS s FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS platform_id, CASE WHEN user_id % 10 = 1 THEN 100 ELSE row_number() OVER (PARTITION BY user_id // 5 ORDER BY s, CAST(user_id AS VARCHAR)) END AS member_id, NULL AS side
FROM s WHERE user_id % 10 NOT IN (3, 7)
UNION ALL SELECT CAST(user_id AS VARCHAR), NULL, CASE WHEN user_id % 10 = 3 THEN 'only_in_reference' ELSE 'only_in_product' END FROM s WHERE user_id % 10 IN (3, 7)""")
def _(spark, sf):
    p = events(spark, sf).groupBy("user_id", "platform_id").agg(F.min("time").alias("start_time"))
    number = F.when(F.col("user_id") % 10 == 1, 100).cast("long")
    ref = p.where("user_id % 10 <> 7").select("platform_id", F.lit(1).alias("array_id"), F.floor(F.col("user_id") / 5).alias("cluster_id"), number.alias("member_id"))
    good, odd = groups.reference_assignments(p.where("user_id % 10 <> 3"), ref)
    return good.select("platform_id", "member_id", F.lit(None).cast("string").alias("side")).unionByName(odd.withColumn("member_id", F.lit(None).cast("long")))


@query("gr07_activation", f"""WITH {GRID}, n AS (SELECT user_id // 20 AS array_id, user_id // 5 AS cluster_id, t, count(DISTINCT platform_id) AS n FROM gr WHERE lon IS NOT NULL GROUP BY 1, 2, 3)
SELECT array_id, cluster_id, min(t) AS activation_us FROM n WHERE n >= 4 GROUP BY 1, 2""")
def _(spark, sf):
    g = plane(spark, sf).withColumn("valid", F.col("lon").isNotNull())
    return groups.activation(g, minimum=4).select("array_id", "cluster_id", us("activation_time").alias("activation_us"))


@query("gr08_cohorts", """WITH s AS (SELECT user_id, CAST(min(ts) + to_days(CAST((user_id // 10) * 10 AS INTEGER)) AS DATE) AS d FROM events GROUP BY 1),
n AS (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS r FROM (SELECT DISTINCT d FROM s)), c AS (SELECT d, dense_rank() OVER (ORDER BY r) AS cohort FROM n)
SELECT CAST(user_id AS VARCHAR) AS platform_id, cohort FROM s JOIN c USING (d)""")
def _(spark, sf):
    return groups.cohorts(starts(spark, sf)).select("platform_id", F.col("cohort").cast("long").alias("cohort"))


def _encounter_grid(spark, sf):
    g = gridded(spark, sf)
    s = g.groupBy("platform_id").agg(F.min("time").alias("start_time"))
    return frames.cut(g.join(s, "platform_id").withColumn("array_id", F.floor(F.col("user_id") / 20).cast("long")))


ENC = f"""{GRID}, en AS (SELECT a.platform_id AS p1, b.platform_id AS p2, min(a.t) AS t FROM gr a JOIN gr b ON a.t = b.t AND a.platform_id < b.platform_id AND a.user_id // 20 = b.user_id // 20
 WHERE a.lon IS NOT NULL AND b.lon IS NOT NULL AND {hav('a.lon','a.lat','b.lon','b.lat')} <= 2500 GROUP BY 1, 2)"""


MET = f"""{GRID}, g AS (SELECT platform_id, user_id // 20 AS array_id, t, lon, lat FROM gr WHERE lon IS NOT NULL),
bg AS (SELECT platform_id, min(t) AS s0 FROM gr GROUP BY 1),
pr AS (SELECT a.platform_id AS p1, b.platform_id AS p2, a.t, a.lon AS lo0, a.lat AS la0, b.lon AS lo1, b.lat AS la1 FROM g a JOIN g b ON a.array_id = b.array_id AND a.t = b.t AND a.platform_id < b.platform_id),
{geodesic("pr")},
me AS (SELECT p1, p2, min(t) FILTER (WHERE s <= 2500) AS et, arg_min(s, t) FILTER (WHERE s <= 2500) AS em, min(t) AS os, max(t) AS oe FROM geo GROUP BY 1, 2)"""


@query("pr01_encounters", f"""WITH {MET}
SELECT p1 AS platform_id_1, p2 AS platform_id_2, et AS encounter_us, round(em, 2) AS encounter_m, os AS overlap_start_us, oe AS overlap_end_us
FROM me JOIN bg x ON x.platform_id = p1 JOIN bg y ON y.platform_id = p2 WHERE et <= least(x.s0, y.s0) + 20*86400000000""")
def _(spark, sf):
    e = pairs.encounters(_encounter_grid(spark, sf), 2500.0, max_from_start_s=20 * 86400.0, same=("array_id",))
    return e.select("platform_id_1", "platform_id_2", us("encounter_time").alias("encounter_us"), rnd("encounter_m", 2).alias("encounter_m"),
                    us("overlap_start").alias("overlap_start_us"), us("overlap_end").alias("overlap_end_us"))


@query("pr01_first_crossings_all", f"""WITH {GRID}, h AS (SELECT a.platform_id AS platform_id_1, b.platform_id AS platform_id_2, a.t, {hav('a.lon','a.lat','b.lon','b.lat')} AS d FROM gr a JOIN gr b ON a.t = b.t AND a.platform_id < b.platform_id
  WHERE a.lon IS NOT NULL AND b.lon IS NOT NULL AND abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.02)
SELECT platform_id_1, platform_id_2, min(t) AS first_us FROM h WHERE d <= 500 GROUP BY 1, 2""")
def _(spark, sf):
    # The same cell join with the spherical distance, which SQL can repeat.
    m = pairs.near_pairs(gridded(spark, sf), 520.0).where(geo_hav() <= 500)
    return m.groupBy("platform_id_1", "platform_id_2").agg(F.min(us("time")).alias("first_us"))


def geo_hav():
    from fleetwake.functions.geo import haversine

    return haversine("lon_1", "lat_1", "lon_2", "lat_2")


@query("pr02_search_counts", f"""WITH {GRID}, p AS (SELECT DISTINCT platform_id, user_id // 20 AS a FROM gr), v AS (SELECT platform_id, user_id // 20 AS a, t FROM gr WHERE lon IS NOT NULL)
SELECT (SELECT count(*)*(count(*)-1)//2 FROM p) AS possible, (SELECT CAST(sum(n*(n-1)//2) AS BIGINT) FROM (SELECT a, count(*) AS n FROM p GROUP BY 1)) AS eligible,
 (SELECT count(*) FROM (SELECT DISTINCT x.platform_id, y.platform_id FROM v x JOIN v y ON x.a = y.a AND x.t = y.t AND x.platform_id < y.platform_id)) AS overlapping""")
def _(spark, sf):
    g = _encounter_grid(spark, sf)
    p = g.select("platform_id", "array_id").distinct()
    found = g.sparkSession.range(0)
    return pairs.search_counts(p, g, found, ("array_id",)).select("possible", "eligible", F.col("overlapping").cast("long").alias("overlapping"))


@query("pr03_pair_table", f"""WITH {MET},
rw AS (SELECT p1, p2, a.t, a.lon AS x1, b.lon AS x2, a.lat AS y1, b.lat AS y2 FROM me JOIN gr a ON a.platform_id = p1 AND a.t BETWEEN os AND oe JOIN gr b ON b.platform_id = p2 AND b.t = a.t WHERE et IS NOT NULL)
SELECT 'pair_' || substr(sha256('["' || p1 || '","' || p2 || '"]'), 1, 20) AS pair_id, row_number() OVER (PARTITION BY p1, p2 ORDER BY t) - 1 AS obs, t AS t_us,
 round(degrees(atan2((sin(radians(x1)) + sin(radians(x2)))/2, (cos(radians(x1)) + cos(radians(x2)))/2)), 6) AS center_lon, round((y1 + y2)/2, 6) AS center_lat FROM rw""")
def _(spark, sf):
    g = _encounter_grid(spark, sf)
    e = pairs.encounters(g, 2500.0, same=("array_id",))
    t = pairs.pair_table(e, g)
    return t.select("pair_id", "obs", us("time").alias("t_us"), rnd("center_lon").alias("center_lon"), rnd("center_lat").alias("center_lat"))


@query("pr04_pr05_pair_observations", f"""WITH {PAIRS} SELECT pair_id, t AS t_us, round(r, 3) AS r_m, round(dul*1e3, 4) + 0.0 AS dul_mm, round(dut*1e3, 4) + 0.0 AS dut_mm, round(-1.25*dul*dul*dul/r*1e12, 4) + 0.0 AS q_e12,
 round(mx, 3) AS mid_x, CASE WHEN c1 = c2 THEN 'within_cluster' ELSE 'cross_cluster' END AS relation FROM pr""")
def _(spark, sf):
    p = pairs.pair_observations(moving(spark, sf), spread=2)
    return p.select("pair_id", us("time").alias("t_us"), rnd("r_m", 3).alias("r_m"), rnd(F.col("dul") * 1e3, 4).alias("dul_mm"), rnd(F.col("dut") * 1e3, 4).alias("dut_mm"),
                    rnd(F.col("q") * 1e12, 4).alias("q_e12"), rnd("mid_x", 3).alias("mid_x"), "relation")


@query("pr06_inventory_violations", """WITH e AS (SELECT user_id AS a, event_id % 7 + user_id - 3 AS b FROM events)
SELECT least(a, b) AS platform_1, greatest(a, b) AS platform_2, count(*) AS n, CASE WHEN a = b THEN 'self_pair' ELSE 'repeated_pair' END AS rule FROM e GROUP BY 1, 2, 4 HAVING count(*) > 1 OR bool_or(a = b)""")
def _(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("a"), (F.col("obs_index") % 7 + F.col("user_id") - 3).alias("b"))
    return pairs.inventory_violations(e, "a", "b")


@query("pr07_pair_coverage", f"""WITH {MOVE}, j AS (SELECT a.cluster_id, a.platform_id AS p1, b.platform_id AS p2, a.t, a.u IS NOT NULL AND b.u IS NOT NULL AS ok FROM mv a JOIN mv b ON a.cluster_id = b.cluster_id AND a.t = b.t AND a.platform_id < b.platform_id),
e AS (SELECT cluster_id, p1, p2, count(*) AS scheduled, count_if(ok) AS valid, min(CASE WHEN ok THEN t END) AS f, max(CASE WHEN ok THEN t END) AS l FROM j GROUP BY 1, 2, 3)
SELECT e.cluster_id, e.p1 AS platform_id_1, e.p2 AS platform_id_2, any_value(scheduled) AS scheduled, any_value(valid) AS valid, count_if(t < f) AS before, count_if(t > l) AS after, round(any_value(valid)/any_value(scheduled), 6) AS fraction FROM e JOIN j USING (cluster_id, p1, p2) GROUP BY 1, 2, 3""")
def _(spark, sf):
    c = pairs.coverage(moving(spark, sf))
    return c.select("cluster_id", "platform_id_1", "platform_id_2", "scheduled", "valid", "before", "after", rnd("fraction").alias("fraction"))


@query("pr08_exclusion_reasons", f"""WITH {MOVE}, j AS (SELECT a.array_id, a.reason AS r1, b.reason AS r2, sqrt(pow(b.x-a.x,2) + pow(b.y-a.y,2)) AS r FROM mv a JOIN mv b ON a.array_id = b.array_id AND a.t = b.t AND a.platform_id < b.platform_id),
k AS (SELECT array_id, CASE WHEN r1 = 'valid' AND r2 = 'valid' THEN CASE WHEN r <= 0 THEN 'zero_or_invalid_separation' WHEN r < 1000 THEN 'below_minimum_reliable_separation' ELSE 'valid' END
  WHEN 'nonfinite_position_in_stencil' IN (r1, r2) THEN 'nonfinite_position_in_stencil' WHEN 'source_gap_exceeded_in_stencil' IN (r1, r2) THEN 'source_gap_exceeded_in_stencil' ELSE 'outside_centered_stencil' END AS reason FROM j)
SELECT array_id, reason, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY array_id), 6) AS fraction FROM k GROUP BY 1, 2""")
def _(spark, sf):
    return pairs.exclusion_reasons(moving(spark, sf), ("array_id",), 1000.0).withColumn("fraction", rnd("fraction"))


@query("pr09_populations", f"""WITH {PAIRS}, k AS (SELECT array_id, CASE WHEN c1 = c2 THEN 'within_cluster' ELSE 'cross_cluster' END AS population FROM pr UNION ALL SELECT array_id, 'all_array' FROM pr)
SELECT array_id, population, count(*) AS n FROM k GROUP BY 1, 2""")
def _(spark, sf):
    return pairs.with_populations(pairs.pair_observations(moving(spark, sf))).groupBy("array_id", "population").agg(F.count(F.lit(1)).alias("n"))


@query("kn02_centred_velocity", f"WITH {MOVE} SELECT platform_id, cell*{H6} AS t_us, reason, round(u*1e3, 4) + 0.0 AS u_mm, round(v*1e3, 4) + 0.0 AS v_mm FROM mv")
def _(spark, sf):
    return moving(spark, sf).select("platform_id", us("time").alias("t_us"), "reason", rnd(F.col("u") * 1e3, 4).alias("u_mm"), rnd(F.col("v") * 1e3, 4).alias("v_mm"))


@query("kn03_exact_span_velocity", f"""WITH {MOVE}, i AS (SELECT *, t >= 1704672000000000 AND t <= 1706140800000000 AS inc FROM pl),
b AS (SELECT platform_id, min(t) AS a, max(t) AS z FROM i WHERE inc GROUP BY 1),
w AS (SELECT i.*, a, z, lag(inc) OVER p AS il, lead(inc) OVER p AS ir, lead(inc, 2) OVER p AS i2, lag(inc, 2) OVER p AS im, lag(x) OVER p AS xl, lead(x) OVER p AS xr, lead(x, 2) OVER p AS x2, lag(x, 2) OVER p AS xm FROM i JOIN b USING (platform_id) WINDOW p AS (PARTITION BY platform_id ORDER BY t)),
k AS (SELECT *, CASE WHEN inc AND il AND ir THEN 'c' WHEN inc AND 2*(t - a) < 43200000000 AND i2 THEN 'f' WHEN inc AND 2*(z - t) < 43200000000 AND im THEN 'b' END AS s FROM w)
SELECT platform_id, t AS t_us, s AS stencil, round(CASE s WHEN 'c' THEN CASE WHEN x IS NOT NULL THEN xr - xl END WHEN 'f' THEN CASE WHEN xr IS NOT NULL THEN x2 - x END WHEN 'b' THEN CASE WHEN xl IS NOT NULL THEN x - xm END END/43200*1e3, 4) + 0.0 AS u_mm FROM k""")
def _(spark, sf):
    t = us("time")
    p = plane(spark, sf).withColumn("included", (t >= 1704672000000000) & (t <= 1706140800000000))
    v = kinematics.exact_span_velocity(p, cadence_s=21600, span_s=43200)
    inc = p.where("included").select("platform_id").distinct()
    return v.join(inc, "platform_id", "left_semi").select("platform_id", us("time").alias("t_us"), "stencil", rnd(F.col("u") * 1e3, 4).alias("u_mm"))


_ECC2 = "(1/298.257223563*(2 - 1/298.257223563))"
_SIN2 = f"(1 - {_ECC2}*pow(sin(radians(py)), 2))"


@query("kn01_stored_velocity_in_plane", f"""WITH {GRID},
nx AS (SELECT platform_id, cell, user_id // 20 AS array_id, lon AS px, lat AS py, {_NEXT} FROM gr WINDOW w AS (PARTITION BY platform_id ORDER BY t)), {geodesic("nx", "ga")},
fv AS (SELECT platform_id, cell, array_id, px, py, s/21600 AS v, radians(az) AS a FROM ga),
fp AS (SELECT user_id // 20 AS array_id, platform_id, radians(arg_min(lon, t)) AS x, radians(arg_min(lat, t)) AS y FROM gr WHERE lon IS NOT NULL GROUP BY 1, 2),
og AS (SELECT array_id, degrees(atan2(avg(cos(y)*sin(x)), avg(cos(y)*cos(x)))) AS lo0, degrees(atan2(avg(sin(y)), sqrt(pow(avg(cos(y)*cos(x)), 2) + pow(avg(cos(y)*sin(x)), 2)))) AS la0 FROM fp GROUP BY 1),
pj AS (SELECT fv.*, og.lo0, og.la0, px AS lo1, py AS la1 FROM fv JOIN og USING (array_id)), {geodesic("pj", "gb")},
pp AS (SELECT platform_id, cell, px, py, v, a, lo0, la0, s*sin(radians(az)) AS x, s*cos(radians(az)) AS y FROM gb),
-- A step of one second is centimetres at most: the radii of curvature at its start are exact enough.
pq AS (SELECT *, CASE WHEN v <= 0.02 THEN px + degrees(v*sin(a)*sqrt({_SIN2})/(6378137.0*cos(radians(py)))) END AS lo1,
  CASE WHEN v <= 0.02 THEN py + degrees(v*cos(a)*pow({_SIN2}, 1.5)/(6378137.0*(1 - {_ECC2}))) END AS la1 FROM pp), {geodesic("pq", "gc")}
SELECT platform_id, cell, CASE WHEN v IS NULL THEN 'missing_stored_forward_velocity' WHEN v > 0.02 THEN 'speed_mask_exceeded' ELSE 'valid' END AS reason,
 round(s*sin(radians(az)) - x, 5) + 0.0 AS u, round(s*cos(radians(az)) - y, 5) + 0.0 AS v FROM gc""")
def _(spark, sf):
    f = frames.cut(fixes(spark, sf))
    g = grid.regular_product(f, cells(f), 2880).withColumn("array_id", F.floor(F.col("user_id") / 20))
    g = frames.cut(g)
    q = audit.project(g, audit.projection_origins(g)).withColumnsRenamed({"u": "u_east", "v": "v_north"})
    s = kinematics.stored_velocity_in_plane(q, 2880.0, 0.02)
    return s.select("platform_id", "cell", "reason", rnd("u", 5).alias("u"), rnd("v", 5).alias("v"))


@query("kn04_platform_diagnostics", f"""WITH {MOVE}, n AS (SELECT array_id, cluster_id, t, count_if(u IS NOT NULL) AS active FROM mv GROUP BY 1, 2, 3), a AS (SELECT cluster_id, min(t) AS a FROM n WHERE active >= 2 GROUP BY 1)
SELECT platform_id, mv.t AS t_us, active AS active_members, round((mv.t - a)/3600e6, 6) AS age_h FROM mv JOIN n ON n.cluster_id = mv.cluster_id AND n.t = mv.t LEFT JOIN a ON a.cluster_id = mv.cluster_id""")
def _(spark, sf):
    m = moving(spark, sf)
    d = kinematics.platform_diagnostics(m, groups.activation(m, minimum=2))
    return d.select("platform_id", us("time").alias("t_us"), "active_members", rnd("age_h").alias("age_h"))


@query("kn05_velocity_observations", f"WITH {MOVE} SELECT platform_id, t AS t_us, round(sqrt(u*u + v*v)*1e3, 4) AS speed_mm FROM mv WHERE u IS NOT NULL")
def _(spark, sf):
    return kinematics.velocity_observations(moving(spark, sf)).select("platform_id", us("time").alias("t_us"), rnd(F.col("speed") * 1e3, 4).alias("speed_mm"))


PTS = f"""{MOVE}, sz AS (SELECT cluster_id, count(DISTINCT platform_id) AS size FROM mv GROUP BY 1),
ac AS (SELECT array_id, cluster_id, t, count_if(x IS NOT NULL) AS active, any_value(size) AS size FROM mv JOIN sz USING (cluster_id) GROUP BY 1, 2, 3),
ms AS (SELECT array_id, cluster_id, min(t) AS s FROM ac WHERE active = size GROUP BY 1, 2),
me AS (SELECT ms.array_id, ms.cluster_id, any_value(s) AS s, min(CASE WHEN active < size THEN t END) AS lost FROM ms JOIN ac ON ac.cluster_id = ms.cluster_id AND t >= s GROUP BY 1, 2),
pts AS (SELECT mv.* FROM mv JOIN me ON me.cluster_id = mv.cluster_id AND t >= s AND (lost IS NULL OR t < lost) WHERE x IS NOT NULL)"""


def points(spark, sf):
    m = moving(spark, sf)
    sizes = m.groupBy("array_id", "cluster_id").agg(F.count_distinct("platform_id").alias("cluster_size"))
    return clusters.admit(m, clusters.membership(m, sizes))


@query("cs01_membership", f"WITH {PTS} SELECT array_id, cluster_id, s AS start_us, lost AS lost_us FROM me")
def _(spark, sf):
    m = moving(spark, sf)
    sizes = m.groupBy("array_id", "cluster_id").agg(F.count_distinct("platform_id").alias("cluster_size"))
    return clusters.membership(m, sizes).select("array_id", "cluster_id", us("start").alias("start_us"), us("lost").alias("lost_us"))


@query("cs02_cs03_geometry", f"""WITH {PTS}, g AS (SELECT cluster_id, t, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy FROM pts GROUP BY 1, 2),
f AS (SELECT cluster_id, arg_min(cx, t) AS fx, arg_min(cy, t) AS fy FROM g GROUP BY 1)
SELECT g.cluster_id, t AS t_us, round(cx, 3) AS cx, round(sqrt((xx+yy)/2 + sqrt(pow((xx-yy)/2, 2) + xy*xy)), 3) AS major_m, round(sqrt(xx+yy), 3) AS gyration_m, round(sqrt(pow(cx-fx,2) + pow(cy-fy,2)), 3) AS centroid_displacement_m FROM g JOIN f USING (cluster_id)""")
def _(spark, sf):
    s = clusters.centroid_displacement(frames.cut(clusters.geometry(points(spark, sf))))
    return s.select("cluster_id", us("time").alias("t_us"), *[rnd(c, 3).alias(c) for c in ("cx", "major_m", "gyration_m", "centroid_displacement_m")])


@query("cs04_hull_area", f"""WITH {PTS}, q AS (SELECT cluster_id, t, count(*) AS n FROM pts GROUP BY 1, 2), u AS (SELECT DISTINCT cluster_id, t, x, y FROM pts),
e AS (SELECT a.cluster_id, a.t, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM u a JOIN u b ON a.cluster_id = b.cluster_id AND a.t = b.t AND (a.x <> b.x OR a.y <> b.y)),
k AS (SELECT e.cluster_id, e.t, ax, ay, qx, qy, min((qx - ax)*(c.y - ay) - (qy - ay)*(c.x - ax)) AS side, max(CASE WHEN (qx - ax)*(c.y - ay) - (qy - ay)*(c.x - ax) = 0 THEN pow(c.x - ax, 2) + pow(c.y - ay, 2) END) AS far,
  max(CASE WHEN (qx - ax)*(c.y - ay) - (qy - ay)*(c.x - ax) = 0 THEN -((c.x - ax)*(qx - ax) + (c.y - ay)*(qy - ay)) END) AS back FROM e JOIN u c ON c.cluster_id = e.cluster_id AND c.t = e.t GROUP BY ALL),
h AS (SELECT cluster_id, t, sum((ax - mx)*(qy - my) - (ay - my)*(qx - mx))/2 AS area, count(*) AS edges FROM k JOIN (SELECT cluster_id, t, min(x) AS mx, min(y) AS my FROM u GROUP BY 1, 2) USING (cluster_id, t)
  WHERE side >= 0 AND far <= pow(qx - ax, 2) + pow(qy - ay, 2) AND back <= 0 GROUP BY 1, 2),
r AS (SELECT q.*, CASE WHEN edges > 2 AND area > 0 THEN area END AS a FROM q LEFT JOIN h USING (cluster_id, t))
SELECT cluster_id, t AS t_us, n, round(a, 2) AS hull_m2, round(a/(arg_min(a, t) FILTER (a IS NOT NULL) OVER (PARTITION BY cluster_id)), 5) AS hull_ratio FROM r""")
def _(spark, sf):
    h = clusters.hull_area(points(spark, sf))
    return h.select("cluster_id", us("time").alias("t_us"), "n", rnd("hull_m2", 2).alias("hull_m2"), rnd("hull_ratio", 5).alias("hull_ratio"))


@query("cs05_cs06_displacement_speed", f"""WITH {PTS}, f AS (SELECT platform_id, arg_min(x, t) AS fx, arg_min(y, t) AS fy FROM pts GROUP BY 1),
d AS (SELECT cluster_id, t, avg(sqrt(pow(x-fx,2) + pow(y-fy,2))) AS dm, quantile_cont(sqrt(pow(x-fx,2) + pow(y-fy,2)), 0.5) AS d50 FROM pts JOIN f USING (platform_id) GROUP BY 1, 2),
m AS (SELECT cluster_id, t, avg(u) AS mu, avg(v) AS mv FROM pts WHERE u IS NOT NULL GROUP BY 1, 2),
s AS (SELECT pts.cluster_id, pts.t, avg(sqrt(u*u+v*v)) AS sm, quantile_cont(sqrt(pow(u-mu,2) + pow(v-m.mv,2)), 0.9) AS i90 FROM pts JOIN m ON m.cluster_id = pts.cluster_id AND m.t = pts.t WHERE u IS NOT NULL GROUP BY 1, 2)
SELECT d.cluster_id, d.t AS t_us, round(dm, 3) AS displacement_mean, round(d50, 3) AS displacement_p50, round(sm*1e3, 5) AS speed_mean_mm, round(i90*1e3, 5) AS internal_speed_p90_mm FROM d LEFT JOIN s ON s.cluster_id = d.cluster_id AND s.t = d.t""")
def _(spark, sf):
    p = frames.cut(points(spark, sf))
    j = clusters.absolute_displacement(p).join(clusters.speeds(p), ["array_id", "cluster_id", "time"], "left")
    return j.select("cluster_id", us("time").alias("t_us"), rnd("displacement_mean", 3).alias("displacement_mean"), rnd("displacement_p50", 3).alias("displacement_p50"),
                    rnd(F.col("speed_mean") * 1e3, 5).alias("speed_mean_mm"), rnd(F.col("internal_speed_p90") * 1e3, 5).alias("internal_speed_p90_mm"))


@query("cs07_cs08_pair_dispersion", f"""WITH {PTS}, p AS (SELECT a.cluster_id, a.t, a.platform_id AS p1, b.platform_id AS p2, b.x-a.x AS dx, b.y-a.y AS dy FROM pts a JOIN pts b ON a.cluster_id = b.cluster_id AND a.t = b.t AND a.platform_id < b.platform_id),
f AS (SELECT p1, p2, arg_min(dx, t) AS fx, arg_min(dy, t) AS fy FROM p GROUP BY 1, 2),
s AS (SELECT cluster_id, t, avg(sqrt(dx*dx+dy*dy)) AS sm, avg(pow(dx-fx,2) + pow(dy-fy,2)) AS d2 FROM p JOIN f USING (p1, p2) GROUP BY 1, 2)
SELECT cluster_id, 'separation_mean' AS metric, count(*) AS n, round(avg(sm), 3) AS mean, round(quantile_cont(sm, 0.5), 3) AS p50 FROM s GROUP BY 1
UNION ALL SELECT cluster_id, 'dispersion_m2', count(*), round(avg(d2), 3), round(quantile_cont(d2, 0.5), 3) FROM s GROUP BY 1""")
def _(spark, sf):
    d = frames.cut(clusters.pair_dispersion(points(spark, sf)))
    s = clusters.summarize(d, ["separation_mean", "dispersion_m2"])
    return s.select("cluster_id", "metric", "n", rnd("mean", 3).alias("mean"), rnd("p50", 3).alias("p50"))


@query("io07_product_audit", f"""WITH {GRID},
fl AS (SELECT *, CASE WHEN lon IS NOT NULL AND cell % 50 = 7 THEN NULL WHEN lon IS NOT NULL AND cell % 60 = 11 THEN 200.0 ELSE lon END AS x FROM gr),
st AS (SELECT DISTINCT t FROM fl), sp2 AS (SELECT t - lag(t) OVER (ORDER BY t) AS d FROM st)
SELECT 'qc_360' AS product, (SELECT count(*) FROM st) AS n_times, (SELECT CAST(count(DISTINCT d) AS INTEGER) FROM sp2) AS n_cadences, (SELECT min(d)/6e7 FROM sp2) AS cadence_min,
 CAST(count_if((x IS NULL) <> (lat IS NULL)) + count_if((x IS NULL) <> (lat IS NULL) AND cell % 97 = 3) AS INTEGER) AS mask_mismatch,
 CAST(count_if(x >= 180) + count_if(x >= 180 AND cell % 97 = 3) AS INTEGER) AS lon_out_of_range, CAST(count_if(cell % 97 = 3) AS INTEGER) AS repeated_cells FROM fl""")
def _(spark, sf):
    g = gridded(spark, sf).withColumn("product", F.lit("qc_360"))
    here = F.col("lon").isNotNull()
    g = g.withColumn("lon", F.when(here & (F.col("cell") % 50 == 7), None).when(here & (F.col("cell") % 60 == 11), 200.0).otherwise(F.col("lon")))
    g = g.unionByName(g.where("cell % 97 = 3"))
    a = tables.product_audit(frames.cut(g))
    return a.select("product", "n_times", *[F.col(c).cast("int").alias(c) for c in ("n_cadences", "mask_mismatch", "lon_out_of_range", "repeated_cells")], "cadence_min")


@query("io11_select_ids", """SELECT CAST(user_id AS VARCHAR) AS platform_id, count(*) AS n FROM events WHERE user_id IN (1, 3, 7) GROUP BY 1 UNION ALL SELECT 'nobody', 0""")
def _(spark, sf):
    e = events(spark, sf)
    rows, unknown = tables.select_ids(e, "platform_id", ["1", "3", "7", "nobody"], e.select("platform_id").distinct())
    return rows.groupBy("platform_id").agg(F.count(F.lit(1)).alias("n")).unionByName(unknown.withColumn("n", F.lit(0).cast("long")))


@query("io13_array_view", f"""WITH {GRID}, w AS (SELECT user_id // 20 AS a, min(t) FILTER (WHERE lon IS NOT NULL) AS s, max(t) FILTER (WHERE lon IS NOT NULL) AS e FROM gr GROUP BY 1)
SELECT platform_id, t AS t_us, round((t - s)/3600e6, 6) AS age_h FROM gr JOIN w ON a = user_id // 20 WHERE t BETWEEN s AND e""")
def _(spark, sf):
    return tables.array_view(plane(spark, sf)).select("platform_id", us("time").alias("t_us"), rnd("age_h").alias("age_h"))


@query("io07_io08_product_store", f"""WITH {GRID} SELECT user_id // 20 AS array_id, platform_id, count(*) AS cells, count(lon) AS positions, any_value(user_id // 5) AS cluster_id FROM gr GROUP BY 1, 2""")
def _(spark, sf):
    """Write two products under product and array folders, read one back with its platform table."""
    import uuid

    g = plane(spark, sf).select("array_id", "platform_id", "time", "lon", "lat", "source_gap_min")
    both = frames.cut(g).withColumn("product", F.explode(F.array(F.lit("qc_360"), F.lit("raw_360"))))
    path = f"{frames.shared_folder(spark).rstrip('/')}/products-{uuid.uuid4().hex}"
    tables.write_products(both, path)
    platforms = events(spark, sf).select("platform_id", F.floor(F.col("user_id") / 5).cast("long").alias("cluster_id")).distinct()
    p = tables.load_product(spark.read.parquet(path), platforms, "qc_360")
    return p.groupBy(F.col("array_id").cast("long").alias("array_id"), "platform_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count("lon").alias("positions"), F.max("cluster_id").alias("cluster_id"))


@query("io12_table_sinks", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, 3 AS copies FROM events GROUP BY 1")
def _(spark, sf):
    """One result table through Parquet, ORC and CSV and back."""
    import uuid

    e = events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    e = frames.cut(e)
    base = f"{frames.shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    back = None
    for fmt in ("parquet", "orc", "csv"):
        tables.write_table(e, f"{base}/{fmt}", fmt)
        one = tables.read(spark, f"{base}/{fmt}", fmt, e.schema, **({"header": True} if fmt == "csv" else {}))
        back = one if back is None else back.unionByName(one)
    return back.groupBy("event_type", "n", rnd("total", 2).alias("total")).agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query("qc23_adjacent_kinematics", f"""WITH {OBS},
fx AS (SELECT platform_id, obs_index, epoch_us(time) AS t, lon, lat FROM obs),
lg AS (SELECT *, (t - lag(t) OVER w)/1e6 AS gap, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM fx WINDOW w AS (PARTITION BY platform_id ORDER BY t, obs_index)),
ed AS (SELECT platform_id, obs_index, t, CASE WHEN gap > 0 THEN gap END AS dt, CASE WHEN gap > 0 THEN plon END AS lo0, CASE WHEN gap > 0 THEN plat END AS la0, lon AS lo1, lat AS la1 FROM lg),
{geodesic("ed")},
ve AS (SELECT *, s/dt AS speed, s/dt*sin(radians(az)) AS ve, s/dt*cos(radians(az)) AS vn FROM geo),
nx AS (SELECT *, lead(dt) OVER w AS dt2, lead(ve) OVER w AS ve2, lead(vn) OVER w AS vn2 FROM ve WINDOW w AS (PARTITION BY platform_id ORDER BY t, obs_index))
SELECT obs_index, round(dt, 6) AS dt_s, round(s, 3) AS distance_m, round(speed, 6) AS speed, round(sqrt(pow(ve2 - ve, 2) + pow(vn2 - vn, 2))/((dt + dt2)/2)*1e6, 4) AS acceleration_um_s2 FROM nx""")
def _(spark, sf):
    from fleetwake.operators.quality import adjacent_kinematics

    k = adjacent_kinematics(fixes(spark, sf))
    return k.select("obs_index", rnd("dt_s").alias("dt_s"), rnd("distance_m", 3).alias("distance_m"), rnd("speed").alias("speed"), rnd(F.col("acceleration") * 1e6, 4).alias("acceleration_um_s2"))
