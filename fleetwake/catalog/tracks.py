"""Queries of the sources and row-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwake.catalog.base import query, rnd, us
from fleetwake.catalog.inputs import OBS, events, hav, observations, signals
from fleetwake.functions import geo
from fleetwake.operators import audit, frames
from fleetwake.sources import tables

DAY = 86_400_000_000
OFF_NULL = 7  # the derived sentinel rule: event_id % 7 = 3 carries -999

LAG = """lagged AS (SELECT *, lag(time) OVER w AS t0, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0,
  lag(obs_index) OVER w AS i0, lead(time) OVER w AS t2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2
  FROM obs WINDOW w AS (PARTITION BY platform_id ORDER BY time, obs_index))"""


@query("flagship_track_audit", f"""
WITH {OBS}, {LAG},
e AS (SELECT *, date_diff('microsecond', t0, time)/1e6 AS dt FROM lagged),
s AS (SELECT *, {hav('lon0','lat0','lon','lat')} / dt AS v FROM e)
SELECT platform_id, count(*) AS n_fixes, count_if(v > 0.003) AS n_fast_edges,
  1 + count_if(dt > 86400) AS n_segments,
  round(quantile_cont(dt, 0.5), 3) AS gap_p50, round(quantile_cont(dt, 0.95), 3) AS gap_p95, round(max(dt), 3) AS gap_max
FROM s GROUP BY platform_id""")
def _(spark, sf):
    o = audit.consecutive_speed(observations(spark, sf))
    counts = o.groupBy("platform_id").agg(
        F.count(F.lit(1)).alias("n_fixes"),
        F.count_if(F.col("speed") > 0.003).alias("n_fast_edges"),
        (F.count_if(F.col("dt_s") > 86400) + 1).alias("n_segments"),
    )
    q = frames.quantiles(o, "platform_id", {"gap": F.col("dt_s")}, {"p50": 0.5, "p95": 0.95, "max": 1.0})
    return counts.join(q, "platform_id", "left").select(
        "platform_id", "n_fixes", "n_fast_edges", "n_segments",
        rnd("gap_p50", 3).alias("gap_p50"), rnd("gap_p95", 3).alias("gap_p95"), rnd("gap_max", 3).alias("gap_max"),
    )


@query("io01_observation_load", f"""
WITH {OBS} SELECT platform_id, obs_index, epoch_us(time) AS t_us, round(lon,6) AS lon, round(lat,6) AS lat,
  CASE WHEN obs_index % 7 = 3 THEN NULL ELSE sst END AS sst FROM obs""")
def _(spark, sf):
    raw = observations(spark, sf).withColumn("sst", F.when(F.col("obs_index") % 7 == 3, -999.0).otherwise(F.col("sst")))
    return tables.load_observations(raw).select(
        "platform_id", "obs_index", us("time").alias("t_us"), rnd("lon").alias("lon"), rnd("lat").alias("lat"), "sst")


@query("io02_signal_load", """
SELECT CAST(user_id AS VARCHAR) AS platform_id, event_id AS obs_index, epoch_us(ts) AS t_us,
  CASE WHEN event_id % 7 = 3 THEN NULL ELSE value END AS ttff, round(value/10, 6) AS strain FROM events""")
def _(spark, sf):
    raw = signals(spark, sf).withColumn("ttff", F.when(F.col("obs_index") % 7 == 3, -999.0).otherwise(F.col("ttff")))
    return tables.load_signals(raw).select("platform_id", "obs_index", us("time").alias("t_us"), "ttff", rnd("strain").alias("strain"))


@query("io03_serial_day_timestamp", """
SELECT event_id AS obs_index,
  CASE WHEN event_id % 11 = 5 THEN NULL ELSE (739251 + event_id % 30 - 719529) * 86400000000 + CAST(round_even((event_id % 1000) / 1000.0 * 86400e6, 0) AS BIGINT) END AS t_us
FROM events""")
def _(spark, sf):
    e = events(spark, sf)
    # Thousandths of a day are not binary fractions; split as the operator does, then compare to the millisecond.
    d = F.when(F.col("obs_index") % 11 == 5, F.lit(-999.0)).otherwise(
        F.lit(739251.0) + F.col("obs_index") % 30 + (F.col("obs_index") % 1000) / 1000.0)
    t = F.unix_micros(tables.serial_day_timestamp(d))
    return e.select("obs_index", (F.round(t / F.lit(1000.0)).cast("long") * 1000).alias("t_us"))


@query("io04_source_order", """
WITH d AS (SELECT CAST(user_id % 40 AS VARCHAR) AS platform_id, user_id // 40 AS grp, event_id,
    CASE WHEN user_id % 40 % 3 = 0 THEN ts WHEN user_id % 40 % 3 = 1 THEN TIMESTAMP '2030-01-01' - (ts - TIMESTAMP '2024-01-01')
         WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 2 DAY END AS t,
    user_id % 40 = 39 AND event_id % 5 = 0 AS bad FROM events),
n AS (SELECT *, CASE WHEN bad THEN NULL ELSE t END AS tt FROM d),
l AS (SELECT *, lag(tt) OVER (PARTITION BY platform_id ORDER BY event_id) AS p FROM n)
SELECT platform_id, count(*) AS n, CASE WHEN bool_or(tt IS NULL) THEN 'invalid_times'
  WHEN coalesce(bool_and(tt >= p), true) THEN 'ascending' WHEN coalesce(bool_and(tt <= p), true) THEN 'descending'
  ELSE 'mixed' END AS source_order FROM l GROUP BY platform_id""")
def _(spark, sf):
    e = events(spark, sf)
    p = F.col("user_id") % 40
    flipped = F.timestamp_micros(
        F.lit(1893456000000000) - (F.unix_micros("time") - F.lit(1704067200000000)))
    t = (F.when(p % 3 == 0, F.col("time")).when(p % 3 == 1, flipped)
         .when(F.col("obs_index") % 2 == 0, F.col("time")).otherwise(F.col("time") + F.expr("INTERVAL 2 DAY")))
    bad = (p == 39) & (F.col("obs_index") % 5 == 0)
    d = e.select(p.cast("string").alias("platform_id"), "obs_index", F.when(~bad, t).alias("time"))
    return tables.source_order(d, width=20_000)


@query("io05_identity_violations", """
WITH d AS (SELECT CAST(user_id AS VARCHAR) AS platform_id, event_id // 2 AS obs_index, event_type || '/' || (user_id % 13) AS source FROM events),
a AS (SELECT source AS subject, count(DISTINCT platform_id) AS n FROM d GROUP BY 1 HAVING count(DISTINCT platform_id) > 1),
b AS (SELECT platform_id, obs_index, count(*) c FROM d GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'several_platforms_in_source' AS rule, subject, n FROM a
UNION ALL SELECT 'repeated_obs_index', platform_id, count(*) FROM b GROUP BY platform_id""")
def _(spark, sf):
    e = events(spark, sf).select(
        "platform_id", F.floor(F.col("obs_index") / 2).alias("obs_index"),
        F.concat_ws("/", "event_type", (F.col("user_id") % 13).cast("string")).alias("source"))
    return tables.identity_violations(e, "source")


@query("io06_deployments", """
WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS platform_id,
  CASE WHEN user_id % 4 = 0 THEN epoch_us(date_trunc('second', a)) END AS exact_us,
  CASE WHEN user_id % 4 = 1 THEN epoch_us(date_trunc('second', a)) END AS start_us,
  CASE WHEN user_id % 4 = 1 THEN epoch_us(date_trunc('second', z)) END AS end_us,
  CASE WHEN user_id % 4 = 2 THEN 'needs_one_exact_time_or_window' WHEN user_id % 4 = 3 THEN 'incomplete_window' END AS rule
FROM s""")
def _(spark, sf):
    s = events(spark, sf).groupBy("user_id", "platform_id").agg(F.min("time").alias("a"), F.max("time").alias("z"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.col("user_id") % 4
    raw = s.select(
        "platform_id",
        F.when(k.isin(0, 2), text("a")).otherwise("").alias("deployment_time"),
        F.when(k.isin(1, 2), text("a")).when(k == 3, text("z")).otherwise("").alias("window_start"),
        F.when(k.isin(1, 2), text("z")).when(k == 3, text("a")).otherwise("").alias("window_end"),
        F.lit("log").alias("provenance"), F.lit("").alias("note"))
    good, bad = tables.load_deployments(raw)
    return good.select("platform_id", us("deployment_time").alias("exact_us"), us("window_start").alias("start_us"),
                       us("window_end").alias("end_us"), F.lit(None).cast("string").alias("rule")).unionByName(
        bad.select("platform_id", F.lit(None).cast("long").alias("exact_us"), F.lit(None).cast("long").alias("start_us"),
                   F.lit(None).cast("long").alias("end_us"), "rule"))


@query("sc01_position_valid", f"""
WITH {OBS} SELECT obs_index, NOT (obs_index % 5 = 1 OR lon + (obs_index % 3)*30 > 180) AND obs_index % 9 <> 4 AS ok,
  NOT (obs_index % 5 = 1 OR lon + (obs_index % 3)*30 > 180) AND obs_index % 9 <> 4 AND obs_index % 2 = 0 AS analysis_ok FROM obs""")
def _(spark, sf):
    o = observations(spark, sf)
    i = F.col("obs_index")
    o = o.withColumn("lon", F.when(i % 5 == 1, F.lit(float("nan"))).otherwise(F.col("lon") + (i % 3) * 30))
    o = o.withColumn("lat", F.when(i % 9 == 4, F.lit(None)).otherwise(F.col("lat")))
    o = o.withColumn("ok", geo.position_valid("lon", "lat"))
    return o.select("obs_index", "ok", geo.analysis_valid("ok", i % 2 == 0, "time").alias("analysis_ok"))


@query("sc03_interval_seconds", f"""
WITH {OBS}, {LAG} SELECT obs_index, round(date_diff('microsecond', t0, time)/1e6, 6) AS dt_s FROM lagged""")
def _(spark, sf):
    return audit.with_previous(observations(spark, sf)).select("obs_index", rnd("dt_s").alias("dt_s"))


@query("sc05_consecutive_speed", f"""
WITH {OBS}, {LAG} SELECT obs_index, round({hav('lon0','lat0','lon','lat')}, 3) AS distance_m,
  round({hav('lon0','lat0','lon','lat')} / (date_diff('microsecond', t0, time)/1e6), 6) AS speed FROM lagged""")
def _(spark, sf):
    o = audit.consecutive_speed(observations(spark, sf))
    return o.select("obs_index", rnd("distance_m", 3).alias("distance_m"), rnd("speed").alias("speed"))


@query("sc06_time_audit", f"""
WITH {OBS}, h AS (SELECT platform_id, obs_index, date_trunc('hour', time) AS time FROM obs),
l AS (SELECT *, date_diff('second', lag(time) OVER (PARTITION BY platform_id ORDER BY time, obs_index), time) AS dt,
      count(*) OVER (PARTITION BY platform_id, time) AS c FROM h)
SELECT obs_index, c > 1 AS duplicate_time, coalesce(abs(dt - 7200) > 1, false) AS off_cadence,
  coalesce(dt > 86401, false) AS large_gap FROM l""")
def _(spark, sf):
    o = observations(spark, sf).withColumn("time", F.date_trunc("hour", "time"))
    f = audit.time_flags(o, nominal_s=7200, large_gap_s=86400)
    return f.select("obs_index", "duplicate_time", "off_cadence", "large_gap")


@query("sc07_edge_metrics", f"""
WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY time, obs_index) AS k FROM obs),
e AS (SELECT b.obs_index AS current, a.obs_index AS predecessor, date_diff('microsecond', a.time, b.time)/1e6 AS dt,
   {hav('a.lon','a.lat','b.lon','b.lat')} AS d FROM n a JOIN n b ON a.platform_id = b.platform_id AND b.k = a.k + 2)
SELECT predecessor, current, round(dt, 6) AS dt_s, round(d, 3) AS distance_m, round(d/dt, 6) AS speed FROM e""")
def _(spark, sf):
    o = observations(spark, sf)
    n = frames.number(o, "platform_id", ["time", "obs_index"]).select("platform_id", "obs_index", "pos")
    edges = n.select("platform_id", F.col("obs_index").alias("predecessor"), (F.col("pos") + 2).alias("pos")).join(
        n.withColumnRenamed("obs_index", "current"), ["platform_id", "pos"]).drop("pos")
    m = audit.edge_metrics(edges, o)
    return m.select("predecessor", "current", rnd("dt_s").alias("dt_s"), rnd("distance_m", 3).alias("distance_m"), rnd("speed").alias("speed"))


def _vel(a0, b0, a1, b1, dt):
    brg = (f"atan2(sin(radians({a1}-{a0}))*cos(radians({b1})), cos(radians({b0}))*sin(radians({b1}))"
           f" - sin(radians({b0}))*cos(radians({b1}))*cos(radians({a1}-{a0})))")
    return f"{hav(a0,b0,a1,b1)}/({dt})", brg


_v1, _b1 = _vel("lon0", "lat0", "lon", "lat", "date_diff('microsecond', t0, time)/1e6")
_v2, _b2 = _vel("lon", "lat", "lon2", "lat2", "date_diff('microsecond', time, t2)/1e6")


@query("sc08_edge_velocity", f"""
WITH {OBS}, {LAG} SELECT obs_index, round({_v1}*sin({_b1}), 6) + 0.0 AS v_east, round({_v1}*cos({_b1}), 6) + 0.0 AS v_north FROM lagged""")
def _(spark, sf):
    o = audit.edge_velocity(observations(spark, sf))
    return o.select("obs_index", rnd("v_east").alias("v_east"), rnd("v_north").alias("v_north"))


@query("sc09_vertex_acceleration", f"""
WITH {OBS}, {LAG}, v AS (SELECT obs_index, {_v1}*sin({_b1}) AS el, {_v1}*cos({_b1}) AS nl, {_v2}*sin({_b2}) AS er, {_v2}*cos({_b2}) AS nr,
  date_diff('microsecond', t0, t2)/2e6 AS half FROM lagged)
SELECT obs_index, round(1e6*sqrt((er-el)*(er-el) + (nr-nl)*(nr-nl))/half, 4) AS acceleration_um_s2 FROM v""")
def _(spark, sf):
    o = audit.vertex_acceleration(observations(spark, sf))
    return o.select("obs_index", rnd(F.col("acceleration") * 1e6, 4).alias("acceleration_um_s2"))


def _u(lon, lat):
    return (f"cos(radians({lat}))*cos(radians({lon}))", f"cos(radians({lat}))*sin(radians({lon}))", f"sin(radians({lat}))")


_A, _B, _C = _u("lon0", "lat0"), _u("lon", "lat"), _u("lon2", "lat2")
UNIT_SQL = ", ".join(f"{v[i]} AS {n}{i}" for n, v in (("a", _A), ("b", _B), ("c", _C)) for i in range(3))


@query("sc10_interpolation_residual", f"""
WITH {OBS}, {LAG}, u AS (SELECT obs_index, {UNIT_SQL}, date_diff('microsecond', t0, time)/CAST(date_diff('microsecond', t0, t2) AS DOUBLE) AS f FROM lagged),
m AS (SELECT *, (1-f)*a0+f*c0 AS m0, (1-f)*a1+f*c1 AS m1, (1-f)*a2+f*c2 AS m2 FROM u)
SELECT obs_index, CASE WHEN f IS NOT NULL THEN round(6371008.8*acos(least(1.0, greatest(-1.0, (b0*m0+b1*m1+b2*m2)/sqrt(m0*m0+m1*m1+m2*m2)))), 0) + 0.0 END AS residual_m FROM m""")
def _(spark, sf):
    o = audit.interpolation_residual(observations(spark, sf))
    return o.select("obs_index", rnd("residual_m", 0).alias("residual_m"))


@query("sc12_wrap_unwrap_longitude", """
WITH e AS (SELECT *, CAST(user_id AS VARCHAR) AS platform_id, (event_id * 97) % 360 - 180.0 AS lon FROM events),
l AS (SELECT *, lon - lag(lon) OVER w AS step FROM e WINDOW w AS (PARTITION BY platform_id ORDER BY ts, event_id)),
f AS (SELECT *, CASE WHEN step > 180 THEN -1 WHEN step < -180 THEN 1 ELSE 0 END AS turn FROM l)
SELECT event_id AS obs_index, CASE WHEN lon + 270 >= 360 THEN lon + 270 - 360 - 180 + 0.0 ELSE lon + 270 - 180 END AS wrapped,
  lon + 360 * coalesce(sum(turn) OVER (PARTITION BY platform_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS unwrapped
FROM f""")
def _(spark, sf):
    e = events(spark, sf).withColumn("lon", (F.col("obs_index") * 97) % 360 - 180.0)
    u = audit.unwrap_longitude(e)
    return u.select("obs_index", geo.wrap_longitude(F.col("lon") + 90).alias("wrapped"), F.col("lon_unwrapped").alias("unwrapped"))


@query("sc14_circular_mean_longitude", """
WITH e AS (SELECT event_id, (event_id * 97) % 360 - 180.0 AS a, (event_id * 53) % 360 - 180.0 AS b FROM events),
s AS (SELECT *, sin(radians(a)) + sin(radians(b)) AS s, cos(radians(a)) + cos(radians(b)) AS c FROM e)
SELECT event_id AS obs_index, CASE WHEN sqrt(s*s+c*c) > 1e-12 THEN CASE WHEN round(degrees(atan2(s, c)), 6) = -180 THEN 180.0 ELSE round(degrees(atan2(s, c)), 6) + 0.0 END END AS lon FROM s""")
def _(spark, sf):
    i = F.col("obs_index")
    e = events(spark, sf)
    m = rnd(geo.circular_mean_longitude((i * 97) % 360 - 180.0, (i * 53) % 360 - 180.0))
    return e.select("obs_index", F.when(m == -180, 180.0).otherwise(m).alias("lon"))


@query("sc15_spherical_mean", f"""
WITH {OBS}, u AS (SELECT platform_id, {_B[0]} AS x, {_B[1]} AS y, {_B[2]} AS z FROM obs),
m AS (SELECT platform_id, avg(x) x, avg(y) y, avg(z) z FROM u GROUP BY 1)
SELECT platform_id, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(atan2(z, sqrt(x*x+y*y))), 6) AS lat FROM m""")
def _(spark, sf):
    lon, lat = geo.spherical_mean()
    return observations(spark, sf).groupBy("platform_id").agg(rnd(lon).alias("lon"), rnd(lat).alias("lat"))


@query("sc17_turning_angle", f"""
WITH {OBS}, {LAG}, u AS (SELECT obs_index, {UNIT_SQL} FROM lagged),
d AS (SELECT *, a0*b0+a1*b1+a2*b2 AS ab, b0*c0+b1*c1+b2*c2 AS bc FROM u),
v AS (SELECT obs_index, b0*ab-a0 AS p0, b1*ab-a1 AS p1, b2*ab-a2 AS p2, c0-b0*bc AS q0, c1-b1*bc AS q1, c2-b2*bc AS q2 FROM d),
n AS (SELECT *, sqrt(p0*p0+p1*p1+p2*p2)*sqrt(q0*q0+q1*q1+q2*q2) AS size FROM v)
SELECT obs_index, CASE WHEN size > 1e-24 THEN round(degrees(acos(least(1.0, greatest(-1.0, (p0*q0+p1*q1+p2*q2)/size)))), 0) + 0.0 END AS turn_deg FROM n""")
def _(spark, sf):
    o = audit.turning_angles(observations(spark, sf))
    return o.select("obs_index", rnd("turn_deg", 0).alias("turn_deg"))


@query("sc18_pair_id", """
WITH p AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS a, CAST(user_id + 1 AS VARCHAR) AS b FROM events)
SELECT a AS platform_1, b AS platform_2, 'pair_' || substr(sha256('["' || least(a, b) || '","' || greatest(a, b) || '"]'), 1, 20) AS pair_id FROM p""")
def _(spark, sf):
    p = events(spark, sf).select("user_id").distinct()
    p = p.select(F.col("user_id").cast("string").alias("platform_1"), (F.col("user_id") + 1).cast("string").alias("platform_2"))
    return p.withColumn("pair_id", audit.pair_id("platform_2", "platform_1"))


@query("sc19_sanitize_coordinates", f"""
WITH {OBS}, d AS (SELECT platform_id, CASE WHEN obs_index % 5 = 1 THEN NULL ELSE lon + (obs_index % 3)*30 END AS x,
  CASE WHEN obs_index % 9 = 4 THEN NULL ELSE lat END AS y FROM obs),
f AS (SELECT *, (x IS NULL) <> (y IS NULL) AS mm, coalesce(x < -180 OR x >= 180 OR y < -90 OR y > 90, false) AS oor FROM d)
SELECT platform_id, count(*) AS source_rows, count_if(x IS NOT NULL AND NOT mm AND NOT oor) AS finite_pair_rows,
 count_if(mm) AS finite_mask_mismatch_rows, count_if(oor AND NOT mm) AS out_of_range_pair_rows FROM f GROUP BY 1""")
def _(spark, sf):
    i = F.col("obs_index")
    o = observations(spark, sf).withColumn("lon", F.when(i % 5 != 1, F.col("lon") + (i % 3) * 30))
    o = o.withColumn("lat", F.when(i % 9 != 4, F.col("lat")))
    return audit.sanitize_counts(audit.sanitize_coordinates(o))


@query("sc20_speed_warnings", f"""
WITH {OBS}, {LAG}, s AS (SELECT obs_index, {_v1} AS v FROM lagged)
SELECT obs_index, coalesce(v > 0.003, false) AS high, coalesce(v <= 0.0005, false) AS near_zero FROM s""")
def _(spark, sf):
    o = audit.consecutive_speed(observations(spark, sf))
    high, zero = audit.speed_warnings("speed", 0.003, 0.0005)
    return o.select("obs_index", high.alias("high"), zero.alias("near_zero"))


@query("sc21_split_paths", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS platform_id, event_id, ts, CASE WHEN event_id % 6 = 2 THEN NULL ELSE (event_id * 97) % 360 - 180.0 END AS lon FROM events),
l AS (SELECT *, lag(lon) OVER (PARTITION BY platform_id ORDER BY ts, event_id) AS p FROM e),
b AS (SELECT *, sum(CASE WHEN lon IS NOT NULL AND (p IS NULL OR abs(lon - p) > 180) THEN 1 ELSE 0 END) OVER (PARTITION BY platform_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS path_id FROM l)
SELECT platform_id, CAST(path_id AS BIGINT) AS path_id, count(*) AS path_points, min(event_id) AS first_index, max(event_id) AS last_index FROM b WHERE lon IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, sf):
    i = F.col("obs_index")
    e = events(spark, sf).withColumn("lon", F.when(i % 6 != 2, (i * 97) % 360 - 180.0)).withColumn("lat", F.lit(0.0))
    return audit.split_paths(e).groupBy("platform_id", "path_id").agg(
        F.max("path_points").alias("path_points"), F.min("obs_index").alias("first_index"), F.max("obs_index").alias("last_index"))


@query("sc22_display_sample", f"""WITH {OBS} SELECT platform_id, obs_index, lon, lat FROM obs
ORDER BY md5('figure|' || CAST(obs_index AS VARCHAR)), obs_index LIMIT 500""")
def _(spark, sf):
    o = observations(spark, sf)
    return audit.display_sample(o, 500, "figure", ["obs_index"]).select("platform_id", "obs_index", "lon", "lat")
