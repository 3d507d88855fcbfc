"""Queries of the position quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwake.catalog.base import query, rnd, us
from fleetwake.catalog.inputs import OBS, events, hav, observations
from fleetwake.operators import quality as ops
from fleetwake.operators.runsolver import PositionConfig

# The derived tracks are slow and sparse; the limits are scaled to them.
CFG = PositionConfig(
    nominal_s=39600.0, nominal_tolerance_s=600.0, min_dt_s=3600.0, max_gap_s=172800.0, speed_limit=0.0035,
    scale_floor=0.0001, boundary_factor=1.5, min_samples=4,
)
SEG = ops.SegmentConfig(gap_h=36.0, main_h=24.0, main_obs=8, fragment_obs=0.3, fragment_duration=0.3)


def drogue(spark, sf):
    u = events(spark, sf).select("user_id", "platform_id").distinct()
    k = F.col("user_id") % 10
    return u.select(
        "platform_id", F.when(k == 0, "uncertain").when(k == 1, "lost").otherwise("not_lost").alias("status"),
        F.when(k == 1, F.lit("2024-01-22").cast("timestamp")).alias("cutoff"))


def deployments(spark, sf):
    u = events(spark, sf).select("user_id", "platform_id").distinct().where("user_id % 7 < 2")
    k = F.col("user_id") % 7
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp")
    return u.select("platform_id", F.when(k == 0, day("03")).alias("deployment_time"),
                    F.when(k == 1, day("02")).alias("window_start"), F.when(k == 1, day("04")).alias("window_end"))


def coarse(spark, sf):
    """Positions on a 0.001 degree lattice and times on the half hour: repeats and twins occur."""
    o = observations(spark, sf)
    half = 1_800_000_000
    return o.select(
        "platform_id", "obs_index", F.timestamp_micros(F.floor(us("time") / half).cast("long") * half).alias("time"),
        (F.floor(F.col("lon_u") / 250) / 4000).alias("lon"), (F.floor(F.col("lat_u") / 250) / 4000).alias("lat"), "user_id")


def fine(spark, sf):
    return observations(spark, sf).select("platform_id", "obs_index", "time", "lon", "lat", "user_id")


def reviews(spark, sf):
    o = events(spark, sf).where("obs_index % 97 = 5")
    k = F.col("obs_index") % 3
    return o.select("platform_id", "obs_index", F.when(k == 0, "keep").when(k == 1, "reject").otherwise("uncertain").alias("decision"))


def staged(spark, sf, source=fine):
    base = ops.base_rows(source(spark, sf), drogue(spark, sf), deployments(spark, sf), reviews(spark, sf))
    return ops.with_segments(base, SEG)


BASE = f"""{OBS},
b0 AS (SELECT platform_id, obs_index, time, lon, lat, user_id, lon_u, lat_u FROM obs),
base AS (SELECT *, CASE user_id % 10 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'lost' ELSE 'not_lost' END AS drogue_status,
  CASE user_id % 10 WHEN 0 THEN false WHEN 1 THEN time < TIMESTAMP '2024-01-22' ELSE true END AS drogue_eligible,
  CASE user_id % 7 WHEN 0 THEN CASE WHEN time < TIMESTAMP '2024-01-03' THEN 'predeployment' ELSE 'eligible' END
   WHEN 1 THEN CASE WHEN time < TIMESTAMP '2024-01-02' THEN 'predeployment' WHEN time < TIMESTAMP '2024-01-04' THEN 'deployment_window_uncertain' ELSE 'eligible' END
   ELSE 'not_configured' END AS deployment_status,
  CASE WHEN obs_index % 97 = 5 THEN CASE obs_index % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' ELSE 'uncertain' END ELSE '' END AS human FROM {{src}}),
us AS (SELECT *, epoch_us(time) AS t FROM base WHERE drogue_eligible AND deployment_status NOT IN ('predeployment', 'deployment_window_uncertain')),
sg0 AS (SELECT *, t - lag(t) OVER w AS dt FROM us WINDOW w AS (PARTITION BY platform_id ORDER BY t, obs_index)),
sg1 AS (SELECT *, CAST(sum(CASE WHEN dt > 36*3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY platform_id ORDER BY t, obs_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM sg0),
st AS (SELECT platform_id, segment, count(*) AS n, min(t) AS s, max(t) AS e, (max(t)-min(t))/1e6/3600 AS dur, median(dt/1e6) FILTER (WHERE dt > 0 AND dt <= 36*3600000000) AS med FROM sg1 GROUP BY 1, 2),
bb AS (SELECT *, max(struct_pack(n := n, d := dur)) OVER (PARTITION BY platform_id) AS best FROM st),
b2 AS (SELECT *, n = best.n AND dur = best.d AS lead, count_if(n = best.n AND dur = best.d) OVER (PARTITION BY platform_id) AS leaders FROM bb),
b3 AS (SELECT *, leaders = 1 AND best.n >= 8 AND best.d >= 24 AND NOT lead AND n/best.n <= 0.3 AND dur/best.d <= 0.3 AS tiny FROM b2),
b4 AS (SELECT *, count_if(NOT tiny) OVER p AS subst, coalesce(min(CASE WHEN NOT tiny THEN segment END) OVER p, 0) AS f, coalesce(max(CASE WHEN NOT tiny THEN segment END) OVER p, 0) AS l FROM b3 WINDOW p AS (PARTITION BY platform_id)),
seg AS (SELECT *, CASE WHEN tiny THEN 'excluded' WHEN subst = 1 THEN 'retained' ELSE 'pending' END AS segment_status,
  CASE WHEN tiny THEN CASE WHEN segment < f THEN 'pre_main_fragment' WHEN segment > l THEN 'post_main_fragment' ELSE 'detached_middle_fragment' END WHEN subst = 1 THEN '' ELSE 'multiple_substantial_segments' END AS event_type FROM b4),
rows0 AS (SELECT sg1.*, segment_status FROM sg1 JOIN seg USING (platform_id, segment))"""
FINE = BASE.format(src="b0")
COARSE = BASE.format(src="""(SELECT platform_id, obs_index, make_timestamp(epoch_us(time) // 1800000000 * 1800000000) AS time, (lon_u // 250)/4000 AS lon, (lat_u // 250)/4000 AS lat, user_id FROM b0)""")


@query("qc01_base_rows", f"WITH {FINE} SELECT obs_index, drogue_status, drogue_eligible, deployment_status, human FROM base")
def _(spark, sf):
    b = ops.base_rows(fine(spark, sf), drogue(spark, sf), deployments(spark, sf), reviews(spark, sf))
    return b.select("obs_index", "drogue_status", "drogue_eligible", "deployment_status", "human")


@query("qc02_segments", f"""WITH {FINE} SELECT platform_id, segment, n, s AS start_us, e AS end_us, round(dur, 6) AS duration_h, round(med, 3) AS median_dt_s,
 round(n/sum(n) OVER (PARTITION BY platform_id), 6) AS obs_fraction, segment_status, event_type FROM seg""")
def _(spark, sf):
    base = ops.base_rows(fine(spark, sf), drogue(spark, sf), deployments(spark, sf), reviews(spark, sf))
    t = ops.segment_table(ops.label_segments(base, SEG), SEG)
    return t.select("platform_id", "segment", "n", us("start").alias("start_us"), us("end").alias("end_us"), rnd("duration_h").alias("duration_h"),
                    rnd("median_dt_s", 3).alias("median_dt_s"), rnd("obs_fraction").alias("obs_fraction"), "segment_status", "event_type")


_REP = """rep AS (SELECT *, segment_status = 'retained' AND count(*) FILTER (WHERE segment_status = 'retained') OVER (PARTITION BY platform_id, lon, lat) > 1 AS rej,
 count(*) FILTER (WHERE segment_status = 'retained') OVER (PARTITION BY platform_id, lon, lat) AS c FROM rows0)"""


@query("qc03_repeats", f"WITH {COARSE}, {_REP} SELECT obs_index, c AS repeat_count FROM rep WHERE rej")
def _(spark, sf):
    return ops.repeat_rejections(staged(spark, sf, coarse)).where("rej_repeat").select("obs_index", "repeat_count")


_SHORT = """sc AS (SELECT *, count(*) OVER (PARTITION BY platform_id, time) > 1 AS dup FROM rep WHERE segment_status = 'retained'),
ln AS (SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY t, obs_index) AS k FROM sc WHERE dup OR NOT rej),
fold AS (SELECT platform_id, k, obs_index, CASE WHEN dup OR human IN ('reject', 'uncertain') THEN NULL ELSE t END AS anchor, segment AS aseg, false AS short FROM ln WHERE k = 1
 UNION ALL SELECT l.platform_id, l.k, l.obs_index,
  CASE WHEN l.dup THEN NULL WHEN f.anchor IS NULL OR f.aseg <> l.segment THEN CASE WHEN l.human IN ('reject', 'uncertain') THEN NULL ELSE l.t END
    WHEN l.t - f.anchor > 0 AND l.t - f.anchor < 3600000000 THEN f.anchor WHEN l.human = 'reject' THEN f.anchor WHEN l.human = 'uncertain' THEN NULL ELSE l.t END,
  CASE WHEN f.anchor IS NOT NULL AND f.aseg = l.segment AND NOT l.dup AND (l.human = 'reject' OR (l.t - f.anchor > 0 AND l.t - f.anchor < 3600000000)) THEN f.aseg ELSE l.segment END,
  NOT l.dup AND f.anchor IS NOT NULL AND f.aseg = l.segment AND l.t - f.anchor > 0 AND l.t - f.anchor < 3600000000
 FROM fold f JOIN ln l ON l.platform_id = f.platform_id AND l.k = f.k + 1)"""


@query("qc04_short_intervals", f"WITH RECURSIVE {COARSE}, {_REP}, {_SHORT} SELECT obs_index FROM fold WHERE short")
def _(spark, sf):
    rows = ops.repeat_rejections(staged(spark, sf, coarse))
    return ops.short_interval_rejections(rows, CFG).where("rej_short").select("obs_index")


def _brg(a0, b0, a1, b1):
    return (f"atan2(sin(radians({a1}-{a0}))*cos(radians({b1})), cos(radians({b0}))*sin(radians({b1}))"
            f" - sin(radians({b0}))*cos(radians({b1}))*cos(radians({a1}-{a0})))")


_DUP = f"""lv AS (SELECT * FROM rows0 WHERE segment_status = 'retained' AND human <> 'reject'),
nb AS (SELECT platform_id, time, count(*) AS c, arg_min(struct_pack(t := t, lon := lon, lat := lat, s := segment), obs_index) AS lo, arg_max(struct_pack(t := t, lon := lon, lat := lat, s := segment), obs_index) AS hi FROM lv GROUP BY 1, 2),
nn AS (SELECT *, lag(hi) OVER w AS p, lead(lo) OVER w AS q FROM nb WINDOW w AS (PARTITION BY platform_id ORDER BY time)),
mm AS (SELECT lv.*, CASE WHEN p.s = segment THEN p END AS p, CASE WHEN q.s = segment THEN q END AS q FROM lv JOIN nn ON nn.platform_id = lv.platform_id AND nn.time = lv.time WHERE c > 1),
ed AS (SELECT *, (t - p.t)/1e6 AS d0, (q.t - t)/1e6 AS d1, {hav('p.lon','p.lat','lon','lat')} AS m0, {hav('lon','lat','q.lon','q.lat')} AS m1,
  {_brg('p.lon','p.lat','lon','lat')} AS g0, {_brg('lon','lat','q.lon','q.lat')} AS g1 FROM mm),
ex AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN d0 BETWEEN 3600 AND 172801 THEN greatest(0, m0/d0 - 0.0035) ELSE 'inf'::DOUBLE END AS x0,
  CASE WHEN q IS NULL THEN 0 WHEN d1 BETWEEN 3600 AND 172801 THEN greatest(0, m1/d1 - 0.0035) ELSE 'inf'::DOUBLE END AS x1,
  CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN sqrt(pow(m1/d1*sin(g1) - m0/d0*sin(g0), 2) + pow(m1/d1*cos(g1) - m0/d0*cos(g0), 2))/((d0+d1)/2) ELSE 'inf'::DOUBLE END AS a FROM ed),
rk AS (SELECT *, row_number() OVER (PARTITION BY platform_id, time ORDER BY CASE WHEN human = 'keep' THEN 0 ELSE 1 END, CASE WHEN x0 > 0 THEN 1 ELSE 0 END + CASE WHEN x1 > 0 THEN 1 ELSE 0 END, x0 + x1, a, obs_index) AS r FROM ex)"""


def _halved(spark, sf):
    """Fine positions with times on the half day: twins occur, positions do not repeat."""
    half = 43_200_000_000
    return fine(spark, sf).withColumn("time", F.timestamp_micros(F.floor(us("time") / half).cast("long") * half))


HALVED = BASE.format(src="(SELECT platform_id, obs_index, make_timestamp(epoch_us(time) // 43200000000 * 43200000000) AS time, lon, lat, user_id FROM b0)")


@query("qc05_duplicate_times", f"WITH {HALVED}, {_DUP} SELECT obs_index FROM rk WHERE r > 1")
def _(spark, sf):
    rows = staged(spark, sf, _halved).withColumns({"rej_repeat": F.lit(False), "rej_short": F.lit(False)})
    return ops.duplicate_rejections(rows, CFG).where("rej_dup").select("obs_index")


@query("qc06_surviving_runs", f"""WITH {HALVED},
lv AS (SELECT *, count(*) OVER (PARTITION BY platform_id, time) > 1 OR human = 'uncertain' AS hard FROM rows0 WHERE segment_status = 'retained' AND human <> 'reject'),
ru AS (SELECT *, segment*4294967296 + CAST(sum(CASE WHEN hard THEN 1 ELSE 0 END) OVER (PARTITION BY platform_id ORDER BY t, obs_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM lv)
SELECT obs_index, run FROM ru WHERE NOT hard""")
def _(spark, sf):
    return ops.surviving_runs(staged(spark, sf, _halved), F.lit(False)).select("obs_index", "run")


def _flags(rows):
    return rows.withColumns({c: F.lit(False) for c in ("rej_repeat", "rej_short", "rej_dup")})


@query("qc07_qc08_qc09_confirmed_cures")
def _(spark, sf):
    c = ops.geometry_cures(_flags(staged(spark, sf)), F.lit(False), CFG)
    return c.select("platform_id", "obs_index", "reason", "anchor", "reconnect", rnd("bridge_speed").alias("bridge_speed"))


@query("qc10_qc11_bounded_cures")
def _(spark, sf):
    c = ops.geometry_cures(_flags(staged(spark, sf)), F.lit(False), CFG, aggressive=True)
    return c.select("platform_id", "obs_index", "reason", "anchor", "reconnect", rnd("bridge_speed").alias("bridge_speed"))


_NEW = """lv AS (SELECT * FROM rows0 WHERE segment_status = 'retained' AND human <> 'reject'),
hd AS (SELECT *, human = 'uncertain' AS hard, lag(segment) OVER (PARTITION BY platform_id ORDER BY t, obs_index) AS ps FROM lv),
rn AS (SELECT *, sum(CASE WHEN hard OR ps IS NULL OR ps <> segment THEN 1 ELSE 0 END) OVER (PARTITION BY platform_id ORDER BY t, obs_index ROWS UNBOUNDED PRECEDING) AS run FROM hd),
rr AS (SELECT *, row_number() OVER (PARTITION BY platform_id, run ORDER BY t, obs_index) AS k FROM rn WHERE NOT hard)"""


@query("qc12_new_side_thinning", f"""WITH RECURSIVE {FINE}, {_NEW},
f AS (SELECT platform_id, run, k, obs_index, t AS zt, lon AS ax, lat AS ay, 0 AS streak, false AS trusted, false AS drop FROM rr WHERE k = 1
 UNION ALL SELECT r.platform_id, r.run, r.k, r.obs_index, CASE WHEN cut THEN zt ELSE r.t END, CASE WHEN cut THEN ax ELSE r.lon END, CASE WHEN cut THEN ay ELSE r.lat END,
   CASE WHEN cut THEN streak WHEN ok THEN streak + 1 ELSE 0 END, trusted OR (NOT cut AND ok AND streak + 1 >= 2), cut
 FROM (SELECT r.*, f.zt, f.ax, f.ay, f.streak, f.trusted, f.trusted AND r.human <> 'keep' AND {hav('f.ax','f.ay','r.lon','r.lat')}/((r.t - f.zt)/1e6) > 0.0035 AS cut,
   (r.t - f.zt)/1e6 BETWEEN 3600 AND 172801 AND {hav('f.ax','f.ay','r.lon','r.lat')}/((r.t - f.zt)/1e6) <= 0.0035 AS ok
   FROM f JOIN rr r ON r.platform_id = f.platform_id AND r.run = f.run AND r.k = f.k + 1) r)
SELECT obs_index FROM f WHERE drop""")
def _(spark, sf):
    return ops.new_side_cures(_flags(staged(spark, sf)), F.lit(False), CFG).select("obs_index")


@query("qc13_anomaly_groups", f"""WITH {FINE}, {_NEW},
e AS (SELECT *, (t - lag(t) OVER w)/1e6 AS ddt, {hav('lag(lon) OVER w','lag(lat) OVER w','lon','lat')} AS d, lag(obs_index) OVER w AS po FROM rr WINDOW w AS (PARTITION BY platform_id, run ORDER BY k)),
h AS (SELECT *, lag(k) OVER (PARTITION BY platform_id, run ORDER BY k) AS pk FROM e WHERE ddt > 0 AND d/ddt > 0.0035),
g AS (SELECT *, sum(CASE WHEN pk IS NULL OR k - pk > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY platform_id, run ORDER BY k) AS grp FROM h)
SELECT platform_id, min(po) AS first_obs, max(obs_index) AS last_obs, count(*) AS n_edges, bool_or(NOT ddt BETWEEN 3600 AND 172801) AS untimed, round(max(d/ddt), 6) AS max_speed FROM g GROUP BY platform_id, run, grp""")
def _(spark, sf):
    rows = _flags(staged(spark, sf)).where("segment_status <> 'pending'")
    g = ops.anomaly_groups(ops.final_edges(rows, F.lit(False), CFG), CFG)
    return g.select("platform_id", "first_obs", "last_obs", "n_edges", "untimed", rnd("max_speed").alias("max_speed")).distinct()


@query("qc14_source_and_temporal_status", f"""WITH {FINE}, f AS (SELECT base.obs_index, CASE WHEN base.drogue_status = 'uncertain' THEN 'unresolved' WHEN NOT base.drogue_eligible THEN 'outside_drogue_window'
  WHEN base.deployment_status = 'deployment_window_uncertain' OR segment_status = 'pending' THEN 'unresolved'
  WHEN base.deployment_status = 'predeployment' OR segment_status = 'excluded' THEN 'outside_operational_segment'
  WHEN base.human = 'reject' THEN 'rejected' WHEN base.human = 'uncertain' THEN 'uncertain' ELSE 'valid' END AS final_status FROM base LEFT JOIN rows0 USING (platform_id, obs_index))
SELECT * FROM f""")
def _(spark, sf):
    rows = _flags(staged(spark, sf)).withColumns({"auto_reject": F.lit(False), "unresolved_event": F.lit(False)})
    return ops.resolve(rows).select("obs_index", "final_status")


def qc(spark, sf, policy="aggressive", source=fine):
    return ops.position_qc(source(spark, sf), drogue(spark, sf), deployments=deployments(spark, sf), reviews=reviews(spark, sf),
                           segment_cfg=SEG, cfg=CFG, policy=policy)


@query("qc15_position_qc_aggressive")
def _(spark, sf):
    return qc(spark, sf).select("platform_id", "obs_index", "final_status", "decision_source", "point_reason", "event_type", "platform_complete")


@query("qc15_position_qc_conservative")
def _(spark, sf):
    return qc(spark, sf, "conservative", coarse).select(
        "platform_id", "obs_index", "final_status", "decision_source", "point_reason", "event_type", "review_required")


def simple_qc(spark, sf):
    """A QC table whose decisions follow from the index, for the operators that read QC tables."""
    i = F.col("obs_index")
    o = fine(spark, sf)
    st = F.when(i % 11 == 4, "rejected").when((F.col("user_id") % 13 == 0) & (i % 5 == 0), "unresolved").otherwise("valid")
    o = o.withColumn("final_status", st).withColumn("final_valid", F.col("final_status") == "valid")
    return o.withColumn("decision_source", F.when(F.col("final_status") == "rejected", "human").otherwise("ordinary"))


SQC = f"""{OBS}, sqc AS (SELECT platform_id, obs_index, time, epoch_us(time) AS t, lon, lat, user_id, CASE WHEN obs_index % 11 = 4 THEN 'rejected' WHEN user_id % 13 = 0 AND obs_index % 5 = 0 THEN 'unresolved' ELSE 'valid' END AS st FROM obs)"""


@query("io09_accepted_tracks", f"""WITH {SQC}, f AS (SELECT platform_id, count_if(st = 'unresolved') AS o, count_if(st = 'valid') AS n, min(CASE WHEN st = 'valid' THEN t END) AS a, max(CASE WHEN st = 'valid' THEN t END) AS z FROM sqc GROUP BY 1),
g AS (SELECT * FROM f WHERE o = 0 AND n >= 2)
SELECT g.platform_id, count_if(st = 'valid') AS n_accepted, count(*) AS n_native FROM g JOIN sqc ON sqc.platform_id = g.platform_id AND t BETWEEN a AND z GROUP BY 1""")
def _(spark, sf):
    from fleetwake.sources.tables import accepted_tracks

    acc, native, _ = accepted_tracks(simple_qc(spark, sf))
    n = native.groupBy("platform_id").agg(F.count(F.lit(1)).alias("n_native"))
    return acc.groupBy("platform_id").agg(F.count(F.lit(1)).alias("n_accepted")).join(n, "platform_id")


@query("io10_valid_span", f"""WITH {SQC}, f AS (SELECT platform_id, min(CASE WHEN st = 'valid' THEN t END) AS a, max(CASE WHEN st = 'valid' THEN t END) AS z, count(*) AS n FROM sqc GROUP BY 1)
SELECT f.platform_id, any_value(n) AS n_source, count_if(t BETWEEN a AND z) AS n_kept, any_value(n) - count_if(t BETWEEN a AND z) AS n_trimmed FROM f JOIN sqc ON sqc.platform_id = f.platform_id GROUP BY 1""")
def _(spark, sf):
    from fleetwake.sources.tables import valid_span

    _, counts = valid_span(simple_qc(spark, sf))
    return counts.select("platform_id", "n_source", "n_kept", "n_trimmed")


@query("qc16_join_back", f"""WITH {SQC} SELECT obs_index, CASE WHEN obs_index % 50 = 9 THEN 'missing_qc_row' ELSE st END AS state FROM sqc WHERE obs_index % 50 <> 9 OR true""")
def _(spark, sf):
    q = simple_qc(spark, sf).where("obs_index % 50 <> 9")
    good, bad = ops.join_back(fine(spark, sf), q)
    return good.select("obs_index", F.col("final_status").alias("state")).unionByName(bad.select("obs_index", F.col("rule").alias("state")))


@query("qc17_event_catalog")
def _(spark, sf):
    return ops.event_catalog(qc(spark, sf, "conservative", coarse)).select("platform_id", "kind", "event_type", "n", "pending", "start_obs")


@query("qc18_latest_reviews", """
WITH l AS (SELECT event_id, user_id, i, (event_id + i) % 3 AS d FROM events, (SELECT unnest([0, 1]) AS i) WHERE event_id % 10 = 0),
x AS (SELECT *, CASE WHEN event_id % 70 = 0 THEN 'source_changed' WHEN event_id % 110 = 0 THEN 'unknown_observation' END AS rule FROM l WHERE i = 1)
SELECT CAST(user_id AS VARCHAR) AS platform_id, CASE WHEN event_id % 110 = 0 THEN -event_id - 1 ELSE event_id END AS obs_index,
 coalesce(rule, CASE d WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' ELSE 'uncertain' END) AS outcome FROM x""")
def _(spark, sf):
    o = fine(spark, sf)
    log = o.where("obs_index % 10 = 0").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    d = (F.col("obs_index") + F.col("i")) % 3
    log = log.select(
        "platform_id", F.when(d == 0, "keep").when(d == 1, "reject").otherwise("uncertain").alias("decision"),
        F.when(F.col("obs_index") % 70 == 0, "old").otherwise("h").alias("source_hash"), F.col("i").alias("reviewed_at"),
        F.when(F.col("obs_index") % 110 == 0, -F.col("obs_index") - 1).otherwise(F.col("obs_index")).alias("obs_index"))
    good, bad = ops.latest_reviews(log, o, o.select("platform_id").distinct().withColumn("source_hash", F.lit("h")))
    return good.select("platform_id", "obs_index", F.col("decision").alias("outcome")).unionByName(bad.select("platform_id", "obs_index", F.col("rule").alias("outcome")))


def _summary_qc(spark, sf):
    i = F.col("obs_index")
    o = fine(spark, sf)
    kinds = [("valid", "ordinary", ""), ("rejected", "automatic_repeat", ""), ("rejected", "automatic_geometry", "unique_endpoint_speed_cure"),
             ("rejected", "human", ""), ("unresolved", "automatic_review_required", ""), ("valid", "ordinary", "automatic_keep_removal_limit_reached")]
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in kinds]), (i % 6 + 1).cast("int"))
    return o.select("platform_id", "obs_index", pick(0).alias("final_status"), pick(1).alias("decision_source"), pick(2).alias("point_reason"),
                    F.concat_ws(":", "platform_id", F.floor(i / 1000).cast("string")).alias("event_id"))


@query("qc19_decision_summary", """
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS platform_id, event_id % 6 AS k, event_id // 1000 AS e FROM events),
z AS (SELECT platform_id, e, count(*) AS size FROM s WHERE k = 2 GROUP BY 1, 2),
p AS (SELECT platform_id, count_if(size = 1) AS single_cure_events, count_if(size > 1) AS multi_cure_events, CAST(coalesce(sum(CASE WHEN size > 1 THEN size END), 0) AS BIGINT) AS multi_cure_points FROM z GROUP BY 1),
m AS (SELECT platform_id, count(DISTINCT e) AS limit_events FROM s WHERE k = 5 GROUP BY 1),
c AS (SELECT platform_id, count(*) AS observations, count_if(k IN (0, 5)) AS valid, count_if(k IN (1, 2, 3)) AS rejected, count_if(k = 1) AS repeats, count_if(k = 2) AS geometry,
  count_if(k = 3) AS human_rejected, count_if(k = 5) AS limit_points, count_if(k = 4) AS local_unresolved FROM s GROUP BY 1),
f AS (SELECT c.*, coalesce(single_cure_events, 0) AS single_cure_events, coalesce(multi_cure_events, 0) AS multi_cure_events, coalesce(multi_cure_points, 0) AS multi_cure_points, coalesce(limit_events, 0) AS limit_events FROM c LEFT JOIN p USING (platform_id) LEFT JOIN m USING (platform_id))
SELECT platform_id, CAST(sum(observations) AS BIGINT) AS observations, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(repeats) AS BIGINT) AS repeats, CAST(sum(geometry) AS BIGINT) AS geometry,
 CAST(sum(human_rejected) AS BIGINT) AS human_rejected, CAST(sum(limit_points) AS BIGINT) AS limit_points, CAST(sum(local_unresolved) AS BIGINT) AS local_unresolved,
 CAST(sum(single_cure_events) AS BIGINT) AS single_cure_events, CAST(sum(multi_cure_events) AS BIGINT) AS multi_cure_events, CAST(sum(multi_cure_points) AS BIGINT) AS multi_cure_points, CAST(sum(limit_events) AS BIGINT) AS limit_events FROM f GROUP BY ROLLUP (platform_id)""")
def _(spark, sf):
    rolled, _ = ops.decision_summary(_summary_qc(spark, sf))
    return rolled.select("platform_id", "observations", "valid", "rejected", "repeats", "geometry", "human_rejected", "limit_points", "local_unresolved",
                         "single_cure_events", "multi_cure_events", "multi_cure_points", "limit_events")


@query("qc19_cure_sizes", """
WITH z AS (SELECT CAST(user_id AS VARCHAR) AS platform_id, event_id // 1000 AS e, count(*) AS size FROM events WHERE event_id % 6 = 2 GROUP BY 1, 2)
SELECT platform_id, size, count(*) AS events, CAST(sum(size) AS BIGINT) AS points FROM z GROUP BY GROUPING SETS ((platform_id, size), (size))""")
def _(spark, sf):
    return ops.decision_summary(_summary_qc(spark, sf))[1]


SPAN = 15 * 86_400_000_000
ACC = "obs_index % 4 <> 1"
SCOPE = f"""{OBS}, r AS (SELECT *, epoch_us(time) AS t, obs_index % 4 <> 1 AS acc FROM obs),
s0 AS (SELECT platform_id, min(t) FILTER (WHERE acc) AS s, max(t) AS z FROM r GROUP BY 1),
q0 AS (SELECT r.platform_id, min(t) AS q FROM r JOIN s0 USING (platform_id) WHERE acc AND t >= s + {SPAN} GROUP BY 1),
scope AS (SELECT s0.platform_id, s, coalesce(q, z) AS e, CASE WHEN q IS NOT NULL THEN 'maximum_span' ELSE 'hard_stop' END AS why FROM s0 LEFT JOIN q0 USING (platform_id))"""


@query("qc20_review_scope", f"WITH {SCOPE} SELECT platform_id, s AS start_us, e AS end_us, why AS end_reason FROM scope")
def _(spark, sf):
    s = ops.review_scope(fine(spark, sf), F.expr(ACC), span_us=SPAN)
    return s.select("platform_id", us("start_time").alias("start_us"), us("end_time").alias("end_us"), "end_reason")


@query("qc21_review_chunks", f"""WITH {SCOPE}, j AS (SELECT r.platform_id, obs_index, CASE WHEN obs_index % 31 = 7 THEN NULL ELSE t END AS t, e FROM r JOIN scope USING (platform_id)),
a AS (SELECT platform_id, min(t) AS a FROM j WHERE t <= e GROUP BY 1),
b AS (SELECT j.platform_id, (t - a) // 259200000000 AS time_bin, count(*) AS n, min(obs_index) AS first_obs, max(obs_index) AS last_obs FROM j JOIN a USING (platform_id) WHERE t <= e GROUP BY 1, 2
  UNION ALL SELECT platform_id, NULL, count(*), min(obs_index), max(obs_index) FROM j WHERE t IS NULL GROUP BY 1)
SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY time_bin NULLS LAST) - 1 AS ordinal FROM b""")
def _(spark, sf):
    o = fine(spark, sf)
    scope = ops.review_scope(o, F.expr(ACC), span_us=SPAN)
    o = o.withColumn("time", F.when(F.col("obs_index") % 31 != 7, F.col("time")))
    return ops.review_chunks(o, scope, 259_200_000_000).select("platform_id", "time_bin", "n", "first_obs", "last_obs", F.col("ordinal").cast("long").alias("ordinal"))


@query("qc22_completion_issues", """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS platform_id, user_id, event_id, CASE WHEN event_id % 31 = 7 THEN NULL ELSE epoch_us(ts) // 43200000000 END AS t, CASE WHEN event_id % 37 = 3 THEN false ELSE true END AS pos_ok,
  CASE WHEN user_id % 9 = 0 THEN false ELSE event_id % 4 <> 1 END AS acc FROM events),
f AS (SELECT platform_id, count_if(acc) AS n, count_if(acc AND t IS NULL) AS bt, count_if(acc AND NOT pos_ok) AS bp FROM r GROUP BY 1),
tw AS (SELECT platform_id, count(*) AS tw FROM (SELECT platform_id, t FROM r WHERE acc AND t IS NOT NULL AND pos_ok GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
j AS (SELECT f.*, coalesce(tw, 0) AS tw FROM f LEFT JOIN tw USING (platform_id))
SELECT platform_id, 'fewer_than_two_accepted' AS issue, n AS count FROM j WHERE n < 2
UNION ALL SELECT platform_id, 'accepted_invalid_timestamps', bt FROM j WHERE n >= 2 AND bt > 0
UNION ALL SELECT platform_id, 'accepted_invalid_coordinates', bp FROM j WHERE n >= 2 AND bp > 0
UNION ALL SELECT platform_id, 'accepted_timestamps_not_unique', tw FROM j WHERE n >= 2 AND tw > 0""")
def _(spark, sf):
    i = F.col("obs_index")
    o = fine(spark, sf)
    o = o.withColumns({
        "time": F.when(i % 31 != 7, F.timestamp_micros(F.floor(us("time") / 43200000000).cast("long") * 43200000000)),
        "lat": F.when(i % 37 != 3, F.col("lat"))})
    scope = ops.review_scope(o, F.lit(True))
    chunks = ops.review_chunks(o, scope, 259_200_000_000)
    return ops.completion_issues(o, chunks, chunks, (F.col("user_id") % 9 != 0) & (i % 4 != 1))


@query("qc24_readiness", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS platform_id, CASE user_id % 5 WHEN 0 THEN 'not_yet_reviewed' WHEN 1 THEN 'source_changed' WHEN 2 THEN 'policy_changed' WHEN 3 THEN 'stale' ELSE 'ready' END AS state FROM events""")
def _(spark, sf):
    p = fine(spark, sf).select("user_id", "platform_id").distinct().withColumns({"source_hash": F.lit("a"), "policy_hash": F.lit("b")})
    k = F.col("user_id") % 5
    f = p.where(k != 0).withColumns({"source_hash": F.when(k == 1, "x").otherwise("a"), "policy_hash": F.when(k == 2, "x").otherwise("b"), "current": k != 3})
    return ops.readiness(p, f)
