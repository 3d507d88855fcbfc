"""Queries of the signal change-point operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwake.catalog.base import query, rnd, us
from fleetwake.catalog.inputs import events
from fleetwake.operators import signals as ops

# Wide bins and mild rules: the derived samples are about 11 hours apart.
TTFF = ops.TtffConfig(
    factor=3.0, min_pre_events=4, min_pre_occupied=2, min_coverage=0.3, quiet_fraction=0.34, agreement_h=96.0
)
STRAIN = ops.StrainConfig(block_h=24.0, min_samples=1, min_side_h=72.0)
CFG = ops.LossConfig(TTFF, STRAIN, 96.0)


def signals(spark, sf):
    """Samples with a change for some platforms (a third drops in ttff, a half in strain)."""
    e = events(spark, sf)
    low = (F.col("user_id") % 3 == 0) & (F.col("time") >= F.lit("2024-01-18").cast("timestamp"))
    eased = (F.col("user_id") % 2 == 0) & (F.col("time") >= F.lit("2024-01-15").cast("timestamp"))
    return e.select(
        "platform_id", "obs_index", "time", "user_id",
        F.when(low, F.col("value") * 0.05).otherwise(F.col("value")).alias("ttff"),
        (F.when(eased, 18.0).otherwise(30.0) + F.col("value") / 50).alias("strain"),
    )


_edges = ops.value_bins(TTFF).edges
_bin = " + ".join(f"CASE WHEN ttff >= {e!r} THEN 1 ELSE 0 END" for e in _edges)

SIG = f"""sig AS (SELECT CAST(user_id AS VARCHAR) AS platform_id, event_id AS obs_index, user_id, epoch_us(ts) AS t,
  CASE WHEN user_id % 3 = 0 AND ts >= TIMESTAMP '2024-01-18' THEN value*0.05 ELSE value END AS ttff,
  CASE WHEN user_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-15' THEN 18.0::DOUBLE ELSE 30.0::DOUBLE END + value/50 AS strain FROM events)"""

C = 43200000000
NOMINAL = f"""{SIG},
d0 AS (SELECT platform_id, t, t - lag(t) OVER (PARTITION BY platform_id ORDER BY t) AS d FROM (SELECT DISTINCT platform_id, t FROM sig)),
nom AS (SELECT platform_id, least(CAST(floor(coalesce(median(d), 0)) AS BIGINT), {C}) AS nominal FROM d0 GROUP BY 1)"""
COVER = f"""{NOMINAL},
iv AS (SELECT d0.platform_id, t // {C} * {C} AS b, greatest(t // {C} * {C}, t - nominal // 2) AS l, least(t // {C} * {C} + {C}, t + nominal - nominal // 2) AS r, t
  FROM d0 JOIN nom USING (platform_id)),
iv2 AS (SELECT *, lag(r) OVER (PARTITION BY platform_id, b ORDER BY t) AS pr FROM iv),
cov AS (SELECT platform_id, b, sum(greatest(0, r - greatest(l, coalesce(pr, l))))/3600e6 AS h FROM iv2 GROUP BY 1, 2)"""
DENSE = f"""{COVER},
rec AS (SELECT platform_id, min(t) AS t0, max(t) AS t1, max(t) + any_value(nominal) AS rend FROM sig JOIN nom USING (platform_id) GROUP BY 1),
sc AS (SELECT platform_id, rend, unnest(generate_series(t0 // {C} * {C}, t1 // {C} * {C}, {C})) AS b FROM rec),
cnt AS (SELECT platform_id, t // {C} * {C} AS b, {_bin} AS bin, count(*) AS n FROM sig GROUP BY 1, 2, 3),
tab AS (SELECT sc.platform_id, rend, sc.b, bins.bin, coalesce(n, 0) AS n, coalesce(h, 0) AS h
  FROM sc CROSS JOIN (SELECT CAST(unnest(generate_series(0, {len(_edges)})) AS INTEGER) AS bin) bins
  LEFT JOIN cov USING (platform_id, b) LEFT JOIN cnt ON cnt.platform_id = sc.platform_id AND cnt.b = sc.b AND cnt.bin = bins.bin)"""


def _frame(name, lo, hi):
    def edge(x):
        return f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"
    f = f"OVER (PARTITION BY platform_id, bin ORDER BY b ROWS BETWEEN {edge(lo)} AND {edge(hi)})"
    return f"CAST(coalesce(sum(n) {f}, 0) AS BIGINT) AS {name}_e, coalesce(sum(h) {f}, 0.0) AS {name}_h"


DROPS = f"""{DENSE},
w AS (SELECT *, row_number() OVER (PARTITION BY platform_id, bin ORDER BY b) AS k, {_frame('pre', -14, -1)}, {_frame('last', -1, 2)}, {_frame('post', 0, 3)},
   coalesce(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY platform_id, bin ORDER BY b ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0) AS occ FROM tab),
r AS (SELECT *, CASE WHEN pre_h > 0 THEN pre_e/pre_h END AS rate FROM w),
x AS (SELECT *, k > 1 AND pre_e >= 4 AND occ >= 2 AND pre_h/168 >= 0.3 AS elig,
   last_e > 1 AND (last_h <= 0 OR last_e/last_h > 0.34*rate) AS last_loud, post_e > 1 AND (post_h <= 0 OR post_e/post_h > 0.34*rate) AS post_loud FROM r),
per AS (SELECT c.platform_id, c.bin, c.k, min(j.k) AS fail, arg_min(j.post_h/48 < 0.3, j.k) AS thin FROM x c JOIN x j
   ON c.platform_id = j.platform_id AND c.bin = j.bin AND j.k BETWEEN c.k AND c.k + 6
   WHERE c.elig AND (j.post_h/48 < 0.3 OR (j.post_e > 1 AND (j.post_h <= 0 OR j.post_e/j.post_h > 0.34*c.rate))) GROUP BY 1, 2, 3),
mp AS (SELECT c.platform_id, c.bin, c.k, min(least(1.0, j.post_h/48)) AS pmin FROM x c JOIN x j ON c.platform_id = j.platform_id AND c.bin = j.bin AND j.k BETWEEN c.k AND c.k + 6 GROUP BY 1, 2, 3),
rea AS (SELECT c.platform_id, c.bin, c.k, bool_or(j.post_e > 1 AND j.post_e/j.post_h > 0.34*c.rate) AS again, max(j.b + 4*{C}) AS until FROM x c JOIN x j
   ON c.platform_id = j.platform_id AND c.bin = j.bin AND j.k >= c.k + 10 AND j.post_h/48 >= 0.3 AND j.b + 4*{C} <= j.rend GROUP BY 1, 2, 3),
ver AS (SELECT x.*, pmin, coalesce(until, x.b + 10*{C}) AS confirmed, CASE WHEN NOT elig THEN 'ineligible'
   WHEN last_h/48 < 0.3 OR NOT last_loud THEN 'skip'
   WHEN post_h/48 < 0.3 THEN CASE WHEN post_e <= 1 THEN 'incomplete' ELSE 'skip' END
   WHEN post_loud THEN 'skip' WHEN rend < x.b + 10*{C} THEN 'incomplete'
   WHEN fail IS NOT NULL THEN CASE WHEN thin THEN 'incomplete' ELSE 'skip' END
   WHEN again THEN 'reactivated' ELSE 'selected' END AS v
   FROM x LEFT JOIN per USING (platform_id, bin, k) LEFT JOIN rea USING (platform_id, bin, k) LEFT JOIN mp USING (platform_id, bin, k)),
ch AS (SELECT *, max(CASE WHEN v = 'selected' THEN b END) OVER (PARTITION BY platform_id, bin) AS chosen FROM ver),
ag AS (SELECT platform_id, bin, any_value(chosen) AS drop_us, bool_or(v <> 'ineligible') AS eligible, bool_or(v = 'incomplete') AS inc, bool_or(v = 'reactivated') AS late_reactivation,
   arg_max({{'e': pre_e, 'p': post_e, 'm': CASE WHEN v = 'selected' THEN pmin END, 'c': CASE WHEN v = 'selected' THEN confirmed END}}, b) FILTER (WHERE v IN ('selected', 'incomplete', 'reactivated') AND (chosen IS NULL OR v = 'selected')) AS ev
   FROM ch WHERE chosen IS NULL OR b >= chosen GROUP BY 1, 2),
drops AS (SELECT platform_id, bin, CASE WHEN drop_us IS NOT NULL THEN 'stable_drop' WHEN inc THEN 'insufficient_followup' WHEN late_reactivation THEN 'reactivated'
   WHEN eligible THEN 'no_stable_drop' ELSE 'insufficient_pre_activity' END AS status, eligible, drop_us, late_reactivation, ev.e AS pre_events, ev.p AS post_events, ev.m AS pmin, ev.c AS confirmed FROM ag)"""
TOL = 96 * 3600000000
GROUPS = f"""{DROPS},
st AS (SELECT * FROM drops WHERE drop_us IS NOT NULL),
lt AS (SELECT DISTINCT platform_id, drop_us AS l FROM st),
g0 AS (SELECT lt.platform_id, l, max(drop_us) AS h, count(*) AS size FROM lt JOIN st ON st.platform_id = lt.platform_id AND drop_us BETWEEN l AND l + {TOL} GROUP BY 1, 2),
grp AS (SELECT * FROM g0 a WHERE NOT EXISTS (SELECT 1 FROM g0 b WHERE b.platform_id = a.platform_id AND b.l < a.l AND b.h >= a.h))"""
TT = f"""{GROUPS},
gd AS (SELECT grp.platform_id, l, h, size, CAST(floor(median(drop_us)) AS BIGINT) AS change_us, min(confirmed) AS confirmed_us, CAST(sum(pre_events) AS BIGINT) AS pe, CAST(sum(post_events) AS BIGINT) AS po, min(pmin) AS pm
   FROM grp JOIN st ON st.platform_id = grp.platform_id AND drop_us BETWEEN l AND h GROUP BY 1, 2, 3, 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY size DESC, change_us DESC, l DESC) AS r FROM gd),
win AS (SELECT a.*, EXISTS (SELECT 1 FROM rk b WHERE b.platform_id = a.platform_id AND b.r > 1 AND b.size >= 2 AND (b.h < a.l OR b.l > a.h)) AS rival FROM rk a WHERE r = 1),
pb AS (SELECT platform_id, count_if(eligible) AS eligible_bins, count_if(status = 'stable_drop') AS stable_bins, bool_or(status = 'insufficient_followup') AS inc FROM drops GROUP BY 1),
tt AS (SELECT pb.platform_id, CASE WHEN stable_bins = 0 AND inc THEN 'insufficient_followup' WHEN stable_bins = 0 AND eligible_bins = 0 THEN 'insufficient_data'
   WHEN stable_bins = 0 THEN 'none' WHEN size >= 2 AND NOT rival THEN 'clear' WHEN stable_bins = 1 THEN 'weak' ELSE 'ambiguous' END AS status,
   change_us, eligible_bins, stable_bins, coalesce(size, 0) AS agreeing_bins, round((h - l)/3600e6, 6) AS span_h, coalesce(pe, 0) AS agreeing_pre_events,
   coalesce(po, 0) AS agreeing_post_events, round(pm, 6) AS min_persistence_fraction, confirmed_us FROM pb LEFT JOIN win USING (platform_id))"""

B = 86400000000
BLOCKS = f"""{SIG},
bf AS (SELECT platform_id, t // {B} * {B} AS b, count(*) AS n, median(strain) AS m FROM sig GROUP BY 1, 2)"""
STR = f"""{BLOCKS},
nb AS (SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY platform_id) AS nn FROM bf),
sp AS (SELECT platform_id, i AS split, b AS block_us, nn FROM nb WHERE i >= 3 AND i <= nn - 3),
md AS (SELECT s.platform_id, split, any_value(block_us) AS block_us, any_value(s.nn) AS nn, median(m) FILTER (WHERE i < split) AS lb, median(m) FILTER (WHERE i >= split) AS la
   FROM sp s JOIN nb ON nb.platform_id = s.platform_id GROUP BY 1, 2),
co AS (SELECT md.platform_id, split, block_us, md.nn, lb, la, sum(CASE WHEN i < split THEN abs(m - lb) ELSE abs(m - la) END) AS cost FROM md JOIN nb ON nb.platform_id = md.platform_id GROUP BY ALL),
nu AS (SELECT nb.platform_id, any_value(nb.nn) AS n_blocks, sum(abs(m - mm)) AS j0 FROM nb JOIN (SELECT platform_id, median(m) AS mm FROM nb GROUP BY 1) q ON q.platform_id = nb.platform_id GROUP BY 1),
dn AS (SELECT *, lb - la AS dr, (lb - la)/greatest(abs(lb), 1.0) AS rel FROM co WHERE lb - la > 0),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY round(cost, 9), split) AS r FROM dn) WHERE r = 1),
ri AS (SELECT dn.platform_id, count(*) AS n_rivals FROM dn JOIN be ON be.platform_id = dn.platform_id AND abs(dn.block_us - be.block_us) >= 172800000000 AND dn.cost <= be.cost + greatest(2.220446049250313e-16, be.cost*0.02) GROUP BY 1),
im AS (SELECT nu.platform_id, n_blocks, j0, be.*, coalesce(n_rivals, 0) AS n_rivals, CASE WHEN be.split IS NOT NULL THEN CASE WHEN j0 > 2.220446049250313e-16 THEN (j0 - cost)/j0 ELSE 0 END END AS imp
   FROM nu LEFT JOIN be ON be.platform_id = nu.platform_id LEFT JOIN ri ON ri.platform_id = nu.platform_id),
ss AS (SELECT platform_id, n_blocks, j0, cost, block_us, lb, la, dr, rel, imp, n_rivals, split, CASE WHEN n_blocks < 6 THEN 'insufficient_data' WHEN split IS NULL THEN 'no_change'
   WHEN imp >= 0.1 AND (dr >= 2 OR rel >= 0.08) AND n_rivals > 0 THEN 'ambiguous' WHEN imp >= 0.1 AND dr >= 2 AND rel >= 0.08 THEN 'clear'
   WHEN imp >= 0.1 AND (dr >= 2 OR rel >= 0.08) THEN 'weak' ELSE 'no_change' END AS status FROM im)"""


@query("dr02_histogram_counts", f"WITH {SIG} SELECT platform_id, {_bin} AS bin, count(*) AS n FROM sig GROUP BY ALL")
def _(spark, sf):
    return ops.histogram_counts(signals(spark, sf), "ttff", ops.value_bins(TTFF))


@query("dr01_linear_value_bins", """
SELECT CAST(user_id AS VARCHAR) AS platform_id, CAST(CASE WHEN value >= 500 THEN 5 ELSE floor(value/100) END AS INTEGER) AS bin, count(*) AS n
FROM events GROUP BY ALL""")
def _(spark, sf):
    b = ops.value_bins(ops.TtffConfig(scale="linear", first_edge=0.0, last_edge=500.0, factor=None, width=100.0, include_lower=False))
    return ops.histogram_counts(events(spark, sf), "value", b)


@query("dr03_nominal_interval", f"WITH {NOMINAL} SELECT platform_id, nominal AS nominal_us FROM nom")
def _(spark, sf):
    return ops.nominal_interval(signals(spark, sf), TTFF.cadence_us)


@query("dr04_coverage_hours", f"WITH {COVER} SELECT platform_id, b AS bin_us, round(h, 6) AS coverage_h FROM cov")
def _(spark, sf):
    s = signals(spark, sf)
    return ops.coverage(s, ops.nominal_interval(s, TTFF.cadence_us), TTFF.cadence_us).select(
        "platform_id", "bin_us", rnd("coverage_h").alias("coverage_h"))


@query("dr05_temporal_event_counts", f"""WITH {DENSE}
SELECT platform_id, b AS bin_us, bin, n, round(h, 6) AS coverage_h, CAST(sum(n) OVER f AS BIGINT) AS forward_events,
 round(least(1.0, sum(h) OVER f / 48), 6) AS forward_fraction, rend >= b + 4*{C} AS forward_complete
FROM tab WINDOW f AS (PARTITION BY platform_id, bin ORDER BY b ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)""")
def _(spark, sf):
    dense, _ = ops.event_counts(signals(spark, sf), TTFF)
    return dense.select("platform_id", "bin_us", "bin", "n", rnd("coverage_h").alias("coverage_h"), "forward_events",
                        rnd("forward_fraction").alias("forward_fraction"), "forward_complete")


@query("dr06_dr07_stable_drops", f"WITH {DROPS} SELECT platform_id, bin, status, eligible, drop_us, late_reactivation, pre_events, post_events, round(pmin, 6) AS pmin, confirmed FROM drops")
def _(spark, sf):
    dense, _ = ops.event_counts(signals(spark, sf), TTFF)
    return ops.stable_drops(dense, TTFF).select(
        "platform_id", "bin", "status", "eligible", "drop_us", "late_reactivation", "pre_events", "post_events",
        rnd("persistence_min_fraction").alias("pmin"), F.col("confirmed_us").alias("confirmed"))


@query("dr08_maximal_date_groups", f"WITH {GROUPS} SELECT platform_id, l AS left_us, h AS right_us, size FROM grp")
def _(spark, sf):
    dense, _ = ops.event_counts(signals(spark, sf), TTFF)
    return ops.date_groups(ops.stable_drops(dense, TTFF), TOL)


@query("dr09_ttff_cessation", f"WITH {TT} SELECT * FROM tt")
def _(spark, sf):
    out, _ = ops.ttff_cessation(signals(spark, sf), TTFF)
    return out.withColumn("span_h", rnd("span_h")).withColumn("min_persistence_fraction", rnd("min_persistence_fraction"))


@query("dr10_strain_blocks", f"""WITH {SIG},
bf AS (SELECT platform_id, t // 21600000000 * 21600000000 AS b, count(*) AS n, median(strain) AS m FROM sig GROUP BY 1, 2),
sc AS (SELECT platform_id, unnest(generate_series(min(b), max(b), 21600000000)) AS b FROM bf GROUP BY 1)
SELECT sc.platform_id, sc.b AS block_us, coalesce(n, 0) AS n_valid, CASE WHEN n >= 2 THEN round(m, 6) END AS median FROM sc LEFT JOIN bf ON bf.platform_id = sc.platform_id AND bf.b = sc.b""")
def _(spark, sf):
    b = ops.strain_blocks(signals(spark, sf), ops.StrainConfig(min_samples=2))
    return b.select("platform_id", "block_us", "n_valid", rnd("median").alias("median"))


@query("dr11_strain_two_regime", f"""WITH {STR} SELECT platform_id, status, CASE WHEN status IN ('clear', 'weak') THEN block_us END AS change_us,
 block_us AS candidate_us, round(lb, 6) AS level_before, round(la, 6) AS level_after, round(dr, 6) AS absolute_drop, round(rel, 6) AS relative_drop,
 CASE WHEN n_blocks >= 6 THEN round(j0, 6) END AS cost_null, round(cost, 6) AS cost, round(imp, 6) AS improvement, coalesce(split, 0) AS n_before, coalesce(n_blocks - split, 0) AS n_after, n_blocks, n_rivals FROM ss""")
def _(spark, sf):
    o = ops.strain_change(signals(spark, sf), STRAIN)
    fl = ["level_before", "level_after", "absolute_drop", "relative_drop", "cost_null", "cost", "improvement"]
    return o.drop("rival_us").withColumns({c: rnd(c) for c in fl})


_COMBINED = f"""WITH {TT}, {STR[len(SIG) + 1:].lstrip()},
t AS (SELECT platform_id, status AS detail, CASE WHEN status IN ('clear','weak','ambiguous') THEN status WHEN status = 'none' THEN 'no_change' ELSE 'insufficient_data' END AS ts,
  CASE WHEN status IN ('clear','weak') THEN change_us END AS tu FROM tt),
c AS (SELECT t.platform_id, detail, ts, tu, ss.status AS s, CASE WHEN ss.status IN ('clear', 'weak') THEN block_us END AS su FROM t JOIN ss ON ss.platform_id = t.platform_id),
a AS (SELECT *, CASE WHEN ts = 'clear' AND s = 'clear' THEN CASE WHEN abs(su - tu) <= {TOL} THEN 'clear_agreement' ELSE 'signal_conflict' END
  WHEN ts = 'clear' AND s IN ('no_change', 'insufficient_data') THEN 'clear_ttff_only' WHEN s = 'clear' AND ts IN ('no_change', 'insufficient_data') THEN 'clear_strain_only' ELSE 'unresolved' END AS auto_status FROM c),
auto AS (SELECT *, CASE auto_status WHEN 'clear_agreement' THEN least(tu, su) WHEN 'clear_ttff_only' THEN tu WHEN 'clear_strain_only' THEN su END AS auto_loss_us,
  CASE auto_status WHEN 'clear_agreement' THEN 'ttff+strain' WHEN 'clear_ttff_only' THEN 'ttff' WHEN 'clear_strain_only' THEN 'strain' ELSE 'none' END AS auto_source FROM a)"""


@query("dr12_dr13_detect_loss", f"{_COMBINED} SELECT platform_id, ts AS ttff_status, detail AS ttff_detail, tu AS ttff_us, s AS strain_status, su AS strain_us, auto_status, auto_loss_us, auto_source, round((su - tu)/3600e6, 6) + 0.0 AS offset_h FROM auto")
def _(spark, sf):
    o = ops.detect_loss(signals(spark, sf), CFG)
    return o.select("platform_id", "ttff_status", "ttff_detail", "ttff_us", "strain_status", "strain_us", "auto_status",
                    "auto_loss_us", "auto_source", rnd("offset_h").alias("offset_h"))


def _reviews(spark, sf):
    """Every fifth platform is reviewed; the kind follows its number."""
    p = events(spark, sf).select("user_id", "platform_id").distinct().where("user_id % 5 = 0")
    k = F.col("user_id") % 4
    return p.select(
        "platform_id",
        F.when(k == 0, "manual_date").when(k == 1, "not_lost").when(k == 2, "uncertain").otherwise("accepted_auto").alias("review_status"),
        F.when(k.isin(0, 3), F.lit("2024-01-20").cast("timestamp")).alias("reviewed_loss"), (k * 6.0).alias("margin_h"))


def _automatic(spark, sf):
    return ops.strain_change(signals(spark, sf), STRAIN).select("platform_id", F.timestamp_micros("change_us").alias("auto_loss"))


_RESOLVED = f"""WITH {STR},
rv AS (SELECT DISTINCT user_id, CAST(user_id AS VARCHAR) AS platform_id, user_id % 4 AS k FROM events WHERE user_id % 5 = 0),
j AS (SELECT ss.platform_id, CASE WHEN status IN ('clear', 'weak') THEN block_us END AS au, k FROM ss LEFT JOIN rv USING (platform_id)),
res AS (SELECT platform_id, CASE WHEN k IS NULL THEN au WHEN k IN (0, 3) THEN 1705708800000000 END AS lu, CASE WHEN k IS NULL THEN 24.0::DOUBLE ELSE k*6.0::DOUBLE END AS margin_h, k FROM j)"""


@query("dr14_dr15_resolve_loss", f"""{_RESOLVED} SELECT platform_id, CASE WHEN lu IS NOT NULL THEN 'lost' WHEN k = 1 THEN 'not_lost' ELSE 'uncertain' END AS status, lu AS loss_us, margin_h,
 lu - CAST(margin_h*3600000000 AS BIGINT) AS cutoff_us, CASE WHEN k IS NULL THEN 'automatic' WHEN k = 0 THEN 'manual_date' WHEN k = 1 THEN 'not_lost' WHEN k = 2 THEN 'uncertain' ELSE 'accepted_auto' END AS source FROM res""")
def _(spark, sf):
    r = ops.resolve_loss(_automatic(spark, sf), _reviews(spark, sf))
    return r.select("platform_id", "status", us("loss_time").alias("loss_us"), "margin_h", us("cutoff").alias("cutoff_us"), "source")


@query("dr16_drogue_valid", f"""{_RESOLVED} SELECT res.platform_id, count(*) AS n, count_if(CASE WHEN lu IS NOT NULL THEN t < lu - CAST(margin_h*3600000000 AS BIGINT) ELSE coalesce(k = 1, false) END) AS n_valid
 FROM res JOIN sig ON sig.platform_id = res.platform_id GROUP BY 1""")
def _(spark, sf):
    r = ops.resolve_loss(_automatic(spark, sf), _reviews(spark, sf))
    d = F.when(F.col("status") == "not_lost", "retained").when(F.col("status") == "lost", "lost").otherwise("unknown")
    s = signals(spark, sf).join(r.withColumn("decision", d), "platform_id")
    return s.groupBy("platform_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ops.drogue_valid("time", "decision", "cutoff")).alias("n_valid"))


@query("dr17_review_queue", f"{_COMBINED} SELECT platform_id FROM auto WHERE auto_status NOT IN ('clear_agreement', 'clear_ttff_only', 'clear_strain_only') OR auto_loss_us IS NULL")
def _(spark, sf):
    return ops.review_queue(ops.detect_loss(signals(spark, sf), CFG))


@query("dr18_stale_reviews", """
WITH p AS (SELECT user_id, min(epoch_us(ts)) AS a, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(CASE WHEN user_id % 10 = 9 THEN -user_id ELSE user_id END AS VARCHAR) AS platform_id,
 CASE WHEN user_id % 10 = 9 THEN 'unknown_platform' WHEN user_id % 10 = 3 THEN 'source_changed' ELSE 'stale' END AS problem FROM p WHERE user_id % 10 IN (9, 3, 5)""")
def _(spark, sf):
    p = events(spark, sf).groupBy("user_id").agg(F.min(us("time")).alias("a"), F.count(F.lit(1)).alias("n"))
    base = [F.md5(F.col("n").cast("string")).alias("source_hash"), F.col("a").alias("ttff_us"), F.lit(None).cast("long").alias("strain_us"),
            F.col("a").alias("auto_loss_us"), F.lit("clear_ttff_only").alias("auto_status"), F.lit("ttff").alias("auto_source")]
    auto = p.select(F.col("user_id").cast("string").alias("platform_id"), *base)
    k = F.col("user_id") % 10
    rev = p.select(F.when(k == 9, -F.col("user_id")).otherwise(F.col("user_id")).cast("string").alias("platform_id"), "user_id", *base)
    rev = rev.withColumn("source_hash", F.when(k == 3, "old").otherwise(F.col("source_hash")))
    rev = rev.withColumn("auto_loss_us", F.when(k == 5, F.col("auto_loss_us") - 1).when(k != 6, F.col("auto_loss_us")))
    return ops.stale_reviews(rev.drop("user_id"), auto)
