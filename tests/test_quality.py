"""Sequential rules on pieces must decide as on whole runs; small facts of the rules."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwake.operators import frames, quality, runsolver
from fleetwake.operators.runsolver import Piece, PositionConfig

CFG = PositionConfig()
T0 = dt.datetime(2025, 1, 1)


def track(n, jumps=(), seconds=None, platform="p"):
    """Fixes every 300 s drifting east; ``jumps``: (first, last, degrees) blocks moved north."""
    sec = seconds or [300 * i for i in range(n)]
    lat = np.zeros(n)
    for a, z, d in jumps:
        lat[a : z + 1] += d
    return pd.DataFrame({"platform_id": platform, "obs_index": range(n), "time": [T0 + dt.timedelta(seconds=s) for s in sec],
                         "lon": 0.001 * np.arange(n), "lat": lat})


def run(spark, pdf, policy="conservative", reviews=None, **kw):
    obs = spark.createDataFrame(pdf, "platform_id string, obs_index long, time timestamp, lon double, lat double")
    drogue = obs.select("platform_id").distinct().withColumns({"status": F.lit("not_lost"), "cutoff": F.lit(None).cast("timestamp")})
    rows = quality.position_qc(obs, drogue, policy=policy, reviews=reviews, **kw).select("platform_id", "obs_index", "final_status", "decision_source", "point_reason").collect()
    return {(r.platform_id, r.obs_index): r for r in rows}


def whole_run_cures(pdf, aggressive):
    t = (pdf["time"] - pdf["time"].iloc[0]).dt.total_seconds().to_numpy()
    p = Piece(t, pdf["lon"].to_numpy(), pdf["lat"].to_numpy(), np.zeros(len(pdf), bool), CFG)
    return {int(r) for c in runsolver.solve(p, pdf["obs_index"].to_numpy(), True, True, aggressive) for r in c.skipped}


def test_blocks_of_one_to_five_points_are_cured_and_longer_ones_are_not(spark):
    parts = [track(60, [(30, 29 + k, 0.2)], platform=f"k{k}") for k in range(1, 7)]
    got = run(spark, pd.concat(parts))
    for k in range(1, 6):
        bad = {i for (p, i), r in got.items() if p == f"k{k}" and r.final_status == "rejected"}
        # Six skipped points would span more than the reach of 1801 s, five just fit.
        assert bad == (set(range(30, 30 + k)))
    assert not any(r.final_status == "rejected" for (p, _), r in got.items() if p == "k6")


def test_repeats_duplicates_and_short_intervals(spark):
    a = track(60, platform="rep")
    a.loc[40, ["lon", "lat"]] = a.loc[20, ["lon", "lat"]].to_numpy()
    b = track(60, seconds=[300 * i - (200 if i == 30 else 0) for i in range(60)], platform="short")
    c = track(60, seconds=[300 * (i - (i > 30)) for i in range(60)], platform="twin")
    got = run(spark, pd.concat([a, b, c]), policy="aggressive")
    src = lambda p: {i: r.decision_source for (q, i), r in got.items() if q == p and r.final_status == "rejected"}
    assert src("rep") == {20: "automatic_repeat", 40: "automatic_repeat"}
    assert src("short") == {30: "automatic_short_interval"}
    assert list(src("twin").values()) == ["automatic_duplicate_time"]


@pytest.mark.parametrize("policy", ["conservative", "aggressive"])
def test_pieces_decide_like_whole_runs(spark, policy):
    rng = np.random.default_rng(5)
    n = 1500
    pdf = track(n)
    for at in rng.choice(np.arange(20, n - 20), 14, replace=False):
        k = int(rng.integers(1, 7))
        pdf.loc[at : at + k - 1, "lat"] += float(rng.choice([0.02, 0.2, -0.3]))
    obs = spark.createDataFrame(pdf, "platform_id string, obs_index long, time timestamp, lon double, lat double")
    drogue = obs.select("platform_id").distinct().withColumns({"status": F.lit("not_lost"), "cutoff": F.lit(None).cast("timestamp")})
    rows = quality.with_segments(quality.base_rows(obs, drogue)).withColumns({c: F.lit(False) for c in ("rej_repeat", "rej_short", "rej_dup")})
    got = {r.obs_index for r in quality.geometry_cures(rows, F.lit(False), CFG, aggressive=policy == "aggressive").collect()}
    assert got == whole_run_cures(pdf, policy == "aggressive") and got


def plain_thinning(t, human, limit):
    """The rule as one walk over an island."""
    drop, at = [False] * len(t), 0
    while at < len(t):
        if human[at] in ("reject", "uncertain"):
            at += 1
            continue
        beyond = at + 1
        while beyond < len(t) and (t[beyond] - t[at] < limit or human[beyond] == "reject"):
            drop[beyond] = bool(t[beyond] - t[at] < limit)
            beyond += 1
        at = beyond
    return drop


def test_short_interval_anchor_is_the_last_survivor():
    t = np.array([0, 100, 200, 250, 400]) * 1_000_000
    human = np.array(["", "", "", "", ""])
    got = runsolver.Thinning(t, human, 150_000_000).fallen(runsolver.NO_ANCHOR)
    assert list(got) == [False, True, False, True, False]


def test_stretches_hand_their_anchor_on():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(2, 60))
        t = np.cumsum(r.integers(1, 12, n)).astype(np.int64)
        human = r.choice(["", "", "", "reject", "uncertain"], n)
        cuts = np.sort(r.integers(0, n + 1, 3))
        anchor, got = runsolver.NO_ANCHOR, []
        for a, b in zip([0, *cuts], [*cuts, n]):
            if b > a:
                s = runsolver.Thinning(t[a:b], human[a:b], 15)
                got += list(s.fallen(anchor))
                anchor = int(s.handed_on(np.array([anchor]))[0])
        assert got == plain_thinning(t, human, 15)


def test_dense_track_over_many_days(spark):
    """One island of a week: chunks are thinned apart and agree with one walk."""
    r = np.random.default_rng(5)
    seconds = np.cumsum(r.integers(200, 1500, 700))
    rows = [("dense", i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=int(s)), 0.001 * i, 0.0) for i, s in enumerate(seconds)]
    rows += [("calm", i, dt.datetime(2025, 1, 1) + dt.timedelta(hours=2 * i), 0.001 * i, 1.0) for i in range(20)]
    d = spark.createDataFrame(rows, "platform_id string, obs_index long, time timestamp, lon double, lat double")
    human = F.when(F.col("obs_index") % 17 == 5, "reject").when(F.col("obs_index") % 41 == 7, "uncertain").otherwise("")
    d = d.withColumns({"human": human, "segment": F.lit(0), "segment_status": F.lit("retained"), "deployment_uncertain": F.lit(False), "rej_repeat": F.lit(False), **{c: F.lit(True) for c in ("valid_time", "valid_position", "drogue_eligible", "deployment_eligible")}})
    cfg = PositionConfig(min_dt_s=1800.0)
    got = {(x.platform_id, x.obs_index) for x in quality.short_interval_rejections(d, cfg).where("rej_short").collect()}
    flags = ["reject" if i % 17 == 5 else "uncertain" if i % 41 == 7 else "" for i in range(700)]
    want = {("dense", i) for i, x in enumerate(plain_thinning(list(map(int, seconds)), flags, 1800)) if x}
    assert got == want and len(want) > 200


def test_small_groups_share_calls_and_their_results_are_written(spark):
    rows = spark.range(3000).select(F.concat(F.lit("p"), F.col("id") % 1000).alias("platform_id"), (3000 - F.col("id")).alias("v"))
    got = frames.in_lots(rows, "platform_id", "v", lambda d: {"n": [len(d)], "up": [bool(d["v"].is_monotonic_increasing)]}
                         if d["platform_id"].iloc[0] != "p7" else None, "platform_id string, n long, up boolean")
    assert got.rdd.getNumPartitions() == 1
    out = got.collect()
    assert len(out) == 999 and all(r.n == 3 and r.up for r in out) and len({r.platform_id for r in out}) == 999

    # Later rules read these steps several times: no grouped function may be left in their plans.
    obs = spark.createDataFrame(track(60, [(30, 30, 0.2)]), "platform_id string, obs_index long, time timestamp, lon double, lat double")
    drogue = obs.select("platform_id").distinct().withColumns({"status": F.lit("not_lost"), "cutoff": F.lit(None).cast("timestamp")})
    flags = quality.with_segments(quality.base_rows(obs, drogue)).withColumns({c: F.lit(False) for c in ("rej_repeat", "rej_short", "rej_dup")})
    for step in (quality.short_interval_rejections(flags.drop("rej_short"), CFG), quality.geometry_cures(flags, F.lit(False), CFG, aggressive=True)):
        assert "FlatMapGroups" not in step._jdf.queryExecution().analyzed().toString()
