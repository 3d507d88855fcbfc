"""Phase splines: the solver against a dense system, short tracks together in lots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fleetwake.operators import frames, grid


def dense(x, y, at):
    h, n = np.diff(x), len(x)
    a, b = np.eye(n), np.zeros_like(y)
    for i in range(1, n - 1):
        a[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m, k = np.linalg.solve(a, b), np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v, w = (x[k + 1] - at)[:, None], (at - x[k])[:, None], h[k][:, None]
    return (m[k] * u**3 + m[k + 1] * v**3) / (6 * w) + (y[k] / w - m[k] * w / 6) * u + (y[k + 1] / w - m[k + 1] * w / 6) * v


def test_solver(spark):
    r = np.random.default_rng(5)
    for n in (4, 5, 30):
        x, y = np.cumsum(r.uniform(0.5, 2, n)), r.normal(size=(n, 2))
        at = np.sort(r.uniform(x[0], x[-1], 50))
        assert np.allclose(grid._natural_spline(x, y, at), dense(x, y, at), rtol=1e-12, atol=1e-12)


def test_short_tracks_share_calls(spark, monkeypatch):
    hour = 3_600_000_000
    rows = [(f"p{p}", i * hour, 10 + 0.01 * ((i * 7 + p) % 5), 20 + 0.002 * i) for p in range(30) for i in range(24)]
    rows += [("few", i * hour, 10.0, 20.0) for i in range(3)]
    f = spark.createDataFrame(rows, "platform_id string, t long, lon double, lat double").withColumn("time", F.timestamp_micros("t"))
    cells = f.select("platform_id", (F.col("t") / hour).cast("long").alias("cell"), "time")
    groups, lots = [], frames.in_lots

    def counted(df, key, *rest):
        groups.append(df.select(*key).distinct().count())
        return lots(df, key, *rest)

    monkeypatch.setattr(frames, "in_lots", counted)
    got = grid.phase_spline(f.drop("t"), cells, cadence_min=60, period_min=180, long_gap_min=600).collect()
    assert groups == [31] and len(got) == len(rows)
    at = np.arange(24.0) * 3600
    for p in (0, 7):
        xy = np.array([r[2:] for r in rows if r[0] == f"p{p}"])
        knots = [sorted({0, 23} | set(range(k, 24, 3))) for k in range(3)]
        want = np.mean([dense(at[k], xy[k], at) for k in knots], axis=0)
        mine = sorted((g for g in got if g.platform_id == f"p{p}"), key=lambda g: g.cell)
        if mine[0].fallback == "":
            assert np.allclose([(g.lon, g.lat) for g in mine], want, rtol=1e-12)
    assert {g.fallback for g in got if g.platform_id == "few"} == {"insufficient"}
    assert any(g.fallback in ("", "overshoot") for g in got)
