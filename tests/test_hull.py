"""Hulls from outer points and shares against the hull of all points."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from fleetwake.operators import clusters


@pytest.mark.parametrize("rows", [4096, 5])
def test_hull(spark, rows):
    r = np.random.default_rng(2)
    shapes = {
        0: r.normal(0, 5, (400, 2)), 1: r.uniform(0, 1, (60, 2)).round(1), 2: np.array([[0, 0], [1, 1], [2, 2], [3, 3]]), 3: np.array([[1, 2]]),
        4: np.array([[0, 0], [4, 0], [4, 3], [0, 3], [2, 0], [2, 1], [2, 1]]), 5: np.array([[1, 2], [1, 2], [1, 2]]), 6: np.array([[0, 0], [5, 1]]), 7: r.integers(0, 4, (50, 2)),
    }
    data = [(1, k, dt.datetime(2025, 1, 1), float(x), float(y)) for k, p in shapes.items() for x, y in p] + [(1, 0, dt.datetime(2025, 1, 2), None, 1.0)]
    d = spark.createDataFrame(data, "array_id int, cluster_id int, time timestamp, x_m double, y_m double")
    got = {x.cluster_id: (x.n, x.hull_m2, x.hull_ratio) for x in clusters.hull_area(d, ("array_id", "cluster_id"), rows).collect()}
    for k, p in shapes.items():
        ring = clusters._ring(p[:, 0].astype(float), p[:, 1].astype(float))
        x, y = ring.T
        area = abs(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1))) / 2 if len(ring) > 2 else 0
        assert got[k][0] == len(p)
        assert got[k][1:] == ((pytest.approx(area), 1.0) if area > 0 else (None, None))
    assert got[4][1] == pytest.approx(12.0)
    if rows > 5:
        assert clusters.outer_points(d.where("x_m IS NOT NULL"), ["array_id", "cluster_id", "time"]).where("cluster_id = 0").count() < 120


def test_small_hulls_share_a_call(spark, monkeypatch):
    lots = []
    plain = clusters.frames.in_lots
    monkeypatch.setattr(clusters.frames, "in_lots", lambda d, *a: lots.append(d.count()) or plain(d, *a))
    day = dt.datetime(2025, 1, 1)
    data = [(1, k, day + dt.timedelta(hours=6 * t), float(x), float(y)) for k in range(6) for t in range(8) for x, y in ((0, 0), (2 + k, 0), (0, 2 + t), (0, 0))]
    d = spark.createDataFrame(data, "array_id int, cluster_id int, time timestamp, x_m double, y_m double")
    got = {(x.cluster_id, x.time): (x.n, x.hull_m2, x.hull_ratio) for x in clusters.hull_area(d).collect()}
    assert got == {(k, day + dt.timedelta(hours=6 * t)): (4, (2 + k) * (2 + t) / 2, (2 + t) / 2) for k in range(6) for t in range(8)}
    assert lots and lots[0] <= 4 * 6 * 8
