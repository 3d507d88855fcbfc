"""Log-spaced thinning: the rows nearest to the targets, in parts that hold a bounded number of rows."""

from __future__ import annotations

import numpy as np

from fleetwake.operators import dispersion


def test_nearest_rows_in_parts_by_row_count(spark, monkeypatch):
    monkeypatch.setattr(dispersion, "THIN_ROWS", 20)
    r = np.random.default_rng(4)
    groups = {g: np.sort(r.integers(1, 60, 3 + 4 * g)).astype(float) for g in range(12)}
    rows = [(g, i, float(x)) for g, v in groups.items() for i, x in enumerate(v)] + [(0, 99, -1.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    out = dispersion.log_thin(df, ["g"], "v", 8, "i")
    assert out.rdd.getNumPartitions() >= sum(map(len, groups.values())) // 20
    want = set()
    for g, v in groups.items():
        goals = [v[0] * (v[-1] / v[0]) ** (k / 7) for k in range(8)]
        want |= {(g, i) for i in (range(len(v)) if len(v) <= 8 else (int(np.argmin(np.abs(v - t))) for t in goals))}
    assert {(x.g, x.i) for x in out.collect()} == want
