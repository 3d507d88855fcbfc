"""Splits of block medians: many platforms to a call, written once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fleetwake.operators import signals


def test_splits_equal_plain_sums_and_are_not_computed_again(spark):
    cfg = signals.StrainConfig()
    side = int(np.ceil(cfg.min_side_h / cfg.block_h))
    size = round(cfg.block_h * 3_600_000_000)
    values = {f"p{i}": np.random.default_rng(i).normal(size=2 * side + i % 3 - 1).round(3) for i in range(9)}
    rows = [(p, k * size, float(v)) for p, x in values.items() for k, v in enumerate(x)]
    s = signals.strain_splits(spark.createDataFrame(rows, "platform_id string, block_us long, median double").orderBy(F.rand(3)), cfg)
    assert "FlatMapGroups" not in s._jdf.queryExecution().analyzed().toString()
    got = {(r.platform_id, r.split): r for r in s.collect()}
    cost = lambda x: np.abs(x - np.median(x)).sum()
    want = 0
    for p, x in values.items():
        splits = range(side, len(x) - side + 1)
        want += max(1, len(splits))
        if not len(splits):
            assert got[p, -1].cost is None and got[p, -1].block_us is None and got[p, -1].n_blocks == len(x)
        for k in splits:
            r = got[p, k]
            assert r.block_us == k * size and np.isclose(r.cost, cost(x[:k]) + cost(x[k:])) and np.isclose(r.cost_null, cost(x))
            assert np.isclose(r.level_before, np.median(x[:k])) and np.isclose(r.level_after, np.median(x[k:]))
    assert len(got) == want
