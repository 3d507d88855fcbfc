"""Registered queries against their SQL at the smallest scale, and the shape of the registry."""

from __future__ import annotations

import pytest

from check import compare, duck
from fleetwake.catalog import load

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_track_audit", "io06_deployments", "sc12_wrap_unwrap_longitude", "dr09_ttff_cessation", "qc02_segments", "rg04_resample_track",
    "gr01_start_arrays", "pr07_pair_coverage", "ep05_ep06_separation_bins", "fs03_first_passages", "af04_affine_fits", "cm05_jump_runs",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    queries, sqls = load()
    ok, message = compare(spark, con, name, queries[name], sqls[name], SF)
    assert ok, message


def test_registry():
    queries, sqls = load()
    assert set(sqls) <= set(queries) and len(queries) > 150


def test_no_plan_puts_a_fact_table_under_an_unpartitioned_window_or_nested_loop(spark):
    queries, _ = load()
    for name in ("sc05_consecutive_speed", "rg04_resample_track", "pr07_pair_coverage"):
        plan = queries[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_spline_blocks_equal_one_solve(spark):
    import numpy as np

    from fleetwake.operators.grid import _natural_spline

    x = np.arange(400.0)
    y = np.column_stack([np.sin(x / 5), np.cos(x / 7)])
    at = np.linspace(150, 250, 301)
    whole = _natural_spline(x, y, at)
    part = _natural_spline(x[80:320], y[80:320], at)
    assert np.abs(whole - part).max() < 1e-14
    assert np.allclose(_natural_spline(x, y, x), y, atol=1e-12)
