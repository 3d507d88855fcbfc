"""Small inputs on which a query once gave another result than its SQL."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from check import compare, duck
from fleetwake.catalog import load
from fleetwake.catalog.base import rnd
from fleetwake.operators import audit

BASE = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.1"
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def folder(events, path):
    events.write.parquet(f"{path}/events.parquet")
    return str(path)


def agrees(spark, name, sf):
    con = duck(BASE)
    con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    queries, sqls = load()
    ok, message = compare(spark, con, name, queries[name], sqls[name], sf)
    assert ok, message


@pytest.mark.parametrize("name", ["cm10_compare_edges", "cm20_representation_summary"])
def test_a_neighbour_within_the_tolerance_is_no_position_of_a_missing_fix(spark, tmp_path, name):
    # Fix 17 is missing from one representation, and fix 12 lies half a second before it.
    start = dt.datetime(2024, 1, 1)
    at = {10: 0.0, 11: 3600.0, 12: 7200.0, 17: 7200.5, 18: 10800.0, 20: 14400.0}
    rows = [(i, start + dt.timedelta(seconds=s), 5, "view", 3.0 * k + 0.37, "{}") for k, (i, s) in enumerate(at.items())]
    agrees(spark, name, folder(spark.createDataFrame(rows, EVENT), tmp_path / "t"))


def test_turning_angle_of_fixes_that_hardly_move(spark, tmp_path):
    e = spark.read.parquet(f"{BIG}/events.parquet")
    hot = e.where("event_id IN (95281, 96756)").select("user_id").distinct()
    agrees(spark, "sc17_turning_angle", folder(e.join(hot, "user_id").select(*e.columns), tmp_path / "t"))


def test_residual_on_the_last_bit_of_a_sine(spark):
    # The SQL has 122 metres; with the JVM's functions it was 121.
    start = dt.datetime(2024, 1, 1)
    rows = [("p", i, start + dt.timedelta(seconds=s), lon, lat) for i, (s, lon, lat) in enumerate(((0, 131.23595, 20.8157), (274, 131.23505, 20.81495), (1001, 131.236, 20.81545)))]
    o = audit.interpolation_residual(spark.createDataFrame(rows, "platform_id string, obs_index long, time timestamp, lon double, lat double"))
    assert [r.residual_m and round(r.residual_m) for r in o.orderBy("obs_index").collect()] == [None, 122, None]


def test_rounding_of_decimal_ties(spark):
    # As the SQL does it: scaled, rounded half away from zero, scaled back.
    values = [k / (2 * n) for n in (320, 1600, 3200, 64, 125, 640) for k in range(1, 2 * n, 7)] + [-0.0015625, 0.0, -1e-9]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", rnd("v").alias("r")).collect()
    assert [(v, r) for v, r in got if r != math.copysign(math.floor(abs(v) * 1e6 + 0.5) / 1e6, v)] == []
    con = duck(BASE)
    assert all(con.sql(f"SELECT round({v!r}::DOUBLE, 6)").fetchall()[0][0] == r for v, r in got[::9])
