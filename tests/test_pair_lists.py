"""Listed pairs by the bits of their members, and sums of pairs in cells, against plain joins."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwake.operators import frames, pairs, spatial, thirdorder

DAY = dt.datetime(2025, 1, 1)
P1, P2 = pairs.P1, pairs.P2


def moving(spark, members=70, times=3):
    r = np.random.default_rng(6)
    rows = [(1 + (m >= 66), m // 5, f"p{m:02d}", DAY + dt.timedelta(hours=6 * t), *map(float, r.uniform(-150, 150, 2)), *map(float, r.normal(0, 1, 2)), 20.0)
            for m in range(members) for t in range(times)]
    rows += [(1, 99, "p99", DAY, None, 1.0, 0.0, 0.0, 20.0), (None, 99, "p98", DAY, 1.0, 1.0, 0.0, 0.0, 20.0), rows[0], rows[7]]
    return spark.createDataFrame(rows, "array_id long, cluster_id long, platform_id string, time timestamp, x_m double, y_m double, u double, v double, lat double")


@pytest.mark.parametrize("spread", [1, 3])
def test_listed_pairs(spark, spread):
    m = frames.cut(moving(spark))
    everyone = pairs.pair_observations(m, within_m=80.0)
    listed = frames.cut(everyone.select("array_id", P1, P2).where(F.crc32(F.concat(P1, P2).cast("binary")) % 3 == 0))
    got = pairs.pair_observations(m, within_m=80.0, spread=spread, listed=listed)
    want = everyone.join(listed, ["array_id", P1, P2], "left_semi")
    names = sorted(want.columns)
    assert sorted(got.columns) == names and 0 < want.count() < everyone.count()
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    bits = {r.platform_id: r for r in pairs.partners(listed, ["array_id"]).where("array_id = 1").collect()}
    assert max(r["__no"] for r in bits.values()) >= 62  # more than one word
    assert sum(w.bit_count() for r in bits.values() for w in r["__bits"]) == 2 * listed.where("array_id = 1").distinct().count()


def test_observations_shuffle_no_pair_rows(spark):
    m = frames.cut(moving(spark))
    inventory = frames.cut(spatial.pair_inventory(m, max_first_m=60.0))
    got = spatial.observations(m, inventory, low_m=10.0, high_m=120.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
    # The join forms the pairs; their separation is computed above it and not once more in its condition.
    assert not any("HYPOT" in line for line in plan.splitlines() if "Join " in line)
    want = pairs.pair_observations(m).join(inventory.where("selected"), ["array_id", P1, P2], "left_semi").where("r_m > 0 AND r_m BETWEEN 10 AND 120")
    names = ["array_id", "time", P1, P2, "r_m", "dul", "dut", "mid_x", "mid_y", "relation"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def test_cells_of_overlapping_and_separate_windows(spark):
    m = frames.cut(moving(spark))
    o = pairs.pair_observations(m, within_m=120.0).where("r_m > 0").withColumn("age_h", F.hour("time").cast("double"))
    bands = spatial.bands([50.0], manual=[100.0, 200.0])
    apart = [("a", 0.0, 6.0), ("b", 6.0, 13.0)]
    both = [*apart, ("c", 0.0, 13.0)]
    key = ["window", "band", "cx", "cy", "observations", "pairs", "platforms", "utc", "clusters"]
    one, two = (sorted(map(tuple, spatial.cells(o, w, bands, ["array_id"])[0].where("window <> 'c'").select(key).collect())) for w in (apart, both))
    assert one == two and sum(r[4] for r in one) == o.count()
    whole = spatial.cells(o, both, bands, ["array_id"])[0].where("window = 'c'").agg(F.sum("observations").alias("n")).first()
    assert whole.n == o.count()


def test_support_and_removals_need_no_pair_id(spark):
    rows = [(1, "a", "b", DAY, 5.0, 0.1), (1, "a", "b", DAY + dt.timedelta(hours=1), 6.0, -0.2), (1, "b", "c", DAY, 7.0, 0.3), (1, "a", "c", DAY, 15.0, 0.1)]
    d = frames.cut(spark.createDataFrame(rows, f"array_id long, {P1} string, {P2} string, time timestamp, r_m double, dul double"))
    s = thirdorder.support(d, ["array_id"]).first()
    assert (s.observations, s.pairs, s.platforms, s.utc, s.occupied_hours) == (4, 3, 3, 2, 2)
    got = {(r.bin, r.removed_platform): (r.remaining_observations, r.remaining_pairs, r.remaining_platforms, r.remaining_utc) for r in thirdorder.leave_one_out(d, [0.0, 10.0, 20.0], ["array_id"]).collect()}
    assert got == {(0, "a"): (1, 1, 2, 1), (0, "b"): (0, 0, 0, 0), (0, "c"): (2, 1, 2, 2), (1, "a"): (0, 0, 0, 0), (1, "c"): (0, 0, 0, 0)}
