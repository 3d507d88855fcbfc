"""Steps whose rows, files or written columns must not grow faster than the input."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwake.operators import thirdorder


def test_block_bootstrap_equals_brute_force_without_joining_replicates(spark):
    total, replicates, edges = 8, 25, [0.0, 10.0, 20.0]
    rows = [(g, float(1 + (7 * i) % 19), ((i * 13) % 17 - 8) / 10, (i * 0.37) % 8) for g in (1, 2) for i in range(40 * g)]
    rows = [r for r in rows if int(r[3]) != 5]  # a scheduled block without rows
    pairs = spark.createDataFrame(rows, "array_id long, r_m double, dul double, age_h double")
    out = thirdorder.block_bootstrap(pairs, edges, ["array_id"], start_h=0, end_h=8, block_min=60, replicates=replicates, seed=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2  # the dense table of bins and its left join
    got = {(r.array_id, r.bin): r for r in out.collect()}
    draws = spark.createDataFrame([(g,) for g in (1, 2)], "array_id long").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    drawn = {}
    for r in draws.withColumn("b", F.pmod(F.xxhash64(F.lit(3), "array_id", "rep", "slot"), F.lit(total))).collect():
        drawn.setdefault((r.array_id, r.rep), []).append(r.b)
    for (g, i), have in got.items():
        c, m, seen = np.zeros(total), np.zeros(total), set()
        for a, r, d, age in rows:
            if a == g and edges[i] <= r < edges[i + 1] + (i == 1) * 1e-9:
                c[int(age)] += d**3
                m[int(age)] += r
                seen.add(int(age))
        e = [-1.25 * c[b].sum() / m[b].sum() for b in (drawn[g, k] for k in range(replicates)) if m[b].sum() > 0]
        assert (have.contributing_blocks, have.successful) == (len(seen), len(e))
        assert np.allclose([have.ci_lower, have.ci_upper], np.percentile(e, [2.5, 97.5]), rtol=1e-12)


@pytest.fixture
def uncoalesced(spark):
    """A few rows use all shuffle partitions, as many rows would."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.unset(name)


def test_products_are_written_as_one_file_an_array_unless_it_is_large(uncoalesced, tmp_path):
    from fleetwake.sources import tables

    spark = uncoalesced
    d = spark.range(1200).select(
        F.lit("raw").alias("product"), F.when(F.col("id") % 4 < 3, F.lit(0)).otherwise(F.col("id") % 12).cast("long").alias("array_id"),
        F.lit("p").alias("platform_id"), F.timestamp_micros(F.col("id") * 3_600_000_000).alias("time"), F.col("id").alias("v"))
    tables.write_products(d, str(tmp_path / "a"))
    arrays = list((tmp_path / "a" / "product=raw").glob("array_id=*"))
    assert len(arrays) == 4 and all(len(list(Path(a).glob("*.parquet"))) == 1 for a in arrays)
    tables.write_products(d, str(tmp_path / "b"), rows_per_file=100)
    files = {a.name: len(list(a.glob("*.parquet"))) for a in (tmp_path / "b" / "product=raw").glob("array_id=*")}
    assert files["array_id=0"] > 1 and all(n == 1 for a, n in files.items() if a != "array_id=0")
    for name in "ab":
        assert sorted(r.v for r in spark.read.parquet(str(tmp_path / name)).collect()) == list(range(1200))


def test_pair_rows_are_written_without_what_follows_from_them(spark, monkeypatch):
    from fleetwake.catalog import analysis
    from fleetwake.operators import frames, pairs

    rows = [(0, f"p{i}", i // 2, "2024-01-06 00:00:00", 100.0 * i, 50.0 * i * i, 0.1 * i, 0.02 * i, 20.0) for i in range(4)]
    m = spark.createDataFrame(rows, "array_id long, platform_id string, cluster_id long, time string, x_m double, y_m double, u double, v double, lat double")
    m = m.withColumn("time", F.col("time").cast("timestamp"))
    written = []
    monkeypatch.setattr(frames, "cut", lambda d: written.append(d.columns) or d)
    got = analysis.paired(m)
    assert len(written) == 1 and not {"pair_id", "q", "dul3", "mixed3", "mid_x", "x_m_1"} & set(written[0])
    names = ["pair_id", "r_m", "dul", "dut", "q", "dul3", "mixed3", "mid_lat"]
    assert sorted(got.select(names).collect()) == sorted(pairs.pair_observations(m).select(names).collect())


def test_inventory_joins_no_pair_at_every_time(spark, monkeypatch):
    from fleetwake.operators import frames, spatial

    # Platform a changes its cluster; b and c first meet a at time 2.
    at = {"a": range(8), "b": range(2, 8), "c": range(2, 5)}
    rows = [(1, p, int(p == "a" and t > 4), t, 10.0 * t, float(ord(p) - 97)) for p, ts in at.items() for t in ts]
    g = spark.createDataFrame(rows, "array_id long, platform_id string, cluster_id long, t long, x_m double, y_m double")
    g = g.withColumn("time", F.timestamp_micros(F.col("t") * 3_600_000_000))
    joined, plain = [], frames.salted_pairs
    monkeypatch.setattr(frames, "salted_pairs", lambda d, on, *a, **k: joined.append(on) or plain(d, on, *a, **k))
    got = {(r.platform_id_1, r.cluster_id_1, r.platform_id_2): (r.first_m, r.selected) for r in spatial.pair_inventory(g, max_first_m=1.5).collect()}
    assert got == {("a", 0, "b"): (1.0, True), ("a", 1, "b"): (1.0, True), ("a", 0, "c"): (2.0, True), ("b", 0, "c"): (1.0, True)}
    assert joined and not any("time" in on for on in joined)


def test_distribution_summary_shuffles_only_the_wanted_buckets(spark):
    values = [((i * 7919) % 1000 - 300) / 7 for i in range(1000)] + [5.0] * 300 + [None, float("nan")]
    d = spark.createDataFrame([(v, abs(v) + 1 if v else v) for v in values], "dul double, r_m double")
    out = thirdorder.distribution_summary(d, ["dul", "r_m"])
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    by_value = [i for i, line in enumerate(plan) if "Aggregate [" in line and "__v#" in line.split("], [")[0]]
    assert by_value and all("Join Inner" in "".join(plan[i + 1:i + 3]) for i in by_value)
    got = {r.metric: r for r in out.collect()}
    for name, of in (("dul", lambda v: v), ("r_m", lambda v: abs(v) + 1 if v else v)):
        x = np.array([of(v) for v in values if v is not None and v == v])
        assert got[name]["count"] == len(x)
        for column, p in (("minimum", 0), ("p05", 5), ("median", 50), ("p99", 99), ("maximum", 100)):
            assert got[name][column] == pytest.approx(np.percentile(x, p), rel=1e-12)
