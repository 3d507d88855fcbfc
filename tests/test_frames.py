"""The cut windows must equal plain windows, also when one key holds most rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetwake.functions import wgs84
from fleetwake.operators import frames, pairs


@pytest.fixture(scope="module")
def skewed(spark):
    # Two thirds of the rows belong to one key; chunks of 50 leave many empty.
    d = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(100000)) / 7).alias("t"), "id",
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    return d


@pytest.mark.parametrize("parts", [1, 17])
def test_scan_equals_plain_window(skewed, parts):
    got = frames.scan(
        skewed.repartition(parts), "k", ["t", "id"], width=50, lag={"g": F.col("id")}, lead={"d": F.col("id")},
        total={"s": F.col("v")}, last={"l": F.col("v")}, first={"f": F.col("v")})
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select(
        "id", F.lag("id").over(w).alias("g"), F.lead("id").over(w).alias("d"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("l"), F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("f"))
    cols = ["id", "g", "d", "s", "l", "f"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_blocks_equal_plain_window(skewed):
    b = frames.blocks(skewed, "k", ["t", "id"], halo=3, width=500, size=16)
    w = frames.block_window("k")
    got = frames.core(b.withColumns({"m": F.sum("id").over(w.rowsBetween(-3, 3)), "x": F.lag("id", 3).over(w)})).select("id", "m", "x")
    p = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select("id", F.sum("id").over(p.rowsBetween(-3, 3)).alias("m"), F.lag("id", 3).over(p).alias("x"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_quantiles_match_numpy(skewed):
    got = {r.k: r for r in frames.quantiles(skewed, "k", {"t": F.col("t") - 5000}, {"a": 0.1, "m": 0.5, "z": 1.0}).collect()}
    pdf = skewed.toPandas()
    for k, part in pdf.groupby("k"):
        want = np.quantile(part["t"] - 5000, [0.1, 0.5, 1.0])
        assert np.allclose([got[k].t_a, got[k].t_m, got[k].t_z], want, rtol=1e-12)
        assert got[k].t_n == len(part)


def test_salted_pairs_make_every_pair_once(spark):
    d = spark.range(60).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("p"))
    for spread in (1, 4):
        rows = frames.salted_pairs(d, "g", "p", spread=spread).select("p_1", "p_2").collect()
        assert len(rows) == len(set(rows)) == 60 * 59 // 2


def test_near_pairs_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), float(179.9 + x) if x < 0.1 else float(x - 180.1), float(y)) for i, (x, y) in enumerate(zip(rng.random(60) * 0.2, 70 + rng.random(60) * 0.2))]
    d = spark.createDataFrame(rows, "platform_id string, lon double, lat double").withColumn("time", F.lit("2025-01-01").cast("timestamp"))
    got = {(r.platform_id_1, r.platform_id_2) for r in pairs.near_pairs(d, 1500.0).collect()}
    a, b = d.select(*[F.col(c).alias(f"{c}_1") for c in ("platform_id", "lon", "lat")]), d.select(*[F.col(c).alias(f"{c}_2") for c in ("platform_id", "lon", "lat")])
    every = wgs84.with_inverse(a.join(b, F.col("platform_id_1") < F.col("platform_id_2")), "g", "lon_1", "lat_1", "lon_2", "lat_2")
    want = {(r.platform_id_1, r.platform_id_2) for r in every.where("g.s <= 1500").collect()}
    assert got == want and len(want) > 10


def test_shared_folder_follows_the_session(spark):
    assert frames.shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def test_rows_without_time_are_cut_by_their_second_order(spark):
    d = spark.range(20_000).select(F.lit("p").alias("platform_id"), F.lit(None).cast("timestamp").alias("time"), F.col("id").alias("obs_index"))
    out = frames.scan(d, "platform_id", ["time", "obs_index"], lag={"prev": F.col("obs_index")}, total={"n": F.lit(1).cast("long")})
    chunks = d.select(frames.chunk_of(d, ["time", "obs_index"], frames.CHUNK_US).alias("c")).groupBy("c").count()
    assert chunks.count() == 5 and chunks.agg(F.max("count")).first()[0] <= frames.NULL_ROWS
    assert out.where("n <> obs_index + 1 OR NOT prev <=> nullif(obs_index - 1, -1)").count() == 0


def test_quantiles_of_tiny_values_use_many_buckets(spark):
    d = spark.range(2000).select(F.lit(1).alias("g"), ((F.col("id") + 1) * 1e-9 * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("v"))
    assert d.select(frames._coarse(F.col("v")).alias("b")).distinct().count() > 1500
    ordered = [r.v for r in d.orderBy("v").collect()]
    assert [r.b for r in d.orderBy("v").select(frames._coarse(F.col("v")).alias("b")).collect()] == sorted(r.b for r in d.select(frames._coarse(F.col("v")).alias("b")).collect())
    q = frames.quantiles(d, "g", {"v": F.col("v")}, {"p1": 0.1, "p9": 0.9}).first()
    import numpy as np

    assert np.allclose([q.v_p1, q.v_p9], np.quantile(ordered, [0.1, 0.9]), rtol=1e-12, atol=0)


@pytest.mark.parametrize("spread", [1, 3])
def test_plane_pairs_are_the_near_ones(spark, spread):
    r = random.Random(6)
    rows = [(g, f"p{i}", r.choice([r.uniform(-50, 50), 10.0 * r.randrange(-3, 4)]), r.uniform(-50, 50)) for g in range(3) for i in range(40)]
    rows += [(0, "x", None, 1.0), (0, "y", 2.0, None), (1, "z1", 0.0, 0.0), (1, "z2", 0.0, 0.0)]
    got = frames.plane_pairs(spark.createDataFrame(rows, "g int, id string, x_m double, y_m double"), "g", "id", 10.0, spread=spread).select("g", "id_1", "id_2", "x_m_1", "y_m_2").collect()
    want = [(a[0], a[1], b[1], a[2], b[3]) for a in rows for b in rows
            if a[0] == b[0] and a[1] < b[1] and None not in (*a, *b) and (b[2] - a[2]) ** 2 + (b[3] - a[3]) ** 2 <= 100 * (1 + 1e-12)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pairs_beyond_the_edge_are_counted_without_being_formed(spark):
    from fleetwake.operators import pairs, thirdorder

    r = random.Random(9)
    rows = [(t % 2, 0, f"p{i}", t, r.uniform(0, 90), r.uniform(0, 90), r.random(), r.random(), 10.0) for t in range(6) for i in range(9)]
    rows += [(1, 0, "q1", 1, 5.0, 5.0, 0.1, 0.1, 10.0), (1, 0, "q2", 1, 5.0, 5.0, 0.2, 0.2, 10.0), (1, 0, "q3", 1, 5.0, 5.0, None, 0.2, 10.0), (7, 0, "alone", 1, 0.0, 0.0, 0.0, 0.0, 0.0)]
    g = spark.createDataFrame(rows, "array_id int, cluster_id int, platform_id string, t long, x_m double, y_m double, u double, v double, lat double")
    g = g.withColumn("time", F.timestamp_seconds("t"))
    edges = [5.0, 15.0, 30.0]
    everyone = thirdorder.range_counts(pairs.pair_observations(g).where("r_m > 0"), edges, ["array_id"]).collect()
    near = pairs.pair_observations(g, within_m=30.0)
    bounded = thirdorder.range_counts(near, edges, ["array_id"], pairs.possible_pairs(g)).collect()
    assert sorted(map(tuple, bounded)) == sorted(map(tuple, everyone)) and near.count() < sum(x.total for x in everyone)
