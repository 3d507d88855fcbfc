"""Published geodesics, and the steps, the bisection and the direct problem against each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fleetwake.functions import wgs84


def dms(d, m, s):
    return float(np.sign(d) * (abs(d) + m / 60 + s / 3600))


def table(spark, *columns):
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in zip(*columns)], "lon1 double, lat1 double, lon2 double, lat2 double")


def inverse(spark, *columns, **how):
    d = wgs84.with_inverse(table(spark, *columns), "g", "lon1", "lat1", "lon2", "lat2", **how).select("g.s", "g.az").collect()
    return np.array([r.s for r in d], float), np.array([r.az for r in d], float)


def test_published_line(spark):
    # The Flinders Peak - Buninyong line of the Australian geodetic manual (GRS80 and WGS84 agree to 0.1 mm here).
    s, az = inverse(spark, [dms(144, 25, 29.52440)], [dms(-37, 57, 3.72030)], [dms(143, 55, 35.38390)], [dms(-37, 39, 10.15610)])
    assert abs(s[0] - 54972.271) < 1e-3
    assert abs(az[0] % 360 - (306 + 52 / 60 + 5.37 / 3600)) < 1e-5


def test_direct_undoes_inverse(spark):
    rng = np.random.default_rng(0)
    lon1, lat1 = rng.uniform(-180, 180, 500), rng.uniform(-80, 80, 500)
    lon2, lat2 = (lon1 + rng.uniform(-60, 60, 500) + 180) % 360 - 180, rng.uniform(-80, 80, 500)
    d = wgs84.with_inverse(table(spark, lon1, lat1, lon2, lat2), "g", "lon1", "lat1", "lon2", "lat2")
    d = wgs84.with_direct(d, "e", "lon1", "lat1", "g.az", "g.s").select("e.lon", "e.lat", "lon2", "lat2").toPandas()
    assert np.max(np.abs((d.lon - d.lon2 + 180) % 360 - 180)) < 1e-9 and np.max(np.abs(d.lat - d.lat2)) < 1e-9


def test_equal_points_and_equator(spark):
    s, az = inverse(spark, [10.0, 0.0], [0.0, 0.0], [10.0, 1.0], [0.0, 0.0])
    assert s[0] == 0
    assert abs(s[1] - 111319.4908) < 1e-3 and abs(az[1] - 90) < 1e-9


def test_near_antipodal_pairs_have_a_distance(spark):
    # Published values for (0, 0) - (179.5, 0.5) and (0, -30) - (179.8, 29.9).
    s, az = inverse(spark, [0.0, 0.0, 0.0, 0.0], [0.0, -30.0, 0.0, 0.0], [179.5, 179.8, 179.7, 180.0], [0.5, 29.9, 0.2, 0.0])
    assert np.allclose(s[:2], [19936288.579, 19989832.827610], atol=1e-3) and np.allclose(az[:2], [25.671872868, 161.890524736], atol=1e-6)
    assert np.isfinite(s).all()


def test_few_steps_more_steps_and_bisection_agree(spark):
    r = np.random.default_rng(4)
    lon1, lon2, lat1, lat2 = r.uniform(-180, 180, 500), r.uniform(-180, 180, 500), r.uniform(-89, 89, 500), r.uniform(-89, 89, 500)
    s, az = inverse(spark, lon1, lat1, lon2, lat2)
    more, az_more = inverse(spark, lon1, lat1, lon2, lat2, steps=6)
    reduced = lambda c: F.atan((1 - wgs84.FLATTENING) * F.tan(F.radians(c)))
    span = F.radians(F.pmod(F.col("lon2") - F.col("lon1") + 180, F.lit(360.0)) - 180)
    d = table(spark, lon1, lat1, lon2, lat2).select(span.alias("span"), reduced("lat1").alias("u1"), reduced("lat2").alias("u2"))
    d = d.select(F.expr(wgs84._bisected("span", "u1", "u2")).alias("b")).select("b.*").toPandas()
    for other, turned in ((more, az_more), (d.s, d.az)):
        assert np.abs(s - other).max() < 1e-4 and np.abs((az - turned + 180) % 360 - 180).max() < 1e-8


def test_missing_inputs_and_no_python_worker(spark):
    d = table(spark, [None, 1.0, float("nan"), 4.0], [0.0, None, 0.0, 5.0], [1.0, 1.0, 1.0, 4.1], [1.0, 1.0, 1.0, 5.0])
    d = wgs84.with_inverse(d, "g", "lon1", "lat1", "lon2", "lat2")
    d = wgs84.with_direct(d, "e", "lon1", "lat1", "g.az", "g.s").where("g.s IS NULL OR g.s < 1e6")
    rows = d.select("g.s", "g.az", "e.lon", "e.lat").collect()
    assert [r.s is None and r.az is None and r.lon is None for r in rows] == [True, True, True, False]
    plan = d._sc._jvm.PythonSQLUtils.explainString(d._jdf.queryExecution(), "simple")
    assert "Arrow" not in plan and "Python" not in plan
