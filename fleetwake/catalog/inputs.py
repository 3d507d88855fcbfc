"""Domain tables derived from the ``events`` table with integer arithmetic.

Every row of ``events`` becomes one position fix and one signal sample of a platform
(``user_id``). The SQL texts are the same derivation for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwake.operators import frames

HOUR_US = 3_600_000_000


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.col("user_id"),
        F.col("user_id").cast("string").alias("platform_id"),
        F.col("event_id").alias("obs_index"),
        F.col("ts").cast("timestamp").alias("time"),
        "event_type",
        "value",
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """platform_id, obs_index, time, lon, lat, sst (plus the integer micro-degrees)."""
    e = events(spark, sf)
    cents = F.round(F.col("value") * 100).cast("long")
    e = e.withColumns(
        {"sx": cents % 41 - 20, "sy": F.floor(cents / 41).cast("long") % 41 - 20}
    )
    walked = frames.scan(
        e, ["user_id", "platform_id"], ["time", "obs_index"],
        total={"cx": F.col("sx"), "cy": F.col("sy")},
    )
    lon_u = 130000000 + (F.col("user_id") % 50) * 20000 + F.col("cx") * 50
    lat_u = 20000000 + (F.floor(F.col("user_id") / 50).cast("long") % 50) * 20000 + F.col("cy") * 50
    return walked.select(
        "platform_id", "obs_index", "time",
        (lon_u / F.lit(1e6)).alias("lon"), (lat_u / F.lit(1e6)).alias("lat"),
        F.col("value").alias("sst"), lon_u.alias("lon_u"), lat_u.alias("lat_u"), "event_type", "user_id",
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """platform_id, obs_index, time, ttff, strain."""
    return events(spark, sf).select(
        "platform_id", "obs_index", "time",
        F.col("value").alias("ttff"), (F.col("value") / 10).alias("strain"),
    )


OBS = """
steps AS (
  SELECT *, CAST(round(value*100) AS BIGINT) % 41 - 20 AS sx,
         (CAST(round(value*100) AS BIGINT) // 41) % 41 - 20 AS sy FROM events),
walk AS (
  SELECT *, SUM(sx) OVER w AS cx, SUM(sy) OVER w AS cy FROM steps
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
obs AS (
  SELECT CAST(user_id AS VARCHAR) AS platform_id, event_id AS obs_index, ts AS time, user_id, event_type,
         CAST(130000000 + (user_id % 50)*20000 + cx*50 AS BIGINT) AS lon_u,
         CAST(20000000 + ((user_id // 50) % 50)*20000 + cy*50 AS BIGINT) AS lat_u,
         CAST(130000000 + (user_id % 50)*20000 + cx*50 AS BIGINT)/1e6 AS lon,
         CAST(20000000 + ((user_id // 50) % 50)*20000 + cy*50 AS BIGINT)/1e6 AS lat,
         value AS sst FROM walk)
"""

HAVERSINE = """12742017.6 * asin(sqrt(
  pow(sin((radians({b1}) - radians({b0}))/2), 2)
  + cos(radians({b0})) * cos(radians({b1})) * pow(sin(radians({a1} - {a0})/2), 2)))"""


def hav(a0: str, b0: str, a1: str, b1: str) -> str:
    return HAVERSINE.format(a0=a0, b0=b0, a1=a1, b1=b1)


_STEP = """sin(lam)*cos(u2) AS e, cos(u1)*sin(u2) - sin(u1)*cos(u2)*cos(lam) AS n, sin(u1)*sin(u2) + cos(u1)*cos(u2)*cos(lam) AS cs"""
_ARC = """sqrt(e*e + n*n) AS ss, atan2(sqrt(e*e + n*n), cs) AS sg, CASE WHEN e*e + n*n > 0 THEN cos(u1)*cos(u2)*sin(lam)/sqrt(e*e + n*n) ELSE 0 END AS sa"""
_MID = """1 - sa*sa AS c2, CASE WHEN 1 - sa*sa > 1e-15 THEN cs - 2*sin(u1)*sin(u2)/(1 - sa*sa) ELSE 0 END AS cm,
  1/298.257223563/16*(1 - sa*sa)*(4 + 1/298.257223563*(4 - 3*(1 - sa*sa))) AS c"""


def geodesic(source: str, out: str = "geo", steps: int = 8) -> str:
    """CTEs from ``source`` with lo0, la0, lo1, la1 to ``out`` with s (metres) and az (degrees) on the ellipsoid.

    Fixed-point steps for the longitude on the auxiliary sphere; for pairs far from the antipode.
    """
    flat = "(1 - 1/298.257223563)"
    ctes = [f"{out}_0 AS (SELECT *, radians(lo1 - lo0) AS sp, radians(lo1 - lo0) AS lam, atan({flat}*tan(radians(la0))) AS u1, atan({flat}*tan(radians(la1))) AS u2 FROM {source})"]
    inner = f"SELECT *, {_MID} FROM (SELECT *, {_ARC} FROM (SELECT *, {_STEP} FROM {out}_{{}}))"
    drop = "e, n, cs, ss, sg, sa, c2, cm, c"
    for i in range(steps):
        more = "sp + (1 - c)/298.257223563*sa*(sg + c*ss*(cm + c*cs*(2*cm*cm - 1)))"
        ctes.append(f"{out}_{i + 1} AS MATERIALIZED (SELECT * EXCLUDE ({drop}, lam), {more} AS lam FROM ({inner.format(i)}))")
    minor = f"(6378137.0*{flat})"
    ctes.append(f"""{out}_u AS (SELECT *, c2*(6378137.0*6378137.0 - {minor}*{minor})/({minor}*{minor}) AS q FROM ({inner.format(steps)}))""")
    big_b = "(q/1024*(256 + q*(-128 + q*(74 - 47*q))))"
    delta = f"({big_b}*ss*(cm + {big_b}/4*(cs*(2*cm*cm - 1) - {big_b}/6*cm*(4*ss*ss - 3)*(4*cm*cm - 3))))"
    ctes.append(f"{out} AS MATERIALIZED (SELECT * EXCLUDE ({drop}, lam, sp, u1, u2, q), {minor}*(1 + q/16384*(4096 + q*(-768 + q*(320 - 175*q))))*(sg - {delta}) AS s, degrees(atan2(e, n)) AS az FROM {out}_u)")
    return ",\n".join(ctes)


def destination(source: str, out: str = "dst", steps: int = 5) -> str:
    """CTEs from ``source`` with lo0, la0, az (degrees), dist (metres) to ``out`` with lo, la: the end of that geodesic."""
    flat = "(1 - 1/298.257223563)"
    minor = f"(6378137.0*{flat})"
    big_a = "(1 + q/16384*(4096 + q*(-768 + q*(320 - 175*q))))"
    big_b = "(q/1024*(256 + q*(-128 + q*(74 - 47*q))))"
    delta = f"({big_b}*sin(sg)*(cos(m1 + sg) + {big_b}/4*(cos(sg)*(2*pow(cos(m1 + sg), 2) - 1) - {big_b}/6*cos(m1 + sg)*(4*pow(sin(sg), 2) - 3)*(4*pow(cos(m1 + sg), 2) - 3))))"
    ctes = [
        f"{out}_a AS (SELECT *, atan({flat}*tan(radians(la0))) AS u1, sin(radians(az)) AS s1, cos(radians(az)) AS c1 FROM {source})",
        f"{out}_b AS (SELECT *, 2*atan2(tan(u1), c1) AS m1, cos(u1)*s1 AS sa, (1 - pow(cos(u1)*s1, 2))*(6378137.0*6378137.0 - {minor}*{minor})/({minor}*{minor}) AS q FROM {out}_a)",
        f"{out}_0 AS (SELECT *, dist/({minor}*{big_a}) AS base, dist/({minor}*{big_a}) AS sg FROM {out}_b)",
    ]
    for i in range(steps):
        ctes.append(f"{out}_{i + 1} AS (SELECT * REPLACE (base + {delta} AS sg) FROM {out}_{i})")
    c = "(1/298.257223563/16*(1 - sa*sa)*(4 + 1/298.257223563*(4 - 3*(1 - sa*sa))))"
    turn = (f"atan2(sin(sg)*s1, cos(u1)*cos(sg) - sin(u1)*sin(sg)*c1) - (1 - {c})/298.257223563*sa*(sg + {c}*sin(sg)*(cos(m1 + sg) + {c}*cos(sg)*(2*pow(cos(m1 + sg), 2) - 1)))")
    ctes.append(f"{out} AS (SELECT * EXCLUDE (u1, s1, c1, m1, sa, q, base, sg), lo0 + degrees({turn}) AS lo, "
                f"degrees(atan2(sin(u1)*cos(sg) + cos(u1)*sin(sg)*c1, {flat}*sqrt(sa*sa + pow(sin(u1)*sin(sg) - cos(u1)*cos(sg)*c1, 2)))) AS la FROM {out}_{steps})")
    return ",\n".join(ctes)
