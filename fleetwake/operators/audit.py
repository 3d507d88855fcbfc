"""Row-level audits of tracks: intervals, speeds, edges and display helpers (SC rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwake.functions import geo, wgs84
from fleetwake.operators import frames

KEY = "platform_id"
TRACK = ["time", "obs_index"]


def _fix() -> Column:
    return F.struct("time", "lon", "lat", geo.position_valid("lon", "lat").alias("ok"), "obs_index")


def with_previous(df: DataFrame, key=KEY, order=TRACK, *, width: int = frames.CHUNK_US) -> DataFrame:
    """Previous row as struct ``prev`` (time, lon, lat, ok, obs_index) and ``dt_s`` to it."""
    out = frames.scan(df, key, order, width=width, lag={"prev": _fix()})
    return out.withColumn("dt_s", geo.seconds_between("prev.time", "time"))


def with_neighbours(df: DataFrame, key=KEY, order=TRACK, *, width: int = frames.CHUNK_US) -> DataFrame:
    return frames.scan(df, key, order, width=width, lag={"prev": _fix()}, lead={"next": _fix()})


def with_neighbour_vectors(df: DataFrame, key=KEY, order=TRACK, *, width: int = frames.CHUNK_US) -> DataFrame:
    """Neighbours as above, with the unit vectors ``__va``, ``__vb`` and ``__vc`` of the previous, this and the next fix."""
    rows = frames.cut(df.withColumn("__vb", geo.unit_vector(geo.missing("lon"), geo.missing("lat"))))
    vector = F.col("__vb")
    return frames.scan(rows, key, order, width=width, lag={"prev": _fix(), "__va": vector}, lead={"next": _fix(), "__vc": vector})


def consecutive_speed(df: DataFrame, key=KEY, order=TRACK, *, width: int = frames.CHUNK_US) -> DataFrame:
    """Haversine speed on the later row of two adjacent valid rows; nothing is bridged."""
    out = with_previous(df, key, order, width=width)
    usable = geo.position_valid("lon", "lat") & F.col("prev.ok") & (F.col("dt_s") > 0)
    d = F.when(usable, geo.haversine("prev.lon", "prev.lat", "lon", "lat"))
    return out.withColumn("distance_m", d).withColumn("speed", geo.speed_over("distance_m", "dt_s"))


def time_flags(
    df: DataFrame,
    key=KEY,
    order=TRACK,
    *,
    nominal_s: float = 300.0,
    tolerance_s: float = 1.0,
    large_gap_s: float = 1800.0,
    width: int = frames.CHUNK_US,
) -> DataFrame:
    """Invalid, duplicate, off-cadence and large-gap flags; the later row carries an interval."""
    copies = df.where("time IS NOT NULL").groupBy(*frames.keys(key), "time").agg(F.count(F.lit(1)).alias("copies"))
    out = with_previous(df, key, order, width=width).join(
        copies.where("copies > 1"), frames.keys(key) + ["time"], "left"
    )
    dt = F.col("dt_s")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({
        "invalid_time": F.col("time").isNull(),
        "duplicate_time": flag(F.col("copies") > 1),
        "off_cadence": flag(F.abs(dt - nominal_s) > tolerance_s),
        "large_gap": flag(dt > large_gap_s + tolerance_s),
    }).drop("copies")


def edge_metrics(edges: DataFrame, fixes: DataFrame) -> DataFrame:
    """dt, haversine distance and speed of arbitrary (predecessor, current) index pairs."""
    f = fixes.select("platform_id", "obs_index", "time", "lon", "lat")
    a = f.select("platform_id", F.col("obs_index").alias("predecessor"),
                 F.col("time").alias("t0"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    b = f.select("platform_id", F.col("obs_index").alias("current"),
                 F.col("time").alias("t1"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    out = edges.join(a, ["platform_id", "predecessor"]).join(b, ["platform_id", "current"])
    return out.withColumn("dt_s", geo.seconds_between("t0", "t1")).withColumn(
        "distance_m", geo.haversine("lon0", "lat0", "lon1", "lat1")
    ).withColumn("speed", geo.speed_over("distance_m", "dt_s"))


def edge_velocity(df: DataFrame, key=KEY, order=TRACK, *, width: int = frames.CHUNK_US) -> DataFrame:
    """East and north velocity of the edge that ends at each row."""
    out = with_previous(df, key, order, width=width)
    east, north = geo.velocity_between("prev.lon", "prev.lat", "lon", "lat", "dt_s")
    return out.withColumn("v_east", east).withColumn("v_north", north)


def vertex_acceleration(df: DataFrame, key=KEY, order=TRACK, *, width: int = frames.CHUNK_US) -> DataFrame:
    """|v_right - v_left| over the time between the two edge midpoints."""
    out = with_neighbours(df, key, order, width=width)
    dt_l, dt_r = geo.seconds_between("prev.time", "time"), geo.seconds_between("time", "next.time")
    el, nl = geo.velocity_between("prev.lon", "prev.lat", "lon", "lat", dt_l)
    er, nr = geo.velocity_between("lon", "lat", "next.lon", "next.lat", dt_r)
    out = out.withColumns({"dt_left": dt_l, "dt_right": dt_r, "el": el, "nl": nl, "er": er, "nr": nr})
    half = (F.col("dt_left") + F.col("dt_right")) / 2
    size = F.hypot(F.col("er") - F.col("el"), F.col("nr") - F.col("nl"))
    return out.withColumn("acceleration", F.when(half > 0, size / half)).drop("el", "nl", "er", "nr")


def interpolation_residual(df: DataFrame, key=KEY, order=TRACK, *, width: int = frames.CHUNK_US) -> DataFrame:
    out = with_neighbour_vectors(df, key, order, width=width)
    a, b, c = F.unix_micros("prev.time"), F.unix_micros("time"), F.unix_micros("next.time")
    f = F.when((a < b) & (b < c), (b - a) / (c - a))
    arc = geo.interpolation_residual(geo.axes("__va"), geo.axes("__vb"), geo.axes("__vc"), f)
    return out.withColumn("residual_m", arc).drop("__va", "__vb", "__vc")


def turning_angles(df: DataFrame, key=KEY, order=TRACK, *, width: int = frames.CHUNK_US) -> DataFrame:
    out = with_neighbour_vectors(df, key, order, width=width)
    turn = geo.turning_angle(geo.axes("__va"), geo.axes("__vb"), geo.axes("__vc"))
    return out.withColumn("turn_deg", turn).drop("__va", "__vb", "__vc")


def unwrap_longitude(df: DataFrame, key=KEY, order=TRACK, *, width: int = frames.CHUNK_US) -> DataFrame:
    """Continuous longitude: the first value plus the running sum of wrapped steps."""
    lagged = frames.scan(df, key, order, width=width, lag={"__p": F.col("lon")})
    step = F.col("lon") - F.col("__p")
    # A step of exactly +180 keeps its sign, as numpy's unwrap does.
    fold = F.when((geo.wrap_longitude(step) == -180) & (step > 0), 180.0).otherwise(geo.wrap_longitude(step))
    turns = F.coalesce(F.round((fold - step) / 360.0).cast("long"), F.lit(0))
    out = frames.scan(lagged, key, order, width=width, total={"__turns": turns})
    return out.withColumn("lon_unwrapped", F.col("lon") + F.col("__turns") * 360.0).drop("__p", "__turns")


def with_geodesic(df: DataFrame, a=("lon1", "lat1"), b=("lon2", "lat2")) -> DataFrame:
    g = wgs84.with_inverse(df, "__g", a[0], a[1], b[0], b[1])
    return g.withColumns({"distance_m": F.col("__g.s"), "azimuth_deg": F.col("__g.az")}).drop("__g")


def with_destination(df: DataFrame, start=("lon", "lat"), azimuth="azimuth_deg", distance="distance_m") -> DataFrame:
    g = wgs84.with_direct(df, "__g", start[0], start[1], azimuth, distance)
    return g.withColumns({"lon_end": F.col("__g.lon"), "lat_end": F.col("__g.lat")}).drop("__g")


def projection_origins(grid: DataFrame, group="array_id", member="platform_id") -> DataFrame:
    """Origin per group: spherical mean of each member's first valid position."""
    ok = geo.position_valid("lon", "lat")
    first = grid.where(ok).groupBy(group, member).agg(
        F.min_by(F.struct("lon", "lat"), "time").alias("p")
    ).select(group, "p.lon", "p.lat")
    lon0, lat0 = geo.spherical_mean()
    return first.groupBy(group).agg(lon0.alias("lon0"), lat0.alias("lat0"))


def project(grid: DataFrame, origins: DataFrame, group="array_id") -> DataFrame:
    """Azimuthal equidistant plane of each group: x = s·sin(az), y = s·cos(az) from its origin."""
    joined = grid.join(origins, group)
    g = wgs84.with_inverse(joined, "__g", "lon0", "lat0", "lon", "lat")
    a = F.radians("__g.az")
    return g.withColumns({"x_m": F.col("__g.s") * F.sin(a), "y_m": F.col("__g.s") * F.cos(a)}).drop("__g")


def unproject(df: DataFrame, x="x_m", y="y_m") -> DataFrame:
    """Back from the plane; needs ``lon0`` and ``lat0``."""
    az = F.degrees(F.atan2(F.col(x), F.col(y)))
    g = wgs84.with_direct(df, "__g", "lon0", "lat0", az, F.hypot(F.col(x), F.col(y)))
    return g.withColumns({"lon": F.col("__g.lon"), "lat": F.col("__g.lat")}).drop("__g")


def pair_id(p1, p2) -> Column:
    """Order-independent id: hash of the JSON list of the two sorted ids."""
    a, b = geo.col(p1).cast("string"), geo.col(p2).cast("string")
    text = F.to_json(F.array(F.least(a, b), F.greatest(a, b)))
    return F.concat(F.lit("pair_"), F.substring(F.sha2(text, 256), 1, 20))


def sanitize_coordinates(df: DataFrame, lon="lon", lat="lat") -> DataFrame:
    """Null mismatched or out-of-range pairs; keeps the reason for counting."""
    x, y = geo.missing(lon), geo.missing(lat)
    mismatch = x.isNull() != y.isNull()
    outside = F.coalesce((x < -180) | (x >= 180) | (y < -90) | (y > 90), F.lit(False))
    fault = F.when(mismatch, "mask_mismatch").when(outside, "out_of_range")
    out = df.withColumns({"__x": x, "__y": y, "coordinate_fault": fault})
    clear = F.col("coordinate_fault").isNull()
    return out.withColumns({lon: F.when(clear, F.col("__x")), lat: F.when(clear, F.col("__y"))}).drop("__x", "__y")


def sanitize_counts(df: DataFrame, key=KEY, lon="lon") -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(F.col(lon).isNotNull()).alias("finite_pair_rows"),
        F.count_if(F.col("coordinate_fault") == "mask_mismatch").alias("finite_mask_mismatch_rows"),
        F.count_if(F.col("coordinate_fault") == "out_of_range").alias("out_of_range_pair_rows"),
    )


def speed_warnings(speed, high_m_s: float | None, zero_m_s: float | None) -> tuple[Column, Column]:
    v = geo.missing(speed)
    high = F.lit(False) if high_m_s is None else F.coalesce(v > high_m_s, F.lit(False))
    zero = F.lit(False) if zero_m_s is None else F.coalesce(v <= zero_m_s, F.lit(False))
    return high, zero


def split_paths(
    df: DataFrame, key=KEY, order=TRACK, *, max_step: float = 180.0, width: int = frames.CHUNK_US
) -> DataFrame:
    """Contiguous pieces of finite points without a jump across the date line, as long rows.

    Each row keeps its ``path_id``; pieces of one point are dropped. The pieces stay long rows
    so that a piece may be as long as its track.
    """
    finite = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    lagged = frames.scan(df, key, order, width=width, lag={"__p": F.struct("lon", "lat")})
    prev_ok = F.col("__p.lon").isNotNull() & F.col("__p.lat").isNotNull()
    begins = finite & (~F.coalesce(prev_ok, F.lit(False)) | (F.abs(F.col("lon") - F.col("__p.lon")) > max_step))
    runs = frames.islands(lagged.withColumn("__begin", begins).drop("__p"), key, order, F.col("__begin"), width=width, out="path_id")
    kept = runs.where(finite).drop("__begin")
    k = frames.keys(key) + ["path_id"]
    sizes = kept.groupBy(*k).agg(F.count(F.lit(1)).alias("path_points")).where("path_points >= 2")
    return kept.join(sizes, k)


def display_sample(df: DataFrame, maximum: int, identity: str, key: list[str]) -> DataFrame:
    """At most ``maximum`` rows, the same ones at any partitioning: top-k by a keyed MD5."""
    h = F.md5(F.concat_ws("|", F.lit(identity), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    return df.withColumn("__h", h).orderBy("__h", *key).limit(maximum).drop("__h")
