"""Table sources, contracts and sinks (IO-01 … IO-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwake.functions.geo import missing
from fleetwake.operators import frames



def _schema(**columns) -> T.StructType:
    """A schema without a running session (DDL text needs one)."""
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_TEXT, _LONG, _REAL, _TIME = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()
OBSERVATION_SCHEMA = _schema(platform_id=_TEXT, obs_index=_LONG, time=_TIME, lon=_REAL, lat=_REAL, sst=_REAL)
SIGNAL_SCHEMA = _schema(platform_id=_TEXT, obs_index=_LONG, time=_TIME, ttff=_REAL, strain=_REAL)
DEPLOYMENT_SCHEMA = _schema(
    platform_id=_TEXT, deployment_time=_TEXT, window_start=_TEXT, window_end=_TEXT, provenance=_TEXT, note=_TEXT
)
# Fixed value: serial day number of 1970-01-01.
UNIX_EPOCH_SERIAL_DAY = 719529


def require(df: DataFrame, *columns: str) -> None:
    """Driver-side schema check; runs no job."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}; have {df.columns}")


def read(spark: SparkSession, path, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Parquet, ORC, CSV or JSON with a declared schema (no inference pass over the data)."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def utc(c) -> Column:
    """Timestamps as they are; text that does not parse becomes NULL."""
    return F.try_to_timestamp(c.cast("string"))


def load_observations(df: DataFrame, sentinel: float = -999.0) -> DataFrame:
    """Positions stay as read; optional scalars lose the sentinel; times become UTC or NULL."""
    require(df, "platform_id", "obs_index", "time", "lon", "lat")
    scalars = [c for c in ("sst", "gps_pos_qual", "gps_num_sat") if c in df.columns]
    time = F.col("time") if isinstance(df.schema["time"].dataType, T.TimestampType) else utc(F.col("time"))
    return df.select(
        F.col("platform_id").cast("string").alias("platform_id"),
        F.col("obs_index").cast("long").alias("obs_index"),
        time.alias("time"),
        missing("lon").alias("lon"),
        missing("lat").alias("lat"),
        *[missing(c, sentinel).alias(c) for c in scalars],
    )


def load_signals(df: DataFrame, sentinel: float = -999.0) -> DataFrame:
    require(df, "platform_id", "obs_index", "time", "ttff")
    strain = missing("strain", sentinel) if "strain" in df.columns else F.lit(None).cast("double")
    return df.select(
        F.col("platform_id").cast("string").alias("platform_id"), "obs_index", "time",
        missing("ttff", sentinel).alias("ttff"), strain.alias("strain"),
    )


def serial_day_timestamp(day) -> Column:
    """Serial days to UTC; whole days and the fraction are converted apart."""
    d = missing(day, -999.0)
    whole = F.floor(d)
    offset = whole.cast("long") - F.lit(UNIX_EPOCH_SERIAL_DAY)
    part = F.rint((d - whole) * F.lit(86400e6)).cast("long")
    ok = (d >= UNIX_EPOCH_SERIAL_DAY - 106752) & (d < UNIX_EPOCH_SERIAL_DAY + 106752)
    return F.when(ok, F.timestamp_micros(offset * F.lit(86_400_000_000) + part))


def source_order(df: DataFrame, key="platform_id", index="obs_index", *, width: int = 1_000_000) -> DataFrame:
    """One of ascending / descending / mixed / invalid_times per key."""
    t = F.unix_micros("time")
    stepped = frames.scan(df, key, index, width=width, lag={"prev": t})
    d = t - F.col("prev")
    return stepped.groupBy(*frames.keys(key)).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or(F.col("time").isNull()), F.lit(False)).alias("bad"),
        F.coalesce(F.bool_and(d >= 0), F.lit(True)).alias("up"),
        F.coalesce(F.bool_and(d <= 0), F.lit(True)).alias("down"),
    ).select(
        *frames.keys(key), "n",
        F.when(F.col("bad"), "invalid_times").when(F.col("up"), "ascending")
        .when(F.col("down"), "descending").otherwise("mixed").alias("source_order"),
    )


def identity_violations(df: DataFrame, source: str, key="platform_id", index="obs_index") -> DataFrame:
    """Sources with several platforms, and repeated observation indices, as rows."""
    many = (
        df.groupBy(source).agg(F.countDistinct(key).alias("n")).where("n > 1")
        .select(F.lit("several_platforms_in_source").alias("rule"), F.col(source).cast("string").alias("subject"), "n")
    )
    repeated = (
        df.groupBy(key, index).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("repeated_obs_index").alias("rule"), F.col(key).cast("string").alias("subject"), "n")
    )
    return many.unionByName(repeated)


def axis_length_violations(df: DataFrame, key="platform_id", axis="axis", variable="variable") -> DataFrame:
    """Variables whose length on an axis differs from another variable of the same axis."""
    sizes = df.groupBy(key, axis, variable).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(key, axis).agg(F.min("n").alias("n_min"), F.max("n").alias("n_max")).where("n_min <> n_max")


def strict(violations: DataFrame, message: str) -> None:
    """Raise when a violation table has a row (one small action, on request only)."""
    row = violations.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def _explicit_utc(c: str) -> Column:
    text = F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.when(text.rlike(r"(Z|[+-]00:?00)$"), F.try_to_timestamp(text))


def load_deployments(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deployments, violations). A row has one exact time or a complete increasing window, in UTC."""
    require(df, *DEPLOYMENT_SCHEMA.names)
    names = ("deployment_time", "window_start", "window_end")
    given = {c: F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull() for c in names}
    parsed = df.select(
        F.trim("platform_id").alias("platform_id"),
        *[_explicit_utc(c).alias(c) for c in names],
        *[given[c].alias(f"__{c}") for c in names], "provenance", "note",
    )
    seen = Window.partitionBy("platform_id")
    exact = F.col("__deployment_time")
    window = F.col("__window_start") | F.col("__window_end")
    rule = (
        F.when(F.coalesce(F.col("platform_id"), F.lit("")) == "", "empty_platform")
        .when(F.count(F.lit(1)).over(seen) > 1, "repeated_platform")
        .when(
            (exact & F.col("deployment_time").isNull())
            | (F.col("__window_start") & F.col("window_start").isNull())
            | (F.col("__window_end") & F.col("window_end").isNull()),
            "not_explicit_utc",
        )
        .when(exact == window, "needs_one_exact_time_or_window")
        .when(window & ~F.coalesce(F.col("window_start") < F.col("window_end"), F.lit(False)), "incomplete_window")
    )
    checked = parsed.withColumn("rule", rule)
    keep = ["platform_id", *names, "provenance", "note"]
    return checked.where("rule IS NULL").select(*keep), checked.where("rule IS NOT NULL").select("platform_id", "rule")


def load_product(grid: DataFrame, platforms: DataFrame, product: str) -> DataFrame:
    """Rows of one product with the metadata of their platform (partition-pruned by product)."""
    require(grid, "product", "platform_id", "time", "lon", "lat", "source_gap_min")
    meta = [c for c in platforms.columns if c == "platform_id" or c not in grid.columns]
    return grid.where(F.col("product") == product).join(platforms.select(*meta), "platform_id")


def product_audit(grid: DataFrame) -> DataFrame:
    """Per product: distinct times, cadences, range and finite-mask faults, repeated cells."""
    lon, lat = missing("lon"), missing("lat")
    cells = grid.groupBy("product", "platform_id", "time").agg(F.count(F.lit(1)).alias("copies"))
    repeats = cells.where("copies > 1").groupBy("product").agg(F.count(F.lit(1)).alias("repeated_cells"))
    steps = (
        frames.scan(grid.select("product", "time").distinct(), "product", "time", lag={"prev": F.unix_micros("time")})
        .groupBy("product")
        .agg(
            F.count(F.lit(1)).alias("n_times"),
            F.countDistinct(F.unix_micros("time") - F.col("prev")).alias("n_cadences"),
            F.min((F.unix_micros("time") - F.col("prev")) / F.lit(60e6)).alias("cadence_min"),
        )
    )
    faults = grid.groupBy("product").agg(
        F.count_if(lon.isNull() != lat.isNull()).alias("mask_mismatch"),
        F.count_if((lon < -180) | (lon >= 180)).alias("lon_out_of_range"),
        F.count_if((lat < -90) | (lat > 90)).alias("lat_out_of_range"),
    )
    return steps.join(faults, "product").join(repeats, "product", "left").na.fill(0, ["repeated_cells"])


def write_products(grid: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 1_000_000) -> None:
    """Long rows under ``product=…/array_id=…``, sorted by platform and time inside each file.

    An array is one file up to ``rows_per_file`` and is spread by day over so many files beyond it: files grow
    with the arrays and the rows, not with arrays times days, and no array is one task's alone.
    """
    require(grid, "product", "array_id", "platform_id", "time")
    on = ["product", "array_id"]
    parts = F.ceil(F.count(F.lit(1)) / rows_per_file).cast("long")
    large = grid.groupBy(F.col("product").alias("__p"), F.col("array_id").alias("__a")).agg(parts.alias("__n")).where("__n > 1")
    cut = grid.join(large, F.col("product").eqNullSafe(F.col("__p")) & F.col("array_id").eqNullSafe(F.col("__a")), "left").drop("__p", "__a")
    part = F.when(F.col("__n") > 1, F.pmod(F.xxhash64(F.date_trunc("day", "time")), F.col("__n"))).otherwise(0)
    (
        cut.withColumn("__part", part).repartition(*on, "__part").drop("__n", "__part")
        .sortWithinPartitions("product", "array_id", "platform_id", "time")
        .write.mode(mode).partitionBy("product", "array_id").parquet(path)
    )


def accepted_tracks(
    qc: DataFrame, *, index="obs_index", status="final_status", valid="final_valid", width: int = frames.CHUNK_US
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, native, violations) of a QC table.

    Accepted fixes come from platforms with no unresolved row, at least two accepted fixes and
    no repeated accepted time; ``native`` holds the valid source fixes inside that lifespan.
    """
    require(qc, "platform_id", index, "time", "lon", "lat", status, valid)
    ok = F.coalesce(F.col(valid), F.lit(False))
    good_source = F.col("time").isNotNull() & (F.abs("lon") <= 180) & (F.abs("lat") <= 90)
    per_time = (
        qc.where(ok).groupBy("platform_id", "time").agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("platform_id").agg(F.max("copies").alias("copies"))
    )
    facts = qc.groupBy("platform_id").agg(
        F.count_if(F.col(status).isin("unresolved", "uncertain")).alias("n_open"),
        F.count_if(ok).alias("n_accepted"),
        F.count_if(ok & ~F.coalesce(good_source, F.lit(False))).alias("n_bad"),
        F.min(F.when(ok, F.col("time"))).alias("start"),
        F.max(F.when(ok, F.col("time"))).alias("end"),
    ).join(per_time, "platform_id", "left")
    rule = (
        F.when(F.col("n_open") > 0, "unresolved")
        .when(F.col("n_accepted") < 2, "too_few_accepted")
        .when(F.col("n_bad") > 0, "invalid_accepted")
        .when(F.col("copies") > 1, "duplicate_accepted_time")
    )
    facts = facts.withColumn("rule", rule)
    usable = facts.where("rule IS NULL").select("platform_id", "start", "end")
    joined = qc.join(usable, "platform_id")
    cols = ["platform_id", index, "time", "lon", "lat"]
    accepted = joined.where(ok).select(*cols)
    native = joined.where(good_source & F.col("time").between(F.col("start"), F.col("end"))).select(*cols)
    return accepted, native, facts.where("rule IS NOT NULL").select("platform_id", "rule")


def valid_span(qc: DataFrame, valid="final_valid") -> tuple[DataFrame, DataFrame]:
    """(rows between the first and last valid time, trim counts per platform)."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    span = qc.groupBy("platform_id").agg(
        F.min(F.when(ok, F.col("time"))).alias("__start"),
        F.max(F.when(ok, F.col("time"))).alias("__end"),
        F.count(F.lit(1)).alias("n_source"),
    )
    joined = qc.join(span.drop("n_source"), "platform_id")
    inside = joined.where(F.col("time").between(F.col("__start"), F.col("__end"))).drop("__start", "__end")
    kept = inside.groupBy("platform_id").agg(F.count(F.lit(1)).alias("n_kept"))
    counts = span.join(kept, "platform_id", "left").select(
        "platform_id", "n_source", F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
        (F.col("n_source") - F.coalesce("n_kept", F.lit(0))).alias("n_trimmed"),
        F.col("__start").alias("valid_start"), F.col("__end").alias("valid_end"),
    )
    return inside, counts


def select_ids(df: DataFrame, column: str, wanted, platforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted ids, wanted ids unknown to the platform table)."""
    kind = platforms.schema[column].dataType
    spark = df.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], T.StructType([T.StructField(column, kind)]))
    unknown = asked.join(platforms.select(column).distinct(), column, "left_anti")
    return df.join(asked.distinct(), column, "left_semi"), unknown


def array_view(grid: DataFrame, *, start=None, end=None, reference=None, category: str | None = None) -> DataFrame:
    """Rows of each array in its time window; by default from its first to its last active time.

    Adds ``reference_time`` (window start unless given), ``age_h`` and, with ``category``, the
    platform category column under that name.
    """
    active = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    span = grid.groupBy("array_id").agg(
        F.min(F.when(active, F.col("time"))).alias("__a"), F.max(F.when(active, F.col("time"))).alias("__z")
    )
    a = F.coalesce(F.lit(start).cast("timestamp"), F.col("__a"))
    z = F.coalesce(F.lit(end).cast("timestamp"), F.col("__z"))
    ref = F.coalesce(F.lit(reference).cast("timestamp"), a)
    out = (
        grid.join(span, "array_id")
        .where(F.col("time").between(a, z))
        .withColumn("reference_time", ref)
        .withColumn("age_h", (F.unix_micros("time") - F.unix_micros("reference_time")) / F.lit(3600e6))
    )
    if category:
        out = out.withColumn("category", F.col(category))
    return out.drop("__a", "__z")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by=()) -> None:
    """One table as Parquet, ORC, CSV or JSON; nested evidence becomes JSON text for CSV."""
    if fmt == "csv":
        nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        df.write.mode(mode).option("header", True).csv(path)
        return
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
