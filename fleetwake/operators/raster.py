"""Gridded background fields as long rows (RA rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Water bit, and the land, lake and ice bits of the mask.
WATER_BIT = 1
OTHER_BITS = 30
KELVIN = 273.15


def quality_mask(raster: DataFrame, start, end, max_error: float | None = None) -> DataFrame:
    """Celsius where the water bit alone is set and the error is small; every day of the span kept.

    ``raster``: day, lat, lon, value_k, mask, error. A missing day becomes one row per cell with NULL.
    """
    m = F.coalesce(F.col("mask"), F.lit(0))
    good = F.col("value_k").isNotNull() & F.col("mask").isNotNull() & (m.bitwiseAND(WATER_BIT) != 0) & (m.bitwiseAND(OTHER_BITS) == 0)
    if max_error is not None:
        good = good & F.coalesce(F.col("error") <= max_error, F.lit(False))
    rows = raster.select("day", "lat", "lon", F.when(good, F.col("value_k") - KELVIN).alias("sst_c"), good.alias("valid"), F.lit(True).alias("source_present"))
    days = raster.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    gone = days.join(raster.select("day").distinct(), "day", "left_anti")
    # The missing days are part of the asked span (a few bytes a day); the cells stay where they are.
    blank = raster.select("lat", "lon").distinct().crossJoin(F.broadcast(gone)).select("day", "lat", "lon").withColumns({
        "sst_c": F.lit(None).cast("double"), "valid": F.lit(False), "source_present": F.lit(False)})
    return rows.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).unionByName(blank)


def composite(bins: DataFrame, window_h: float, bin_h: float, bbox=None, key="window_start") -> tuple[DataFrame, DataFrame]:
    """(equal-weight mean, bins, coverage and summed observations per window and cell, violations).

    ``bins``: time (start of a bin), lat, lon, value, observation_count. A bin must lie inside one window.
    """
    step, width = round(window_h * 3600e6), round(bin_h * 3600e6)
    t = F.unix_micros("time")
    w = F.floor(t / step).cast("long") * step
    b = bins.withColumn("__w", w)
    crossing = (t + width) > F.col("__w") + step
    odd = F.coalesce((F.col("observation_count") < 0) | (F.col("observation_count") != F.floor("observation_count")), F.lit(False))
    bad = b.agg(F.count_if(crossing).alias("bins_crossing_a_window"), F.count_if(odd).alias("odd_observation_counts"))
    b = b.where(~crossing)
    if bbox is not None:
        west, east, south, north = bbox
        b = b.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    out = b.groupBy(F.timestamp_micros("__w").alias(key), "lat", "lon").agg(
        F.avg(v).alias("value"), F.count(v).alias("contributing_bins"), F.sum(F.when(v.isNotNull(), F.coalesce("observation_count", F.lit(0)))).alias("observations"))
    return out.withColumn("coverage_fraction", F.col("contributing_bins") / F.lit(window_h / bin_h)).na.fill(0, ["observations"]), bad
