"""Change points in sensor signals of each platform (DR rows).

All platforms are worked at once. Raw samples are reduced to time bins first (map-side partial
counts); everything after that works on tables whose size follows the record length, not the
number of samples.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.functions import geo
from fleetwake.operators import frames

HOUR_US = 3_600_000_000
KEY = "platform_id"


@dataclass(frozen=True)
class TtffConfig:
    # Fixed default values.
    scale: str = "log"
    first_edge: float = 10.0
    last_edge: float = 1000.0
    factor: float = 1.5
    width: float | None = None
    include_lower: bool = True
    time_bin_h: float = 12.0
    rolling_h: float = 48.0
    pre_h: float = 168.0
    min_pre_events: int = 12
    min_pre_occupied: int = 3
    min_coverage: float = 0.75
    quiet_fraction: float = 0.10
    max_quiet_events: int = 1
    persistence_h: float = 120.0
    reactivation_h: float = 48.0
    agreement_h: float = 48.0
    min_agreeing: int = 2

    @property
    def cadence_us(self) -> int:
        return round(self.time_bin_h * HOUR_US)

    def steps(self, hours: float) -> int:
        n = hours / self.time_bin_h
        if abs(n - round(n)) > 1e-9:
            raise ValueError(f"{hours} h is not a multiple of the {self.time_bin_h} h time bin")
        return round(n)


@dataclass(frozen=True)
class StrainConfig:
    # Fixed default values.
    block_h: float = 6.0
    min_samples: int = 3
    min_side_h: float = 72.0
    min_drop: float = 2.0
    min_drop_relative: float = 0.08
    min_improvement: float = 0.10
    relative_floor: float = 1.0
    comparable_fraction: float = 0.02
    separation_h: float = 48.0


@dataclass(frozen=True)
class LossConfig:
    ttff: TtffConfig = field(default_factory=TtffConfig)
    strain: StrainConfig = field(default_factory=StrainConfig)
    agreement_h: float = 48.0


@dataclass(frozen=True)
class ValueBins:
    edges: tuple[float, ...]
    include_lower: bool
    labels: tuple[str, ...]

    def index(self, value) -> Column:
        """Left-closed bin number; NULL below the first edge when there is no lower bin."""
        v = geo.col(value)
        below = sum((F.when(v >= e, 1).otherwise(0) for e in self.edges), F.lit(0))
        at = below if self.include_lower else below - 1
        return F.when(v.isNotNull() & (at >= 0), at).cast("int")


def value_bins(cfg: TtffConfig = TtffConfig()) -> ValueBins:
    """Increasing edges, logarithmic or linear, and labels with the open outer bins."""
    if cfg.scale == "log":
        edges, at = [], float(cfg.first_edge)
        while at < cfg.last_edge * (1 - 1e-12) and not np.isclose(at, cfg.last_edge):
            edges.append(at)
            at *= cfg.factor
    else:
        n = int(np.floor((cfg.last_edge - cfg.first_edge) / cfg.width))
        edges = [cfg.first_edge + i * cfg.width for i in range(n + 1)]
        edges = [e for e in edges if e < cfg.last_edge * (1 - 1e-12)]
    edges.append(float(cfg.last_edge))
    if cfg.scale == "log" and cfg.include_lower:
        edges.insert(0, 0.0)
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("binning does not give increasing edges")
    labels = [f"<{edges[0]:g}"] if cfg.include_lower else []
    labels += [f"[{a:g}, {b:g})" for a, b in zip(edges, edges[1:])]
    return ValueBins(tuple(edges), cfg.include_lower, (*labels, f">={edges[-1]:g}"))


def histogram_counts(df: DataFrame, value, bins: ValueBins, key=KEY, sentinel: float | None = -999.0) -> DataFrame:
    v = geo.missing(value, sentinel)
    return (
        df.select(*frames.keys(key), bins.index(v).alias("bin")).where("bin IS NOT NULL")
        .groupBy(*frames.keys(key), "bin").agg(F.count(F.lit(1)).alias("n"))
    )


def nominal_interval(times: DataFrame, cadence_us: int, key=KEY) -> DataFrame:
    """min(median spacing of distinct times, cadence) in microseconds; 0 without a spacing."""
    distinct = times.select(*frames.keys(key), "time").distinct()
    stepped = frames.scan(distinct, key, "time", lag={"__p": F.unix_micros("time")})
    q = frames.quantiles(
        stepped, key, {"dt": F.unix_micros("time") - F.col("__p")}, {"p50": 0.5}
    )
    out = distinct.select(*frames.keys(key)).distinct().join(q, frames.keys(key), "left")
    med = F.floor(F.col("dt_p50")).cast("long")
    return out.select(*frames.keys(key), F.coalesce(F.least(med, F.lit(cadence_us)), F.lit(0)).alias("nominal_us"))


def coverage(times: DataFrame, nominal: DataFrame, cadence_us: int, key=KEY) -> DataFrame:
    """Hours of each time bin covered by intervals of the nominal width around its samples."""
    key = frames.keys(key)
    t = F.unix_micros("time")
    half = F.floor(F.col("nominal_us") / 2).cast("long")
    start = F.col("bin_us")
    rows = (
        times.select(*key, "time").distinct().join(nominal, key)
        .withColumn("bin_us", F.floor(t / cadence_us).cast("long") * cadence_us)
        .withColumn("l", F.greatest(start, t - half))
        .withColumn("r", F.least(start + cadence_us, t + F.col("nominal_us") - half))
    )
    w = Window.partitionBy(*key, "bin_us").orderBy("time")
    fresh = F.col("r") - F.greatest(F.col("l"), F.coalesce(F.lag("r").over(w), F.col("l")))
    return rows.select(*key, "bin_us", F.greatest(F.lit(0), fresh).alias("d")).groupBy(*key, "bin_us").agg(
        (F.sum("d") / F.lit(float(HOUR_US))).alias("coverage_h")
    )


def event_counts(signals: DataFrame, cfg: TtffConfig = TtffConfig(), value="ttff") -> tuple[DataFrame, DataFrame]:
    """(dense time bins × value bins, per-platform record table).

    Time bins are aligned to the epoch and run from the first to the last valid timestamp.
    ``forward_*`` columns sum the ``rolling_h`` that start with a bin.
    """
    bins = value_bins(cfg)
    cad = cfg.cadence_us
    timed = signals.where("time IS NOT NULL").withColumn("__v", geo.missing(value, -999.0))
    t = F.unix_micros("time")
    seen = timed.where("__v IS NOT NULL")
    nominal = frames.cut(nominal_interval(seen, cad))
    record = (
        timed.groupBy(KEY).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("__v").alias("n_values"))
        .join(nominal, KEY, "left").na.fill(0, ["nominal_us"])
        .withColumn("record_end_us", F.col("t1") + F.col("nominal_us"))
    )
    at = F.floor(t / cad).cast("long") * cad
    counts = (
        seen.select(KEY, at.alias("bin_us"), bins.index("__v").alias("bin")).where("bin IS NOT NULL")
        .groupBy(KEY, "bin_us", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    valid = seen.groupBy(KEY, at.alias("bin_us")).agg(F.count(F.lit(1)).alias("n_valid"))
    cover = coverage(seen, nominal, cad)
    first, final = (F.floor(F.col(c) / cad).cast("long") * cad for c in ("t0", "t1"))
    scaffold = record.select(KEY, "record_end_us", F.explode(F.sequence(first, final, F.lit(cad))).alias("bin_us"))
    scaffold = scaffold.join(valid, [KEY, "bin_us"], "left").join(cover, [KEY, "bin_us"], "left").na.fill(0, ["n_valid", "coverage_h"])
    labels = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(s).alias("label")) for i, s in enumerate(bins.labels)])
    dense = scaffold.withColumn("__b", F.explode(labels)).select(
        KEY, "record_end_us", "bin_us", "n_valid", "coverage_h", "__b.bin", "__b.label"
    ).join(counts, [KEY, "bin_us", "bin"], "left").na.fill(0, ["n"])
    roll = cfg.steps(cfg.rolling_h)
    ahead = Window.partitionBy(KEY, "bin").orderBy("bin_us").rowsBetween(0, roll - 1)
    dense = dense.withColumns({
        "coverage_fraction": F.least(F.lit(1.0), F.col("coverage_h") / cfg.time_bin_h),
        "coverage_adequate": F.col("coverage_h") / cfg.time_bin_h >= cfg.min_coverage,
        "forward_events": F.sum("n").over(ahead),
        "forward_coverage_h": F.sum("coverage_h").over(ahead),
    })
    return dense.withColumns({
        "forward_fraction": F.least(F.lit(1.0), F.col("forward_coverage_h") / cfg.rolling_h),
        "forward_complete": F.col("record_end_us") >= F.col("bin_us") + roll * cad,
    }), record


def loud(events: Column, hours: Column, pre_rate: Column, cfg: TtffConfig) -> Column:
    """The opposite of quiet: more events than tolerated and a rate above the quiet share."""
    above = F.when(hours > 0, events / hours > cfg.quiet_fraction * pre_rate).otherwise(True)
    return (events > cfg.max_quiet_events) & above


def stable_drops(dense: DataFrame, cfg: TtffConfig = TtffConfig()) -> DataFrame:
    """Latest stable drop of every platform and value bin, or the reason there is none."""
    cad = cfg.cadence_us
    roll, pre, keep, back = (cfg.steps(h) for h in (cfg.rolling_h, cfg.pre_h, cfg.persistence_h, cfg.reactivation_h))
    w = Window.partitionBy(KEY, "bin").orderBy("bin_us")

    def window(name: str, lo: int, hi: int, hours: float) -> dict:
        f = w.rowsBetween(lo, hi)
        h = F.coalesce(F.sum("coverage_h").over(f), F.lit(0.0))
        return {
            f"{name}_events": F.coalesce(F.sum("n").over(f), F.lit(0)),
            f"{name}_h": h,
            f"{name}_fraction": F.least(F.lit(1.0), h / hours),
        }

    rows = dense.withColumns({
        "k": F.row_number().over(w),
        **window("pre", -pre, -1, cfg.pre_h),
        **window("last", -1, roll - 2, cfg.rolling_h),
        **window("post", 0, roll - 1, cfg.rolling_h),
        **window("back", 0, back - 1, cfg.reactivation_h),
        "pre_occupied": F.coalesce(F.sum((F.col("n") > 0).cast("int")).over(w.rowsBetween(-pre, -1)), F.lit(0)),
    })
    rows = rows.withColumn("pre_rate", F.when(F.col("pre_h") > 0, F.col("pre_events") / F.col("pre_h")))
    checked = (F.col("back_fraction") >= cfg.min_coverage) & (F.col("bin_us") + back * cad <= F.col("record_end_us"))
    later = w.rowsBetween(keep, Window.unboundedFollowing)
    back_rate = F.when(F.col("back_h") > 0, F.col("back_events") / F.col("back_h"))
    rows = rows.withColumns({
        "windows": F.collect_list(
            F.struct(F.col("post_events").alias("e"), F.col("post_h").alias("h"), F.col("post_fraction").alias("f"))
        ).over(w.rowsBetween(0, keep - roll)),
        "later_rate": F.max(F.when(checked & (F.col("back_events") > cfg.max_quiet_events), back_rate)).over(later),
        "later_end": F.max(F.when(checked, F.col("bin_us") + back * cad)).over(later),
    })
    rate = F.col("pre_rate")
    eligible = (
        (F.col("k") > 1) & (F.col("pre_events") >= cfg.min_pre_events)
        & (F.col("pre_occupied") >= cfg.min_pre_occupied) & (F.col("pre_fraction") >= cfg.min_coverage)
    )
    thin = lambda x: x["f"] < cfg.min_coverage
    noisy = lambda x: loud(x["e"], x["h"], rate, cfg)
    failing = F.element_at(F.filter("windows", lambda x: thin(x) | noisy(x)), 1)
    end = F.col("bin_us") + keep * cad
    verdict = (
        F.when(~eligible, "ineligible")
        .when((F.col("last_fraction") < cfg.min_coverage) | ~loud(F.col("last_events"), F.col("last_h"), rate, cfg), "skip")
        .when(F.col("post_fraction") < cfg.min_coverage, F.when(F.col("post_events") <= cfg.max_quiet_events, "incomplete").otherwise("skip"))
        .when(loud(F.col("post_events"), F.col("post_h"), rate, cfg), "skip")
        .when(F.col("record_end_us") < end, "incomplete")
        .when(F.exists("windows", lambda x: thin(x) | noisy(x)), F.when(failing["f"] < cfg.min_coverage, "incomplete").otherwise("skip"))
        .when(F.coalesce(F.col("later_rate") > cfg.quiet_fraction * rate, F.lit(False)), "reactivated")
        .otherwise("selected")
    )
    rows = rows.withColumn("verdict", verdict)
    picked = Window.partitionBy(KEY, "bin")
    rows = rows.withColumn("chosen_us", F.max(F.when(F.col("verdict") == "selected", F.col("bin_us"))).over(picked))
    examined = F.col("chosen_us").isNull() | (F.col("bin_us") >= F.col("chosen_us"))
    named = lambda *v: F.coalesce(F.bool_or(F.col("verdict").isin(*v)), F.lit(False))
    shown = F.when(F.col("verdict") == "selected", 2).when(F.col("verdict").isin("incomplete", "reactivated"), 1)
    evidence = F.struct(
        "pre_events", "pre_occupied", "post_events", "pre_rate", "pre_fraction", "post_fraction",
        F.when(F.col("verdict") == "selected", F.array_min(F.transform("windows", lambda x: x["f"]))).alias("persistence_min_fraction"),
        F.when(F.col("verdict") == "selected", F.coalesce(F.col("later_end"), end)).alias("confirmed_us"),
    )
    per_bin = rows.where(examined).groupBy(KEY, "bin").agg(
        F.first("label").alias("label"),
        F.first("chosen_us").alias("drop_us"),
        named("skip", "incomplete", "reactivated", "selected").alias("eligible"),
        named("incomplete").alias("__inc"),
        named("reactivated").alias("late_reactivation"),
        F.max_by(evidence, F.when(shown.isNotNull(), F.struct(shown, F.col("bin_us")))).alias("e"),
    )
    status = (
        F.when(F.col("drop_us").isNotNull(), "stable_drop").when(F.col("__inc"), "insufficient_followup")
        .when(F.col("late_reactivation"), "reactivated").when(F.col("eligible"), "no_stable_drop")
        .otherwise("insufficient_pre_activity")
    )
    return per_bin.select(KEY, "bin", "label", status.alias("status"), "eligible", "drop_us", "late_reactivation", "e.*")


def date_groups(drops: DataFrame, tolerance_us: int) -> DataFrame:
    """Maximal groups of drop dates within the tolerance, one row per group.

    A platform has at most one drop per value bin, so its rows here are bounded by the bin table.
    """
    at = drops.where("drop_us IS NOT NULL").groupBy(KEY, "drop_us").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(KEY).orderBy("drop_us")
    ahead = w.rangeBetween(0, tolerance_us)
    rows = at.withColumns({"size": F.sum("n").over(ahead), "right_us": F.max("drop_us").over(ahead)})
    rows = rows.withColumn("__r", F.lag("right_us").over(w)).where(F.col("__r").isNull() | (F.col("right_us") > F.col("__r")))
    return rows.select(KEY, F.col("drop_us").alias("left_us"), "right_us", "size")


def ttff_cessation(signals: DataFrame, cfg: TtffConfig = TtffConfig(), value="ttff") -> tuple[DataFrame, DataFrame]:
    """(per-platform detection, per-bin results with the consensus flag)."""
    dense, record = event_counts(signals, cfg, value)
    # One row per platform and value bin from here on; read five times below.
    drops, record = frames.cut(stable_drops(dense, cfg)), frames.cut(record)
    groups = date_groups(drops, round(cfg.agreement_h * HOUR_US))
    stable = drops.where("status = 'stable_drop'")
    members = stable.join(groups, KEY).where(F.col("drop_us").between(F.col("left_us"), F.col("right_us")))
    described = members.groupBy(KEY, "left_us", "right_us", "size").agg(
        F.floor(F.percentile("drop_us", F.lit(0.5))).cast("long").alias("change_us"),
        F.min("confirmed_us").alias("confirmed_us"),
        F.sum("pre_events").alias("agreeing_pre_events"), F.sum("post_events").alias("agreeing_post_events"),
        F.min("persistence_min_fraction").alias("min_persistence_fraction"),
    )
    best = Window.partitionBy(KEY).orderBy(F.desc("size"), F.desc("change_us"), F.desc("left_us"))
    ranked = described.withColumns({
        "r": F.row_number().over(best),
        "__l": F.first("left_us").over(best), "__h": F.first("right_us").over(best),
    })
    rival = (F.col("r") > 1) & (F.col("size") >= cfg.min_agreeing) & ((F.col("right_us") < F.col("__l")) | (F.col("left_us") > F.col("__h")))
    winner = ranked.groupBy(KEY).agg(
        F.bool_or(rival).alias("rival"),
        F.max(F.when(F.col("r") == 1, F.struct(
            "left_us", "right_us", "size", "change_us", "confirmed_us", "agreeing_pre_events", "agreeing_post_events",
            "min_persistence_fraction"))).alias("g"),
    ).select(KEY, "rival", "g.*")
    bins = drops.groupBy(KEY).agg(
        F.count_if("eligible").alias("eligible_bins"),
        F.count_if(F.col("status") == "stable_drop").alias("stable_bins"),
        F.bool_or(F.col("status") == "insufficient_followup").alias("__inc"),
    )
    status = (
        F.when(F.col("n_values") == 0, "unavailable")
        .when((F.col("stable_bins") == 0) & F.col("__inc"), "insufficient_followup")
        .when((F.col("stable_bins") == 0) & (F.col("eligible_bins") == 0), "insufficient_data")
        .when(F.col("stable_bins") == 0, "none")
        .when((F.col("size") >= cfg.min_agreeing) & ~F.col("rival"), "clear")
        .when(F.col("stable_bins") == 1, "weak").otherwise("ambiguous")
    )
    out = record.select(KEY, "n_values").join(bins, KEY, "left").join(winner, KEY, "left").select(
        KEY, status.alias("status"), "change_us",
        F.coalesce("eligible_bins", F.lit(0)).alias("eligible_bins"),
        F.coalesce("stable_bins", F.lit(0)).alias("stable_bins"),
        F.coalesce("size", F.lit(0)).alias("agreeing_bins"),
        ((F.col("right_us") - F.col("left_us")) / F.lit(float(HOUR_US))).alias("span_h"),
        F.coalesce("agreeing_pre_events", F.lit(0)).alias("agreeing_pre_events"),
        F.coalesce("agreeing_post_events", F.lit(0)).alias("agreeing_post_events"),
        "min_persistence_fraction", "confirmed_us",
    )
    flagged = drops.join(winner.select(KEY, "left_us", "right_us"), KEY, "left").withColumn(
        "in_consensus",
        F.coalesce((F.col("status") == "stable_drop") & F.col("drop_us").between(F.col("left_us"), F.col("right_us")), F.lit(False)),
    ).drop("left_us", "right_us")
    return out, flagged


def strain_blocks(signals: DataFrame, cfg: StrainConfig = StrainConfig(), value="strain") -> DataFrame:
    """Epoch-aligned blocks from the first to the last valid sample; median NULL below the minimum."""
    size = round(cfg.block_h * HOUR_US)
    ok = signals.withColumn("__v", geo.missing(value, -999.0)).where("time IS NOT NULL AND __v IS NOT NULL")
    at = F.floor(F.unix_micros("time") / size).cast("long") * size
    filled = ok.groupBy(KEY, at.alias("block_us")).agg(
        F.count(F.lit(1)).alias("n_valid"), F.median("__v").alias("m")
    ).withColumn("m", F.when(F.col("n_valid") >= cfg.min_samples, F.col("m")))
    span = filled.groupBy(KEY).agg(F.min("block_us").alias("a"), F.max("block_us").alias("z"))
    scaffold = span.select(KEY, F.explode(F.sequence("a", "z", F.lit(size))).alias("block_us"))
    return scaffold.join(filled, [KEY, "block_us"], "left").select(
        KEY, "block_us", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.col("m").alias("median")
    )


class _RunningMedian:
    """Median and summed absolute deviation of a growing sample (two heaps)."""

    def __init__(self):
        self.low, self.high, self.low_sum, self.high_sum = [], [], 0.0, 0.0

    def push(self, x: float) -> tuple[float, float]:
        if self.low and x > -self.low[0]:
            heapq.heappush(self.high, x)
            self.high_sum += x
        else:
            heapq.heappush(self.low, -x)
            self.low_sum += x
        if len(self.low) > len(self.high) + 1:
            moved = -heapq.heappop(self.low)
            heapq.heappush(self.high, moved)
            self.low_sum -= moved
            self.high_sum += moved
        elif len(self.high) > len(self.low):
            moved = heapq.heappop(self.high)
            heapq.heappush(self.low, -moved)
            self.high_sum -= moved
            self.low_sum += moved
        even = len(self.low) == len(self.high)
        med = (self.high[0] - self.low[0]) / 2 if even else -self.low[0]
        return med, self.high_sum - med * len(self.high) + med * len(self.low) - self.low_sum


SPLIT_SCHEMA = (
    "platform_id string, n_blocks long, split long, block_us long, level_before double, level_after double, "
    "cost double, cost_null double"
)


def strain_splits(blocks: DataFrame, cfg: StrainConfig = StrainConfig()) -> DataFrame:
    """L1 cost of every admissible split of a platform's block medians.

    The group is the block table of one platform (four rows per day of record), many platforms to a call. Two running
    medians give all splits in one pass each way instead of a splits × blocks join.
    """
    side = int(np.ceil(cfg.min_side_h / cfg.block_h))

    def score(part: pd.DataFrame) -> dict:
        x, at, n = part["median"].to_numpy(float), part["block_us"].to_numpy(), len(part)
        ahead, behind = _RunningMedian(), _RunningMedian()
        fwd = [ahead.push(v) for v in x]
        bwd = [behind.push(v) for v in x[::-1]][::-1]
        s = np.arange(side, n - side + 1) if n >= 2 * side else np.array([], int)
        if len(s):
            out = {
                "split": s, "block_us": at[s], "level_before": np.array([fwd[i - 1][0] for i in s]), "level_after": np.array([bwd[i][0] for i in s]),
                "cost": np.array([fwd[i - 1][1] + bwd[i][1] for i in s]),
            }
        else:
            out = {"split": np.array([-1]), **{c: np.array([None]) for c in ("block_us", "level_before", "level_after", "cost")}}
        size = len(out["split"])
        return {**out, "n_blocks": np.full(size, n), "cost_null": np.full(size, fwd[-1][1])}

    # The change point reads the splits five times.
    return frames.cut(frames.in_lots(blocks.where("median IS NOT NULL"), KEY, "block_us", score, SPLIT_SCHEMA))


def strain_change(signals: DataFrame, cfg: StrainConfig = StrainConfig(), value="strain") -> DataFrame:
    """Robust downward change point per platform with status clear / weak / ambiguous / no_change."""
    splits = strain_splits(strain_blocks(signals, cfg, value), cfg)
    platforms = signals.select(KEY).distinct()
    drop = F.col("level_before") - F.col("level_after")
    real = splits.where("split >= 0").withColumns({
        "drop": drop, "relative": drop / F.greatest(F.abs("level_before"), F.lit(cfg.relative_floor)),
    })
    down = real.where("drop > 0")
    # Equal costs go to the earliest split; costs equal to 1e-9 count as equal.
    best = down.withColumn("__r", F.round("cost", 9)).groupBy(KEY).agg(
        F.min_by(F.struct("split", "block_us", "level_before", "level_after", "drop", "relative", "cost", "cost_null", "n_blocks"),
                 F.struct("__r", "split")).alias("b")
    )
    tol = F.greatest(F.lit(float(np.finfo(float).eps)), F.col("b.cost") * cfg.comparable_fraction)
    rivals = down.join(best, KEY).where(
        (F.abs(F.col("block_us") - F.col("b.block_us")) >= round(cfg.separation_h * HOUR_US))
        & (F.col("cost") <= F.col("b.cost") + tol)
    ).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rivals"),
        F.min_by("block_us", F.struct(F.round("cost", 9), F.col("block_us"))).alias("rival_us"),
    )
    tallies = splits.groupBy(KEY).agg(
        F.max("n_blocks").alias("n_blocks"), F.max("cost_null").alias("cost_null"), F.bool_or(F.col("split") >= 0).alias("enough"),
    )
    out = platforms.join(tallies, KEY, "left").join(best, KEY, "left").join(rivals, KEY, "left")
    gain = F.when(F.col("b.cost_null") > float(np.finfo(float).eps), (F.col("b.cost_null") - F.col("b.cost")) / F.col("b.cost_null")).otherwise(0.0)
    out = out.withColumn("improvement", F.when(F.col("b").isNotNull(), gain))
    better = F.col("improvement") >= cfg.min_improvement
    big, rel = F.col("b.drop") >= cfg.min_drop, F.col("b.relative") >= cfg.min_drop_relative
    useful = better & (big | rel)
    status = (
        F.when(~F.coalesce("enough", F.lit(False)), "insufficient_data").when(F.col("b").isNull(), "no_change")
        .when(useful & (F.col("n_rivals") > 0), "ambiguous").when(better & big & rel, "clear")
        .when(useful, "weak").otherwise("no_change")
    )
    out = out.withColumn("status", status)
    return out.select(
        KEY, "status", F.when(F.col("status").isin("clear", "weak"), F.col("b.block_us")).alias("change_us"),
        F.col("b.block_us").alias("candidate_us"), "b.level_before", "b.level_after", F.col("b.drop").alias("absolute_drop"),
        F.col("b.relative").alias("relative_drop"), F.when(F.col("enough"), F.col("cost_null")).alias("cost_null"),
        F.col("b.cost").alias("cost"), "improvement",
        F.coalesce("b.split", F.lit(0)).alias("n_before"), (F.coalesce(F.col("b.n_blocks") - F.col("b.split"), F.lit(0))).alias("n_after"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("n_rivals", F.lit(0)).alias("n_rivals"), "rival_us",
    )


def combine(both: DataFrame, agreement_h: float = 48.0) -> DataFrame:
    """Needs ``ttff_status, ttff_us, strain_status, strain_us``; adds ``auto_*`` columns."""
    t_clear, s_clear = F.col("ttff_status") == "clear", F.col("strain_status") == "clear"
    quiet = ("no_change", "insufficient_data")
    near = F.abs(F.col("strain_us") - F.col("ttff_us")) <= agreement_h * HOUR_US
    case = (
        F.when(t_clear & s_clear & near, "clear_agreement").when(t_clear & s_clear, "signal_conflict")
        .when(t_clear & F.col("strain_status").isin(*quiet), "clear_ttff_only")
        .when(s_clear & F.col("ttff_status").isin(*quiet), "clear_strain_only").otherwise("unresolved")
    )
    out = both.withColumn("auto_status", case)
    s = F.col("auto_status")
    return out.withColumns({
        "auto_loss_us": F.when(s == "clear_agreement", F.least("ttff_us", "strain_us"))
        .when(s == "clear_ttff_only", F.col("ttff_us")).when(s == "clear_strain_only", F.col("strain_us")),
        "auto_source": F.when(s == "clear_agreement", "ttff+strain").when(s == "clear_ttff_only", "ttff")
        .when(s == "clear_strain_only", "strain").otherwise("none"),
    })


def detect_loss(signals: DataFrame, cfg: LossConfig = LossConfig()) -> DataFrame:
    """Both detectors and their combination for every platform with a valid timestamp."""
    timed = signals.where("time IS NOT NULL")
    ttff, _ = ttff_cessation(timed, cfg.ttff)
    detail = F.col("status")
    shown = F.when(detail.isin("clear", "weak", "ambiguous"), detail).when(detail == "none", "no_change").otherwise("insufficient_data")
    t = ttff.select(
        KEY, shown.alias("ttff_status"), detail.alias("ttff_detail"),
        F.when(detail.isin("clear", "weak"), F.col("change_us")).alias("ttff_us"),
        "eligible_bins", "stable_bins", "agreeing_bins", "span_h", "agreeing_pre_events", "agreeing_post_events", "min_persistence_fraction",
    )
    s = strain_change(timed, cfg.strain).select(
        KEY, F.col("status").alias("strain_status"), F.col("change_us").alias("strain_us"), "level_before", "level_after",
        "absolute_drop", "relative_drop", "improvement", "n_before", "n_after", "n_blocks",
    )
    out = combine(t.join(s, KEY), cfg.agreement_h)
    return out.withColumn("offset_h", (F.col("strain_us") - F.col("ttff_us")) / F.lit(float(HOUR_US)))


def cutoff(loss, margin_h) -> Column:
    """Analysis cutoff: the loss less the margin in hours."""
    return F.timestamp_micros(F.unix_micros(geo.col(loss)) - F.round(margin_h * F.lit(float(HOUR_US))).cast("long"))


def resolve_loss(automatic: DataFrame, reviews: DataFrame, default_margin_h: float = 24.0) -> DataFrame:
    """Effective state: a review (accepted_auto, manual_date, not_lost, uncertain) wins over the detector.

    ``automatic``: platform_id, auto_loss TIMESTAMP. ``reviews``: platform_id, review_status,
    reviewed_loss TIMESTAMP, margin_h DOUBLE.
    """
    j = automatic.select(KEY, "auto_loss").join(reviews.select(KEY, "review_status", "reviewed_loss", "margin_h"), KEY, "left")
    reviewed = F.col("review_status").isNotNull()
    dated = F.col("review_status").isin("accepted_auto", "manual_date")
    loss = F.when(reviewed, F.when(dated, F.col("reviewed_loss"))).otherwise(F.col("auto_loss"))
    bad = reviewed & (
        ~F.col("review_status").isin("accepted_auto", "manual_date", "not_lost", "uncertain")
        | (dated & F.col("reviewed_loss").isNull()) | (F.col("margin_h") < 0)
    )
    out = j.withColumns({
        "loss_time": loss,
        "margin": F.when(reviewed, F.coalesce("margin_h", F.lit(default_margin_h))).otherwise(F.lit(float(default_margin_h))),
    })
    status = F.when(F.coalesce(bad, F.lit(False)), "invalid_review").when(F.col("loss_time").isNotNull(), "lost").when(reviewed & ~dated, F.col("review_status")).otherwise("uncertain")
    return out.select(
        KEY, status.alias("status"), "loss_time", F.col("margin").alias("margin_h"),
        cutoff("loss_time", F.col("margin")).alias("cutoff"),
        F.when(reviewed, F.col("review_status")).otherwise("automatic").alias("source"),
    )


def drogue_valid(time, decision, cutoff_time) -> Column:
    """retained → every valid time; lost → strictly before the cutoff; unknown → none."""
    t = geo.col(time)
    d = geo.col(decision)
    return F.coalesce(
        F.when(d == "retained", t.isNotNull()).when(d == "lost", t < geo.col(cutoff_time)).otherwise(False), F.lit(False)
    )


# Statuses that need no review.
RESOLVED_STATUSES = ("clear_agreement", "clear_ttff_only", "clear_strain_only")


def review_queue(automatic: DataFrame) -> DataFrame:
    return automatic.where(~F.col("auto_status").isin(*RESOLVED_STATUSES) | F.col("auto_loss_us").isNull()).select(KEY)


def stale_reviews(reviews: DataFrame, automatic: DataFrame) -> DataFrame:
    """Problem per review: unknown_platform, source_changed or stale evidence; clean ones are absent.

    Both tables carry ``source_hash, ttff_us, strain_us, auto_loss_us, auto_status, auto_source``;
    an empty review field does not count as changed.
    """
    fields = ("ttff_us", "strain_us", "auto_loss_us", "auto_status", "auto_source")
    a = automatic.select(KEY, F.lit(True).alias("__known"), *[F.col(c).alias(f"a_{c}") for c in ("source_hash", *fields)])
    j = reviews.join(a, KEY, "left")
    changed = F.lit(False)
    for c in fields:
        changed = changed | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"a_{c}")))
    problem = (
        F.when(F.col("__known").isNull(), "unknown_platform")
        .when(~F.col("source_hash").eqNullSafe(F.col("a_source_hash")), "source_changed").when(changed, "stale")
    )
    return j.select(KEY, problem.alias("problem")).where("problem IS NOT NULL")
