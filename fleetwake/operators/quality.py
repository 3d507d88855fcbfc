"""Position quality control of whole fleets (QC rows).

Columns carry every rule that has a window or join form. The sequential rules run in grouped
functions on pieces that hold only the rows around a fast edge (or closely spaced rows), so calm
stretches of a track never leave the JVM and no piece grows with the length of its track.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.functions import geo, wgs84
from fleetwake.operators import frames
from fleetwake.operators import runsolver
from fleetwake.operators.runsolver import Piece, PositionConfig

KEY = "platform_id"
TRACK = ["time", "obs_index"]
HALO = 64  # rows of calm context on each side of a piece


@dataclass(frozen=True)
class SegmentConfig:
    # Fixed default values.
    gap_h: float = 6.0
    fragment_obs: float = 0.10
    fragment_duration: float = 0.10
    main_h: float = 48.0
    main_obs: int = 48


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def base_rows(obs: DataFrame, drogue: DataFrame, deployments: DataFrame | None = None,
              reviews: DataFrame | None = None) -> DataFrame:
    """Source validity, drogue and deployment eligibility and the human decision of every fix.

    ``drogue``: platform_id, status, cutoff (platforms without a row count as uncertain).
    ``deployments``: platform_id, deployment_time, window_start, window_end.
    ``reviews``: platform_id, obs_index, decision.
    """
    j = obs.join(drogue.select(KEY, F.col("status").alias("drogue_status"), "cutoff"), KEY, "left")
    j = j.withColumn("drogue_status", F.coalesce("drogue_status", F.lit("uncertain")))
    if deployments is None:
        none = F.lit(None).cast("timestamp")
        j = j.withColumns({"deployment_time": none, "window_start": none, "window_end": none})
    else:
        j = j.join(deployments.select(KEY, "deployment_time", "window_start", "window_end"), KEY, "left")
    if reviews is None:
        j = j.withColumn("human", F.lit(""))
    else:
        j = j.join(reviews.select(KEY, "obs_index", F.col("decision").alias("human")), [KEY, "obs_index"], "left")
        j = j.withColumn("human", F.coalesce("human", F.lit("")))
    t_ok, p_ok = F.col("time").isNotNull(), geo.position_valid("lon", "lat")
    s = F.col("drogue_status")
    exact, opens = F.col("deployment_time"), F.col("window_start")
    place = (
        F.when(exact.isNotNull(), F.when(F.col("time") < exact, "predeployment").when(t_ok, "eligible"))
        .when(opens.isNotNull(), F.when(F.col("time") < opens, "predeployment")
              .when(F.col("time") < F.col("window_end"), "deployment_window_uncertain").when(t_ok, "eligible"))
    )
    j = j.withColumns({
        "valid_time": t_ok,
        "valid_position": p_ok,
        "invalid_reason": F.when(~t_ok, "invalid_timestamp").when(~p_ok, "invalid_position").otherwise(""),
        "drogue_eligible": _flag(F.when(s == "lost", F.col("time") < F.col("cutoff")).when(s == "not_lost", t_ok)),
        "deployment_status": F.coalesce(place, F.lit("not_configured")),
    })
    d = F.col("deployment_status")
    return j.withColumns({
        "deployment_eligible": ~d.isin("predeployment", "deployment_window_uncertain"),
        "deployment_uncertain": d == "deployment_window_uncertain",
    }).drop("deployment_time", "window_start", "window_end")


def _usable() -> Column:
    return F.col("valid_time") & F.col("valid_position") & F.col("drogue_eligible") & F.col("deployment_eligible")


def label_segments(base: DataFrame, cfg: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Usable rows with their segment number (0-based) along the track."""
    rows = base.where(_usable()).select(KEY, *[c for c in base.columns if c != KEY])
    gap = F.unix_micros("time") - F.col("__p") > round(cfg.gap_h * 3600e6)
    lagged = frames.scan(rows, KEY, TRACK, lag={"__p": F.unix_micros("time")})
    return frames.islands(lagged.withColumn("__dt", F.unix_micros("time") - F.col("__p")).withColumn("__g", _flag(gap)).drop("__p"),
                          KEY, TRACK, F.col("__g"), out="segment").drop("__g")


def segment_table(labelled: DataFrame, cfg: SegmentConfig = SegmentConfig(), reviews: DataFrame | None = None) -> DataFrame:
    """One row per segment with its statistics, automatic decision and status.

    ``reviews``: platform_id, segment_key, decision (retain / exclude / uncertain).
    """
    g = [KEY, "segment"]
    inner = F.when(F.col("__dt") <= round(cfg.gap_h * 3600e6), F.col("__dt"))
    stats = labelled.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("start"), F.max("time").alias("end"),
        F.sha2(F.concat_ws(":", F.col(KEY), F.count(F.lit(1)), F.min("obs_index"), F.max("obs_index"),
                           F.sum("obs_index"), F.bit_xor(F.xxhash64("obs_index"))), 256).alias("segment_key"),
    )
    med = frames.quantiles(
        labelled.where(F.col("__dt") > 0), g, {"dt": inner / F.lit(1e6)}, {"p50": 0.5}
    ).select(*g, F.col("dt_p50").alias("median_dt_s"))
    t = stats.join(med, g, "left").withColumn("duration_h", geo.seconds_between("start", "end") / 3600)
    by, w = Window.partitionBy(KEY), Window.partitionBy(KEY).orderBy("segment")
    t = t.withColumns({
        "gap_before_h": geo.seconds_between(F.lag("end").over(w), "start") / 3600,
        "gap_after_h": geo.seconds_between("end", F.lead("start").over(w)) / 3600,
        "obs_fraction": F.col("n") / F.sum("n").over(by),
        "duration_fraction": F.when(F.sum("duration_h").over(by) > 0, F.col("duration_h") / F.sum("duration_h").over(by)),
        "__best": F.max(F.struct("n", "duration_h")).over(by),
    })
    lead = F.struct("n", "duration_h") == F.col("__best")
    t = t.withColumn("__leaders", F.count_if(lead).over(by)).withColumn("dominant", (F.col("__leaders") == 1) & lead)
    sound = (F.col("__leaders") == 1) & (F.col("__best.n") >= cfg.main_obs) & (F.col("__best.duration_h") >= cfg.main_h)
    small = (F.col("n") / F.col("__best.n") <= cfg.fragment_obs) & (
        F.try_divide("duration_h", F.col("__best.duration_h")) <= cfg.fragment_duration)
    t = t.withColumn("tiny", _flag(sound & ~F.col("dominant") & small))
    t = t.withColumns({
        "__substantial": F.count_if(~F.col("tiny")).over(by),
        "__first": F.coalesce(F.min(F.when(~F.col("tiny"), F.col("segment"))).over(by), F.lit(0)),
        "__last": F.coalesce(F.max(F.when(~F.col("tiny"), F.col("segment"))).over(by), F.lit(0)),
    })
    alone = F.col("__substantial") == 1
    t = t.withColumns({
        "auto_status": F.when(F.col("tiny"), "high_confidence_detached_fragment").when(alone, "automatic_retain").otherwise("multiple_substantial_segments"),
        "auto_decision": F.when(F.col("tiny"), "exclude").when(alone, "retain").otherwise(""),
        "event_type": F.when(F.col("tiny"), F.when(F.col("segment") < F.col("__first"), "pre_main_fragment")
                             .when(F.col("segment") > F.col("__last"), "post_main_fragment").otherwise("detached_middle_fragment"))
        .when(alone, "").otherwise("multiple_substantial_segments"),
    })
    if reviews is None:
        t = t.withColumn("human_segment", F.lit(""))
    else:
        t = t.join(reviews.select(KEY, "segment_key", F.col("decision").alias("human_segment")), [KEY, "segment_key"], "left")
        t = t.withColumn("human_segment", F.coalesce("human_segment", F.lit("")))
    h = F.col("human_segment")
    status = (
        F.when(h == "retain", "retained").when(h == "exclude", "excluded").when(h == "uncertain", "uncertain")
        .when(F.col("tiny"), "excluded").when(alone, "retained").otherwise("pending")
    )
    event = F.when(F.col("event_type") != "", F.concat(F.lit("temporal_segment:"), F.substring("segment_key", 1, 16))).otherwise("")
    return t.withColumn("segment_status", status).withColumn("temporal_event_id", event).drop(
        "__best", "__leaders", "__substantial", "__first", "__last")


def with_segments(base: DataFrame, cfg: SegmentConfig = SegmentConfig(), reviews: DataFrame | None = None) -> DataFrame:
    """Every base row with its segment and the segment status (not_applicable outside)."""
    labelled = label_segments(base, cfg)
    table = segment_table(labelled, cfg, reviews).select(
        KEY, "segment", "segment_status", "segment_key", "temporal_event_id", "event_type",
        F.col("auto_decision").alias("temporal_auto_decision"), "human_segment",
    ).withColumnRenamed("event_type", "temporal_event_type")
    inside = labelled.drop("__dt").join(table, [KEY, "segment"])
    outside = base.where(~_usable()).withColumn("segment_status", F.lit("not_applicable"))
    out = inside.unionByName(outside, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("temporal_event_id", "temporal_event_type", "temporal_auto_decision", "human_segment")})


def repeat_rejections(rows: DataFrame) -> DataFrame:
    """Flags every occurrence of a coordinate that a platform repeats exactly within its scope."""
    scope = F.col("segment_status") == "retained"
    g = [KEY, "lon", "lat"]
    copies = rows.where(scope & _usable()).groupBy(*g).agg(
        F.count(F.lit(1)).alias("repeat_count"), geo.seconds_between(F.min("time"), F.max("time")).alias("repeat_span_s"),
    ).where("repeat_count > 1")
    copies = copies.withColumn("repeat_group", F.concat(F.lit("repeated_position:"), F.substring(
        F.sha2(F.concat_ws(":", KEY, F.col("lon").cast("string"), F.col("lat").cast("string")), 256), 1, 16)))
    out = rows.join(copies, g, "left")
    hit = _flag(scope & _usable() & F.col("repeat_count").isNotNull())
    return out.withColumns({
        "rej_repeat": hit,
        "repeat_count": F.when(hit, F.col("repeat_count")).otherwise(0),
        "repeat_span_s": F.when(hit, F.col("repeat_span_s")),
        "repeat_group": F.when(hit, F.col("repeat_group")).otherwise(""),
    })


def _linked(close: DataFrame, limit_us: int) -> DataFrame:
    """``platform_id, island, chunk, anchor``: the anchor with which every chunk of an island begins.

    A chunk maps the anchor it gets to the one it hands on. Only rows in the last ``limit`` before a chunk can
    be its anchor, so this map has few rows; maps of neighbouring chunks are composed to maps of
    2, 4, 8 … chunks, and what is reached from the first chunk doubles with them.
    """
    k = [KEY, "island", "chunk"]
    none = F.lit(runsolver.NO_ANCHOR)
    span = close.groupBy(KEY, "island").agg(F.min("chunk").alias("c0"), F.max("chunk").alias("c1"))
    start = span.select(KEY, "island", F.col("c0").alias("chunk"), none.alias("anchor"))
    long = frames.cut(span.where("c1 > c0").withColumn("span", F.col("c1") - F.col("c0")))
    most = long.agg(F.max("span")).first()[0]
    if not most:
        return start
    rows = close.join(long.select(KEY, "island"), [KEY, "island"])
    end = (F.col("chunk") + 1) * frames.CHUNK_US
    tails = rows.where((F.col("t_us") >= end - limit_us) & ~F.col("human").isin("reject", "uncertain")).withColumns({"chunk": F.col("chunk") + 1, "before": F.lit(True)})
    both = rows.withColumn("before", F.lit(False)).unionByName(tails)

    def handed_on(d: pd.DataFrame) -> dict | None:
        before = d["before"].to_numpy(bool)
        if before.all():
            return None
        t, human = d["t_us"].to_numpy(np.int64), d["human"].to_numpy()
        given = np.r_[runsolver.NO_ANCHOR, t[before]]
        return {"anchor": given, "next": runsolver.Thinning(t[~before], human[~before], limit_us).handed_on(given)}

    hop = frames.in_lots(both, k, "t_us", handed_on, "platform_id string, island long, chunk long, anchor long, next long")
    # An anchor whose reach ends with the chunk is none to the next one.
    hop = frames.cut(hop.withColumn("next", F.when(F.col("next") + limit_us > end, F.col("next")).otherwise(none)))
    reached, step = frames.cut(start), 1
    while step <= most:
        further = reached.join(hop, [*k, "anchor"]).select(KEY, "island", (F.col("chunk") + step).alias("chunk"), F.col("next").alias("anchor"))
        reached = frames.cut(reached.unionByName(further))
        step *= 2
        if step <= most:
            onward = hop.select(KEY, "island", (F.col("chunk") - step // 2).alias("chunk"), F.col("anchor").alias("next"), F.col("next").alias("__to"))
            hop = frames.cut(hop.join(onward, [*k, "next"]).select(*k, "anchor", F.col("__to").alias("next")))
    return reached


def short_interval_rejections(rows: DataFrame, cfg: PositionConfig = PositionConfig()) -> DataFrame:
    """Thins rows that follow the surviving anchor by less than the minimum interval.

    A row at least the minimum after its predecessor survives whatever came before, so the track
    falls apart into islands of closely spaced rows there; single rows never reach Python. Islands are
    cut into the chunks of ``frames`` (a day), so that a densely sampled platform spreads over many tasks;
    each chunk is thinned from the anchor that :func:`_linked` finds for it.
    """
    rows = frames.cut(rows)
    scope = (F.col("segment_status") == "retained") & _usable() & ~F.col("deployment_uncertain")
    considered = rows.where(_flag(scope)).select(KEY, "segment", "time", "obs_index", "human", "rej_repeat")
    t = F.unix_micros("time")
    twins = considered.groupBy(KEY, "time").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
    considered = considered.join(twins, [KEY, "time"], "left").withColumn("__dup", F.col("__c").isNotNull()).drop("__c")
    # Repeated rows are skipped; duplicate times are barriers between islands.
    line = considered.where(~F.col("rej_repeat") | F.col("__dup"))
    limit_us = round(cfg.min_dt_s * 1e6)
    seen = frames.scan(line, KEY, TRACK, lag={"__p": F.struct(t.alias("t"), "segment", "__dup")})
    fresh = (
        F.col("__p").isNull() | F.col("__p.__dup") | F.col("__dup") | (F.col("__p.segment") != F.col("segment"))
        | (t - F.col("__p.t") >= limit_us)
    )
    lots = frames.islands(seen.withColumn("__f", fresh).drop("__p"), KEY, TRACK, F.col("__f"), out="island").where(~F.col("__dup"))
    sizes = lots.groupBy(KEY, "island").agg(F.count(F.lit(1)).alias("__s")).where("__s > 1")
    if limit_us > frames.CHUNK_US:
        raise ValueError("the minimum interval must not exceed a day")
    close = lots.join(sizes, [KEY, "island"]).select(
        KEY, "island", "obs_index", t.alias("t_us"), "human", F.floor(t / F.lit(frames.CHUNK_US)).cast("long").alias("chunk"))
    close = frames.cut(close)

    def thin(d: pd.DataFrame) -> dict:
        stretch = runsolver.Thinning(d["t_us"].to_numpy(np.int64), d["human"].to_numpy(), limit_us)
        return {"obs_index": d["obs_index"].to_numpy()[stretch.fallen(int(d["anchor"].iloc[0]))]}

    k = [KEY, "island", "chunk"]
    hits = frames.cut(frames.in_lots(close.join(_linked(close, limit_us), k), k, ["t_us", "obs_index"], thin, "platform_id string, obs_index long"))
    return rows.join(hits.withColumn("rej_short", F.lit(True)), [KEY, "obs_index"], "left").withColumn("rej_short", _flag(F.col("rej_short")))


def duplicate_rejections(rows: DataFrame, cfg: PositionConfig = PositionConfig()) -> DataFrame:
    """Of fixes at one time the smoothest stays: fewest bad edges, least excess, least acceleration."""
    scope = _flag((F.col("segment_status") == "retained") & _usable() & ~F.col("deployment_uncertain")
                  & ~F.col("rej_repeat") & ~F.col("rej_short") & (F.col("human") != "reject"))
    live = rows.where(scope).select(KEY, "segment", "time", "obs_index", "lon", "lat", "human")
    fix = F.struct("time", "lon", "lat", "obs_index", "segment")
    # One first and one last row stand for every time; neighbours of a time are those of the next one.
    by_time = live.groupBy(KEY, "time").agg(
        F.count(F.lit(1)).alias("copies"), F.min_by(fix, "obs_index").alias("lo"), F.max_by(fix, "obs_index").alias("hi"))
    around = frames.scan(by_time, KEY, "time", lag={"prev": F.col("hi")}, lead={"next": F.col("lo")})
    crowded = around.where("copies > 1").select(KEY, "time", "prev", "next")
    m = live.join(crowded, [KEY, "time"])
    m = m.withColumns({
        "prev": F.when(F.col("prev.segment") == F.col("segment"), F.col("prev")),
        "next": F.when(F.col("next.segment") == F.col("segment"), F.col("next")),
    })
    m = m.withColumns({
        "dt0": geo.seconds_between("prev.time", "time"), "dt1": geo.seconds_between("time", "next.time"),
        "d0": geo.haversine("prev.lon", "prev.lat", "lon", "lat"), "d1": geo.haversine("lon", "lat", "next.lon", "next.lat"),
    })

    def judged(side: str, dt: str, d: str) -> tuple[Column, Column]:
        present = F.col(side).isNotNull()
        usable = _flag((F.col(dt) >= cfg.min_dt_s) & (F.col(dt) <= cfg.reach_s))
        excess = F.when(usable, F.greatest(F.lit(0.0), F.col(d) / F.col(dt) - cfg.speed_limit)).otherwise(F.lit(float("inf")))
        return (
            F.when(present, (excess > 0).cast("int")).otherwise(0),
            F.when(present, excess).otherwise(0.0),
        )

    (c0, x0), (c1, x1) = judged("prev", "dt0", "d0"), judged("next", "dt1", "d1")
    e0, n0 = geo.velocity_between("prev.lon", "prev.lat", "lon", "lat", "dt0")
    e1, n1 = geo.velocity_between("lon", "lat", "next.lon", "next.lat", "dt1")
    half = (F.col("dt0") + F.col("dt1")) / 2
    bend = F.when(half > 0, F.hypot(e1 - e0, n1 - n0) / half)
    score = F.struct(
        F.when(F.col("human") == "keep", 0).otherwise(1).alias("k"), (c0 + c1).alias("c"), (x0 + x1).alias("x"),
        F.coalesce(bend, F.lit(float("inf"))).alias("a"), F.col("obs_index").alias("i"),
    )
    best = m.withColumn("score", score).groupBy(KEY, "time").agg(F.min("score").alias("best"))
    out = rows.join(best.select(KEY, "time", F.col("best.i").alias("__keep")), [KEY, "time"], "left")
    return out.withColumn("rej_dup", _flag(scope & F.col("__keep").isNotNull() & (F.col("obs_index") != F.col("__keep")))).drop("__keep")


def surviving_runs(rows: DataFrame, rejected: Column, statuses=("retained",)) -> DataFrame:
    """Surviving rows with their run number; duplicate times and human doubt end a run."""
    keep = _flag(F.col("segment_status").isin(*statuses) & ~rejected & (F.col("human") != "reject"))
    live = rows.where(keep)
    twins = live.groupBy(KEY, "time").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
    live = live.join(twins, [KEY, "time"], "left")
    live = live.withColumn("__hard", F.col("__c").isNotNull() | (F.col("human") == "uncertain")).drop("__c")
    # A run is named by its segment and the barriers before it; segments are ordered in time.
    counted = frames.islands(live, KEY, TRACK, F.col("__hard"), out="__barriers").where(~F.col("__hard"))
    return counted.withColumn("run", F.col("segment") * F.lit(2**32) + F.col("__barriers")).drop("__barriers", "__hard")


def run_edges(runs: DataFrame) -> DataFrame:
    """Position in the run and the edge from the previous row of the run."""
    e = frames.scan(runs, [KEY, "run"], TRACK, lag={"prev": F.struct("time", "lon", "lat", "obs_index")},
                    total={"pos": F.lit(1).cast("long")})
    return e.withColumns({"edge_dt_s": geo.seconds_between("prev.time", "time"),
                          "edge_m": geo.haversine("prev.lon", "prev.lat", "lon", "lat")}).withColumn(
        "edge_speed", geo.speed_over("edge_m", "edge_dt_s"))


def is_timed(cfg: PositionConfig) -> Column:
    return (F.col("edge_dt_s") >= cfg.min_dt_s) & (F.col("edge_dt_s") <= cfg.reach_s)


def pieces(edges: DataFrame, fast: Column, halo: int = HALO) -> DataFrame:
    """Rows within ``halo`` rows of a fast edge, with a piece number per run.

    Fast edges closer than two halos share a piece. Beyond two calm edges the walks know nothing
    of what lies further away, so a piece decides exactly as the whole run would.
    """
    g = [KEY, "run"]
    marked = edges.withColumn("__fast", _flag(fast))
    near = frames.scan(marked, g, TRACK, last={"__before": F.when(F.col("__fast"), F.col("pos"))},
                       first={"__after": F.when(F.col("__fast"), F.col("pos"))})
    close_b = _flag(F.col("pos") - F.col("__before") <= halo)
    close_a = _flag(F.col("__after") - 1 - F.col("pos") <= halo)
    near = near.where(close_b | close_a).withColumn("__ref", F.when(close_b, F.col("__before")).otherwise(F.col("__after")))
    spots = marked.where("__fast").select(*g, "time", "obs_index", "pos")
    lagged = frames.scan(spots, g, TRACK, lag={"__q": F.col("pos")})
    begins = F.col("__q").isNull() | (F.col("pos") - F.col("__q") > 2 * halo + 1)
    named = frames.islands(lagged.withColumn("__f", begins), g, TRACK, F.col("__f"), out="piece").select(*g, F.col("pos").alias("__ref"), "piece")
    return near.join(named, g + ["__ref"]).drop("__ref", "__before", "__after", "__fast")


CURE_SCHEMA = (
    "platform_id string, obs_index long, reason string, event_id string, implicated array<long>, anchor long, "
    "reconnect long, bridge_speed double, iteration int, samples int, speed_median double, speed_scale double, "
    "bridge_z double, atypical boolean, residual_m double, rival_z double"
)


CURE_COLUMNS = CURE_SCHEMA.replace(",", "").split()[::2]


def _emit(cures, idx: np.ndarray, platform: str, warning_z: float) -> list[tuple]:
    """Rows of ``CURE_SCHEMA`` without the platform, one for each dropped row."""
    from hashlib import sha256
    import json

    def finite(x: float) -> float | None:
        return float(x) if np.isfinite(x) else None

    out = []
    for c in cures:
        members = [int(idx[r]) for r in c.skipped]
        tag = sha256(json.dumps([platform, c.reason, members]).encode()).hexdigest()[:16]
        z = finite(c.z)
        for m in members:
            out.append((
                m, c.reason, f"{c.reason}:{tag}", members, int(idx[c.anchor]), None if c.reconnect < 0 else int(idx[c.reconnect]),
                finite(c.bridge_speed), c.iteration, c.samples, finite(c.median), finite(c.scale), z,
                None if z is None else c.z > warning_z, finite(c.residual_m), finite(c.rival_z)))
    return out


def _grouped(rows: DataFrame, solve, cfg: PositionConfig) -> DataFrame:
    """Run ``solve(pdf of one piece) -> cures`` over all pieces, many to a call; written, since the rules read the cures twice."""

    def column(values: list) -> np.ndarray:
        out = np.empty(len(values), object)
        out[:] = values
        return out

    def work(part: pd.DataFrame) -> dict | None:
        found = _emit(solve(part), part["obs_index"].to_numpy(), part[KEY].iloc[0], cfg.warning_z)
        return {c: column(v) for c, v in zip(CURE_COLUMNS[1:], map(list, zip(*found)))} if found else None

    return frames.cut(frames.in_lots(rows, [KEY, "run", "piece"], ["t_us", "obs_index"], work, CURE_SCHEMA))


def run_baseline(edges: DataFrame, cfg: PositionConfig) -> DataFrame:
    """Median and floored robust scale of the calm speeds of every run with a fast edge."""
    g = [KEY, "run"]
    limit = F.col("edge_speed") <= cfg.speed_limit
    hot = edges.where(is_timed(cfg) & ~limit).select(*g).distinct()
    calm = frames.cut(edges.where(is_timed(cfg) & limit).join(hot, g, "left_semi").select(*g, "edge_speed"))
    middle = frames.quantiles(calm, g, {"speed": F.col("edge_speed")}, {"median": 0.5}).select(*g, "speed_median")
    off = frames.cut(calm.join(middle, g).select(*g, "speed_median", F.abs(F.col("edge_speed") - F.col("speed_median")).alias("off")))
    scale = frames.quantiles(off, g, {"off": F.col("off")}, {"median": 0.5})
    return middle.join(scale, g).select(*g, "speed_median", F.greatest(1.4826 * F.col("off_median"), F.lit(cfg.scale_floor)).alias("speed_scale"))


def geometry_cures(rows: DataFrame, rejected: Column, cfg: PositionConfig = PositionConfig(), *, aggressive: bool = False) -> DataFrame:
    """Rows rejected by the confirmed-hop, endpoint and (aggressive) bounded speed cures."""
    edges = run_edges(surviving_runs(rows, rejected))
    ends = rows.where(_flag((F.col("segment_status") == "retained") & _usable() & ~F.col("deployment_uncertain") & ~rejected & (F.col("human") != "reject")))
    first = ends.groupBy(KEY, "segment").agg(
        F.min(F.struct(*TRACK)).alias("a"), F.max(F.struct(*TRACK)).alias("z")
    ).select(KEY, "segment", F.col("a.obs_index").alias("first_obs"), F.col("z.obs_index").alias("last_obs"))
    none = F.lit(None).cast("double")
    near = pieces(edges, is_timed(cfg) & (F.col("edge_speed") > cfg.speed_limit)).join(first, [KEY, "segment"], "left")
    if aggressive:
        near = near.join(run_baseline(edges, cfg), [KEY, "run"], "left")
    else:
        near = near.withColumns({"speed_median": none, "speed_scale": none})
    near = near.select(
        KEY, "speed_median", "speed_scale", "run", "piece", "obs_index", F.unix_micros("time").alias("t_us"), "lon", "lat",
        F.col("human").isin("keep", "uncertain").alias("protected"),
        _flag(F.col("obs_index") == F.col("first_obs")).alias("is_first"), _flag(F.col("obs_index") == F.col("last_obs")).alias("is_last"))

    def solve(pdf: pd.DataFrame):
        t = pdf["t_us"].to_numpy()
        usual = (float(pdf["speed_median"].iloc[0]), float(pdf["speed_scale"].iloc[0]))
        p = Piece((t - t[0]) / 1e6, pdf["lon"].to_numpy(), pdf["lat"].to_numpy(), pdf["protected"].to_numpy(bool), cfg,
                  usual if np.isfinite(usual).all() else None)
        return runsolver.solve(p, pdf["obs_index"].to_numpy(), bool(pdf["is_first"].iloc[0]), bool(pdf["is_last"].iloc[-1]), aggressive)

    return _grouped(near, solve, cfg)


def new_side_cures(rows: DataFrame, rejected: Column, cfg: PositionConfig = PositionConfig()) -> DataFrame:
    """Last resort on the fast edges that are left, cut into pieces by reach.

    A dropped block ends once distance / elapsed time falls to the limit, at the latest after
    (diameter of the run's box) / limit seconds. Edges whose reaches do not touch are independent;
    whether the older side is trusted follows from the first two calm edges of the run.
    """
    g = [KEY, "run"]
    e = run_edges(surviving_runs(rows, rejected))
    fast = _flag((F.col("edge_dt_s") > 0) & (F.col("edge_speed") > cfg.speed_limit))
    calm = _flag(is_timed(cfg) & (F.col("edge_speed") <= cfg.speed_limit))
    e = e.withColumns({"__fast": fast, "__calm": calm})
    hot = e.where("__fast").select(*g).distinct()
    e = e.join(hot, g, "left_semi")
    e = frames.scan(e, g, TRACK, lag={"__c1": F.col("__calm")})
    box = e.groupBy(*g).agg(
        F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"),
        F.min(F.when(F.col("__calm") & _flag(F.col("__c1")), F.unix_micros("time"))).alias("trust_us"))
    # Any two points are within the box: its height plus its width along the widest parallel.
    deg = geo.EARTH_RADIUS_M * 3.141592653589793 / 180
    tall = (F.col("y1") - F.col("y0")) * deg
    wide = F.least(F.col("x1") - F.col("x0"), F.lit(360.0)) * deg
    e = e.join(box.select(*g, "trust_us", ((tall + wide) / cfg.speed_limit * 1e6).cast("long").alias("reach_us")), g)
    t = F.unix_micros("time")
    # A piece is a stretch of rows after fast edges, none further than the reach from the last one,
    # plus the anchor row before it and two rows of history.
    near = frames.scan(e, g, TRACK, last={"__hit": F.when(F.col("__fast"), t)})
    inside = _flag(t - F.col("__hit") <= F.col("reach_us"))
    near = near.withColumn("__in", inside)
    b = frames.blocks(near, g, TRACK, halo=5)
    w = frames.block_window(g)
    b = b.withColumn("__m", F.max("__in").over(w.rowsBetween(-1, 3)))
    b = b.withColumn("__f", F.col("__m") & ~_flag(F.lag("__m").over(w)))
    named = frames.islands(frames.core(b).where("__m"), g, TRACK, F.col("__f"), out="piece")
    sel = named.select(KEY, "run", "piece", "obs_index", t.alias("t_us"), "lon", "lat",
                       F.col("human").isin("keep", "uncertain").alias("protected"), "trust_us")

    def solve(pdf: pd.DataFrame):
        t0 = pdf["t_us"].to_numpy()
        p = Piece((t0 - t0[0]) / 1e6, pdf["lon"].to_numpy(), pdf["lat"].to_numpy(), pdf["protected"].to_numpy(bool), cfg)
        trust = pdf["trust_us"].iloc[0]
        return runsolver.thin_new_side(p, float("inf") if pd.isna(trust) else (trust - t0[0]) / 1e6)

    return _grouped(sel, solve, cfg)


def _with_cures(rows: DataFrame, cures: DataFrame) -> DataFrame:
    c = cures.select(KEY, "obs_index", "reason", F.col("event_id").alias("cure_id"), "implicated", "anchor", "reconnect", "bridge_speed", "iteration")
    return rows.join(c, [KEY, "obs_index"], "left").withColumn("rej_geometry", F.col("reason").isNotNull())


def final_edges(rows: DataFrame, rejected: Column, cfg: PositionConfig = PositionConfig()) -> DataFrame:
    """Edges between surviving rows of retained and pending segments, with timing flags."""
    e = run_edges(surviving_runs(rows, rejected, ("retained", "pending")))
    dt, v = F.col("edge_dt_s"), F.col("edge_speed")
    return e.select(
        KEY, "obs_index", "time", "run", "pos", F.col("prev.obs_index").alias("prev_obs"),
        "edge_dt_s", "edge_m", "edge_speed",
        _flag(dt <= 0).alias("nonpositive_dt"), _flag((dt > 0) & (dt < cfg.min_dt_s)).alias("short_dt"),
        _flag(F.abs(dt - cfg.nominal_s) <= cfg.nominal_tolerance_s).alias("nominal_dt"),
        _flag(dt > cfg.reach_s).alias("large_gap"), _flag(v > cfg.speed_limit).alias("high_speed"),
        _flag(is_timed(cfg)).alias("timed"),
    )


def anomaly_groups(edges: DataFrame, cfg: PositionConfig = PositionConfig()) -> DataFrame:
    """Rows implicated by groups of remaining fast edges at most ``merge_gap_edges`` apart."""
    g = [KEY, "run"]
    fast = edges.where("high_speed")
    lagged = frames.scan(fast, g, TRACK, lag={"__q": F.col("pos")})
    fresh = F.col("__q").isNull() | (F.col("pos") - F.col("__q") > cfg.merge_gap_edges + 1)
    named = frames.islands(lagged.withColumn("__f", fresh), g, TRACK, F.col("__f"), out="group")
    k = g + ["group"]
    facts = named.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_edges"), F.bool_or(~F.col("timed")).alias("untimed"), F.min("prev_obs").alias("first_obs"),
        F.max("obs_index").alias("last_obs"), F.max("edge_speed").alias("max_speed"))
    facts = facts.withColumn("anomaly_id", F.substring(F.sha2(F.concat_ws(":", KEY, "first_obs", "last_obs", "n_edges"), 256), 1, 16))
    ends = named.select(*k, F.explode(F.array("prev_obs", "obs_index")).alias("obs_index")).distinct()
    return ends.join(facts, k)


def local_qc(rows: DataFrame, cfg: PositionConfig = PositionConfig(), *, policy: str = "conservative") -> DataFrame:
    """All local rules in their order of precedence; adds rejection flags, events and review needs."""
    if policy not in ("conservative", "aggressive"):
        raise ValueError(f"unsupported policy {policy!r}")
    rows = short_interval_rejections(repeat_rejections(rows), cfg)
    first = F.col("rej_repeat") | F.col("rej_short")
    bold = policy == "aggressive"
    rows = duplicate_rejections(rows, cfg) if bold else rows.withColumn("rej_dup", F.lit(False))
    # What follows reads these rows several times.
    rows = frames.cut(rows)
    rejected = first | F.col("rej_dup")
    cures = geometry_cures(rows, rejected, cfg, aggressive=bold)
    if bold:
        so_far = rows.join(cures.select(KEY, "obs_index", F.lit(True).alias("__cured")), [KEY, "obs_index"], "left")
        cures = cures.unionByName(new_side_cures(so_far, rejected | _flag(F.col("__cured")), cfg))
    rows = frames.cut(_with_cures(rows, cures))
    rejected = rejected | F.col("rej_geometry")
    edges = final_edges(rows, rejected, cfg)
    groups = anomaly_groups(edges, cfg).groupBy(KEY, "obs_index").agg(
        F.min(F.struct("run", "group", "anomaly_id", "n_edges", "untimed")).alias("an"))
    scope = F.col("segment_status").isin("retained", "pending") & F.col("valid_time") & F.col("valid_position")
    twins = rows.where(_flag(scope)).groupBy(KEY, "time").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
    out = (
        rows.join(edges.drop("time", "run", "pos", "timed"), [KEY, "obs_index"], "left")
        .join(groups, [KEY, "obs_index"], "left").join(twins, [KEY, "time"], "left")
    )
    twin = _flag(scope & F.col("__c").isNotNull())
    flagged = F.col("an").isNotNull()
    why = (
        F.when(F.lit(bold), "automatic_keep_removal_limit_reached").when(F.col("an.untimed"), "high_speed_edge_has_untrusted_timing")
        .when(F.col("an.n_edges") == 1, "single_high_speed_edge_has_no_unique_bad_endpoint")
        .otherwise("no_bidirectionally_confirmed_cure_within_timing_limit")
    )
    kind = (
        F.when(F.lit(bold), "automatic_retained_anomaly").when(F.col("an.untimed"), "boundary_or_insufficient_context")
        .when(F.col("an.n_edges") == 1, "single_edge_ambiguous").otherwise("persistent_excursion")
    )
    reason = (
        F.when(F.col("rej_repeat"), "exact_repeated_coordinates").when(F.col("rej_short"), "positive_dt_below_minimum_local_interval")
        .when(F.col("rej_dup"), "automatic_duplicate_time_resolution").when(F.col("rej_geometry"), F.col("reason"))
        .when(twin & F.lit(bold), "automatic_duplicate_time_resolution").when(twin, "duplicate_or_nonpositive_timestamp")
        .when(flagged, why).otherwise("")
    )
    status = (
        F.when(F.col("rej_repeat"), "repeated_position").when(F.col("rej_short"), "short_interval_reject")
        .when(F.col("rej_dup"), "duplicate_timestamp_reject")
        .when(F.col("reason") == "automatic_new_side_speed_thinning", "automatic_new_side_reject")
        .when(F.col("rej_geometry"), "high_confidence_reject")
        .when(twin & F.lit(bold), "duplicate_timestamp_representative").when(twin, "review_required")
        .when(flagged & F.lit(bold), "automatic_retained_anomaly").when(flagged, "review_required").otherwise("")
    )
    stamp = F.concat_ws(":", F.col(KEY), F.unix_micros("time"))
    event_id = (
        F.when(F.col("rej_repeat"), F.col("repeat_group"))
        .when(F.col("rej_short"), F.concat(F.lit("short_interval:"), F.substring(F.sha2(F.concat_ws(":", KEY, "obs_index"), 256), 1, 16)))
        .when(F.col("rej_dup"), F.concat(F.lit("duplicate_timestamp:"), F.substring(F.sha2(stamp, 256), 1, 16)))
        .when(F.col("rej_geometry"), F.col("cure_id"))
        .when(twin & ~F.lit(bold), F.concat(F.lit("boundary_or_insufficient_context:"), F.substring(F.sha2(stamp, 256), 1, 16)))
        .when(flagged, F.concat_ws(":", kind, F.col("an.anomaly_id"))).otherwise("")
    )
    event_type = (
        F.when(F.col("rej_repeat"), "repeated_position").when(F.col("rej_short"), "short_interval")
        .when(F.col("rej_dup"), "duplicate_timestamp").when(F.col("reason") == "automatic_new_side_speed_thinning", F.col("reason"))
        .when(F.col("rej_geometry"), "local_spike_or_short_block").when(twin & ~F.lit(bold), "boundary_or_insufficient_context")
        .when(flagged, kind).otherwise("")
    )
    review = F.lit(False) if bold else (twin | flagged)
    undecided = F.when(twin, ~F.col("human").isin("keep", "reject")).otherwise(F.col("human") == "")
    flags = {c: _flag(F.col(c)) for c in ("nonpositive_dt", "short_dt", "nominal_dt", "large_gap", "high_speed")}
    return out.withColumns({
        **flags,
        "point_reason": reason, "point_status": status, "event_id": event_id, "event_type": event_type,
        "review_required": review, "unresolved_event": review & undecided,
        "auto_reject": F.col("rej_repeat") | F.col("rej_short") | F.col("rej_dup") | F.col("rej_geometry"),
    }).withColumns({
        "point_decision": F.when(F.col("auto_reject"), "reject").when(F.col("point_status").isin(
            "duplicate_timestamp_representative", "automatic_retained_anomaly"), "keep").otherwise(""),
        "nonpositive_dt": F.col("nonpositive_dt") | twin,
        "short_dt": F.col("short_dt") | F.col("rej_short"),
    }).drop("an", "__c", "cure_id", "reason")


def resolve(rows: DataFrame) -> DataFrame:
    """One final status and decision source per fix, and completeness per platform."""
    source_ok = F.col("valid_time") & F.col("valid_position")
    seg = F.col("segment_status")
    human = F.col("human")
    cases = [
        (~source_ok, "source_invalid", "source"),
        (F.col("drogue_status") == "uncertain", "unresolved", "drogue"),
        (~F.col("drogue_eligible"), "outside_drogue_window", "drogue"),
        (seg == "uncertain", "uncertain", "human"),
        (F.col("deployment_uncertain") | (seg == "pending"), "unresolved", "temporal"),
        (~F.col("deployment_eligible") | (seg == "excluded"), "outside_operational_segment", "temporal"),
        (F.col("rej_repeat"), "rejected", "automatic_repeat"),
        (F.col("rej_short"), "rejected", "automatic_short_interval"),
        (F.col("rej_dup"), "rejected", "automatic_duplicate_time"),
        (human == "reject", "rejected", "human"),
        (human == "keep", "valid", "human"),
        (human == "uncertain", "uncertain", "human"),
        (F.col("auto_reject"), "rejected", "automatic_geometry"),
        (F.col("unresolved_event"), "unresolved", "automatic_review_required"),
    ]
    status = source = F
    for cond, st, so in cases:
        status, source = status.when(_flag(cond), st), source.when(_flag(cond), so)
    out = rows.withColumns({"final_status": status.otherwise("valid"), "decision_source": source.otherwise("ordinary")})
    out = out.withColumn("final_valid", F.col("final_status") == "valid")
    done = out.groupBy(KEY).agg(
        (~F.bool_or(F.col("final_status").isin("uncertain", "unresolved"))).alias("platform_complete"),
        F.bool_or("final_valid").alias("__any"))
    return out.join(done.withColumn("reconstruction_available", F.col("platform_complete") & F.col("__any")).drop("__any"), KEY)


def position_qc(obs: DataFrame, drogue: DataFrame, *, deployments=None, reviews=None, segment_reviews=None,
                segment_cfg: SegmentConfig = SegmentConfig(), cfg: PositionConfig = PositionConfig(),
                policy: str = "conservative") -> DataFrame:
    """One row per source fix with all evidence, flags and the final status."""
    base = base_rows(obs, drogue, deployments, reviews)
    return resolve(local_qc(with_segments(base, segment_cfg, segment_reviews), cfg, policy=policy))


def join_back(obs: DataFrame, qc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source rows with their QC masks, identity violations)."""
    q = qc.select(KEY, "obs_index", "final_status", "final_valid", "decision_source")
    copies = q.groupBy(KEY, "obs_index").agg(F.count(F.lit(1)).alias("copies"))
    both = obs.select(KEY, "obs_index", F.lit(True).alias("__s")).join(copies, [KEY, "obs_index"], "full_outer")
    rule = F.when(F.col("__s").isNull(), "unknown_source_row").when(F.col("copies").isNull(), "missing_qc_row").when(F.col("copies") > 1, "repeated_qc_row")
    bad = both.withColumn("rule", rule).where("rule IS NOT NULL").select(KEY, "obs_index", "rule")
    return obs.join(q, [KEY, "obs_index"]), bad


def event_catalog(qc: DataFrame) -> DataFrame:
    """One row per event id: kind, type, pending flag, first time and row of the event."""
    auto = ("retain", "exclude", "reject")
    cols = [KEY, "time", "obs_index", "final_status", "review_required", "human"]
    temporal = qc.where("temporal_event_id <> ''").select(
        *cols, F.col("temporal_event_id").alias("event_id"), F.lit("temporal").alias("kind"),
        F.col("temporal_event_type").alias("event_type"), F.col("temporal_auto_decision").alias("auto_decision"),
        (((F.col("human_segment") == "retain") & (F.col("temporal_auto_decision") == "exclude"))
         | ((F.col("human_segment") == "exclude") & (F.col("temporal_auto_decision") == "retain"))).alias("conflict"))
    local = qc.where("event_id <> ''").select(
        *cols, "event_id", F.lit("local").alias("kind"), "event_type", F.col("point_decision").alias("auto_decision"), F.lit(False).alias("conflict"))
    rows = temporal.unionByName(local)
    head = F.min_by(F.struct("kind", "event_type", "auto_decision", "time", "obs_index"), F.struct("time", "obs_index"))
    e = rows.groupBy(KEY, "event_id").agg(
        head.alias("h"), F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("final_status").isin("unresolved", "uncertain")).alias("open"), F.bool_or("review_required").alias("wanted"),
        F.bool_or("conflict").alias("conflict"), F.bool_or(F.col("human") == "keep").alias("kept"))
    pending = F.col("open") | F.col("wanted") | F.col("conflict") | (F.col("kept") & F.col("h.auto_decision").isin(*auto))
    return e.select(
        KEY, "event_id", "h.kind", "h.event_type", "n",
        (pending & ~F.col("h.event_type").isin("repeated_position", "short_interval")).alias("pending"),
        F.col("h.time").alias("start_time"), F.col("h.obs_index").alias("start_obs"))


def latest_reviews(log: DataFrame, obs: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(latest decision per observation, rejected reviews).

    ``log``: platform_id, obs_index, decision, source_hash, reviewed_at. ``hashes``: platform_id, source_hash.
    """
    last = log.groupBy(KEY, "obs_index").agg(F.max_by(F.struct("decision", "source_hash"), "reviewed_at").alias("r")).select(KEY, "obs_index", "r.*")
    h = hashes.select(KEY, F.col("source_hash").alias("__h"))
    j = last.join(h, KEY, "left").join(obs.select(KEY, "obs_index", F.lit(True).alias("__k")), [KEY, "obs_index"], "left")
    rule = (
        F.when(F.col("__h").isNull(), "unknown_platform").when(F.col("__h") != F.col("source_hash"), "source_changed")
        .when(F.col("__k").isNull(), "unknown_observation").when(~F.col("decision").isin("keep", "reject", "uncertain"), "unknown_decision")
    )
    j = j.withColumn("rule", rule)
    return j.where("rule IS NULL").select(KEY, "obs_index", "decision"), j.where("rule IS NOT NULL").select(KEY, "obs_index", "rule")


# Point reasons of the speed cures.
SPEED_REASONS = (
    "unique_endpoint_speed_cure",
    "bidirectionally_confirmed_time_bounded_excursion_cure",
    "automatic_boundary_endpoint_speed_cure",
    "automatic_iterative_endpoint_speed_cure",
    "automatic_iterative_excursion_speed_cure",
    "automatic_new_side_speed_thinning",
)


def decision_summary(qc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counters per platform and in total, histogram of cure sizes per platform and in total)."""
    src, fin = F.col("decision_source"), F.col("final_status")
    open_, limit = fin.isin("unresolved", "uncertain"), F.col("point_reason") == "automatic_keep_removal_limit_reached"
    cured = (src == "automatic_geometry") & (fin == "rejected") & F.col("point_reason").isin(*SPEED_REASONS)
    sizes = qc.where(cured).groupBy(KEY, "event_id").agg(F.count(F.lit(1)).alias("size"))
    hist = sizes.rollup(KEY, "size").agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("points"), F.grouping_id().alias("__g"))
    total = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("points"))
    hist = hist.where("__g = 0").drop("__g").unionByName(total.withColumn(KEY, F.lit(None).cast("string")))
    per_size = sizes.groupBy(KEY).agg(
        F.count_if(F.col("size") == 1).alias("single_cure_events"), F.count_if(F.col("size") > 1).alias("multi_cure_events"),
        F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)).alias("multi_cure_points"))
    marks = qc.where(limit & (F.col("event_id") != "")).select(KEY, "event_id").distinct().groupBy(KEY).agg(F.count(F.lit(1)).alias("limit_events"))
    n = lambda c, name: F.count_if(c).alias(name)
    flat = qc.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("observations"), n(fin == "valid", "valid"), n(fin == "rejected", "rejected"),
        n(src == "automatic_repeat", "repeats"), n(src == "automatic_short_interval", "short_intervals"),
        n(src == "automatic_duplicate_time", "duplicate_times"),
        n((src == "automatic_geometry") & (fin == "rejected"), "geometry"), n((src == "human") & (fin == "rejected"), "human_rejected"),
        n(limit, "limit_points"), n(open_ & (src == "automatic_review_required"), "local_unresolved"),
        n(open_ & (src != "automatic_review_required"), "upstream_uncertain"))
    flat = flat.join(per_size, KEY, "left").join(marks, KEY, "left").na.fill(0)
    counters = [c for c in flat.columns if c != KEY]
    rolled = flat.rollup(KEY).agg(*[F.sum(c).alias(c) for c in counters])
    return rolled, hist


def review_scope(obs: DataFrame, accepted: Column, *, hard_end: DataFrame | None = None, span_us: int | None = None) -> DataFrame:
    """Per platform: first accepted time, end of the review scope and why it ends there.

    ``hard_end``: platform_id, hard_end. The end is the first accepted fix at or after start + span,
    else the hard end (or the last time of the platform).
    """
    ok = _flag(accepted & F.col("time").isNotNull() & geo.position_valid("lon", "lat"))
    rows = obs if hard_end is None else obs.join(hard_end, KEY, "left")
    if hard_end is not None:
        ok = ok & (F.col("hard_end").isNull() | (F.col("time") <= F.col("hard_end")))
    limit = [F.max("time").alias("__z")] + ([F.max("hard_end").alias("hard_end")] if hard_end is not None else [])
    s = rows.groupBy(KEY).agg(F.min(F.when(ok, F.col("time"))).alias("start_time"), *limit)
    s = s.withColumn("__hard", F.coalesce("hard_end", "__z") if hard_end is not None else F.col("__z"))
    if span_us is None:
        return s.select(KEY, "start_time", F.col("__hard").alias("end_time"), F.lit("hard_stop").alias("end_reason"))
    target = F.unix_micros("start_time") + span_us
    reach = rows.where(ok).join(s.select(KEY, target.alias("__t")), KEY).where(F.unix_micros("time") >= F.col("__t")).groupBy(KEY).agg(F.min("time").alias("__q"))
    j = s.join(reach, KEY, "left")
    return j.select(KEY, "start_time", F.coalesce("__q", "__hard").alias("end_time"),
                    F.when(F.col("__q").isNotNull(), "maximum_span").otherwise("hard_stop").alias("end_reason"))


def review_chunks(obs: DataFrame, scope: DataFrame, width_us: int) -> DataFrame:
    """Fixed windows from the first in-scope fix; a chunk of invalid times comes last."""
    j = obs.join(scope.select(KEY, "end_time"), KEY)
    timed = j.where(F.col("time").isNotNull() & (F.col("time") <= F.col("end_time")))
    anchor = timed.groupBy(KEY).agg(F.min(F.unix_micros("time")).alias("__a"))
    timed = timed.join(anchor, KEY).withColumn("time_bin", F.floor((F.unix_micros("time") - F.col("__a")) / width_us).cast("long"))
    idx = [F.count(F.lit(1)).alias("n"), F.min("obs_index").alias("first_obs"), F.max("obs_index").alias("last_obs"),
           F.sum("obs_index").alias("__s"), F.bit_xor(F.xxhash64("obs_index")).alias("__x")]
    a = timed.groupBy(KEY, "time_bin").agg(F.timestamp_micros(F.first("__a") + F.col("time_bin") * width_us).alias("start_time"), *idx).withColumn("kind", F.lit("time"))
    b = j.where("time IS NULL").groupBy(KEY).agg(*idx).withColumn("kind", F.lit("invalid_time"))
    u = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(KEY).orderBy(F.col("kind") == "invalid_time", "time_bin")
    key = F.substring(F.sha2(F.concat_ws(":", KEY, "kind", "time_bin", F.lit(width_us), "n", "first_obs", "last_obs", "__s", "__x"), 256), 1, 24)
    return u.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("chunk_key", key).drop("__s", "__x")


def completion_issues(obs: DataFrame, chunks: DataFrame, reviewed: DataFrame, accepted: Column) -> DataFrame:
    """One row per platform and issue that blocks completion."""
    pending = chunks.join(reviewed.select("chunk_key"), "chunk_key", "left_anti").groupBy(KEY).agg(F.count(F.lit(1)).alias("pending"))
    ok = obs.where(_flag(accepted))
    good = F.col("time").isNotNull() & geo.position_valid("lon", "lat")
    facts = obs.select(KEY).distinct().join(ok.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("time").isNull()).alias("bad_time"),
        F.count_if(~geo.position_valid("lon", "lat")).alias("bad_position")), KEY, "left")
    twins = ok.where(good).groupBy(KEY, "time").agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy(KEY).agg(F.count(F.lit(1)).alias("twins"))
    j = facts.join(twins, KEY, "left").join(pending, KEY, "left").na.fill(0)
    few = F.col("n") < 2
    item = lambda cond, name, count: F.when(cond, F.struct(F.lit(name).alias("issue"), count.cast("long").alias("count")))
    issues = F.array(
        item(F.col("pending") > 0, "review_chunks_not_complete", F.col("pending")),
        item(few, "fewer_than_two_accepted", F.col("n")),
        item(~few & (F.col("bad_time") > 0), "accepted_invalid_timestamps", F.col("bad_time")),
        item(~few & (F.col("bad_position") > 0), "accepted_invalid_coordinates", F.col("bad_position")),
        item(~few & (F.col("twins") > 0), "accepted_timestamps_not_unique", F.col("twins")))
    return j.select(KEY, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i")).select(KEY, "i.*")


def adjacent_kinematics(obs: DataFrame, key=KEY, order=TRACK) -> DataFrame:
    """Ellipsoidal speed on the later row and acceleration on the row two edges share."""
    fix = F.struct("time", "lon", "lat", geo.position_valid("lon", "lat").alias("ok"))
    e = frames.scan(obs, key, order, lag={"prev": fix})
    dt = geo.seconds_between("prev.time", "time")
    usable = _flag(geo.position_valid("lon", "lat") & F.col("prev.ok") & (dt > 0))
    e = wgs84.with_inverse(e, "__g", *[F.when(usable, F.col(c)) for c in ("prev.lon", "prev.lat", "lon", "lat")])
    e = e.withColumns({"dt_s": F.when(usable, dt), "distance_m": F.when(usable, F.col("__g.s"))})
    e = e.withColumn("speed", F.col("distance_m") / F.col("dt_s"))
    az = F.radians("__g.az")
    e = e.withColumns({"v_east": F.col("speed") * F.sin(az), "v_north": F.col("speed") * F.cos(az)}).drop("__g", "prev")
    n = frames.scan(e, key, order, lead={"__n": F.struct("dt_s", "v_east", "v_north")})
    half = (F.col("dt_s") + F.col("__n.dt_s")) / 2
    bend = F.hypot(F.col("__n.v_east") - F.col("v_east"), F.col("__n.v_north") - F.col("v_north"))
    return n.withColumn("acceleration", F.when(half > 0, bend / half)).drop("__n")


def readiness(selected: DataFrame, finalised: DataFrame) -> DataFrame:
    """Selected platforms with their state: ready, or why they are pending.

    ``selected``: platform_id, source_hash, policy_hash. ``finalised``: the same plus current BOOLEAN.
    """
    f = finalised.select(KEY, F.col("source_hash").alias("fs"), F.col("policy_hash").alias("fp"), "current")
    j = selected.join(f, KEY, "left")
    state = (
        F.when(F.col("fs").isNull(), "not_yet_reviewed").when(F.col("fs") != F.col("source_hash"), "source_changed")
        .when(F.col("fp") != F.col("policy_hash"), "policy_changed").when(~F.col("current"), "stale").otherwise("ready")
    )
    return j.select(KEY, state.alias("state"))
