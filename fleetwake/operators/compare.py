"""Comparison of products and diagnostics of flagged edges (CM rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.functions import geo
from fleetwake.operators import audit, frames, grid

KEY = "platform_id"
TRACK = ["time", "obs_index"]
# Run classes and edge behaviours.
CLASSES = ("isolated_spike_candidate", "single_flagged_edge", "persistent_high_speed_run", "boundary_or_insufficient_context")
BEHAVIOURS = ("resolved_in_both", "resolved_in_30_only", "resolved_in_60_only", "remains_flagged_in_both", "missing_reconstructed_context")


def _no(c) -> Column:
    return F.coalesce(c, F.lit(False))


def _finite(g: DataFrame) -> DataFrame:
    ok = g.where("lon IS NOT NULL AND lat IS NOT NULL")
    ok = frames.cut_if_shuffled(ok.select(KEY, "source_gap_min"))
    q = frames.quantiles(ok, KEY, {"gap": F.col("source_gap_min")}, {"p50": 0.5, "p95": 0.95, "max": 1.0})
    return ok.groupBy(KEY).agg(F.count(F.lit(1)).alias("cells")).join(q.drop("gap_n"), KEY, "left")


def platform_comparison(grid_a: DataFrame, grid_b: DataFrame, platforms_a: DataFrame, platforms_b: DataFrame) -> DataFrame:
    """Presence, starts, assignments, finite counts and gaps of two products, each on its own support.

    ``platforms_*``: platform_id, start_time, array_id, cluster_id.
    """
    def side(p, g, s):
        j = p.select(KEY, "start_time", "array_id", "cluster_id").join(_finite(g), KEY, "left").na.fill(0, ["cells"])
        return j.select(KEY, *[F.col(c).alias(f"{c}_{s}") for c in j.columns if c != KEY], F.lit(True).alias(f"in_{s}"))

    j = side(platforms_a, grid_a, "a").join(side(platforms_b, grid_b, "b"), KEY, "full_outer")
    return j.withColumns({
        "in_a": _no(F.col("in_a")), "in_b": _no(F.col("in_b")),
        "start_difference_h": geo.seconds_between("start_time_a", "start_time_b") / 3600,
        "same_array": _no(F.col("array_id_a") == F.col("array_id_b")), "same_cluster": _no(F.col("cluster_id_a") == F.col("cluster_id_b"))})


def long_union(tables: dict[str, DataFrame]) -> DataFrame:
    """Result tables of several sources under a ``source`` column; absent columns become NULL."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("source", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def flagged_pairs(obs: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """(edges above the limit with their context, counts and rates per platform)."""
    ok = geo.position_valid("lon", "lat") & F.col("time").isNotNull()
    s = audit.consecutive_speed(obs.withColumn("__ok", ok))
    s = frames.scan(s, KEY, TRACK, lag={"__b": F.col("prev.ok")}, lead={"__a": F.col("__ok")}, total={"pos": F.lit(1).cast("long")})
    s = frames.cut(s)
    hit = s.where(F.col("speed") > limit).select(
        KEY, F.col("prev.obs_index").alias("obs_1"), F.col("obs_index").alias("obs_2"), F.col("prev.time").alias("time_1"), F.col("time").alias("time_2"),
        (F.col("dt_s") / 60).alias("dt_min"), "distance_m", "speed", "pos", (F.abs(F.col("obs_index") - F.col("prev.obs_index")) - 1).alias("source_rows_between"),
        (F.col("__b").isNotNull() & ~F.col("__b")).alias("invalid_before"), (F.col("__a").isNotNull() & ~F.col("__a")).alias("invalid_after"))
    blocked = F.col("prev").isNotNull() & ~(F.col("__ok") & F.col("prev.ok"))
    n = s.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("speed").alias("n_pairs"), F.count_if(F.col("speed") > limit).alias("n_flags"),
        F.count_if(blocked).alias("n_blocked"), F.count_if(blocked & F.col("speed").isNotNull()).alias("n_speeds_on_blocked"), F.max(F.when(F.col("speed") > limit, F.col("speed"))).alias("max_speed"))
    return hit, n.withColumn("flags_per_10000", F.when(F.col("n_pairs") > 0, 10000 * F.col("n_flags") / F.col("n_pairs")).otherwise(0.0))


def stored_mismatches(stored: DataFrame, recomputed: DataFrame, limit: float) -> DataFrame:
    """Rows whose stored speed or flag does not reproduce exactly."""
    j = stored.select(KEY, "obs_index", F.col("speed").alias("s0"), F.col("flag").alias("f0")).join(recomputed.select(KEY, "obs_index", "speed"), [KEY, "obs_index"])
    flag = _no(F.col("speed") > limit)
    return j.where(~F.col("s0").eqNullSafe(F.col("speed")) | (F.col("f0") != flag)).select(KEY, "obs_index")


def select_cases(flags: DataFrame, platforms: DataFrame, nominal_min: float = 5.0, tolerance_min: float = 1 / 60) -> DataFrame:
    """Ranked example cases; a pair chosen for several reasons keeps the first."""
    rank = [F.desc("speed"), KEY, "pos"]
    one = lambda d, order, k, name: d.orderBy(*order).limit(1).select(F.lit(k).alias("priority"), F.lit(name).alias("reason"), KEY, "obs_2", "speed", "distance_m", "dt_min")
    worst = platforms.orderBy(F.desc("n_flags"), KEY).limit(1).select(KEY)
    u = one(flags, rank, 0, "Largest speed")
    u = u.unionByName(one(flags, [F.desc("distance_m"), KEY, "pos"], 1, "Largest displacement"))
    u = u.unionByName(one(flags.where(F.abs(F.col("dt_min") - nominal_min) <= tolerance_min), rank, 2, "Largest speed at nominal cadence"))
    u = u.unionByName(one(flags.join(F.broadcast(worst), KEY), rank, 3, "Highest-count platform: its largest speed"))
    first = u.groupBy(KEY, "obs_2").agg(F.min("priority").alias("priority"))
    return u.join(first, [KEY, "obs_2", "priority"])


def jump_runs(rows: DataFrame, limit: float, *, max_gap_s: float = 1801.0, key=KEY, width: int = 1_000_000, clocks: dict | None = None):
    """(runs, middle points, edges) of consecutive flagged edges.

    ``rows``: key, pos (row number in stored order), time, lon, lat. Edges join neighbouring stored
    rows; the outer context and the skip-one bridge use the nearest valid rows. ``clocks`` (name to a
    function of microseconds and row) judges the rows under several clocks, named by ``scenario`` in all three:
    neighbours and distances, which no clock changes, are found once, and only flagged edges are made once for each.
    """
    k = frames.keys(key)
    ok = rows.where(F.col("time").isNotNull() & geo.position_valid("lon", "lat")).select(*k, F.col("pos").alias("row"), "time", "lon", "lat")
    b = frames.blocks(ok, k, "row", halo=4, width=width)
    w = frames.block_window(k)
    fix = F.struct("row", "time", "lon", "lat")
    b = frames.core(b.withColumns({"A": F.lag(fix, 1).over(w), "P": F.lag(fix, 2).over(w), "C": F.lead(fix, 1).over(w), "D": F.lead(fix, 2).over(w), "B": fix}))
    sides = ("AB", "BC", "AC", "PA", "CD")
    b = b.withColumns({f"d_{a}{c}": geo.haversine(f"{a}.lon", f"{a}.lat", f"{c}.lon", f"{c}.lat") for a, c in sides})
    cases = F.array(*[
        F.struct(F.lit(name).alias("scenario"), *[clock(F.unix_micros(f"{f}.time"), F.col(f"{f}.row")).alias(f) for f in "PABCD"])
        for name, clock in (clocks or {"": lambda t, _: t}).items()])
    seconds = lambda c, n: (c[n[1]] - c[n[0]]) / F.lit(1e6)
    flag = lambda c: _no((F.col("A.row") == F.col("row") - 1) & (geo.speed_over("d_AB", seconds(c, "AB")) > limit))
    b = b.withColumn("__c", F.explode(F.filter(cases, flag)))
    if clocks:
        b, k = b.withColumn("scenario", F.col("__c.scenario")), ["scenario", *k]
    b = b.withColumns({f"dt_{n}": seconds(F.col("__c"), n) for n in sides})
    b = b.withColumns({f"v_{n}": geo.speed_over(f"d_{n}", f"dt_{n}") for n in sides})
    b = b.withColumns({
        "flag_before": _no((F.col("P.row") == F.col("A.row") - 1) & (F.col("v_PA") > limit)),
        "flag_after": _no((F.col("C.row") == F.col("row") + 1) & (F.col("v_BC") > limit))})
    fine = lambda n: _no((F.col(f"dt_{n}") > 0) & (F.col(f"dt_{n}") <= max_gap_s) & F.col(f"v_{n}").isNotNull())
    b = b.withColumns({
        "usable_PA": fine("PA"), "usable_CD": fine("CD"), "usable_BC": fine("BC"),
        "triplet_usable": fine("AB") & fine("BC") & fine("AC")})
    b = b.withColumn("passes", F.col("flag_after") & F.col("triplet_usable") & _no(F.col("v_AC") <= limit))
    place = lambda f: F.struct(*[F.col(f"{f}.{c}").alias(c) for c in ("lon", "lat")])
    hot = b.select(
        *k, "row", "lon", "lat", place("A").alias("A"), place("C").alias("C"), F.timestamp_micros("__c.A").alias("from"), F.timestamp_micros("__c.B").alias("time"), "dt_AB", "v_AB", "v_AC", "v_BC", "v_PA", "v_CD",
        "flag_before", "flag_after", "usable_PA", "usable_CD", "usable_BC", "triplet_usable", "passes", (~F.col("flag_before")).alias("__start"))
    hot = frames.cut(frames.islands(hot, k, "row", F.col("__start"), width=width, out="run"))
    g = [*k, "run"]
    head, tail = F.col("__start"), ~F.col("flag_after")
    runs = hot.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n_edges"), (F.min("row") - 1).alias("row_start"), F.max("row").alias("row_end"), F.min("from").alias("start_time"), F.max("time").alias("end_time"),
        F.max("v_AB").alias("max_speed"), F.sum(F.col("v_AB") * F.col("dt_AB")).alias("distance_m"),
        F.bool_or(F.col("dt_AB") > max_gap_s).alias("wide"), F.bool_or(head & F.col("usable_PA")).alias("before_usable"), F.bool_or(tail & F.col("usable_BC")).alias("after_usable"),
        F.bool_or((head & F.col("usable_PA") & (F.col("v_PA") > limit)) | (tail & F.col("usable_BC") & (F.col("v_BC") > limit))).alias("outer_above"),
        F.coalesce(F.bool_and(F.when(F.col("flag_after"), F.col("triplet_usable"))), F.lit(True)).alias("triplets_usable"),
        F.count_if("passes").alias("candidates"), F.min(F.when(F.col("passes"), F.col("row"))).alias("first_candidate"))
    n = F.col("n_edges")
    label = (
        F.when(F.col("wide"), CLASSES[3]).when(n == 1, F.when(F.col("before_usable") & F.col("after_usable"), CLASSES[1]).otherwise(CLASSES[3]))
        .when(~F.col("triplets_usable"), CLASSES[3]).when((n == 2) & (F.col("candidates") > 0), CLASSES[0]).otherwise(CLASSES[2])
    )
    why = (
        F.when(F.col("wide"), "flagged_edge_exceeds_local_gap_limit")
        .when(n == 1, F.when(F.col("before_usable") & F.col("after_usable"), "one_existing_flagged_edge_with_nearby_valid_context").otherwise("missing_nonpositive_or_distant_outer_context"))
        .when(~F.col("triplets_usable"), "skip_one_context_missing_or_exceeds_gap_limit")
        .when((n == 2) & (F.col("candidates") > 0), "two_flagged_legs_replaced_by_one_reasonable_bridge")
        .when(n > 2, "more_than_two_flagged_edges_cannot_be_resolved_by_one_point").otherwise("skip_one_bridge_remains_above_threshold")
    )
    runs = runs.withColumns({"class": label, "class_reason": why}).withColumn("suspect", F.when(F.col("class") == CLASSES[0], F.col("first_candidate"))).drop("wide", "triplets_usable", "first_candidate")
    runs = frames.cut(runs)
    points = hot.where("flag_after").join(runs.select(*g, "class"), g).select(
        *g, "row", "class", "passes", F.col("v_AC").alias("bridge_speed"), geo.turning_angle(("A.lon", "A.lat"), ("lon", "lat"), ("C.lon", "C.lat")).alias("turn_deg"),
        (F.col("usable_PA") & F.col("usable_CD")).alias("outer_usable"),
        ((F.col("usable_PA") & (F.col("v_PA") > limit)) | (F.col("usable_CD") & (F.col("v_CD") > limit))).alias("outer_above"))
    support = points.where("passes").select(*g, F.explode(F.array("row", F.col("row") + 1)).alias("row")).groupBy(*g, "row").agg(F.count(F.lit(1)).alias("support"))
    edges = hot.select(*g, "row", F.col("v_AB").alias("speed"), F.col("dt_AB").alias("dt_s")).join(runs.select(*g, "class", "n_edges"), g).join(support, [*g, "row"], "left").na.fill(0, ["support"])
    return runs, points, edges


def clock_sensitivity(rows: DataFrame, limit: float, **kw) -> DataFrame:
    """Changed flags, edge classes and candidates under rounded and jittered clocks, per platform."""
    sign = lambda row: F.when(row % 2 == 0, 10).otherwise(-10)
    names = ["nearest_second", "plus_minus_10_us", "minus_plus_10_us"]
    _, points, edges = jump_runs(rows, limit, **kw, clocks={
        "stored": lambda t, _: t, names[0]: lambda t, _: F.round(t / F.lit(1e6)).cast("long") * 1_000_000,
        names[1]: lambda t, row: t + sign(row), names[2]: lambda t, row: t - sign(row)})
    found = edges.select("scenario", KEY, "row", "class", F.lit(None).cast("boolean").alias("passes")).unionByName(
        points.where("passes").select("scenario", KEY, "row", F.lit(None).cast("string").alias("class"), "passes"))
    # One row for each edge flagged under some clock: its class and verdict under every clock.
    under = lambda n, c: F.max(F.when(F.col("scenario") == n, F.col(c)))
    wide = found.groupBy(KEY, "row").agg(*[under(n, c).alias(f"{c}_{n}") for n in ("stored", *names) for c in ("class", "passes")])
    was = lambda n, c: F.col(f"{c}_{n}")
    moved = wide.groupBy(KEY).agg(F.array(*[F.struct(
        F.lit(n).alias("scenario"),
        F.count_if(was(n, "class").isNull() != was("stored", "class").isNull()).alias("changed_flags"),
        F.count_if(~was(n, "class").eqNullSafe(was("stored", "class"))).alias("changed_classes"),
        F.count_if(~was(n, "passes").eqNullSafe(was("stored", "passes"))).alias("changed_candidates")) for n in names]).alias("__m"))
    moved = moved.select(KEY, F.explode("__m").alias("__m")).select("__m.scenario", KEY, "__m.changed_flags", "__m.changed_classes", "__m.changed_candidates")
    base = rows.select(KEY).distinct().withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in names])))
    return base.join(moved, ["scenario", KEY], "left").na.fill(0)


def sustained_start(obs: DataFrame, *, gap_min: float, min_obs: int, min_duration_min: float, tolerance_s: float = 1.0, near_min: float = 5.0):
    """(segments of valid fixes, inferred start per platform with its status)."""
    ok = obs.where(F.col("time").isNotNull() & geo.position_valid("lon", "lat"))
    s = frames.scan(ok, KEY, TRACK, lag={"__p": F.unix_micros("time")})
    s = s.withColumn("gap_s", (F.unix_micros("time") - F.col("__p")) / F.lit(1e6)).drop("__p")
    s = frames.cut(frames.islands(s, KEY, TRACK, F.col("gap_s") > gap_min * 60 + tolerance_s, out="segment"))
    limit = gap_min * 60 + tolerance_s
    seg = s.groupBy(KEY, "segment").agg(
        F.min("time").alias("start"), F.max("time").alias("end"), F.count(F.lit(1)).alias("n"),
        (F.count_if((F.col("gap_s") > 0) & (F.col("gap_s") <= limit)) + 1).alias("n_distinct"), F.min_by("obs_index", F.struct(*TRACK)).alias("start_obs"))
    seg = frames.cut(seg.withColumn("duration_s", geo.seconds_between("start", "end")))
    good = (F.col("n") >= min_obs) & (F.col("n_distinct") >= min_obs) & (F.col("duration_s") >= min_duration_min * 60 - tolerance_s)
    first = seg.where(good).groupBy(KEY).agg(F.min_by(F.struct("segment", "start", "n", "duration_s", "start_obs"), "segment").alias("c"))
    j = seg.join(first, KEY, "left")
    out = j.groupBy(KEY).agg(
        F.first("c").alias("c"), F.min("start").alias("first_valid"), F.count(F.lit(1)).alias("segments"),
        F.sum(F.when(F.col("segment") < F.col("c.segment"), F.col("n")).otherwise(0)).alias("positions_before"))
    delta = geo.seconds_between("first_valid", "c.start")
    k = F.col("c.segment")
    status = F.when(F.col("c").isNull(), "no_sustained_segment_found").when(k > 1, "multiple_early_segments").when(k == 1, "earlier_isolated_fragment_removed").otherwise("same_or_nearly_same")
    return seg, out.select(KEY, F.col("c.start").alias("inferred_start"), (delta / 3600).alias("delay_h"), "segments", k.alias("segments_before"),
                           F.when(F.col("c").isNotNull(), F.col("positions_before")).alias("positions_before"), status.alias("start_status"),
                           _no(delta <= near_min * 60 + tolerance_s).alias("nearly_same"))


def gap_distribution(obs: DataFrame, thresholds_min=(10, 15, 20, 30, 60, 360, 1440), tolerance_s: float = 1.0) -> DataFrame:
    """Quantiles of all gaps of the fleet and how many exceed each threshold, one row."""
    ok = obs.where(F.col("time").isNotNull() & geo.position_valid("lon", "lat"))
    s = frames.scan(ok, KEY, TRACK, lag={"__p": F.unix_micros("time")}).select(KEY, ((F.unix_micros("time") - F.col("__p")) / F.lit(1e6)).alias("g"))
    s = frames.cut(s)
    q = frames.quantiles(s.withColumn("all", F.lit(0)), "all", {"gap": F.col("g")}, {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999, "max": 1.0}, few=True).drop("all")
    n = s.agg(F.count_distinct(KEY).alias("tracks"), F.count(F.lit(1)).alias("positions"), F.count_if(F.col("g") == 0).alias("zero_gaps"),
              *[F.count_if(F.col("g") > m * 60).alias(f"over_{m}") for m in thresholds_min], *[F.count_if(F.col("g") > m * 60 + tolerance_s).alias(f"over_{m}_adjusted") for m in thresholds_min])
    return n.join(q)


def match_nearest(queries: DataFrame, stored: DataFrame, tolerance_s: float = 1.0, key=KEY) -> DataFrame:
    """Stored time nearest to each query time; ties and duplicated stamps are ambiguous.

    ``queries``: key, time and more columns; ``stored``: key, time. Adds matched_time, status, offset_us.
    """
    k = frames.keys(key)
    stamps = stored.where("time IS NOT NULL").groupBy(*k, "time").agg(F.count(F.lit(1)).alias("copies"))
    b = grid.brackets(stamps, queries, ["copies"], key)
    t = F.unix_micros("time")
    before, after = t - F.unix_micros("p.time"), F.unix_micros("n.time") - t
    same = F.col("p.time").eqNullSafe(F.col("n.time")) | (before == 0)
    use_p = (before == 0) | F.col("n").isNull() | (before < after)
    best = F.when(use_p & F.col("p").isNotNull(), F.col("p")).otherwise(F.col("n"))
    b = b.withColumns({"__best": best, "__tie": _no((before == after) & (before > 0))})
    off = F.unix_micros("__best.time") - t
    status = (
        F.when(F.col("__best").isNull() | (F.abs(off) > tolerance_s * 1e6), "no_timestamp_within_tolerance")
        .when(F.col("__tie") | (F.col("__best.copies") > 1), "ambiguous_duplicate_or_equidistant_timestamp").otherwise("matched")
    )
    b = b.withColumn("match_status", status)
    hit = F.col("match_status") == "matched"
    return b.withColumns({"matched_time": F.when(hit, F.col("__best.time")), "offset_us": F.when(hit, off)}).drop("p", "n", "__best", "__tie")


def compare_edges(edges: DataFrame, tracks: dict[str, DataFrame], limit: float, tolerance_s: float = 1.0) -> DataFrame:
    """Flagged native edges looked up in two other representations and what became of them.

    ``edges``: platform_id, edge_id, time_1, time_2. ``tracks``: name → platform_id, time, lon, lat.
    """
    out = edges
    names = list(tracks)
    for name, t in tracks.items():
        ends = edges.select(KEY, "edge_id", F.explode(F.array(F.struct(F.lit(1).alias("e"), F.col("time_1").alias("time")), F.struct(F.lit(2).alias("e"), F.col("time_2").alias("time")))).alias("x")).select(KEY, "edge_id", "x.*")
        m = match_nearest(ends, t, tolerance_s).select(KEY, "edge_id", "e", F.col("matched_time").alias("time"))
        pos = m.join(t.select(KEY, "time", "lon", "lat"), [KEY, "time"], "left")
        at = lambda i: F.max(F.when(F.col("e") == i, F.struct("time", "lon", "lat")))
        p = pos.groupBy(KEY, "edge_id").agg(at(1).alias("a"), at(2).alias("b"))
        dt = geo.seconds_between("a.time", "b.time")
        v = geo.speed_over(geo.haversine("a.lon", "a.lat", "b.lon", "b.lat"), dt)
        out = out.join(p.select(KEY, "edge_id", v.alias(f"{name}_speed")), [KEY, "edge_id"], "left")
    a, b = (F.col(f"{n}_speed") for n in names)
    kind = (
        F.when(a.isNull() | b.isNull(), BEHAVIOURS[4]).when((a <= limit) & (b <= limit), BEHAVIOURS[0])
        .when(a <= limit, BEHAVIOURS[1]).when(b <= limit, BEHAVIOURS[2]).otherwise(BEHAVIOURS[3])
    )
    return out.withColumn("behaviour", kind)


def overlap_association(edges: DataFrame, known: DataFrame, *, match_s: float = 1.0, overlap_s: float = 1.0, bucket_us: int = 21_600_000_000) -> DataFrame:
    """Exact, near or overlapping known interval of every edge; intervals meet through time buckets.

    Both sides: platform_id, edge_id, time_1, time_2.
    """
    def cut_up(d, pre):
        a, z = F.floor((F.unix_micros("time_1") - round(match_s * 1e6)) / bucket_us), F.floor((F.unix_micros("time_2") + round(match_s * 1e6)) / bucket_us)
        return d.select(KEY, F.col("edge_id").alias(f"{pre}id"), F.unix_micros("time_1").alias(f"{pre}a"), F.unix_micros("time_2").alias(f"{pre}z"), F.explode(F.sequence(a.cast("long"), z.cast("long"))).alias("bucket"))

    j = cut_up(edges, "e").join(cut_up(known, "k"), [KEY, "bucket"])
    tol = match_s * 1e6
    j = j.groupBy(KEY, F.col("eid").alias("edge_id")).agg(
        F.bool_or((F.col("ea") == F.col("ka")) & (F.col("ez") == F.col("kz"))).alias("exact"),
        F.bool_or((F.abs(F.col("ea") - F.col("ka")) <= tol) & (F.abs(F.col("ez") - F.col("kz")) <= tol)).alias("near"),
        F.max(F.greatest(F.lit(0), F.least("ez", "kz") - F.greatest("ea", "ka")) / F.lit(1e6)).alias("overlap_s"))
    out = edges.join(j, [KEY, "edge_id"], "left")
    out = out.withColumns({"exact": _no(F.col("exact")), "near": _no(F.col("near")), "overlap_s": F.coalesce("overlap_s", F.lit(0.0))})
    return out.withColumn("associated", F.col("exact") | F.col("near") | (F.col("overlap_s") > overlap_s))


def series_metrics(obs: DataFrame, prefix: str) -> DataFrame:
    """First, last and second distinct time, first valid fix and counts per platform."""
    t_ok = F.col("time").isNotNull()
    ok = t_ok & geo.position_valid("lon", "lat")
    m = obs.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_if(ok).alias("n_valid"), F.count_if(~t_ok).alias("n_invalid_times"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.min(F.when(ok, F.col("time"))).alias("first_valid_time"))
    j = obs.join(m.select(KEY, "first_time", "first_valid_time"), KEY)
    later = j.groupBy(KEY).agg(F.min(F.when(F.col("time") > F.col("first_time"), F.col("time"))).alias("second_time"),
                               F.count_if(F.col("time") < F.col("first_valid_time")).alias("rows_before_first_valid"))
    out = m.join(later, KEY)
    return out.select(KEY, *[F.col(c).alias(f"{prefix}_{c}") for c in out.columns if c != KEY])


def compare_series(raw: DataFrame, qc: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """Timing deltas of two versions and whether early rows were omitted or kept without a position."""
    r, q = series_metrics(raw, "raw"), series_metrics(qc, "qc")
    j = r.join(q, KEY, "full_outer")
    starts = q.select(KEY, "qc_first_valid_time")
    early = raw.join(starts, KEY).where(F.unix_micros("time") < F.unix_micros("qc_first_valid_time") - round(tolerance_s * 1e6)).select(KEY, "time", "obs_index")
    m = match_near(early, qc, tolerance_s)
    e = m.groupBy(KEY).agg(F.count(F.lit(1)).alias("early_rows"), F.count_if("near").alias("early_masked"))
    j = j.join(e, KEY, "left").na.fill(0, ["early_rows", "early_masked"])
    h = lambda a, b: geo.seconds_between(a, b) / 3600
    return j.withColumns({
        "early_omitted": F.col("early_rows") - F.col("early_masked"), "delay_first_h": h("raw_first_time", "qc_first_time"),
        "delay_valid_h": h("raw_first_valid_time", "qc_first_valid_time"), "delay_first_to_valid_h": h("raw_first_time", "qc_first_valid_time"),
        "qc_first_precedes_valid": _no(geo.seconds_between("qc_first_time", "qc_first_valid_time") > tolerance_s)})


def match_near(queries: DataFrame, reference: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """``near``: a reference time of the platform lies within the tolerance (duplicates are fine)."""
    b = grid.brackets(reference.where("time IS NOT NULL").select(KEY, "time").distinct(), queries, [])
    t, tol = F.unix_micros("time"), round(tolerance_s * 1e6)
    near = _no(t - F.unix_micros("p.time") <= tol) | _no(F.unix_micros("n.time") - t <= tol)
    return b.withColumn("near", near).drop("p", "n")


def matching_report(raw_sources: DataFrame, qc_sources: DataFrame) -> DataFrame:
    """Platforms by source counts on both sides: matched, missing on one side or ambiguous."""
    a = raw_sources.groupBy(KEY).agg(F.count(F.lit(1)).alias("raw_sources"))
    b = qc_sources.groupBy(KEY).agg(F.count(F.lit(1)).alias("qc_sources"))
    j = a.join(b, KEY, "full_outer").na.fill(0)
    kind = (F.when(F.col("raw_sources") == 0, "qc_without_raw").when(F.col("qc_sources") == 0, "raw_without_qc")
            .when((F.col("raw_sources") == 1) & (F.col("qc_sources") == 1), "matched").otherwise("ambiguous"))
    return j.withColumn("match_status", kind)


def import_audit(tracks: DataFrame, spans: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row per platform: rows, finite rows, span, coverage span and assignment."""
    t = tracks.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("lon").isNotNull() & F.col("lat").isNotNull()).alias("finite_rows"),
                                F.min("time").alias("record_start"), F.max("time").alias("record_end"))
    return t.join(spans.select(KEY, F.col("start").alias("coverage_start"), F.col("end").alias("coverage_end")), KEY, "left").join(
        assignments.select(KEY, "array_id", "cluster_id", "member_id"), KEY, "left")


def flag_summary(flags: DataFrame, platforms: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """Totals, duration classes, quantiles and the share of the worst platforms, one row."""
    f = frames.cut_if_shuffled(flags.withColumn("all", F.lit(0)))
    probs = {"min": 0.0, "median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}
    q = frames.quantiles(f, "all", {"speed": F.col("speed"), "distance": F.col("distance_m"), "dt": F.col("dt_min")}, probs, few=True).drop("all")
    tol = tolerance_s / 60
    n = f.agg(
        F.count(F.lit(1)).alias("flags"), F.count_if(F.col("invalid_before") | F.col("invalid_after")).alias("near_invalid"), F.count_if(F.col("source_rows_between") != 0).alias("nonadjacent_sources"),
        *[F.count_if(F.col("dt_min") <= m + tol).alias(f"dt_le_{m}") for m in (6, 10)], *[F.count_if(F.col("dt_min") > m + tol).alias(f"dt_gt_{m}") for m in (10, 30)])
    p = platforms.agg(F.count_if(F.col("n_flags") > 0).alias("affected"), F.max("n_flags").alias("__top"), F.sum("n_rows").alias("rows"), F.sum("n_pairs").alias("pairs"))
    ten = platforms.orderBy(F.desc("n_flags"), KEY).limit(10).agg(F.sum("n_flags").alias("__ten"))
    j = n.join(q, how="left").join(p).join(ten)
    share = lambda c: F.when(F.col("flags") > 0, 100 * F.col(c) / F.col("flags")).otherwise(0.0)
    return j.withColumns({"top_1_percent": share("__top"), "top_10_percent": share("__ten")}).drop("__top", "__ten")


def case_context(obs: DataFrame, cases: DataFrame, minutes: float = 45.0) -> DataFrame:
    """Rows around the chosen cases, which meet them in time cells of the span around a case.

    ``cases``: case_id, platform_id, time_2.
    """
    width = max(1, round(minutes * 60e6))
    cell = F.floor(F.unix_micros("time") / width)
    c = cases.select("case_id", KEY, F.col("time_2").alias("__t"))
    c = c.withColumn("__c", F.explode(F.array(*[F.floor(F.unix_micros("__t") / width) + i for i in (-1, 0, 1)])))
    off = geo.seconds_between("__t", "time") / 60
    return obs.withColumn("__c", cell).join(c, [KEY, "__c"]).drop("__c").withColumn("offset_min", off).where(F.abs("offset_min") <= minutes).drop("__t")


def run_summary(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts per class, counts per platform and class, run-length histogram)."""
    c = runs.groupBy("class").agg(F.count(F.lit(1)).alias("runs"), F.sum("n_edges").alias("edges"), F.count_distinct(KEY).alias("platforms"))
    p = runs.groupBy(KEY).pivot("class", list(CLASSES)).agg(F.count(F.lit(1))).na.fill(0)
    return c, p, runs.groupBy("n_edges").agg(F.count(F.lit(1)).alias("runs"))


def choose_examples(runs: DataFrame, per_class: int = 3) -> DataFrame:
    """Up to three runs of the isolated and the persistent class by fixed priorities, no run twice."""
    clean = F.col("before_usable") & F.col("after_usable") & ~F.col("outer_above")
    iso, per = runs.where(F.col("class") == CLASSES[0]), runs.where(F.col("class") == CLASSES[2])
    fast, slow = [F.desc("max_speed"), KEY, "run"], [F.asc("max_speed"), F.desc(KEY), F.desc("run")]
    pick = lambda d, order, n, k: d.orderBy(*order).limit(n).select(F.lit(k).alias("priority"), "class", KEY, "run", "max_speed", "n_edges")
    u = pick(iso.where(clean), fast, 1, 0).unionByName(pick(iso, fast, 1, 1)).unionByName(pick(iso.where(clean), slow, 1, 2)).unionByName(pick(iso, fast, per_class, 3))
    u = u.unionByName(pick(per, [F.desc("n_edges"), F.desc("max_speed"), KEY, "run"], 1, 0)).unionByName(pick(per, fast, per_class, 1))
    best = u.groupBy("class", KEY, "run").agg(F.min("priority").alias("priority"), F.first("max_speed").alias("max_speed"), F.first("n_edges").alias("n_edges"))
    w = Window.partitionBy("class").orderBy("priority", F.desc("max_speed"), KEY, "run")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_class)


def compare_starts(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Platforms of the candidate whose inferred start differs from the baseline."""
    b = baseline.select(KEY, F.col("inferred_start").alias("baseline_start"))
    j = candidate.select(KEY, F.col("inferred_start").alias("candidate_start")).join(b, KEY, "left")
    return j.where(~F.col("candidate_start").eqNullSafe(F.col("baseline_start"))).withColumn("delta_h", geo.seconds_between("baseline_start", "candidate_start") / 3600)


def representation_summary(compared: DataFrame, by: str = "class", speeds: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(behaviour counts per class, median / p95 / max of the speeds per representation)."""
    c = compared.groupBy(by).pivot("behaviour", list(BEHAVIOURS)).agg(F.count(F.lit(1))).na.fill(0)
    q = frames.quantiles(frames.cut_if_shuffled(compared.withColumn("all", F.lit(0))), "all", {s: F.col(s) for s in speeds}, {"median": 0.5, "p95": 0.95, "max": 1.0}, few=True).drop("all")
    return c, q


def timing_summary(compared: DataFrame, cohort: Column, tolerance_s: float = 1.0) -> DataFrame:
    """Delays per cohort with a dead band of the tolerance, and mismatch counts."""
    band = tolerance_s / 3600
    zero = lambda c: F.when(F.abs(c) <= band, 0.0).otherwise(F.col(c))
    d = compared.withColumn("cohort", cohort)
    aggs = []
    delays = ("delay_first_h", "delay_valid_h", "delay_first_to_valid_h")
    for c in delays:
        aggs += [F.min(zero(c)).alias(f"{c}_min"), F.max(zero(c)).alias(f"{c}_max")]
    middle = frames.quantiles(d, "cohort", {c: zero(c) for c in delays}, {"median": 0.5}).drop(*[f"{c}_n" for c in delays])
    out = d.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count_if("qc_first_precedes_valid").alias("first_precedes_valid"),
                                F.count_if(F.abs("delay_first_h") <= band).alias("equal_first_times"), *aggs)
    same = out["cohort"].eqNullSafe(middle["cohort"])
    return out.join(middle, same, "left").drop(middle["cohort"])
