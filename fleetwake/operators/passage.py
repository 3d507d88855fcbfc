"""First-passage scale statistics of pair distances (FS rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.functions import wgs84
from fleetwake.functions.bins import bin_index, bin_table
from fleetwake.operators import frames
from fleetwake.operators.pairs import near_pairs

KEY = "platform_id"
PAIR = "pair_id"
DAY_US = 86_400_000_000


def _shells(spark, edges: list[float]) -> DataFrame:
    return bin_table(spark, edges).select(F.col("bin").alias("shell"), "lower", "upper")


def contiguous(series: DataFrame, interval_s: float, keys=(PAIR,)) -> tuple[DataFrame, DataFrame]:
    """(rows before the first missing or off-cadence sample, termination per pair)."""
    k = list(keys)
    s = frames.scan(series, k, "time", lag={"__p": F.unix_micros("time")})
    missing = F.col("distance_km").isNull() | F.isnan("distance_km")
    step = F.coalesce(F.abs((F.unix_micros("time") - F.col("__p")) / F.lit(1e6) - interval_s) > 1e-6, F.lit(False))
    s = s.withColumn("__bad", F.when(missing, "missing_coordinate_or_time").when(step, "time_step_mismatch")).drop("__p")
    s = frames.cut_if_shuffled(s)
    end = s.groupBy(*k).agg(F.min(F.when(F.col("__bad").isNotNull(), F.struct("time", "__bad"))).alias("b"), F.max("time").alias("__z"))
    end = end.select(*k, F.col("b.time").alias("stop_time"), F.coalesce("b.__bad", F.lit("track_end")).alias("termination_reason"))
    ok = s.join(end, k).where(F.col("stop_time").isNull() | (F.col("time") < F.col("stop_time"))).drop("__bad", "stop_time", "termination_reason")
    return ok, end


def _chunk(time: str = "time") -> Column:
    return F.floor(F.unix_micros(time) / F.lit(frames.CHUNK_US)).cast("long")


def _later(rows: DataFrame, k: list[str], events: dict[str, Column]) -> DataFrame:
    """For every (pair, chunk): the earliest of each event in the chunks after it.

    An event is a struct that begins with its time, NULL on other rows. One row for each chunk is
    carried backwards along a pair, so what comes next is known without looking at the series again.
    """
    first = rows.groupBy(*k, "chunk").agg(*[F.min(e).alias(n) for n, e in events.items()])
    after = Window.partitionBy(*k).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    return first.select(*k, "chunk", *[F.min(n).over(after).alias(n) for n in events])


def _of_shell(prefix: str, n: int) -> Column:
    return F.get(F.array(*[F.col(f"{prefix}{i}") for i in range(n)]), F.col("shell"))


def first_passages(series: DataFrame, edges: list[float], interval_s: float, keys=(PAIR,)) -> DataFrame:
    """Pair mode: the clock starts at the first sample in [δ, ρδ), stops at the first later one above ρδ.

    A sample can start only the shell it lies in, so entries need one pass without a shell join. An
    exit lies in the chunk of its entry, or is the next exceedance of that chunk (:func:`_later`); entries meet
    no other samples.
    """
    k, n = list(keys), len(edges) - 1
    ok, end = contiguous(series, interval_s, keys)
    ok = frames.cut(ok.select(*k, "time", "distance_km", _chunk().alias("chunk")).withColumn("shell", bin_index("distance_km", edges)))
    # Half-open: the closed top edge of the bins belongs to no shell.
    inside = (F.col("shell") >= 0) & (F.col("shell") < n) & (F.col("distance_km") < edges[-1])
    entry = ok.where(inside).groupBy(*k, "shell").agg(F.min_by(F.struct("time", "distance_km", "chunk"), "time").alias("e")).select(
        *k, "shell", F.col("e.time").alias("entry_time"), F.col("e.distance_km").alias("entry_km"), F.col("e.chunk").alias("chunk"))
    shells = _shells(series.sparkSession, edges)
    clocks = entry.join(F.broadcast(shells), "shell")
    sample = F.struct("time", "distance_km")
    later = _later(ok, k, {f"x{i}": F.when(F.col("distance_km") > edges[i + 1], sample) for i in range(n)})
    here = clocks.join(ok.select(*k, "chunk", "time", "distance_km"), [*k, "chunk"]).where((F.col("time") > F.col("entry_time")) & (F.col("distance_km") > F.col("upper")))
    here = here.groupBy(*k, "shell").agg(F.min(sample).alias("near"))
    exits = clocks.select(*k, "shell", "chunk").join(later, [*k, "chunk"]).join(here, [*k, "shell"], "left").select(
        *k, "shell", F.coalesce("near", _of_shell("x", n)).alias("x"))
    entry = entry.drop("chunk")
    last = ok.groupBy(*k).agg(F.max("time").alias("last_time"))
    dense = end.join(last, k).crossJoin(F.broadcast(shells))
    j = dense.join(entry, [*k, "shell"], "left").join(exits, [*k, "shell"], "left")
    ended = F.col("termination_reason") == "track_end"
    status = (
        F.when(F.col("entry_time").isNull(), F.when(ended, "not_observed_in_shell").otherwise("not_observed_before_gap"))
        .when(F.col("x").isNull(), F.when(ended, "right_censored_track_end").otherwise("right_censored_gap")).otherwise("reached")
    )
    days = (F.unix_micros("x.time") - F.unix_micros("entry_time")) / F.lit(float(DAY_US))
    return j.select(
        *k, "shell", F.col("lower").alias("scale_lower_km"), F.col("upper").alias("scale_upper_km"), status.alias("status"), "termination_reason",
        "entry_time", F.col("x.time").alias("exit_time"), F.when(F.col("x").isNull(), F.col("last_time")).alias("censor_time"),
        "entry_km", F.col("x.distance_km").alias("exit_km"), days.alias("passage_days"), F.log(F.col("x.distance_km") / F.col("entry_km")).alias("log_growth"))


def observed_passages(series: DataFrame, edges: list[float], interval_s: float, *, policy: str = "strict_observed",
                      max_gap_min: float | None = None, keys=(PAIR,)) -> DataFrame:
    """Observed mode: an entry must be witnessed from below; exits reach the upper threshold.

    ``series`` has one row per scheduled time (distance NULL where missing) and source_gap_min when
    a gap limit is set. Strict passages end at the first missing sample or irregular step, bridging
    ones only at the gap limit.
    """
    if policy not in ("strict_observed", "bridge_missing"):
        raise ValueError(f"unknown policy {policy!r}")
    k = list(keys)
    d = F.col("distance_km")
    have = d.isNotNull() & ~F.isnan(F.coalesce(d, F.lit(0.0)))
    hard = F.lit(False) if max_gap_min is None else have & ~F.coalesce(F.col("source_gap_min") <= max_gap_min, F.lit(False))
    s = series.withColumns({"__hard": hard, "__ok": have & F.coalesce(d >= 0, F.lit(False)) & ~hard})
    tv = F.when(F.col("__ok"), F.col("time"))
    s = frames.scan(s, k, "time", lag={"__p": F.struct("time", "distance_km", "__ok")}, last={"__seen": tv})
    s = frames.scan(s, k, "time", lag={"__pv": F.col("__seen")}, total={"__miss": (~F.col("__ok")).cast("long")})
    step_ok = F.coalesce(F.abs((F.unix_micros("time") - F.unix_micros("__p.time")) / F.lit(1e6) - interval_s) <= 1e-6, F.lit(False))
    gap = (F.unix_micros("time") - F.unix_micros("__pv")) / F.lit(60e6)
    s = s.withColumns({
        "__adj": step_ok, "__first": F.col("__p").isNull(), "__gap": F.when(F.col("__ok"), gap),
        "shell": F.when(F.col("__ok") & (d < edges[-1]), bin_index("distance_km", edges)),
    })
    shells = _shells(series.sparkSession, edges)
    lower = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("shell") + 1)
    begins = F.when(F.col("shell") >= 0, (F.col("__adj") & F.col("__p.__ok") & (F.col("__p.distance_km") < lower)) | (F.col("__first") & (d == lower)))
    if policy == "strict_observed":
        fault = F.when(F.col("__hard"), 1).when(~F.col("__ok"), 2).when(~F.col("__adj"), 3)
    else:
        fault = F.when(F.col("__hard"), 1)
        if max_gap_min is not None:
            fault = fault.when(F.col("__gap") > max_gap_min, 4)
    s = s.withColumns({"__entry": F.coalesce(begins, F.lit(False)), "__fault": fault, "chunk": _chunk()})
    s = frames.cut(s.select(*k, "time", "distance_km", "shell", "chunk", F.col("__p.time").alias("__before"), "__ok", "__gap", "__pv", "__miss", "__entry", "__fault"))
    entry = s.where("__entry").groupBy(*k, "shell").agg(F.min(F.struct("time", "distance_km", F.col("__before").alias("before"), "chunk", "__miss")).alias("e"))
    n = len(edges) - 1
    # Exits and faults after an entry: in its own chunk, or the next ones known to that chunk.
    exit_, trouble = F.struct("time", "distance_km", "__miss"), F.when(F.col("__fault").isNotNull(), F.struct("time", "__fault", "__pv"))
    reach = lambda edge: F.when(F.col("__ok") & (F.col("distance_km") >= edge), exit_)
    later = _later(s, k, {**{f"x{i}": reach(F.lit(edges[i + 1])) for i in range(n)}, "f1": trouble})
    clocks = entry.join(F.broadcast(shells), "shell").select(*k, "shell", "upper", "e", F.col("e.chunk").alias("chunk"))
    here = clocks.join(s.drop("shell"), [*k, "chunk"]).where(F.col("time") > F.col("e.time")).groupBy(*k, "shell").agg(
        F.min(reach(F.col("upper"))).alias("near"), F.min(trouble).alias("f0"))
    whole = s.groupBy(*k).agg(F.max(F.when(F.col("__ok"), F.col("time"))).alias("last_seen"), F.max("__miss").alias("all_missing"))
    runs = clocks.join(later, [*k, "chunk"]).join(here, [*k, "shell"], "left").join(whole, k).select(
        *k, "shell", "e", "last_seen", "all_missing", F.coalesce("near", _of_shell("x", n)).alias("x"), F.coalesce("f0", "f1").alias("f"))
    runs = frames.cut(runs.withColumn("f", F.when(F.col("x").isNull() | (F.col("f.time") <= F.col("x.time")), F.col("f"))))
    # The widest gap of a run: from rows in its first and last chunk, from one row for each chunk between them.
    c0, c1 = F.col("e.chunk"), _chunk("x.time")
    widest = s.groupBy(*k, "chunk").agg(F.max("__gap").alias("gap"))
    between = runs.join(widest, k).where((F.col("chunk") > c0) & (c1.isNull() | (F.col("chunk") < c1))).select(*k, "shell", "gap")
    ends = runs.withColumn("chunk", F.explode(F.array_distinct(F.array(c0, F.coalesce(c1, c0))))).join(s.select(*k, "chunk", "time", F.col("__gap").alias("gap")), [*k, "chunk"])
    ends = ends.where((F.col("time") > F.col("e.time")) & (F.col("x").isNull() | (F.col("time") <= F.col("x.time")))).select(*k, "shell", "gap")
    gaps = between.unionByName(ends).groupBy(*k, "shell").agg(F.max("gap").alias("gap"))
    runs = runs.join(gaps, [*k, "shell"], "left").select(
        *k, "shell", "x", "f", "last_seen", F.col("f.__pv").alias("before_fault"), (F.coalesce("x.__miss", "all_missing") - F.col("e.__miss")).alias("missing_count"),
        F.coalesce("gap", F.lit(0.0)).alias("max_gap_min"), F.col("e.time").alias("entry_time"), F.col("e.distance_km").alias("entry_km"), F.col("e.before").alias("preceding_time"))
    pairs = series.select(*k).distinct()
    j = pairs.crossJoin(F.broadcast(shells)).join(runs, [*k, "shell"], "left")
    names = F.create_map(*[F.lit(x) for kv in ((1, "source_gap_limit"), (2, "missing_pair_position"), (3, "time_step_mismatch"), (4, "elapsed_gap_limit")) for x in kv])
    failed, none = F.col("f").isNotNull(), F.col("entry_time").isNull()
    reached = ~none & ~failed & F.col("x").isNotNull()
    status = F.when(none, "not_observed_entry").when(failed, "right_censored_gap").when(F.col("x").isNull(), "right_censored_track_end").otherwise("reached")
    why = F.when(none, "no_witnessed_entry").when(failed, names[F.col("f.__fault")]).when(F.col("x").isNull(), "track_end").otherwise("upper_threshold_reached")
    only = lambda c: F.when(reached, c)
    return j.select(
        *k, "shell", F.col("lower").alias("scale_lower_km"), F.col("upper").alias("scale_upper_km"), status.alias("status"), why.alias("termination_reason"),
        "entry_time", "preceding_time", only(F.col("x.time")).alias("exit_time"),
        F.when(failed, F.coalesce("before_fault", "entry_time")).when(~none & F.col("x").isNull(), F.col("last_seen")).alias("censor_time"),
        "entry_km", only(F.col("x.distance_km")).alias("exit_km"),
        only((F.unix_micros("x.time") - F.unix_micros("entry_time")) / F.lit(float(DAY_US))).alias("passage_days"),
        only(F.log(F.col("x.distance_km") / F.col("entry_km"))).alias("log_growth"), F.coalesce("missing_count", F.lit(0)).alias("missing_count"), "max_gap_min")


def pair_catalogue(grid: DataFrame, *, chance_km: float = 10.0, max_gap_min: float | None = None, start=None, end=None) -> DataFrame:
    """Pairs to analyse: all pairs of a cluster, and pairs of other clusters of the array that come near by chance.

    ``grid``: array_id, cluster_id, platform_id, time, lon, lat, source_gap_min. A common sample is
    supported where both source gaps are at most ``max_gap_min``. The least distance counts supported
    samples only; a cluster pair starts at its first supported sample, a chance pair at its (earliest)
    nearest one if that is within ``chance_km``. Both end with the last common sample, supported or
    not. ``start`` (included) and ``end`` (excluded) bound the time. Chance pairs are found
    through cells of the chance distance, so far pairs of an array never form.
    """
    rows = grid.where("lon IS NOT NULL AND lat IS NOT NULL")
    if start is not None:
        rows = rows.where(F.col("time") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("time") < F.lit(end))
    held = F.lit(True) if max_gap_min is None else F.coalesce(F.col("source_gap_min") <= max_gap_min, F.lit(False))
    rows = frames.cut(rows.select("array_id", "cluster_id", KEY, "time", "lon", "lat", held.alias("held")))
    p1, p2 = f"{KEY}_1", f"{KEY}_2"
    least = F.min(F.struct("distance_m", "time"))

    together = frames.salted_pairs(rows, ["array_id", "cluster_id", "time"], KEY)
    both = F.col("held_1") & F.col("held_2")
    together = wgs84.with_inverse(together, "__g", "lon_1", "lat_1", "lon_2", "lat_2").withColumn("distance_m", F.when(both, F.col("__g.s"))).drop("__g")
    within = together.groupBy("array_id", F.col("cluster_id").alias("cluster_1"), F.col("cluster_id").alias("cluster_2"), p1, p2).agg(
        F.min(F.when(both, F.struct("distance_m", "time"))).alias("m"), F.min(F.when(both, F.col("time"))).alias("analysis_start"), F.max("time").alias("analysis_end"))
    within = within.where("m IS NOT NULL").withColumn("kind", F.lit("within_cluster"))

    met = near_pairs(rows.where("held").drop("held"), chance_km * 1000.0, ("array_id",))
    of = rows.select(KEY, "array_id", "cluster_id").distinct()
    met = met.groupBy("array_id", p1, p2).agg(least.alias("m"))
    for i in (1, 2):
        met = met.join(of.select("array_id", F.col(KEY).alias(f"{KEY}_{i}"), F.col("cluster_id").alias(f"cluster_{i}")), ["array_id", f"{KEY}_{i}"])
    met = frames.cut(met.where("cluster_1 <> cluster_2"))
    times = rows.select("array_id", KEY, "time")
    last = met.select("array_id", p1, p2).join(times.withColumnRenamed(KEY, p1), ["array_id", p1]).join(times.withColumnRenamed(KEY, p2), ["array_id", p2, "time"])
    last = last.groupBy("array_id", p1, p2).agg(F.max("time").alias("analysis_end"))
    chance = met.join(last, ["array_id", p1, p2]).withColumns({"analysis_start": F.col("m.time"), "kind": F.lit("chance")})
    return within.unionByName(chance).select(
        F.concat_ws("|", p1, p2).alias(PAIR), "array_id", p1, p2, "cluster_1", "cluster_2", "kind", "analysis_start", "analysis_end",
        (F.col("m.distance_m") / 1000).alias("min_distance_km"), F.col("m.time").alias("min_time"))


def spectrum(passages: DataFrame, edges: list[float], sets: list[tuple[str, list[str]]], min_reached: int = 3) -> DataFrame:
    """λ = mean log growth / mean passage time per shell for several groupings (scope, columns)."""
    r = F.col("status") == "reached"
    risk = r | F.col("status").isin("right_censored_track_end", "right_censored_gap")
    only = lambda c: F.when(r, F.col(c))
    cols = sorted({c for _, cs in sets for c in cs})
    out = None
    for scope, by in sets:
        g = [*by, "shell"]
        p = passages.withColumns({"__r": r, "__k": risk})
        a = p.groupBy(*g).agg(
            F.count_if("__k").alias("at_risk"), F.count_if("__r").alias("reached"), F.count_if(~F.col("__k")).alias("not_observed"),
            F.avg(only("passage_days")).alias("mean_days"), F.avg(only("log_growth")).alias("mean_growth"), F.stddev_samp(only("passage_days")).alias("std_days"),
            F.avg(F.when(r, F.col("log_growth") * F.col("log_growth") / F.col("passage_days"))).alias("__g2"))
        middle = frames.quantiles(passages.where(r), g, {"days": F.col("passage_days")}, {"median": 0.5}).select(*g, F.col("days_median").alias("median_days"))
        a = a.join(middle, g, "left")
        total = passages.select(*by, PAIR).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("total_pairs"))
        dense = total.crossJoin(F.broadcast(_shells(passages.sparkSession, edges)))
        j = dense.join(a, g, "left").na.fill(0, ["at_risk", "reached", "not_observed"])
        j = j.withColumn("fsle", F.when(F.col("mean_days") > 0, F.col("mean_growth") / F.col("mean_days")))
        var = F.greatest(F.lit(0.0), F.col("__g2") / F.col("mean_days") - F.col("fsle") * F.col("fsle"))
        j = j.withColumns({
            "fsle_se": F.when(F.col("reached") >= 2, F.sqrt(var / F.col("reached"))), "censored": F.col("at_risk") - F.col("reached"),
            "censored_fraction": F.when(F.col("at_risk") > 0, 1 - F.col("reached") / F.col("at_risk")),
            "plot_included": F.col("reached") >= min_reached, "scope": F.lit(scope)}).drop("__g2")
        for c in cols:
            if c not in j.columns:
                j = j.withColumn(c, F.lit(None).cast(passages.schema[c].dataType))
        out = j if out is None else out.unionByName(j)
    return out


def power_fits(spectra: DataFrame, fits: list[tuple[str, float, float, float]], by: list[str]) -> DataFrame:
    """Fixed-power fits log(λ/86400) = log A + p·log(1000·δ) over supported shells of (id, power, low, high)."""
    specs = F.array(*[F.struct(F.lit(i).alias("fit"), F.lit(float(p)).alias("power"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, p, a, b in fits])
    s = spectra.withColumn("__s", F.explode(specs)).select(*by, "lower", "upper", "fsle", "plot_included", "__s.*")
    ok = F.col("plot_included") & (F.col("fsle") > 0) & (F.col("lower") >= F.col("a") * (1 - 1e-12)) & (F.col("upper") <= F.col("b") * (1 + 1e-12))
    y, x = F.log(F.col("fsle") / 86400), F.log(F.col("lower") * 1000)
    s = s.withColumn("__e", F.when(F.coalesce(ok, F.lit(False)), y - F.col("power") * x))
    a = s.groupBy(*by, "fit", "power").agg(F.count("__e").alias("shells"), F.avg("__e").alias("log_a"), F.var_pop("__e").alias("__v"),
                                          F.min(F.when(F.col("__e").isNotNull(), F.col("lower"))).alias("used_min_km"), F.max(F.when(F.col("__e").isNotNull(), F.col("upper"))).alias("used_max_km"))
    fit = F.col("shells") >= 2
    co = F.exp("log_a")
    return a.select(*by, "fit", "power", "shells", F.when(fit, "fitted").otherwise("insufficient_shells").alias("status"), F.when(fit, co).alias("coefficient"),
                    F.when(fit & (F.abs(F.col("power") + 2 / 3) < 1e-12), co * co * co).alias("coefficient_cubed"), F.when(fit, F.sqrt("__v")).alias("log_rmse"), "used_min_km", "used_max_km")


def cluster_inventory(platforms: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Possible and selected within-cluster pairs of every cluster."""
    n = platforms.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.first("cluster_size").alias("declared"))
    sel = catalogue.where("kind = 'within_cluster'").groupBy(F.col("cluster_1").alias("cluster_id")).agg(F.count(F.lit(1)).alias("selected_pairs"))
    j = n.join(sel, "cluster_id", "left").na.fill(0, ["selected_pairs"])
    return j.withColumn("possible_pairs", (F.col("members") * (F.col("members") - 1) / 2).cast("long")).withColumn("size_ok", F.col("members") == F.col("declared"))
