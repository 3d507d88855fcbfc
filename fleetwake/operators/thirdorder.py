"""Separation-bin statistics and the third-order dissipation estimator (EP rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.functions.bins import bin_index, bin_table
from fleetwake.operators import frames

# The four-fifths coefficient and the Earth's rotation rate.
FOUR_FIFTHS = -1.25
ROTATION = 7.2921159e-5
P1, P2 = "platform_id_1", "platform_id_2"


def binned(pairs: DataFrame, edges: list[float]) -> DataFrame:
    b = pairs.withColumn("bin", bin_index("r_m", edges))
    return b.where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))


def estimator(cube_sum: Column, r_sum: Column) -> Column:
    """-5/4 · <dul³> / <r> from sums; the count cancels."""
    return F.when(r_sum > 0, F.lit(FOUR_FIFTHS) * cube_sum / r_sum)


def epsilon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Estimator, mean separation, third moment and the weighted-q identity per group."""
    ok = pairs.where("r_m > 0 AND dul IS NOT NULL").withColumn("__c", F.col("dul") * F.col("dul") * F.col("dul"))
    a = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r_m").alias("mean_r"), F.avg("__c").alias("s_lll"),
        F.avg(FOUR_FIFTHS * F.col("__c") / F.col("r_m")).alias("mean_q"),
        (F.sum(F.col("r_m") * (FOUR_FIFTHS * F.col("__c") / F.col("r_m"))) / F.sum("r_m")).alias("weighted_q"),
        estimator(F.sum("__c"), F.sum("r_m")).alias("epsilon"))
    return a.withColumn("identity_error", F.abs(F.col("epsilon") - F.col("weighted_q")))


def _moment_sums(v: Column, name: str) -> list[Column]:
    """Aggregates for :func:`_moment_columns`; Spark merges the central ones without cancellation."""
    return [
        F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.avg(v * v).alias(f"raw2_{name}"), F.avg(v * v * v).alias(f"raw3_{name}"),
        F.avg(v * v * v * v).alias(f"raw4_{name}"), F.var_pop(v).alias(f"var_{name}"), F.skewness(v).alias(f"skew_{name}"), F.kurtosis(v).alias(f"flat_{name}"),
    ]


def _moment_columns(name: str) -> dict[str, Column]:
    """Central moments and ratios from the aggregates; a group without values has none."""
    c2, r2 = F.col(f"var_{name}"), F.col(f"raw2_{name}")
    third, fourth = F.when(c2 > 0, F.col(f"skew_{name}")), F.when(c2 > 0, F.col(f"flat_{name}") + 3)
    central = lambda ratio, power: F.when(c2 > 0, ratio * F.pow(c2, F.lit(power))).otherwise(c2)
    return {
        f"cen3_{name}": central(third, 1.5), f"cen4_{name}": central(fourth, 2.0),
        f"ratio3_{name}": F.when(r2 > 0, F.col(f"raw3_{name}") / F.pow(r2, F.lit(1.5))), f"ratio4_{name}": F.when(r2 > 0, F.col(f"raw4_{name}") / (r2 * r2)),
        f"skew_{name}": third, f"flat_{name}": fourth, f"n_{name}": F.when(F.col(f"n_{name}") > 0, F.col(f"n_{name}")),
    }


def moments(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Raw and central moments 1–4 (population) in one pass."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(*_moment_sums(F.col(value), name)).withColumns(_moment_columns(name))


def support(rows: DataFrame, by: list[str], each: DataFrame | None = None) -> DataFrame:
    """Observations, distinct pairs, platforms, times and hours per group.

    Rows are counted by pair (by its two platforms) and by time first; what is distinct follows from these two small
    tables. ``each`` has such counts ``n`` where the caller made them already.
    """
    pairs = rows.groupBy(*by, P1, P2).agg(F.count(F.lit(1)).alias("n")) if each is None else each.groupBy(*by, P1, P2).agg(F.sum("n").alias("n"))
    members = pairs.select(*by, F.explode(F.array(P1, P2)).alias("p")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("platforms"))
    pairs = pairs.groupBy(*by).agg(F.sum("n").alias("observations"), F.count(F.lit(1)).alias("pairs"))
    times = rows.select(*by, "time").distinct().groupBy(*by, F.date_trunc("hour", "time").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    times = times.groupBy(*by).agg(F.sum("n").alias("utc"), F.count(F.lit(1)).alias("occupied_hours"))
    return pairs.join(members, by).join(times, by)


def support_status(kind: str, need=(12, 3, 3, 12)) -> Column:
    """need: observations, pairs, platforms, times."""
    obs, pairs, platforms, utc = (F.coalesce(F.col(c), F.lit(0)) for c in ("observations", "pairs", "platforms", "utc"))
    if kind == "snapshot":
        rest = (F.when(pairs == 1, "descriptive_snapshot_single_pair")
                .when((pairs < need[1]) | (platforms < need[2]), "descriptive_snapshot_low_pair_or_platform_support")
                .otherwise("descriptive_snapshot_no_temporal_uncertainty"))
    else:
        low = F.concat_ws("_", F.when(obs < need[0], "observations"), F.when(pairs < need[1], "pairs"),
                          F.when(platforms < need[2], "platforms"), F.when(utc < need[3], "utc"))
        rest = F.when(low == "", "supported").otherwise(F.concat(F.lit("low_support_"), low))
    return F.when(obs == 0, "missing_no_observations").otherwise(rest)


def separation_bins(pairs: DataFrame, edges: list[float], by: list[str], *, kind: str = "window", scheduled: int | None = None, need=(12, 3, 3, 12),
                    groups: DataFrame | None = None) -> DataFrame:
    """Every configured bin of every group with estimator, moments, support and influence of the extreme row.

    ``groups`` names the groups where ``pairs`` has only those within the last edge (by default the
    groups of ``pairs``). The window over a bin ranks five rows of each task at most: Spark takes the limit
    on the rank to both sides of the exchange.
    """
    b = binned(pairs.where("r_m > 0 AND dul IS NOT NULL"), edges)
    b = frames.cut_if_shuffled(b.withColumn("__c", F.col("dul") * F.col("dul") * F.col("dul")).withColumn("__a", F.abs("__c")))
    g = [*by, "bin"]
    ext = F.max_by(F.struct("__a", "__c", "r_m", "pair_id", "time"), F.struct("__a", "pair_id", "time"))
    main = b.groupBy(*g).agg(
        F.avg("r_m").alias("mean_r"), F.avg("__c").alias("s_lll"), estimator(F.sum("__c"), F.sum("r_m")).alias("epsilon"),
        F.sum("__c").alias("__sc"), F.sum("r_m").alias("__sr"), F.sum("__a").alias("__sa"), F.sum(F.col("__a") * F.col("__a")).alias("__sa2"),
        F.avg("mid_lat").alias("mean_lat"), F.avg(F.col("dul") * F.col("dul")).alias("__s2"), ext.alias("__x"),
        F.min("time").alias("__t0"), F.max("time").alias("__t1"), F.count(F.lit(1)).alias("__n"),
        *_moment_sums(F.col("dul"), "dul"), *_moment_sums(F.col("dut"), "dut"))
    main = main.withColumns({**_moment_columns("dul"), **_moment_columns("dut")})
    best = Window.partitionBy(*g).orderBy(F.desc("__a"), "pair_id", "time")
    tops = b.select(*g, "__a", "pair_id", "time").withColumn("__r", F.row_number().over(best)).where("__r <= 5")
    tops = tops.groupBy(*g).agg(F.sum("__a").alias("__top5"))
    got = main.join(support(b, g), g).join(tops, g)
    spark = pairs.sparkSession
    if by:
        dense = (pairs if groups is None else groups).select(*by).distinct().crossJoin(F.broadcast(bin_table(spark, edges)))
    else:
        dense = bin_table(spark, edges)
    j = dense.join(got, g, "left")
    f = 2 * ROTATION * F.sin(F.radians("mean_lat"))
    more = F.col("__n") > 1
    without = F.when(more, estimator(F.col("__sc") - F.col("__x.__c"), F.col("__sr") - F.col("__x.r_m")))
    j = j.withColumns({
        "coriolis": f, "epsilon_without_extreme": without,
        "rossby": F.when((f != 0) & (F.col("mean_r") > 0), F.sqrt("__s2") / (F.abs(f) * F.col("mean_r"))),
        "extreme_fraction": F.when(F.col("__sa") > 0, F.col("__x.__a") / F.col("__sa")).otherwise(0.0),
        "top_five_fraction": F.when(F.col("__sa") > 0, F.col("__top5") / F.col("__sa")).otherwise(0.0),
        "effective_count": F.when(F.col("__sa2") > 0, F.col("__sa") * F.col("__sa") / F.col("__sa2")),
        "cancellation": F.when(F.col("__sa") > 0, F.abs("__sc") / F.col("__sa")).otherwise(0.0),
        "extreme_pair": F.col("__x.pair_id"), "extreme_time": F.col("__x.time"),
        "utc_span_h": (F.unix_micros("__t1") - F.unix_micros("__t0")) / F.lit(3600e6),
        "support_status": support_status(kind, need),
    })
    j = j.withColumn("support_ok", F.col("support_status") == "supported").withColumn("epsilon_change", F.col("epsilon_without_extreme") - F.col("epsilon"))
    if scheduled:
        j = j.withColumn("occupied_fraction", F.coalesce("utc", F.lit(0)) / F.lit(scheduled))
    return j.drop("__sc", "__sr", "__sa", "__sa2", "__s2", "__x", "__t0", "__t1", "__n", "__top5").na.fill(0, ["observations", "pairs", "platforms", "utc", "occupied_hours"])


def range_counts(pairs: DataFrame, edges: list[float], by: list[str], possible: DataFrame | None = None) -> DataFrame:
    """Pairs inside, under and over the edges.

    ``possible`` (``by…, possible``, of ``pairs.possible_pairs``) has the counts of all pairs where ``pairs`` lists only
    those within the last edge: the rest of them is over it. Listed pairs without a separation above zero
    then count nowhere.
    """
    i, top = bin_index("r_m", edges), len(edges) - 2
    inside = (i >= 0) & (i <= top)
    if possible is None:
        return pairs.groupBy(*by).agg(
            F.count(F.lit(1)).alias("total"), F.count_if(inside).alias("in_bins"), F.count_if(i == -1).alias("under"),
            F.count_if(i > top).alias("over"), F.count_if(i == -2).alias("invalid"))
    apart = F.col("r_m") > 0
    near = pairs.groupBy(*by).agg(F.count_if(~apart).alias("__zero"), F.count_if(apart & inside).alias("in_bins"), F.count_if(apart & (i == -1)).alias("under"))
    n = possible.groupBy(*by).agg(F.sum("possible").alias("possible")).join(near, by, "left").na.fill(0)
    return n.select(*by, (F.col("possible") - F.col("__zero")).alias("total"), "in_bins", "under",
                    (F.col("possible") - F.col("__zero") - F.col("in_bins") - F.col("under")).alias("over"), F.lit(0).cast("long").alias("invalid"))


# Quantile labels.
NINE = {"minimum": 0.0, "p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "maximum": 1.0}


def distribution_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Nine quantiles, deviation and moments of named columns, one row per metric."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")).select("s.*")
    long = frames.cut_if_shuffled(long.where("value IS NOT NULL AND NOT isnan(value)"))
    q = frames.quantiles(long, "metric", {"q": F.col("value")}, NINE, few=True)
    m = moments(long, ["metric"], "value", "value")
    return q.join(m, "metric").withColumn("standard_deviation", F.sqrt("var_value")).select(
        "metric", F.col("q_n").alias("count"), *[F.col(f"q_{k}").alias(k) for k in NINE], "standard_deviation",
        *[c for c in m.columns if c not in ("metric", "n_value")])


def windowed(pairs: DataFrame, windows: list[tuple[str, float, float]]) -> DataFrame:
    """Rows once per half-open age window they fall into (windows may overlap)."""
    table = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, a, b in windows])
    hit = F.filter(table, lambda w: (F.col("age_h") >= w["a"]) & (F.col("age_h") < w["b"]))
    return pairs.withColumn("__w", F.explode(hit)).withColumn("window", F.col("__w.window")).drop("__w")


def snapshot(pairs: DataFrame) -> DataFrame:
    return pairs.where("age_h = 0").withColumn("window", F.lit("snapshot"))


def union_once(*parts: DataFrame) -> DataFrame:
    """De-duplicated union of selections: one row per pair and time."""
    out = parts[0].drop("window")
    for p in parts[1:]:
        out = out.unionByName(p.drop("window"))
    return out.dropDuplicates(["array_id", "pair_id", "time"]) if "array_id" in out.columns else out.dropDuplicates(["pair_id", "time"])


def q_histogram(pairs: DataFrame, edges: list[float], q_edges: list[float], by: list[str], groups: DataFrame | None = None) -> DataFrame:
    """Dense separation × q counts with the conditional mass and what lies outside; ``groups`` as for :func:`separation_bins`."""
    b = binned(pairs, edges).where("q IS NOT NULL")
    i = bin_index("q", q_edges)
    top = len(q_edges) - 2
    c = b.groupBy(*by, "bin", i.alias("q_bin")).agg(F.count(F.lit(1)).alias("n"))
    c = frames.cut_if_shuffled(c)
    inside = (F.col("q_bin") >= 0) & (F.col("q_bin") <= top)
    tot = c.groupBy(*by, "bin").agg(
        F.sum("n").alias("column_n"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("in_range"),
        F.sum(F.when(F.col("q_bin") == -1, F.col("n")).otherwise(0)).alias("under"), F.sum(F.when(F.col("q_bin") > top, F.col("n")).otherwise(0)).alias("over"))
    spark = pairs.sparkSession
    cells = bin_table(spark, edges).select("bin").withColumn("q_bin", F.explode(F.sequence(F.lit(0), F.lit(top))))
    dense = (pairs if groups is None else groups).select(*by).distinct().crossJoin(F.broadcast(cells)) if by else cells
    j = dense.join(c.where(inside), [*by, "bin", "q_bin"], "left").join(tot, [*by, "bin"], "left").na.fill(0)
    return j.withColumn("mass", F.when(F.col("in_range") > 0, F.col("n") / F.col("in_range")))


def block_bootstrap(pairs: DataFrame, edges: list[float], by: list[str], *, start_h: float, end_h: float, block_min: float,
                    replicates: int = 2000, level: float = 0.95, seed: int = 0, min_blocks: int = 6, min_success: float = 0.9,
                    supported: DataFrame | None = None) -> DataFrame:
    """Synchronised block bootstrap of the estimator in every bin.

    Rows are reduced to block × bin sums first; a replicate only adds those it draws. Draws come
    from hashes of (seed, group, replicate, slot): the same law as drawing blocks with replacement,
    identical at any partitioning. Scheduled blocks without rows stay in the draw. A bin is one row that
    holds its scheduled blocks and its replicates, both bounded by the arguments.
    """
    total = round((end_h - start_h) * 60 / block_min)
    if abs((end_h - start_h) * 60 / block_min - total) > 1e-10 or total < 1:
        raise ValueError("the block length must divide the window")
    b = binned(pairs.where("r_m > 0 AND dul IS NOT NULL"), edges)
    block = F.floor((F.col("age_h") - start_h) * 60 / block_min + 1e-10).cast("int")
    sums = b.groupBy(*by, "bin", block.alias("block")).agg(F.sum(F.col("dul") * F.col("dul") * F.col("dul")).alias("c"), F.sum("r_m").alias("r"))
    spark = pairs.sparkSession
    # One row per bin with its sums in the order of the scheduled blocks (zeros where there are no rows).
    slots = F.sequence(F.lit(0), F.lit(total - 1))
    none = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("r"))
    held = F.map_from_entries(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", F.struct("c", "r")))))
    rows = sums.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("contributing_blocks"), held.alias("__m"))
    rows = frames.cut(rows.select(*by, "bin", "contributing_blocks", F.transform(slots, lambda i: F.coalesce(F.try_element_at("__m", i), none)).alias("__s")))
    groups = rows.select(*by).distinct() if by else spark.range(1).select()

    def replicate(rep: Column) -> Column:
        drawn = F.transform(slots, lambda slot: F.get("__s", F.pmod(F.xxhash64(F.lit(seed), *by, rep, slot), F.lit(total)).cast("int")))
        add = lambda t, x: F.struct((t["c"] + x["c"]).alias("c"), (t["r"] + x["r"]).alias("r"))
        return F.aggregate(drawn, none, add, lambda t: estimator(t["c"], t["r"]))

    alpha = (1 - level) / 2

    def at(values: Column, share: float) -> Column:
        pos = (F.size(values) - 1) * F.lit(share)
        low = F.floor(pos).cast("int")
        a, z = F.get(values, low), F.get(values, F.ceil(pos).cast("int"))
        return F.when(pos == low, a).otherwise((low + 1 - pos) * a + (pos - low) * z)

    # The replicates of a bin are one array in its row: nothing is joined, shuffled or sent to the driver for them.
    # A transform over one element names the sorted array once for its three uses.
    made = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), replicate)
    made = F.array(F.sort_array(F.filter(made, lambda e: e.isNotNull())))
    made = F.transform(made, lambda v: F.struct(F.size(v).cast("long").alias("successful"), at(v, alpha).alias("lo"), at(v, 1 - alpha).alias("hi")))
    spread = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, "bin")
    ci = spread.select(*by, "bin", "contributing_blocks", F.get(made, F.lit(0)).alias("__x")).select(*by, "bin", "contributing_blocks", "__x.*")
    dense = groups.crossJoin(F.broadcast(bin_table(pairs.sparkSession, edges).select("bin"))) if by else bin_table(pairs.sparkSession, edges).select("bin")
    j = dense.join(ci, [*by, "bin"], "left").na.fill(0, ["contributing_blocks", "successful"])
    ok = F.lit(True)
    if supported is not None:
        j = j.join(supported.select(*by, "bin", "support_ok"), [*by, "bin"], "left")
        ok = F.coalesce("support_ok", F.lit(False))
    status = (
        F.when(~ok, "suppressed_descriptive_support").when(F.col("contributing_blocks") < min_blocks, "suppressed_insufficient_contributing_blocks")
        .when(F.col("successful") / replicates < min_success, "suppressed_insufficient_successful_replicates").otherwise("available")
    )
    j = j.withColumn("status", status)
    shown = F.col("status") == "available"
    return j.select(*by, "bin", F.lit(total).alias("scheduled_blocks"), "contributing_blocks", "successful",
                    F.when(shown, F.col("lo")).alias("ci_lower"), F.when(shown, F.col("hi")).alias("ci_upper"), "status")


def leave_one_out(pairs: DataFrame, edges: list[float], by: list[str], need=(12, 3, 3, 12)) -> DataFrame:
    """Estimate and support of every bin after removing each platform.

    Everything is a total less the platform's share: rows and sums directly; a pair or another
    platform or a time disappears with a platform when all its rows in the bin belong to it.
    """
    b = binned(pairs.where("r_m > 0 AND dul IS NOT NULL"), edges)
    g = [*by, "bin"]
    b = frames.cut_if_shuffled(b.select(*g, P1, P2, "time", "r_m", (F.col("dul") * F.col("dul") * F.col("dul")).alias("c")))
    per_pair = frames.cut(b.groupBy(*g, P1, P2).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.sum("r_m").alias("r")))
    total = per_pair.groupBy(*g).agg(F.sum("n").alias("tn"), F.sum("c").alias("tc"), F.sum("r").alias("tr"), F.count(F.lit(1)).alias("tp"))
    side = per_pair.select(*g, "n", "c", "r", F.explode(F.array(F.struct(F.col(P1).alias("p"), F.col(P2).alias("o")), F.struct(F.col(P2).alias("p"), F.col(P1).alias("o")))).alias("s")).select(*g, "n", "c", "r", "s.p", "s.o")
    mine = side.groupBy(*g, "p").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("np"))
    everyone = mine.groupBy(*g).agg(F.count(F.lit(1)).alias("tm"))
    # A partner whose only pair in the bin is with p leaves together with p.
    lone = mine.where("np = 1").select(*g, F.col("p").alias("o"))
    gone = side.join(lone, [*g, "o"], "left_semi").groupBy(*g, "p").agg(F.count(F.lit(1)).alias("lost_partners"))
    at_time = b.groupBy(*g, "time").agg(F.count(F.lit(1)).alias("n"))
    times = at_time.groupBy(*g).agg(F.count(F.lit(1)).alias("tt"))
    own = b.select(*g, "time", F.explode(F.array(P1, P2)).alias("p")).groupBy(*g, "time", "p").agg(F.count(F.lit(1)).alias("k"))
    alone = own.join(at_time, [*g, "time"]).where("k = n").groupBy(*g, "p").agg(F.count(F.lit(1)).alias("lost_times"))
    j = mine.join(total, g).join(everyone, g).join(times, g).join(gone, [*g, "p"], "left").join(alone, [*g, "p"], "left").na.fill(0, ["lost_partners", "lost_times"])
    base = estimator(F.col("tc"), F.col("tr"))
    left = F.col("tn") - F.col("n")
    after = F.when(left > 0, estimator(F.col("tc") - F.col("c"), F.col("tr") - F.col("r")))
    j = j.withColumns({
        "baseline": base, "epsilon_after": after, "remaining_observations": left, "remaining_pairs": F.col("tp") - F.col("np"),
        "remaining_platforms": F.col("tm") - 1 - F.col("lost_partners"), "remaining_utc": F.col("tt") - F.col("lost_times")})
    j = j.withColumn("change", F.col("epsilon_after") - F.col("baseline"))
    return j.select(
        *g, F.col("p").alias("removed_platform"), "baseline", "epsilon_after", "change",
        F.when(F.col("baseline") != 0, F.abs("change") / F.abs("baseline")).alias("relative_change"),
        F.coalesce((F.signum("epsilon_after") != F.signum("baseline")) & (F.col("epsilon_after") != 0) & (F.col("baseline") != 0), F.lit(False)).alias("sign_reversal"),
        "remaining_observations", "remaining_pairs", "remaining_platforms", "remaining_utc",
        ((F.col("remaining_observations") >= need[0]) & (F.col("remaining_pairs") >= need[1]) & (F.col("remaining_platforms") >= need[2]) & (F.col("remaining_utc") >= need[3])).alias("support_ok"))


def influence(details: DataFrame, by: list[str]) -> DataFrame:
    """Most influential platform of every bin."""
    size = F.abs("change")
    lead = F.max_by(F.struct("removed_platform", "relative_change", "support_ok"), F.when(size.isNotNull(), F.struct(size, F.col("removed_platform"))))
    a = details.groupBy(*by, "bin").agg(F.count("change").alias("evaluable"), lead.alias("l"), F.max(size).alias("max_change"),
                                        F.coalesce(F.bool_or(F.col("sign_reversal") & size.isNotNull()), F.lit(False)).alias("any_sign_reversal"))
    return a.select(*by, "bin", "evaluable", F.col("l.removed_platform").alias("most_influential"), "max_change",
                    F.col("l.relative_change").alias("max_relative_change"), F.coalesce("l.support_ok", F.lit(False)).alias("removal_support_ok"), "any_sign_reversal")


def time_contributions(pairs: DataFrame, edges: list[float], by: list[str]) -> DataFrame:
    """Additive share of the estimate per (time, bin), signed sums and the leading pair."""
    b = binned(pairs.where("r_m > 0 AND dul IS NOT NULL"), edges).withColumn("c", F.col("dul") * F.col("dul") * F.col("dul"))
    g = [*by, "bin"]
    ab = F.abs("c")
    cell = b.groupBy(*g, "time").agg(
        F.count(F.lit(1)).alias("n"), F.sum("r_m").alias("r_sum"), F.sum("c").alias("cube_sum"),
        F.sum(F.when(F.col("c") > 0, F.col("c")).otherwise(0.0)).alias("positive_sum"), F.sum(F.when(F.col("c") < 0, F.col("c")).otherwise(0.0)).alias("negative_sum"),
        F.sum(ab).alias("absolute_sum"), F.max(ab).alias("__m"), F.min_by("pair_id", F.struct(-ab, F.col("pair_id"))).alias("leading_pair"))
    cell = frames.cut_if_shuffled(cell)
    den = cell.groupBy(*g).agg(F.sum("r_sum").alias("bin_r_sum"))
    j = cell.join(den, g)
    return j.withColumns({
        "contribution": FOUR_FIFTHS * F.col("cube_sum") / F.col("bin_r_sum"),
        "leading_fraction": F.when(F.col("absolute_sum") > 0, F.col("__m") / F.col("absolute_sum")),
        "cancellation": F.when(F.col("absolute_sum") > 0, F.abs("cube_sum") / F.col("absolute_sum"))}).drop("__m")


def influence_audit(summary: DataFrame, details: DataFrame, by: list[str], *, small_scale_m: float, dominant_observation: float = 0.5, dominant_platform: float = 0.5) -> DataFrame:
    """Class of every negative small-scale bin by what its sign depends on."""
    neg = summary.where((F.col("epsilon") < 0) & (F.col("center") <= small_scale_m))
    d = details.groupBy(*by, "bin").agg(F.count("epsilon_after").alias("removals"), F.bool_or("sign_reversal").alias("platform_reversal"),
                                        F.count_if("sign_reversal").alias("reversals"), F.min("epsilon_after").alias("lopo_min"), F.max("epsilon_after").alias("lopo_max"))
    j = neg.join(d, [*by, "bin"], "left").join(influence(details, by).select(*by, "bin", "max_relative_change"), [*by, "bin"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    event, platform = no(F.col("epsilon_without_extreme") > 0), no(F.col("platform_reversal"))
    obs, plat = no(F.col("extreme_fraction") >= dominant_observation), no(F.col("max_relative_change") >= dominant_platform)
    tested = F.col("epsilon_without_extreme").isNotNull() & no(F.col("removals") > 0)
    label = (
        F.when(~F.col("support_ok"), "low_support").when(event & platform, "event_and_platform_sign_sensitive").when(event, "event_sign_sensitive")
        .when(platform, "platform_sign_sensitive").when(obs & plat, "observation_and_platform_concentrated").when(obs, "observation_concentrated")
        .when(plat, "platform_sensitive_without_sign_reversal").when(tested, "persistent_negative_under_tested_removals").otherwise("influence_test_incomplete")
    )
    return j.withColumn("classification", label)
