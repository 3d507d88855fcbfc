"""Platform pairs: encounters, kinematics, coverage (PR rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.functions import geo, wgs84
from fleetwake.operators import frames
from fleetwake.operators.audit import pair_id

KEY = "platform_id"
P1, P2 = f"{KEY}_1", f"{KEY}_2"


def near_pairs(grid: DataFrame, max_m: float, on=()) -> DataFrame:
    """Pairs within ``max_m`` at the same time, found through latitude/longitude cells.

    Only rows in the same or a neighbouring cell meet, so far-apart platforms never form a pair.
    A row goes to its own cell on the left and to the cells around it on the right; the search box
    of longitude widens with latitude.
    """
    rows = grid.where("lon IS NOT NULL AND lat IS NOT NULL").select(*on, "time", KEY, "lon", "lat", *[c for c in ("start_time",) if c in grid.columns])
    deg = max_m / 110_500.0 * 1.001
    bands = max(int(180 / max(deg, 1e-6)), 1)
    tall = 180.0 / bands if deg < 180 else 180.0
    cy = F.floor((F.col("lat") + 90) / tall).cast("long")
    # Columns are as wide as the band's poleward edge needs; each band has its own count of them.
    def columns_of(band: Column) -> Column:
        edge = F.greatest(F.abs(band * tall - 90 - tall), F.abs((band + 1) * tall - 90 + tall))
        return F.greatest(F.lit(1), F.floor(360.0 / (deg / F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-9)))).cast("long"))

    turn = F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360
    left = rows.select(*on, "time", *[F.col(c).alias(f"{c}_1") for c in rows.columns if c not in (*on, "time")],
                       cy.alias("__cy"), F.least(F.floor(turn * columns_of(cy)), columns_of(cy) - 1).cast("long").alias("__cx"))
    around = rows.withColumn("__cy", F.explode(F.array(cy - 1, cy, cy + 1)))
    n = columns_of(F.col("__cy"))
    mid = F.least(F.floor(turn * n), n - 1).cast("long")
    around = around.withColumn("__n", n).withColumn("__cx", F.explode(F.array_distinct(F.array(*[F.pmod(mid + k, F.col("__n")) for k in (-1, 0, 1)]))))
    right = around.select(*on, "time", "__cy", "__cx", *[F.col(c).alias(f"{c}_2") for c in rows.columns if c not in (*on, "time")])
    met = left.join(right, [*on, "time", "__cy", "__cx"]).where(f"{P1} < {P2}").drop("__cy", "__cx")
    rough = geo.haversine("lon_1", "lat_1", "lon_2", "lat_2") <= max_m * 1.01 + 1
    met = wgs84.with_inverse(met.where(rough), "__g", "lon_1", "lat_1", "lon_2", "lat_2")
    return met.withColumn("distance_m", F.col("__g.s")).drop("__g").where(F.col("distance_m") <= max_m)


def encounters(grid: DataFrame, max_m: float, *, max_from_start_s: float | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """First time a pair comes within ``max_m``, its common window and the delays from both starts.

    ``grid`` needs start_time per row; ``same`` names group columns that must agree (array, cluster).
    """
    met = near_pairs(grid, max_m, same)
    if max_from_start_s is not None:
        limit = F.least(F.unix_micros("start_time_1"), F.unix_micros("start_time_2")) + round(max_from_start_s * 1e6)
        met = met.where(F.unix_micros("time") <= limit)
    first = met.groupBy(*same, P1, P2).agg(F.min_by(F.struct("time", "distance_m", "start_time_1", "start_time_2"), "time").alias("e"))
    first = frames.cut_if_shuffled(first.select(*same, P1, P2, "e.*"))
    rows = grid.where("lon IS NOT NULL AND lat IS NOT NULL").select(KEY, "time")
    a = first.select(P1, P2).join(rows.withColumnRenamed(KEY, P1), P1)
    common = a.join(rows.withColumnRenamed(KEY, P2), [P2, "time"]).groupBy(P1, P2).agg(
        F.min("time").alias("overlap_start"), F.max("time").alias("overlap_end"))
    return first.join(common, [P1, P2]).select(
        *same, P1, P2, F.col("time").alias("encounter_time"), F.col("distance_m").alias("encounter_m"), "overlap_start", "overlap_end",
        geo.seconds_between("start_time_1", "time").alias("delay_1_s"), geo.seconds_between("start_time_2", "time").alias("delay_2_s"))


#: Times in one word of a presence index; the sign of a long stays free.
WORD = 62


def presence(grid: DataFrame, on, flags: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(words, times): which platforms are there when, as bits.

    ``words``: ``on…, platform_id, word`` and one long for each flag, whose bit k says that the flag holds at
    position 62·word + k. ``times``: ``time, pos``, the distinct times in order. Two platforms meet where the words
    of one number have a common bit, so pairs are joined by words and not by times.
    """
    times = grid.select("time").where("time IS NOT NULL").distinct().withColumn("__all", F.lit(0))
    times = frames.cut(frames.number(times, "__all", "time", out="pos").select("time", "pos"))
    rows = grid.select(*on, "time", KEY, *[f.alias(f"__{n}") for n, f in flags.items()]).join(times, "time")
    bit = F.expr(f"shiftleft(1L, CAST(pos % {WORD} AS INT))")
    words = rows.groupBy(*on, KEY, F.floor(F.col("pos") / WORD).cast("long").alias("word")).agg(
        *[F.bit_or(F.when(F.col(f"__{n}"), bit).otherwise(F.lit(0).cast("long"))).alias(n) for n in flags])
    return words, times


def lowest(bits: Column) -> Column:
    """Number of the lowest bit that is set."""
    return F.bit_count(bits.bitwiseAND(-bits) - 1)


def highest(bits: Column) -> Column:
    return F.length(F.bin(bits)) - 1


def below(bits: Column, k: Column) -> Column:
    """How many bits under number ``k`` are set."""
    return F.bit_count(bits.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int")) - 1))


def partners(listed: DataFrame, on) -> DataFrame:
    """``on…, platform_id, __no, __bits``: the number of every member of a group, and whom it is listed with.

    Members are numbered in the order of their ids; bit k of word w stands for number 62·w + k. The bits of a group
    are an eighth of a byte for each pair of its members, listed or not.
    """
    on = list(on)
    both = F.array(F.struct(F.col(P1).alias(KEY), F.col(P2).alias("__o")), F.struct(F.col(P2).alias(KEY), F.col(P1).alias("__o")))
    sides = frames.cut_if_shuffled(listed.select(*on, P1, P2)).select(*on, F.explode(both).alias("__s")).select(*on, "__s.*")
    numbers = sides.select(*on, KEY).distinct().withColumn("__no", F.row_number().over(Window.partitionBy(*on).orderBy(KEY)).cast("long") - 1)
    numbers = frames.cut(numbers)
    other = numbers.withColumnsRenamed({KEY: "__o", "__no": "__n"})
    bit = F.expr(f"shiftleft(1L, CAST(__n % {WORD} AS INT))")
    words = sides.join(other, [*on, "__o"]).groupBy(*on, KEY, F.floor(F.col("__n") / WORD).cast("int").alias("__w")).agg(F.bit_or(bit).alias("__b"))
    words = words.groupBy(*on, KEY).agg(F.max("__w").alias("__top"), F.map_from_entries(F.collect_list(F.struct("__w", "__b"))).alias("__m"))
    held = F.transform(F.sequence(F.lit(0), F.col("__top")), lambda w: F.coalesce(F.try_element_at("__m", w), F.lit(0).cast("long")))
    return numbers.join(words.select(*on, KEY, held.alias("__bits")), [*on, KEY])


def search_counts(platforms: DataFrame, grid: DataFrame, found: DataFrame, same: tuple[str, ...] = ()) -> DataFrame:
    """Sizes of the search: possible, eligible, overlapping and found pairs, as counts without listing pairs.

    Overlap is counted per pair of presence patterns: platforms with the same set of grid times
    share a pattern, and only patterns (with their head counts) are compared, by words of their
    presence index.
    """
    n = platforms.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("possible"))
    if same:
        e = platforms.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("eligible"))
    else:
        e = n.select(F.col("possible").alias("eligible"))
    words, _ = presence(grid.where("lon IS NOT NULL AND lat IS NOT NULL"), same, {"bits": F.lit(True)})
    words = frames.cut(words)
    shape = words.groupBy(*same, KEY).agg(
        F.sum(F.bit_count("bits")).alias("c"), F.bit_xor(F.xxhash64("word", "bits")).alias("x"), F.sum(F.xxhash64("word", "bits").cast("decimal(38,0)")).alias("s"))
    heads = shape.groupBy(*same, "c", "x", "s").agg(F.count(F.lit(1)).alias("k"), F.min(KEY).alias(KEY))
    reps = frames.cut(heads.select(*same, KEY, "k"))
    rows = words.join(reps.select(KEY, "k"), KEY)
    meet = frames.salted_pairs(rows.select(*same, "word", KEY, "bits", "k"), [*same, "word"], KEY)
    meet = meet.where(F.col("bits_1").bitwiseAND(F.col("bits_2")) != 0).select(P1, P2, "k_1", "k_2").distinct()
    cross = meet.agg(F.coalesce(F.sum(F.col("k_1") * F.col("k_2")), F.lit(0)).alias("a"))
    own = reps.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0)).cast("long").alias("b"))
    f = found.agg(F.count(F.lit(1)).alias("found"))
    one = n.join(e).join(cross).join(own).join(f)
    return one.select("possible", "eligible", (F.col("a") + F.col("b")).alias("overlapping"), "found")


def first_common(grid: DataFrame, on=("array_id",), spread: int = 1) -> DataFrame:
    """``on…, platform_id_1, platform_id_2, first_common``: the first time at which both have a position."""
    on = list(on)
    words, times = presence(grid.where("lon IS NOT NULL AND lat IS NOT NULL"), on, {"bits": F.lit(True)})
    met = frames.salted_pairs(words, [*on, "word"], KEY, spread=spread).withColumn("both", F.col("bits_1").bitwiseAND(F.col("bits_2")))
    first = met.where("both <> 0").groupBy(*on, P1, P2).agg(F.min(F.col("word") * WORD + lowest(F.col("both"))).alias("pos"))
    return first.join(times, "pos").select(*on, P1, P2, F.col("time").alias("first_common"))


def pair_table(found: DataFrame, grid: DataFrame, columns=("lon", "lat")) -> DataFrame:
    """Rows of both members over the complete common window, with the centre and the row number."""
    rows = grid.select(KEY, "time", *columns)
    one = found.join(rows.select(F.col(KEY).alias(P1), "time", *[F.col(c).alias(f"{c}_1") for c in columns]), P1)
    one = one.where(F.col("time").between(F.col("overlap_start"), F.col("overlap_end")))
    both = one.join(rows.select(F.col(KEY).alias(P2), "time", *[F.col(c).alias(f"{c}_2") for c in columns]), [P2, "time"])
    both = both.withColumns({
        "pair_id": pair_id(P1, P2), "center_lon": geo.wrap_longitude(geo.circular_mean_longitude("lon_1", "lon_2")),
        "center_lat": (F.col("lat_1") + F.col("lat_2")) / 2})
    return frames.number(both, "pair_id", "time", out="obs")


def kinematics(df: DataFrame) -> DataFrame:
    """Separation, longitudinal and transverse increments and q of x_m_1, y_m_1, u_1, v_1, x_m_2, …"""
    dx, dy = F.col("x_m_2") - F.col("x_m_1"), F.col("y_m_2") - F.col("y_m_1")
    du, dv = F.col("u_2") - F.col("u_1"), F.col("v_2") - F.col("v_1")
    # Not deterministic, so that filters on r_m, dul and what follows from them stay above and find them computed.
    here = F.spark_partition_id() >= 0
    d = df.withColumns({"__dx": dx, "__dy": dy, "__du": du, "__dv": dv}).withColumn("r_m", F.when(here, F.hypot("__dx", "__dy")))
    ok = (F.col("r_m") > 0) & here
    lo = F.when(ok, (F.col("__du") * F.col("__dx") + F.col("__dv") * F.col("__dy")) / F.col("r_m"))
    tr = F.when(ok, (F.col("__dv") * F.col("__dx") - F.col("__du") * F.col("__dy")) / F.col("r_m"))
    return _powers(d.withColumns({"dul": lo, "dut": tr})).drop("__dx", "__dy", "__du", "__dv")


def _powers(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "dul3": F.col("dul") * F.col("dul") * F.col("dul"), "mixed3": F.col("dul") * F.col("dut") * F.col("dut"),
        "q": -1.25 * F.col("dul") * F.col("dul") * F.col("dul") / F.col("r_m"),
    })


def derived(df: DataFrame) -> DataFrame:
    """The columns that follow from both ids, r_m, dul and dut, for rows written without them."""
    return _powers(df).withColumn("pair_id", pair_id(P1, P2))


def _moving(grid: DataFrame) -> DataFrame:
    return grid.where("x_m IS NOT NULL AND y_m IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL")


def pair_observations(grid: DataFrame, population=("array_id",), *, within_m: float | None = None, min_reliable_m: float = 0.0, spread: int = 1,
                      activation: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Kinematics of the pairs of a population at the times both have a valid velocity.

    ``grid``: population columns, cluster_id, platform_id, time, x_m, y_m, u, v, lat. ``within_m`` is the
    largest separation that the caller has a bin for: pairs beyond it are not formed at all, and
    :func:`possible_pairs` counts them. ``spread`` splits populations (or cells) too large for one task.
    ``activation`` adds the age. ``listed`` (population columns, both ids) names the only pairs to form; pairs within
    a distance find them by the bits of :func:`partners`, so that no pair row is shuffled for it.
    """
    on = list(population)
    cols = [c for c in (KEY, "cluster_id", "x_m", "y_m", "u", "v", "lat") if c not in on]
    rows = _moving(grid).select(*on, "time", *cols)
    if within_m is None:
        p = frames.salted_pairs(rows, [*on, "time"], KEY, spread=spread, columns=cols)
        if listed is not None:
            p = p.join(listed.select(*on, P1, P2), [*on, P1, P2], "left_semi")
    elif listed is not None:
        rows = rows.join(partners(listed, on), [*on, KEY])
        p = frames.plane_pairs(rows, [*on, "time"], KEY, within_m, spread=spread, columns=cols, listed=("__no", "__bits"))
    else:
        p = frames.plane_pairs(rows, [*on, "time"], KEY, within_m, spread=spread, columns=cols)
    p = kinematics(p)
    if within_m is not None:
        p = p.where(F.col("r_m") <= within_m)
    p = p.withColumns({
        "pair_id": pair_id(P1, P2), "mid_x": (F.col("x_m_1") + F.col("x_m_2")) / 2, "mid_y": (F.col("y_m_1") + F.col("y_m_2")) / 2,
        "mid_lat": (F.col("lat_1") + F.col("lat_2")) / 2, "below_reliable": F.col("r_m") < min_reliable_m})
    if "cluster_id" in cols:
        p = p.withColumn("relation", F.when(F.col("cluster_id_1") == F.col("cluster_id_2"), "within_cluster").otherwise("cross_cluster"))
    if activation is not None:
        p = p.join(activation, on).withColumn("age_h", geo.seconds_between("activation_time", "time") / 3600)
    return p


def possible_pairs(grid: DataFrame, population=("array_id",), activation: DataFrame | None = None) -> DataFrame:
    """``population, time, possible``: how many pairs have a valid velocity at a time, from head counts alone."""
    on = list(population)
    n = _moving(grid).groupBy(*on, "time").agg(F.count(F.lit(1)).alias("n"))
    n = n.where("n > 1").select(*on, "time", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("possible"))
    if activation is not None:
        n = n.join(activation, on).withColumn("age_h", geo.seconds_between("activation_time", "time") / 3600)
    return n


def with_populations(pairs: DataFrame) -> DataFrame:
    """Each pair row once as all_array and once under its relation."""
    return pairs.withColumn("population", F.explode(F.array(F.lit("all_array"), F.col("relation"))))


def inventory_violations(pairs: DataFrame, a: str = P1, b: str = P2) -> DataFrame:
    """Unordered pairs listed more than once and pairs of a platform with itself."""
    n = pairs.groupBy(F.least(a, b).alias("platform_1"), F.greatest(a, b).alias("platform_2")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.when(F.col("platform_1") == F.col("platform_2"), "self_pair").when(F.col("n") > 1, "repeated_pair")
    return n.withColumn("rule", rule).where("rule IS NOT NULL")


def coverage(grid: DataFrame, population=("array_id", "cluster_id"), spread: int = 1) -> DataFrame:
    """Scheduled and valid times of every pair: every row of ``grid`` is a scheduled time of its platform.

    Counts before, inside and after the pair's first and last valid time, from the words of the
    presence index: whole words by their number of bits, the first and the last valid word bit by bit.
    """
    on = list(population)
    words, times = presence(grid, on, {"s": F.lit(True), "v": F.coalesce(F.col("valid"), F.lit(False))})
    g = [*on, P1, P2]
    w = frames.salted_pairs(words, [*on, "word"], KEY, spread=spread).select(
        *g, "word", F.col("s_1").bitwiseAND(F.col("s_2")).alias("s"), F.col("v_1").bitwiseAND(F.col("v_2")).alias("v"))
    w = frames.cut(w.where("s <> 0").withColumns({"n": F.bit_count("s").cast("long"), "m": F.bit_count("v").cast("long")}))
    held, at = F.col("v") != 0, F.struct("word", "s", "v")
    ends = w.groupBy(*g).agg(F.sum("n").alias("scheduled"), F.sum("m").alias("valid"), F.min(F.when(held, at)).alias("a"), F.max(F.when(held, at)).alias("z"))
    j = w.join(ends.select(*g, F.col("a.word").alias("w0"), F.col("z.word").alias("w1")), g)
    c = j.groupBy(*g).agg(F.coalesce(F.sum(F.when(F.col("word") < F.col("w0"), F.col("n"))), F.lit(0)).alias("b0"),
                          F.coalesce(F.sum(F.when(F.col("word") > F.col("w1"), F.col("n"))), F.lit(0)).alias("a0"))
    early = below(F.col("a.s"), lowest(F.col("a.v")))
    late = F.bit_count("z.s") - below(F.col("z.s"), highest(F.col("z.v")) + 1)
    out = ends.join(c, g).withColumns({
        "before": F.col("b0") + F.coalesce(early, F.lit(0)), "after": F.col("a0") + F.coalesce(late, F.lit(0)),
        "__p": F.col("a.word") * WORD + lowest(F.col("a.v")), "__q": F.col("z.word") * WORD + highest(F.col("z.v"))})
    for pos, name in (("__p", "first_valid"), ("__q", "last_valid")):
        out = out.join(times.select(F.col("pos").alias(pos), F.col("time").alias(name)), pos, "left")
    out = out.drop("b0", "a0", "a", "z", "__p", "__q")
    return out.withColumns({
        "inside_missing": F.when(F.col("valid") > 0, F.col("scheduled") - F.col("valid") - F.col("before") - F.col("after")).otherwise(F.lit(0)),
        "complete": F.col("scheduled") == F.col("valid"), "fraction": F.col("valid") / F.col("scheduled")})


# Velocity reasons in falling priority.
EXCLUSIONS = (
    "nonfinite_position_in_stencil",
    "missing_source_support_in_stencil",
    "source_gap_exceeded_in_stencil",
    "speed_mask_exceeded",
    "nonfinite_velocity",
    "outside_centered_stencil",
)


def exclusion_reasons(grid: DataFrame, population=("array_id", "cluster_id"), min_reliable_m: float = 0.0, spread: int = 1) -> DataFrame:
    """Primary reason of every pair-time by fixed priority, counted with its share.

    ``grid``: population, platform_id, time, x_m, y_m, valid, reason (of the velocity).
    """
    on = list(population)
    p = frames.salted_pairs(grid.select(*on, "time", KEY, "x_m", "y_m", "valid", "reason"), [*on, "time"], KEY, spread=spread)
    r = F.hypot(F.col("x_m_2") - F.col("x_m_1"), F.col("y_m_2") - F.col("y_m_1"))
    both = F.col("valid_1") & F.col("valid_2")
    reason = (
        F.when(both & (r.isNull() | (r <= 0)), "zero_or_invalid_separation")
        .when(both & (r < min_reliable_m), "below_minimum_reliable_separation").when(both, "valid")
    )
    for name in EXCLUSIONS:
        reason = reason.when((F.col("reason_1") == name) | (F.col("reason_2") == name), name)
    n = p.withColumn("reason", reason.otherwise("other_invalid_velocity")).groupBy(*on, "reason").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*on).agg(F.sum("n").alias("__t"))
    return n.join(total, on).withColumn("fraction", F.col("n") / F.col("__t")).drop("__t")
