"""Deployment groups: arrays by start time, clusters by distance (GR rows)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.functions import geo, wgs84
from fleetwake.operators import frames
from fleetwake.operators.pairs import first_common

KEY = "platform_id"


@dataclass(frozen=True)
class ClusterRule:
    """Limits of the clusters of an array; ``assignment`` is ``infer`` or ``single_cluster`` (the whole array, whatever its distances)."""

    max_start_gap_s: float
    max_pair_m: float
    max_diameter_m: float
    max_members: int | None = None
    assignment: str = "infer"

    def __post_init__(self) -> None:
        if self.assignment not in ("infer", "single_cluster"):
            raise ValueError(f"unknown assignment {self.assignment!r}")
        if min(self.max_start_gap_s, self.max_pair_m) <= 0 or self.max_diameter_m < self.max_pair_m or (self.max_members is not None and self.max_members < 1):
            raise ValueError("limits must be positive, and the diameter at least the pair distance")


def _with_rules(df: DataFrame, rule: ClusterRule, overrides: dict[int, ClusterRule] | None) -> DataFrame:
    """The limits of each row's array as columns; ``overrides`` are the arrays with a rule of their own."""
    kinds = {"max_start_gap_s": "double", "max_pair_m": "double", "max_diameter_m": "double", "max_members": "int", "assignment": "string"}
    if overrides:
        rows = [(i, *(getattr(r, c) for c in kinds)) for i, r in overrides.items()]
        table = df.sparkSession.createDataFrame(rows, "array_id int, " + ", ".join(f"__{c} {k}" for c, k in kinds.items()))
        df = df.join(F.broadcast(table.withColumn("__own", F.lit(True))), "array_id", "left")
    own = F.coalesce(F.col("__own"), F.lit(False)) if overrides else F.lit(False)
    value = lambda c, k: F.when(own, F.col(f"__{c}")).otherwise(F.lit(getattr(rule, c)).cast(k)) if overrides else F.lit(getattr(rule, c)).cast(k)
    return df.withColumns({c: value(c, k) for c, k in kinds.items()}).drop("__own", *[f"__{c}" for c in kinds])


RULES = ("max_start_gap_s", "max_pair_m", "max_diameter_m", "max_members", "assignment")


def start_arrays(starts: DataFrame, max_gap_h: float) -> DataFrame:
    """Array number by chronological start; a gap above the limit opens a new array.

    The order is global, so it runs through the chunked scan (one row per platform, chunks of a day).
    """
    s = starts.withColumn("__all", F.lit(0))
    order = ["start_time", KEY]
    g = frames.scan(s, "__all", order, lag={"__p": F.col("start_time")}, lead={"__n": F.col("start_time")})
    g = g.withColumns({"gap_before_h": geo.seconds_between("__p", "start_time") / 3600,
                       "gap_after_h": geo.seconds_between("start_time", "__n") / 3600}).drop("__p", "__n")
    out = frames.islands(g, "__all", order, F.col("gap_before_h") > max_gap_h, out="array_id")
    return out.withColumn("array_id", (F.col("array_id") + 1).cast("int")).drop("__all")


def pair_metrics(platforms: DataFrame, grid: DataFrame, rule: ClusterRule, overrides: dict[int, ClusterRule] | None = None, *,
                 reference: str = "observed_starts", spread: int = 1) -> DataFrame:
    """Start gap, start distance and first-common distance of the pairs of an array, and whether they are linked.

    ``platforms``: platform_id, array_id, start_time, start_lon, start_lat. ``overrides``: rules of single arrays.
    """
    p = frames.salted_pairs(platforms.select("array_id", KEY, "start_time", "start_lon", "start_lat"), "array_id", KEY, spread=spread)
    p = p.withColumn("start_gap_s", F.abs(geo.seconds_between("start_time_1", "start_time_2")))
    p = wgs84.with_inverse(p, "__g", "start_lon_1", "start_lat_1", "start_lon_2", "start_lat_2").withColumn("observed_m", F.col("__g.s")).drop("__g")
    met = first_common(grid, ("array_id",), spread)
    for i in (1, 2):
        at = grid.select(F.col(KEY).alias(f"{KEY}_{i}"), F.col("time").alias("first_common"), F.col("lon").alias(f"lon_{i}"), F.col("lat").alias(f"lat_{i}"))
        met = met.join(at, [f"{KEY}_{i}", "first_common"])
    met = wgs84.with_inverse(met, "__g", "lon_1", "lat_1", "lon_2", "lat_2")
    met = met.select("array_id", f"{KEY}_1", f"{KEY}_2", "first_common", F.col("__g.s").alias("common_m"))
    j = p.join(met, ["array_id", f"{KEY}_1", f"{KEY}_2"], "left")
    d = F.col("observed_m") if reference == "observed_starts" else F.col("common_m")
    j = j.withColumn("distance_m", d)
    j = _with_rules(j, rule, overrides)
    link = F.coalesce((F.col("start_gap_s") <= F.col("max_start_gap_s")) & (F.col("distance_m") <= F.col("max_pair_m")), F.lit(False))
    return j.select("array_id", F.col(f"{KEY}_1").alias("platform_1"), F.col(f"{KEY}_2").alias("platform_2"),
                    "start_gap_s", "observed_m", "first_common", "common_m", "distance_m", link.alias("link"))


def agglomerate(platforms: DataFrame, metrics: DataFrame, rule: ClusterRule, overrides: dict[int, ClusterRule] | None = None) -> DataFrame:
    """``array_id, platform_id, seed``: clusters by best-first merging of linked platforms within the rule of their array.

    The best merge has the shortest link, then the smallest diameter, start spread and member list. All
    merges that are the best of both their clusters are made in one round. Limits on diameter, spread
    and size only tighten as clusters grow, so a merge elsewhere never gives a cluster a better partner
    than it had, and rounds end where merging one pair at a time does (short of pairs that tie in all
    three numbers). What is kept from round to round is one row for each cluster and for each pair of
    clusters that may still merge: number of pairs, longest distance and shortest link between them. A
    pair of platforms further apart than the diameter is never looked at.
    """
    nodes = _with_rules(platforms.select("array_id", KEY, F.unix_micros("start_time").alias("t")), rule, overrides)
    single = nodes.where("assignment = 'single_cluster'").select("array_id", KEY, F.min(KEY).over(Window.partitionBy("array_id")).alias("seed"))
    nodes = nodes.where("assignment = 'infer'")
    clusters = nodes.select("array_id", F.col(KEY).alias("seed"), F.col("t").alias("t0"), F.col("t").alias("t1"), F.lit(0.0).alias("wide"), F.array(KEY).alias("names"))
    near = _with_rules(metrics.select("array_id", "platform_1", "platform_2", "start_gap_s", "distance_m", "link"), rule, overrides).where(
        "assignment = 'infer' AND start_gap_s <= max_start_gap_s AND distance_m <= max_diameter_m")
    a, b = F.least("platform_1", "platform_2"), F.greatest("platform_1", "platform_2")
    between = near.select("array_id", a.alias("a"), b.alias("b"), F.lit(1).cast("long").alias("n"), F.col("distance_m").alias("far"), F.when(F.col("link"), F.col("distance_m")).alias("tie"))
    clusters, between = frames.cut(clusters), frames.cut(between)
    while True:
        side = lambda s: clusters.select("array_id", F.col("seed").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("t0", "t1", "wide", "names")])  # noqa: E731, B023
        j = between.join(side("a"), ["array_id", "a"]).join(side("b"), ["array_id", "b"])
        j = _with_rules(j, rule, overrides).withColumns({
            "wide": F.greatest("far", "a_wide", "b_wide"), "names": F.array_sort(F.concat("a_names", "b_names")),
            "spread": (F.greatest("a_t1", "b_t1") - F.least("a_t0", "b_t0")) / F.lit(1e6)})
        whole = F.col("n") == F.size("a_names").cast("long") * F.size("b_names")
        small = F.col("max_members").isNull() | (F.size("names") <= F.col("max_members"))
        # What does not fit now will not fit later; what fits without a link may get one.
        j = frames.cut(j.where(whole & small & (F.col("spread") <= F.col("max_start_gap_s"))).select("array_id", "a", "b", "n", "far", "tie", "wide", "spread", "names"))
        offer = F.struct("tie", "wide", "spread", "names", "a", "b")
        best = j.where("tie IS NOT NULL").select("array_id", offer.alias("o"), F.explode(F.array("a", "b")).alias("seed")).groupBy("array_id", "seed").agg(F.min("o").alias("o"))
        merged = frames.cut(best.groupBy("array_id", "o").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("array_id", "o.a", "o.b", "o.wide", "o.names"))
        if merged.isEmpty():
            break
        into = merged.select("array_id", F.col("b").alias("seed"), F.col("a").alias("__into"))
        grown = merged.select("array_id", F.col("a").alias("seed"), F.col("wide").alias("__wide"), F.col("names").alias("__names"))
        moved = clusters.join(into, ["array_id", "seed"], "left").withColumn("seed", F.coalesce("__into", "seed")).groupBy("array_id", "seed").agg(
            F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("wide").alias("wide"), F.first("names").alias("names"))
        clusters = frames.cut(moved.join(grown, ["array_id", "seed"], "left").select(
            "array_id", "seed", "t0", "t1", F.coalesce("__wide", "wide").alias("wide"), F.coalesce("__names", "names").alias("names")))
        for end in ("a", "b"):
            j = j.join(into.withColumnRenamed("seed", end), ["array_id", end], "left").withColumn(end, F.coalesce("__into", end)).drop("__into")
        between = frames.cut(j.where("a <> b").select("array_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "far", "tie").groupBy("array_id", "a", "b").agg(
            F.sum("n").alias("n"), F.max("far").alias("far"), F.min("tie").alias("tie")))
    return clusters.select("array_id", F.explode("names").alias(KEY), F.array_min("names").alias("seed")).unionByName(single)


def number_clusters(platforms: DataFrame, members: DataFrame, rule: ClusterRule | None = None, overrides: dict[int, ClusterRule] | None = None) -> DataFrame:
    """Cluster and member numbers by (earliest start, id), sizes and status; the rules name the arrays that are one cluster."""
    j = platforms.select(KEY, "array_id", "start_time").join(members.select(KEY, "seed"), KEY)
    g = Window.partitionBy("array_id", "seed")
    first = F.min(F.struct("start_time", KEY)).over(g)
    j = j.withColumns({"__f": first, "cluster_size": F.count(F.lit(1)).over(g)})
    j = j.withColumns({
        "cluster_number": F.dense_rank().over(Window.partitionBy("array_id").orderBy("__f")),
        "member_id": F.row_number().over(g.orderBy("start_time", KEY)),
    })
    cid = F.concat(F.lit("array_"), F.lpad(F.col("array_id").cast("string"), 3, "0"), F.lit("__cluster_"), F.lpad(F.col("cluster_number").cast("string"), 3, "0"))
    status = F.when(F.col("cluster_size") == 1, "algorithmic_singleton").otherwise("candidate_cluster")
    if rule is not None:
        j = _with_rules(j, rule, overrides)
        status = F.when(F.col("assignment") == "single_cluster", "configured_single_cluster").otherwise(status)
    return j.select(KEY, "array_id", "start_time", cid.alias("cluster_id"), "member_id", F.col("cluster_size").cast("int").alias("cluster_size"), status.alias("status"))


def cluster_statistics(assigned: DataFrame, metrics: DataFrame) -> DataFrame:
    """Spread, diameter (NULL when a distance is missing), largest known distance and links per cluster.

    ``observed_diameter_m`` and ``common_diameter_m`` are the same for the distances at the starts and at the first
    common times, whichever of them the clusters were made with; ``common_unavailable`` counts the pairs
    without a common time.
    """
    base = assigned.groupBy("array_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("members"), geo.seconds_between(F.min("start_time"), F.max("start_time")).alias("start_spread_s"))
    a = assigned.select(F.col(KEY).alias("platform_1"), F.col("cluster_id"))
    b = assigned.select(F.col(KEY).alias("platform_2"), F.col("cluster_id").alias("__c2"))
    inner = metrics.join(a, "platform_1").join(b, "platform_2").where("cluster_id = __c2")
    kinds = {"": "distance_m", "observed_": "observed_m", "common_": "common_m"}
    s = inner.groupBy("array_id", "cluster_id").agg(
        F.count_if("link").alias("links"), *[x for p, c in kinds.items() for x in (F.max(c).alias(f"__{p}max"), F.count_if(F.col(c).isNull()).alias(f"{p}unavailable"))])
    j = base.join(s, ["array_id", "cluster_id"], "left").na.fill(0, ["links", *[f"{p}unavailable" for p in kinds]])
    for p in kinds:
        widest = F.when(F.col("members") == 1, 0.0).otherwise(F.col(f"__{p}max"))
        j = j.withColumns({f"{p}diameter_m": F.when(F.col(f"{p}unavailable") == 0, widest)} | ({"max_available_m": widest} if not p else {}))
    return j.drop(*[f"__{p}max" for p in kinds], "observed_unavailable")


def reference_assignments(platforms: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments of another product, platforms that only one side knows).

    A missing member number is filled by (start, id) within the cluster.
    """
    r = reference.select(KEY, "array_id", "cluster_id", "member_id")
    j = platforms.select(KEY, "start_time", F.lit(True).alias("__p")).join(r.withColumn("__r", F.lit(True)), KEY, "full_outer")
    odd = j.where("__p IS NULL OR __r IS NULL").select(KEY, F.when(F.col("__p").isNull(), "only_in_reference").otherwise("only_in_product").alias("side"))
    good = j.where("__p AND __r").drop("__p", "__r")
    w = Window.partitionBy("array_id", "cluster_id").orderBy("start_time", KEY)
    return good.withColumn("member_id", F.coalesce("member_id", F.row_number().over(w))), odd


def activation(grid: DataFrame, sizes: DataFrame | None = None, *, minimum: int | None = None, group=("array_id", "cluster_id")) -> DataFrame:
    """First time with at least ``minimum`` usable members, or with all of ``sizes.cluster_size``."""
    g = list(group)
    n = grid.where("valid").groupBy(*g, "time").agg(F.count_distinct(KEY).alias("n"))
    if minimum is None:
        n = n.join(sizes.select(*g, F.col("cluster_size").alias("__need")), g)
    else:
        n = n.withColumn("__need", F.lit(minimum))
    return n.where("n >= __need").groupBy(*g).agg(F.min("time").alias("activation_time"))


def cohorts(starts: DataFrame, column: str = "start_time") -> DataFrame:
    """Runs of consecutive UTC dates, numbered from 1. Works on the distinct dates only."""
    days = starts.select(F.to_date(column).alias("day")).where("day IS NOT NULL").distinct()
    n = days.withColumn("run", F.date_add("day", -F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day"))))
    n = n.withColumn("cohort", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("run"))).drop("run")
    return starts.withColumn("day", F.to_date(column)).join(n, "day", "left")
