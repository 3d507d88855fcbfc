"""Mix deployment notes to target weights of their provenances by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.llm import shared

#: Fixed value: a rank falls into one of so many bins before the cut is searched.
BINS = 1 << 16
#: Provenance tables of up to so many rows are broadcast (a few dozen bytes a row).
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    """Runs of other characters than space and the controls 9 to 13; null has none."""
    plain = F.trim(F.regexp_replace(F.translate(text, "\t\n\x0b\x0c\r", "     "), " +", " "))
    return F.when(text.isNull() | (plain == ""), 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1).cast("long")


def _random(key: Column, provenance: Column) -> Column:
    """A number in (0, 1) that depends on the record alone: 52 bits of an MD5."""
    text = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(provenance, F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``provenance, source_size, target`` for ``provenance, source_size``.

    Provenances in code point order (null last) weigh ``weights``, repeating. They share the sum of
    all sizes by weight; a target stops at ``most`` times the size, and the excess is shared again
    among the others until no target is above. The table has one row for each provenance.
    """
    order = Window.orderBy(F.col("provenance").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    room = F.lit(most) * F.col("source_size")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Provenances reach their limit in the order of limit / weight. The first that need not stop
    # there has limit / weight >= (rest of the sum) / (rest of the weights).
    fill = Window.orderBy("full_at", F.col("provenance").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = (
        sizes.withColumn("w", w).withColumn("full_at", room / F.col("w"))
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum(room).over(fill), F.lit(0.0)))
                    / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(fill), F.lit(0.0))))
        .withColumn("place", F.row_number().over(Window.orderBy("full_at", F.col("provenance").asc_nulls_last())))
        .withColumn("level", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("place", "level"))).over(whole)["level"])
    )
    return t.select("provenance", "source_size", F.least(room, F.col("w") * F.col("level")).alias("target"))


def _odds_scale(rest: DataFrame) -> DataFrame:
    """``provenance, c, sure``: records of at least ``sure`` words are certain, others have probability c * size.

    ``rest`` has ``provenance, size, n, missing``: records by size, and the words still missing. The
    expected words of the sample equal ``missing``. A provenance has as many rows as distinct sizes.
    """
    above = Window.partitionBy("provenance").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("provenance").orderBy(F.desc("size")).rowsBetween(0, Window.unboundedFollowing)
    got = F.col("missing") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(above), F.lit(0))
    squares = F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).over(below)
    c = rest.withColumn("c", got / squares).where(F.col("c") * F.col("size") <= 1)
    return c.groupBy("provenance").agg(F.max_by(F.struct("c", "size"), "size").alias("s")).select("provenance", "s.c", F.col("s.size").alias("top"))


def mix(
    deployments: DataFrame,
    *,
    key: str = "platform_id",
    note: str = "note",
    provenance: str = "provenance",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How often the mix takes each deployment record: ``key, size, source_size, target, copies, taken``.

    ``size`` is the number of words of the note (null: none), ``source_size`` their sum over the
    provenance (of null too), ``target`` its share (see :func:`targets`). A record gets
    ``floor(target / source_size)`` certain whole copies, and the rest of the target is a sample of
    fixed size: a record of s words has the inclusion probability p = min(1, c s), with c such that
    the expected words are those that are missing; records are ranked by their random odds
    u / (1 - u) divided by p / (1 - p) (Pareto order sampling) and taken from the lowest rank up to
    the last that still fits; then the one further record whose size comes nearest to what is left is added
    where that brings the sum nearer. ``taken = copies * size``; no record exceeds ``most`` copies.

    Random numbers are hashes of key and provenance, so reruns agree at any partitioning; equal
    ranks go by key, then size; records equal in all of these are taken together or not at all.
    Empty and null notes have size 0, are in the sample as often as certain copies say and add no
    words. An empty table gives an empty table. ``keep`` names further columns to carry along.

    DataFrame functions only. The words are counted once and written with the keys; no window holds
    more than one bin of 65,536 of a provenance, or its distinct sizes.
    """
    d = deployments.select(
        F.col(key).alias("k"), F.col(provenance).cast("string").alias("provenance"), n_words(F.col(note)).alias("size"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
    )
    d = shared.cut(d)
    by_size = d.groupBy("provenance", "size").agg(F.count(F.lit(1)).alias("n"))
    source = targets(by_size.groupBy("provenance").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, float(most))
    source = source.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    source = source.withColumn("missing", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")))
    pairs = by_size.alias("a").join(source.alias("b"), F.col("a.provenance").eqNullSafe(F.col("b.provenance")))
    scale = _odds_scale(pairs.where("missing > 0 AND size > 0").select("a.provenance", "size", "n", "missing"))
    source = source.alias("a").join(scale.alias("b"), F.col("a.provenance").eqNullSafe(F.col("b.provenance")), "left").select("a.*", "b.c", "b.top")
    source = shared.cut(source.coalesce(1))
    small = source.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)

    u = _random(F.col("k"), F.col("a.provenance"))
    p = F.when(F.col("size") > F.coalesce("top", F.lit(0)), 1.0).otherwise(F.col("c") * F.col("size"))
    rank = F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - p)))
    # rank / (1 + rank) grows with the rank and lies in [0, 1).
    ranked = (
        d.alias("a").join(hint(source.alias("b")), F.col("a.provenance").eqNullSafe(F.col("b.provenance")))
        .select("k", "size", *[f"keep_{c}" for c in keep], F.col("a.provenance").alias("provenance"), "source_size", "target", "whole", "missing",
                F.when((F.col("missing") > 0) & (F.col("size") > 0), rank).alias("rank"))
        .withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("long"))
    )
    ranked = shared.cut(ranked)
    order = Window.partitionBy("provenance").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        ranked.where("rank IS NOT NULL").groupBy("provenance", "bin").agg(F.sum("size").alias("words"), F.max("missing").alias("missing"))
        .withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    )
    # The bin in which the sum passes what is missing; bins below it are taken whole.
    edge = bins.where("before <= missing AND before + words > missing").groupBy("provenance").agg(F.min("bin").alias("edge"), F.min_by("before", "bin").alias("before"))
    ranked = ranked.alias("a").join(hint(edge.alias("b")), F.col("a.provenance").eqNullSafe(F.col("b.provenance")), "left").select("a.*", "edge", "before")
    inside = Window.partitionBy("provenance").orderBy("rank", "k", "size")  # equal records together
    at_edge = ranked.where("bin = edge").withColumn("upto", F.col("before") + F.sum("size").over(inside))
    # A record of the edge bin is in while the sum does not pass what is missing.
    stop = at_edge.groupBy("provenance").agg(
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("missing"), F.col("upto"))), F.max("before")).alias("got"),
        F.min(F.when(F.col("upto") > F.col("missing"), F.struct("rank", "k", "size"))).alias("out"),
        F.max("missing").alias("missing"),
    )
    out = ranked.alias("a").join(hint(stop.alias("b")), F.col("a.provenance").eqNullSafe(F.col("b.provenance")), "left").select(
        "a.*", (F.col("b.missing") - F.col("b.got")).alias("left"),
        F.when(F.col("rank").isNull(), F.lit(False)).when(F.col("edge").isNull(), F.lit(True)).when(F.col("bin") < F.col("edge"), F.lit(True))
        .when(F.col("bin") > F.col("edge"), F.lit(False)).otherwise(F.coalesce(F.struct("a.rank", "a.k", "a.size") < F.col("out"), F.lit(True))).alias("taken_once"),
    )
    # What is left is less than the first record that did not fit; one other record may come nearer.
    filler = (
        out.where("rank IS NOT NULL AND NOT taken_once AND size < 2 * left")
        .groupBy("provenance", "left", "rank", "k", "size").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("size") * F.col("n") < 2 * F.col("left"))
        .groupBy("provenance").agg(F.min(F.struct(F.abs(F.col("left") - F.col("size") * F.col("n")).alias("off"), "rank", "k", "size")).alias("f"))
    )
    out = out.alias("a").join(hint(filler.alias("b")), F.col("a.provenance").eqNullSafe(F.col("b.provenance")), "left")
    extra = F.col("taken_once") | F.coalesce(F.struct("a.rank", "a.k", "a.size") == F.struct("f.rank", "f.k", "f.size"), F.lit(False))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return out.select(
        F.col("k").alias(key), "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
        *[F.col(f"keep_{c}").alias(c) for c in keep],
    )
