"""The trie of review histories: which openings platforms share, rolled up by bands of depth.

A history is the sequence of reviews of one platform (``platform_id, reviewed_at, decision, note``)
in the order in which they were made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwake.llm import shared
from fleetwake.operators import frames

#: Depths of one band.
HEIGHT = 16
#: Reviews that one task orders, where the order is a number.
CHUNK = 4096
#: Fixed value: node names are sums modulo this prime, so they fit a long.
PRIME = 2**61 - 1
NODE = ["depth", "a", "b"]


def numbered(reviews: DataFrame, key: str, order: str, decision: str, digest: str, *, out: str = "pos") -> DataFrame:
    """Position of each review in its history, from 0; missing orders first, ties by decision and digest.

    Long histories are cut into chunks of the order, so none of them is sorted in one task.
    """
    width = frames.CHUNK_US if isinstance(reviews.schema[order].dataType, T.TimestampType) else CHUNK
    return frames.number(reviews, key, [order, decision, digest], width=width, out=out)


def _halves(text: Column) -> list[Column]:
    digest = F.md5(text.cast("binary"))
    return [F.conv(F.substring(digest, i, 15), 16, 10).cast("long") for i in (1, 17)]


def _summed(steps: str, i: Column, name: str, before: str) -> Column:
    return F.aggregate(F.slice(steps, 1, i + 1), F.col(before), lambda s, x: (s + x[name]) % PRIME)


def _bands(reviews: DataFrame, ids: DataFrame, height: int) -> DataFrame:
    """``k, band, last, keys``: the nodes of a history within one band of depths, one row for each band.

    A node is named by its depth and two sums, modulo a prime, of digests of (depth, review) over its
    path: equal beginnings have equal names, and the name of the parent follows by subtraction.
    """
    at = numbered(reviews, "k", "o", "r", "h", out="depth").withColumn("depth", F.col("depth") + 1)
    a, b = _halves(F.concat_ws(":", "depth", F.length("r"), "r", "h"))
    # Depth 0 is the root, which belongs to every history.
    start = [F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "units")]
    steps = at.select("k", "depth", a.alias("a"), b.alias("b"), "units").union(ids.select("k", *start))
    step = F.struct("depth", "a", "b", "units")
    banded = steps.groupBy("k", F.floor(F.col("depth") / height).cast("long").alias("band")).agg(
        F.array_sort(F.collect_list(step)).alias("steps"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(f"sum_{c}") for c in "ab"]
    )
    total = {f"upto_{c}": F.col(f"sum_{c}") for c in "ab"}
    carried = frames.scan(banded, "k", "band", width=CHUNK, total=total, lead={"next": F.lit(1)})
    before = {f"before_{c}": ((F.col(f"upto_{c}") - F.col(f"sum_{c}")) % PRIME).cast("long") for c in "ab"}

    def named(x: Column, i: Column) -> Column:
        key = {c: _summed("steps", i, c, f"before_{c}") for c in "ab"}
        parent = {f"p{c}": F.pmod(key[c] - x[c], F.lit(PRIME)) for c in "ab"}
        return F.struct(x["depth"].alias("depth"), *[v.alias(c) for c, v in {**key, **parent}.items()], x["units"].alias("units"))

    return carried.withColumns(before).select("k", "band", F.col("next").isNull().alias("last"), F.transform("steps", named).alias("keys"))


def _rolled(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*NODE).agg(F.min("k").alias("k"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _totals(bands: DataFrame, values: DataFrame, height: int, deepest: int) -> DataFrame:
    """``depth, a, b, k, leaves, saved``: sums of the values of every node over its subtree.

    ``bands``: keys of each history by band. ``values``: ``k, depth, leaves, saved`` of every node under
    its smallest member ``k``. A node goes only to its ancestors within its band, so a row grows by
    ``height`` at most. The roots of the bands with these sums are a tree of depths divided by
    ``height``, which is solved in the same way; their totals then go to the ancestors in the band above.
    The number of rounds is the logarithm of the depth to the base ``height``.
    """
    own = values.groupBy("k", F.floor(F.col("depth") / height).cast("long").alias("band")).agg(
        F.collect_list(F.struct("depth", "leaves", "saved")).alias("own"), F.max("depth").alias("end")
    )

    def under(e: Column, name: str) -> Column:
        return F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + F.when(x["depth"] >= e["depth"], x[name]).otherwise(0))

    reached = F.filter("keys", lambda e: e["depth"] <= F.col("end"))
    sums = F.transform(reached, lambda e: F.struct(*[e[c].alias(c) for c in NODE], under(e, "leaves").alias("leaves"), under(e, "saved").alias("saved")))
    within = _rolled(own.join(bands, ["k", "band"]).select("k", F.explode(sums).alias("s")).select("k", "s.*"))
    if deepest < height:
        return within
    within = shared.cut(within)
    roots = within.where(F.col("depth") % height == 0).select("k", (F.col("depth") / height).cast("long").alias("depth"), "leaves", "saved")
    head = F.get("keys", F.lit(0))
    above = bands.groupBy("k", F.floor(F.col("band") / height).cast("long").alias("upper")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("band").alias("depth"), head["a"].alias("a"), head["b"].alias("b")))).alias("keys")
    )
    whole = _totals(shared.cut(above.withColumnRenamed("upper", "band")), roots, height, deepest // height)
    below = whole.where("depth > 0").select("k", (F.col("depth") - 1).alias("band"), "leaves", "saved")
    passed = below.join(bands, ["k", "band"]).select("k", "leaves", "saved", F.explode("keys").alias("e"))
    return _rolled(within.unionByName(passed.select(*[F.col(f"e.{c}").alias(c) for c in NODE], "k", "leaves", "saved")))


def review_trie(
    reviews: DataFrame, platforms: DataFrame | None = None, *, key: str = "platform_id", order: str = "reviewed_at",
    decision: str = "decision", note: str = "note", height: int = HEIGHT,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie of review histories.

    Every distinct sequence of the first d reviews (decision and note) of some platform is a node of depth
    d; the root (d = 0) has no review. Platforms whose history begins with it are its members.

    ``nodes``: ``key`` (smallest member), ``depth``, ``parent_<key>`` (smallest member of the parent, null at the
    root), ``n_members``, ``n_children``, ``n_leaves`` (nodes without children in its subtree, itself included),
    ``saved_chars`` (over its subtree: (members - 1) x code points of the last note, which is what storing
    shared notes once saves), ``a, b`` (the name of the node, with its depth).
    ``ends``: ``depth, a, b, key`` for the node in which the history of each platform ends.

    ``platforms`` names further platforms, whose history may be empty. Reviews are ordered by ``order`` (a
    number or time; null first, then decision and a digest of the note). Null decisions and notes count as
    empty; equal reviews count as often as they occur; rows without a platform take no part; other columns
    are ignored. Without any platform there is no node.

    Notes are reduced to digests before anything is shuffled. Histories are cut into bands of ``height``
    depths; subtree sums are rolled up inside bands and carried across them (see :func:`_totals`), so neither
    the rounds nor the rows grow with the depth. Nodes that many platforms share are summed before they are
    shuffled.
    """
    text = F.coalesce(F.col(note), F.lit(""))
    rows = reviews.where(F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(decision), F.lit("")).alias("r"),
        F.md5(text.cast("binary")).alias("h"), F.char_length(text).cast("long").alias("units"),
    )
    ids = rows.select("k")
    if platforms is not None:
        ids = ids.union(platforms.where(F.col(key).isNotNull()).select(F.col(key).alias("k")))
    bands = shared.cut(_bands(rows, ids.distinct(), height))
    found = bands.select("k", F.explode("keys").alias("e")).select("k", "e.*").groupBy(*NODE).agg(
        F.min("k").alias("k"), F.count(F.lit(1)).alias("n"), F.max("units").alias("units"), F.max("pa").alias("pa"), F.max("pb").alias("pb")
    )
    found = shared.cut(found)
    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    n_children = found.where("depth > 0").select(*parent).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = shared.cut(found.join(n_children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    values = nodes.select("k", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("units")).alias("saved"))
    totals = _totals(bands, values, height, deepest).drop("k")
    # A parent of very many children makes a skewed join, which adaptive execution splits.
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("k").alias("up"))
    out = nodes.join(totals, NODE).join(above, ["depth", "pa", "pb"], "left").select(
        F.col("k").alias(key), "depth", F.when(F.col("depth") > 0, F.col("up")).alias(f"parent_{key}"), F.col("n").alias("n_members"),
        "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_chars"), "a", "b",
    )
    end = F.element_at("keys", -1)
    ends = bands.where("last").select(*[end[c].alias(c) for c in NODE], F.col("k").alias(key))
    return out, ends
