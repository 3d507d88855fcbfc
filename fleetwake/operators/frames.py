"""Ordered windows over tracks that never put one whole track into one task.

A plain ``Window.partitionBy(platform)`` sorts each platform in a single task, and a platform
may hold a third of all rows. The primitives here cut every track first:

* :func:`scan` cuts by chunks of the ordering value, runs the window inside ``(key, chunk)``
  and carries one row per chunk (last row, first row, sums) across the chunk borders. The facts
  are shuffled once by ``(key, chunk)``; only the per-chunk carry table sees a window by key.
* :func:`blocks` numbers the rows and cuts them into blocks of equal row count with a halo of
  neighbour rows, for frames that look a fixed number of rows to either side.
* :func:`quantiles` finds exact quantiles by rank with a two-level histogram instead of a value
  map held by one task.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000
CHUNK_US = DAY_US  # 288 rows at a fix every five minutes
BLOCK_ROWS = 32_768
_NULL_CHUNK = -(2**62)
NULL_ROWS = 4096  # rows without an ordering value in one chunk, by their second ordering column
LOT_ROWS = 4096  # rows of small groups that one call of a grouped function takes, on average
LOT_TASKS = 512


def shared_folder(spark) -> str:
    """The folder for written steps, which all executors share.

    ``spark.checkpoint.dir`` names it, or else the folder given to ``SparkContext.setCheckpointDir``.
    Where neither is set, local mode (driver and executors are one process) gets a temporary one;
    elsewhere that is an error, since other machines do not see a local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fleetwake-"))
        named = context.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write a step to the shared folder and go on from the written table.

    Ends the lineage, survives lost executors and keeps plans that read a step twice from
    computing it twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/fleetwake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_if_shuffled(df: DataFrame) -> DataFrame:
    """``cut`` unless the plan is still a plain scan with projections and filters."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return cut(df) if any(node in plan for node in ("Window [", "Join ", "Aggregate [", "MapInPandas", "FlatMapGroups")) else df


def in_lots(df: DataFrame, key, order, work, schema: str) -> DataFrame:
    """``work(rows of one group in order) -> {column: values}`` for every group, many small groups to a call.

    A call of a grouped function costs milliseconds whatever it gets, and AQE puts a small table into one task.
    So groups are thrown into lots by their hash, as many as the rows ask for; a lot is sorted once and cut into
    its groups there. The key columns come from the group; a group whose ``work`` returns nothing adds no row.
    """
    key, order = keys(key), keys(order)
    df = cut(df)
    lots = max(1, -(-df.count() // LOT_ROWS))
    names = [f.strip().split()[0] for f in schema.split(",")]

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key, *order], kind="stable", ignore_index=True)
        group = pdf.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        made: dict[str, list] = {c: [] for c in names}
        held, sizes = [], []
        for a, z in zip(starts, [*starts[1:], len(pdf)]):
            got = work(pdf.iloc[a:z])
            if not got:
                continue
            held.append(a)
            sizes.append(len(next(iter(got.values()))))
            for c, values in got.items():
                made[c].append(values)
        if not held:
            return pd.DataFrame(columns=names)
        at = np.repeat(held, sizes)
        return pd.DataFrame({c: np.concatenate(made[c]) if made[c] else pdf[c].to_numpy()[at] for c in names})

    lotted = df.withColumn("__lot", F.pmod(F.xxhash64(*key), F.lit(lots))).repartition(min(lots, LOT_TASKS), "__lot")
    return lotted.groupBy("__lot").applyInPandas(lambda pdf: call(pdf.drop(columns="__lot")), schema)


def keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def chunk_of(df: DataFrame, order: list[str], width: int) -> Column:
    """Chunk of the first ordering column; rows without it come first, in chunks of the second one."""
    c = F.col(order[0])
    if isinstance(df.schema[order[0]].dataType, T.TimestampType):
        c = F.unix_micros(c)
    empty = F.lit(_NULL_CHUNK)
    if len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.IntegralType):
        empty = F.coalesce(F.lit(_NULL_CHUNK) + F.floor(F.col(order[1]) / F.lit(NULL_ROWS)).cast("long"), F.lit(2 * _NULL_CHUNK))
    return F.coalesce(F.floor(c / F.lit(width)).cast("long"), empty)


def scan(
    df: DataFrame,
    key,
    order,
    *,
    width: int = CHUNK_US,
    lag: dict | None = None,
    lead: dict | None = None,
    total: dict | None = None,
    last: dict | None = None,
    first: dict | None = None,
) -> DataFrame:
    """Add neighbour, running-sum and fill columns along the order of each key.

    ``lag`` / ``lead``: ``{out: expr}`` evaluated on the previous / next row.
    ``total``: ``{out: expr}`` running sum up to and including the row.
    ``last`` / ``first``: ``{out: expr}`` nearest non-null value at or before / at or after it.
    The order must be total within a key; ``width`` is in the units of its first column
    (microseconds for timestamps).
    """
    key, order = keys(key), keys(order)
    lag, lead, total = lag or {}, lead or {}, total or {}
    last, first = last or {}, first or {}
    kinds = (("g", lag), ("d", lead), ("t", total), ("l", last), ("f", first))
    tmp = {(k, out): f"__{k}_{out}" for k, group in kinds for out in group}
    # The step is read twice below (rows and carry), so it must not be recomputed.
    df = cut_if_shuffled(df)
    base = df.withColumns(
        {
            "__chunk": chunk_of(df, order, width),
            **{tmp[k, out]: e for k, group in kinds for out, e in group.items()},
        }
    )
    rank = F.struct(*[F.col(c) for c in order])

    aggs: list[Column] = []
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(tmp["g", o]).alias(o) for o in lag]), rank).alias("__lag"))
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(tmp["d", o]).alias(o) for o in lead]), rank).alias("__lead"))
    aggs += [F.sum(tmp["t", o]).alias(tmp["t", o]) for o in total]
    for o in last:
        v = F.col(tmp["l", o])
        aggs.append(F.max_by(v, F.when(v.isNotNull(), rank)).alias(tmp["l", o]))
    for o in first:
        v = F.col(tmp["f", o])
        aggs.append(F.min_by(v, F.when(v.isNotNull(), rank)).alias(tmp["f", o]))
    by_chunk = Window.partitionBy(*key).orderBy("__chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    after = by_chunk.rowsBetween(1, Window.unboundedFollowing)
    carried = [F.col(k) for k in key] + [F.col("__chunk")]
    if lag:
        carried.append(F.lag("__lag").over(by_chunk).alias("__lag"))
    if lead:
        carried.append(F.lead("__lead").over(by_chunk).alias("__lead"))
    carried += [F.sum(tmp["t", o]).over(before).alias("__c" + tmp["t", o]) for o in total]
    carried += [F.last(tmp["l", o], True).over(before).alias("__c" + tmp["l", o]) for o in last]
    carried += [F.first(tmp["f", o], True).over(after).alias("__c" + tmp["f", o]) for o in first]
    carry = base.groupBy(*key, "__chunk").agg(*aggs).select(*carried)

    here = Window.partitionBy(*key, "__chunk").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    onward = here.rowsBetween(0, Window.unboundedFollowing)
    local = [F.col(c) for c in df.columns] + [F.col("__chunk")]
    if lag or lead:
        local.append(F.row_number().over(here).alias("__rn"))
    if lag:
        local += [F.lag(tmp["g", o]).over(here).alias(tmp["g", o]) for o in lag]
    if lead:
        local += [F.lead(tmp["d", o]).over(here).alias(tmp["d", o]) for o in lead]
        local.append(F.lead(F.lit(1)).over(here).isNull().alias("__end"))
    local += [F.sum(tmp["t", o]).over(upto).alias(tmp["t", o]) for o in total]
    local += [F.last(tmp["l", o], True).over(upto).alias(tmp["l", o]) for o in last]
    local += [F.first(tmp["f", o], True).over(onward).alias(tmp["f", o]) for o in first]

    joined = base.select(*local).join(carry, key + ["__chunk"], "left")
    out = {}
    for o in lag:
        out[o] = F.when(F.col("__rn") == 1, F.col(f"__lag.{o}")).otherwise(F.col(tmp["g", o]))
    for o in lead:
        out[o] = F.when(F.col("__end"), F.col(f"__lead.{o}")).otherwise(F.col(tmp["d", o]))
    for o in total:
        here_sum, prior = F.col(tmp["t", o]), F.col("__c" + tmp["t", o])
        out[o] = F.when(
            here_sum.isNotNull() | prior.isNotNull(),
            F.coalesce(here_sum, F.lit(0)) + F.coalesce(prior, F.lit(0)),
        )
    for o in last:
        out[o] = F.coalesce(F.col(tmp["l", o]), F.col("__c" + tmp["l", o]))
    for o in first:
        out[o] = F.coalesce(F.col(tmp["f", o]), F.col("__c" + tmp["f", o]))
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[c.alias(o) for o, c in out.items()])


def number(df: DataFrame, key, order, *, width: int = CHUNK_US, out: str = "pos") -> DataFrame:
    """Zero-based position of each row along its key."""
    return scan(df, key, order, width=width, total={out: F.lit(1).cast("long")}).withColumn(
        out, F.col(out) - 1
    )


def islands(df: DataFrame, key, order, starts: Column, *, width: int = CHUNK_US, out: str = "island"):
    """Number the runs that begin where ``starts`` holds (0 before the first start)."""
    flag = F.coalesce(starts, F.lit(False)).cast("long")
    return scan(df, key, order, width=width, total={out: flag})


def blocks(
    df: DataFrame, key, order, *, halo: int, width: int = CHUNK_US, size: int = BLOCK_ROWS
) -> DataFrame:
    """Rows cut into blocks of ``size`` with ``halo`` neighbour rows copied into each block.

    Adds ``pos``, ``__block`` and ``__core``; run windows over :func:`block_window` and keep
    the rows with ``__core`` afterwards (see :func:`core`).
    """
    if halo >= size:
        raise ValueError("halo must be smaller than the block size")
    numbered = number(df, key, order, width=width)
    b = F.floor(F.col("pos") / size)
    r = F.col("pos") % size
    targets = F.filter(
        F.array(b, F.when((r < halo) & (b > 0), b - 1), F.when(r >= size - halo, b + 1)),
        lambda x: x.isNotNull(),
    )
    return numbered.withColumn("__block", F.explode(targets)).withColumn(
        "__core", F.col("__block") == F.floor(F.col("pos") / size)
    )


def block_window(key) -> Window:
    return Window.partitionBy(*keys(key), "__block").orderBy("pos")


def core(df: DataFrame, keep_pos: bool = False) -> DataFrame:
    drop = ["__block", "__core"] + ([] if keep_pos else ["pos"])
    return df.where("__core").drop(*drop)


def _coarse(v: Column) -> Column:
    """A monotone map of doubles to a bounded set of integers: 4,096 steps for each power of two, at any size.

    Near a power of two the exponent may be one off; the step then is -1 or 4,096, which is the
    same integer.
    """
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    steps = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 4096)
    return F.when(size > 0, F.signum(v) * ((exponent + 1100) * 4096 + steps)).otherwise(0).cast("long")


def quantiles(df: DataFrame, key, values: dict, probs: dict, *, few: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles of several expressions per key.

    ``values``: ``{name: expr}``, ``probs``: ``{suffix: p}``; the result has the key and one
    column ``name_suffix`` each. Equal values are counted before the shuffle, a histogram of
    coarse value buckets finds the buckets that hold the wanted ranks, and only those are ordered.
    ``name_n`` is the count of non-null values.

    ``few`` is for a handful of keys with many different values each: the rows are read twice, once for the
    histogram and once for the wanted buckets, which are broadcast; other values are never shuffled.
    """
    key = keys(key)
    long = df.select(
        *key,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("__m"), e.cast("double").alias("__v")) for n, e in values.items()])
        ).alias("__s"),
    ).select(*key, "__s.*").where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    g = key + ["__m"]
    if few:
        long = long.withColumn("__b", _coarse(F.col("__v")))
        hist = long.groupBy(*g, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    else:
        counts = (
            long.groupBy(*g, "__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", _coarse(F.col("__v")))
        )
        hist = counts.groupBy(*g, "__b").agg(F.sum("__n").alias("__bn"))
    wb = Window.partitionBy(*g).orderBy("__b")
    whole = Window.partitionBy(*g)
    plist = list(probs.items())
    hist = hist.select(
        *g, "__b",
        (F.sum("__bn").over(wb) - F.col("__bn")).alias("__before"), "__bn",
        F.sum("__bn").over(whole).alias("__total"),
    )
    at = [F.lit(float(p)) * (F.col("__total") - 1) for _, p in plist]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at])))
    wanted = hist.withColumn("__ranks", ranks).where(
        F.exists("__ranks", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__bn")))
    )
    if few:
        detail = long.join(F.broadcast(wanted.drop("__ranks")), g + ["__b"]).groupBy(*g, "__b", "__before", "__total", "__v").agg(F.count(F.lit(1)).alias("__n"))
    else:
        detail = counts.join(wanted, g + ["__b"])
    inside = Window.partitionBy(*g, "__b").orderBy("__v")
    detail = detail.withColumn(
        "__hi", F.col("__before") + F.sum("__n").over(inside)
    ).withColumn("__lo", F.col("__hi") - F.col("__n"))

    def pick(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__lo")) & (rank < F.col("__hi")), F.col("__v")))

    aggs = [F.max("__total").alias("__n")]
    for i, a in enumerate(at):
        aggs += [pick(F.floor(a)).alias(f"__a{i}"), pick(F.ceil(a)).alias(f"__z{i}")]
    got = detail.groupBy(*g).agg(*aggs)
    fields = [F.col("__n").alias("n")]
    for i, (s, p) in enumerate(plist):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        t = pos - F.floor(pos)
        fields.append((F.col(f"__a{i}") + (F.col(f"__z{i}") - F.col(f"__a{i}")) * t).alias(s))
    got = got.select(*g, F.struct(*fields).alias("__q"))
    wide = got.groupBy(*key).agg(
        *[F.max(F.when(F.col("__m") == n, F.col("__q"))).alias(f"__q_{n}") for n in values]
    )
    return wide.select(
        *key,
        *[
            F.coalesce(F.col(f"__q_{n}.n"), F.lit(0)).alias(f"{n}_n") if s == "n" else F.col(f"__q_{n}.{s}").alias(f"{n}_{s}")
            for n in values
            for s in ["n", *probs]
        ],
    )


def plane_pairs(df: DataFrame, on, ident: str, within: float, *, x: str = "x_m", y: str = "y_m", spread: int = 1, columns: list[str] | None = None,
                listed: tuple[str, str] | None = None) -> DataFrame:
    """The pairs of :func:`salted_pairs` that are at most ``within`` apart in the plane, and no others.

    Rows meet through square cells of twice that width: one row in its own cell, the other also in those of
    four of the eight cells around that it reaches, so that each pair is made once and far pairs never form. Rows
    without a position make no pair. ``spread`` cuts crowded cells as it cuts groups there. ``listed`` names two more
    columns, the number of a member and the words of 62 bits of those it may meet; other pairs do not form.
    """
    on = keys(on)
    columns = columns or [c for c in df.columns if c not in on]
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    number, bits = listed or ("__r", "__r")
    wide = 2 * within
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *on, F.floor(F.col(x) / wide).cast("long").alias("__x"), F.floor(F.col(y) / wide).cast("long").alias("__y"), row.alias("__r"), *(listed or ()))
    reach = within * (1 + 1e-9)
    low, high = F.col(f"__r.{x}") - reach <= F.col("__x") * wide, F.col(f"__r.{x}") + reach >= (F.col("__x") + 1) * wide
    up = F.col(f"__r.{y}") + reach >= (F.col("__y") + 1) * wide
    cell = lambda i, j: F.struct((F.col("__x") + i).alias("x"), (F.col("__y") + j).alias("y"), F.lit((i, j) == (0, 0)).alias("home"))
    around = F.array(cell(0, 0), F.when(high, cell(1, 0)), F.when(low & up, cell(-1, 1)), F.when(up, cell(0, 1)), F.when(high & up, cell(1, 1)))
    left = cells.select(*on, "__x", "__y", F.col("__r").alias("__a"), F.col(bits).alias("__bits"))
    right = cells.select(*on, F.explode(around).alias("__c"), F.col("__r").alias("__b"), F.col(number).alias("__no")).where("__c IS NOT NULL").select(
        *on, F.col("__c.x").alias("__x"), F.col("__c.y").alias("__y"), F.col("__c.home").alias("__home"), "__b", "__no")
    key = [*on, "__x", "__y"]
    if spread > 1:
        share = F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<long>")
        left = left.withColumn("__i", F.pmod(F.xxhash64(f"__a.{ident}"), F.lit(spread))).withColumn("__j", F.explode(share))
        right = right.withColumn("__j", F.pmod(F.xxhash64(f"__b.{ident}"), F.lit(spread))).withColumn("__i", F.explode(share))
        key += ["__i", "__j"]
    a, b = F.col(f"__a.{ident}"), F.col(f"__b.{ident}")
    dx, dy = F.col(f"__b.{x}") - F.col(f"__a.{x}"), F.col(f"__b.{y}") - F.col(f"__a.{y}")
    met = ((a < b) | (~F.col("__home") & (a != b))) & (dx * dx + dy * dy <= within * within * (1 + 1e-12))
    if listed:
        n = F.col("__no")
        met &= F.call_function("shiftright", F.get(F.col("__bits"), F.floor(n / 62).cast("int")), (n % 62).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = left.join(right, key).where(met)
    # An expression that is not deterministic keeps filters on what follows from a pair above the swap; pushed
    # into the join, they would write out the whole chain for each of its uses, too much code to be compiled.
    swap = ~(a < b) & (F.spark_partition_id() >= 0)
    first, second = (F.when(swap, F.col(f"__{q}")).otherwise(F.col(f"__{p}")) for p, q in ("ab", "ba"))
    met = met.select(*on, first.alias("__f"), second.alias("__s"))
    return met.select(*on, *[F.col(f"__f.{c}").alias(f"{c}_1") for c in columns], *[F.col(f"__s.{c}").alias(f"{c}_2") for c in columns])


def salted_pairs(
    df: DataFrame,
    on,
    ident: str,
    *,
    spread: int = 1,
    columns: list[str] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Join rows that share ``on`` into pairs with ``ident_1 < ident_2``.

    A group whose members exceed one task is cut into ``spread`` × ``spread`` cells: the left row
    meets every right share and the right row every left share, so each pair is made in exactly one
    cell. ``on`` holds plain equality keys; the other columns get the suffixes ``_1`` / ``_2``.
    """
    on = keys(on)
    columns = columns or [c for c in df.columns if c not in on]
    left = df.select(*on, *[F.col(c).alias(f"{c}_1") for c in columns])
    right = df.select(*on, *[F.col(c).alias(f"{c}_2") for c in columns])
    key = list(on)
    if spread > 1:
        share = F.array(*[F.lit(i).cast("long") for i in range(spread)])
        left = left.withColumn("__i", F.pmod(F.xxhash64(f"{ident}_1"), F.lit(spread))).withColumn("__j", F.explode(share))
        right = right.withColumn("__j", F.pmod(F.xxhash64(f"{ident}_2"), F.lit(spread))).withColumn("__i", F.explode(share))
        key = key + ["__i", "__j"]
    cond = [left[k] == right[k] for k in key]
    if ordered:
        cond.append(F.col(f"{ident}_1") < F.col(f"{ident}_2"))
    out = left.join(right, _all(cond))
    return out.select(*[left[k] for k in on], *[f"{c}_1" for c in columns], *[f"{c}_2" for c in columns])
