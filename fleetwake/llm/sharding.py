"""Reshard deployment notes with the fewest bytes moved: minimum-cost flow between shard sizes."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.llm import shared


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow (i, j) → amount that ships every supply into the capacities at the least total cost.

    Successive shortest augmenting paths with potentials. ``cost(i, j)`` is at least 0. The tables
    are shard sizes, a few numbers for each shard and never rows. Ties take the lowest shard.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than the supply")
    n, m = len(supply), len(capacity)
    flow = {(i, j): 0 for i in range(n) for j in range(m)}
    left, room = list(supply), list(capacity)
    high = [0] * (n + m)
    for s in range(n):
        while left[s]:
            best, back, queue = {s: 0}, {}, [(0, s)]
            while queue:
                d, v = heappop(queue)
                if d > best[v]:
                    continue
                steps = [(n + j, cost(v, j)) for j in range(m)] if v < n else [(i, -cost(i, v - n)) for i in range(n) if flow[i, v - n]]
                for w, c in steps:
                    reach = d + c + high[v] - high[w]
                    if w not in best or reach < best[w]:
                        best[w], back[w] = reach, v
                        heappush(queue, (reach, w))
            ends = [(best[n + j] + high[n + j] - high[s], j) for j in range(m) if room[j] and n + j in best]
            _, j = min(ends)
            top = best[n + j]
            for v in range(n + m):
                high[v] += min(best.get(v, top), top)
            path, v = [], n + j
            while v != s:
                path.append((back[v], v))
                v = back[v]
            amount = min([left[s], room[j], *(flow[b, a - n] for a, b in path if a >= n)])
            for a, b in path:
                if a < n:
                    flow[a, b - n] += amount
                else:
                    flow[b, a - n] -= amount
            left[s] -= amount
            room[j] -= amount
    return {k: v for k, v in flow.items() if v}


def even(total: int, n: int) -> list[int]:
    """Capacities that share a total as evenly as whole numbers allow."""
    return [total // n + (i < total % n) for i in range(n)]


def plan(deployments: DataFrame, *, old: Column, n_old: int, n_new: int = 16, key: str = "platform_id", note: str = "note",
         capacities: list[int] | None = None, cost=None, bins: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """The new place of every deployment record: ``key, size, text_crc32, old_shard, shard, slot``.

    ``old`` is the shard that a record lies in now (0 to ``n_old`` - 1; null: 0). A record with another
    number lies outside of the old shards: it is placed like the others and counts as moved wherever
    it goes. ``size`` is the UTF-8
    bytes of its note (null: none) plus 1. ``capacities`` are the bytes of the new shards, near equal
    by default. Minimum-cost flow over the sums of the shards says how many bytes go from each old
    to each new shard (``cost(i, j)`` a byte; by default 0 where the shard stays, else 1, so that
    the fewest bytes move). Within an old shard records are ordered by their text's hash, so that
    equal texts lie together, and the flows cut that order: a record goes where the middle of its
    bytes falls. Records, not groups of equal texts, are what is moved: a group that lies in several old
    shards, or at a border, stays spread where keeping it together would move more bytes. Each new shard thus differs from its capacity by less than its border records;
    ``slot`` numbers the records of a shard from 0 without gaps.

    The order is cut into ``bins`` ranges of hashes of each old shard, finer by key hash, and places
    come from sums over those ranges; only the rows of one range are sorted together, and a range
    with more than its share (many equal texts) spreads over the hash of its keys. The driver sees
    the old shards' sums alone. Notes are read once and never shuffled.

    Null keys are records like others. Equal records get one slot each. An empty table gives an
    empty table. ``keep`` names columns to carry along; other columns are ignored.
    """
    text = F.coalesce(F.col(note).cast("binary"), F.lit(b""))
    d = deployments.select(
        F.col(key).alias("k"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce(old, F.lit(0)).cast("int").alias("old_shard"), F.xxhash64(text).alias("h"), F.xxhash64(F.col(key).cast("string")).alias("g"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
    )
    d = d.withColumn("source", F.when(F.col("old_shard").between(0, n_old - 1), F.col("old_shard")).otherwise(n_old))
    d = d.withColumn("bin", F.shiftrightunsigned("h", 64 - (bins - 1).bit_length()).cast("int")).withColumn("sub", F.shiftrightunsigned("g", 56).cast("int"))
    d = shared.cut(d)
    sums = {r.source: r.size for r in d.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    supply = [sums.get(i, 0) for i in range(n_old + 1)]
    capacities = capacities or even(sum(supply), n_new)
    cost = cost or (lambda i, j: int(i != j))
    flows = min_cost_flow(supply, capacities, lambda i, j: cost(i, j) if i < n_old else 1)

    # Bytes and rows before each (source, bin, sub): at most (n_old + 1) x bins x 256 rows, however many records.
    cells = d.groupBy("source", "bin", "sub").agg(F.sum("size").alias("bytes"))
    line = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    in_bin = Window.partitionBy("source", "bin").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = cells.groupBy("source", "bin").agg(F.sum("bytes").alias("b")).withColumn("before_bin", F.coalesce(F.sum("b").over(line), F.lit(0)))
    cells = cells.withColumn("before_sub", F.coalesce(F.sum("bytes").over(in_bin), F.lit(0))).join(per_bin.drop("b"), ["source", "bin"])
    cells = cells.select("source", "bin", "sub", (F.col("before_bin") + F.col("before_sub")).alias("before"))
    inside = Window.partitionBy("source", "bin", "sub").orderBy("h", "g", "k", "size", "text_crc32", *[f"keep_{c}" for c in keep]).rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("upto", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["source", "bin", "sub"])
    middle = F.col("before") + F.col("upto") + F.col("size") / 2
    shard = None
    for i in range(n_old + 1):
        out = sorted((j for a, j in flows if a == i), key=lambda j: (j != i, j))
        edge = 0
        for j in out:
            edge += flows[i, j]
            here = (F.col("source") == i) & ((middle <= edge) if j != out[-1] else F.lit(True))
            shard = F.when(here, j) if shard is None else shard.when(here, j)
    placed = placed.withColumn("shard", (shard if shard is not None else F.lit(0)).cast("int"))
    return number(placed, key, keep)


def number(placed: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """Add gapless slots; counts by (shard, old shard, bin, sub) come first, so no shard is sorted whole."""
    placed = shared.cut(placed)
    cell = ["shard", "old_shard", "bin", "sub"]
    counts = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    a = Window.partitionBy("shard").orderBy("old_shard", "bin").rowsBetween(Window.unboundedPreceding, -1)
    b = Window.partitionBy("shard", "old_shard", "bin").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy("shard", "old_shard", "bin").agg(F.sum("n").alias("n")).withColumn("a", F.coalesce(F.sum("n").over(a), F.lit(0))).drop("n")
    counts = counts.withColumn("b", F.coalesce(F.sum("n").over(b), F.lit(0))).drop("n").join(bins, ["shard", "old_shard", "bin"])
    inside = Window.partitionBy(*cell).orderBy("h", "g", "k", "size", "text_crc32", *[f"keep_{c}" for c in keep])
    out = placed.withColumn("r", F.row_number().over(inside)).join(counts, cell)
    return out.select(
        F.col("k").alias(key), "size", "text_crc32", "old_shard", "shard", (F.col("a") + F.col("b") + F.col("r") - 1).cast("long").alias("slot"),
        *[F.col(f"keep_{c}").alias(c) for c in keep],
    )


def rewrite(deployments: DataFrame, placed: DataFrame, path: str, *, key: str = "platform_id", note: str = "note", old: Column | None = None) -> list[int]:
    """Write the files of the shards that the plan changes under ``path/shard=…`` and return their numbers.

    A shard whose records all stay and which gets none keeps its files. ``placed`` is the plan of
    ``deployments``, of which every record meets one slot: by key (null is a key like others), size
    and hash of the note, the columns that the plan has carried along (``keep``) and the old shard where
    ``old`` is given as to the plan. Records equal in all these take their slots in turn, so ``old`` or
    ``keep`` is needed where records of one key and note lie in different shards and differ otherwise.
    Rows of one shard spread over several files by their slot, so no task holds a shard.
    """
    moved = placed.where("shard <> old_shard")
    touched = moved.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    numbers = sorted(r.s for r in touched.collect())  # at most one row for each shard
    text = F.coalesce(F.col(note).cast("binary"), F.lit(b""))
    kept = [c for c in placed.columns if c in deployments.columns and c not in (key, "size", "text_crc32", "old_shard", "shard", "slot")]
    own = {"key": F.col(key), "size": (F.octet_length(text) + 1).cast("long"), "crc": F.crc32(text)} | {f"keep_{c}": F.col(c) for c in kept}
    place = {"key": F.col(key), "size": F.col("size"), "crc": F.col("text_crc32")} | {f"keep_{c}": F.col(c) for c in kept}
    if old is not None:
        own, place = own | {"old": F.coalesce(old, F.lit(0)).cast("int")}, place | {"old": F.col("old_shard")}
    hashable = [c for c, kind in deployments.dtypes if "map<" not in kind and "variant" not in kind]
    line = Window.partitionBy(*own)
    rows = deployments.select(F.struct(*[F.col(c) for c in deployments.columns if c not in ("shard", "slot")]).alias("record"), F.xxhash64(*hashable).alias("order"), *[v.alias(k) for k, v in own.items()])
    rows = rows.withColumn("turn", F.row_number().over(line.orderBy("order"))).drop("order")
    slots = placed.select("shard", "slot", *[v.alias(k) for k, v in place.items()]).withColumn("turn", F.row_number().over(line.orderBy("shard", "slot")))
    slots = slots.where(F.col("shard").isin(numbers))
    same = rows["turn"] == slots["turn"]
    for k in own:
        same &= rows[k].eqNullSafe(slots[k])
    rows = rows.join(slots, same).select("record.*", "shard", "slot")
    spread = F.floor(F.col("slot") / 65536)
    rows.repartition("shard", spread).sortWithinPartitions("shard", "slot").write.mode("append").partitionBy("shard").parquet(path)
    return numbers
