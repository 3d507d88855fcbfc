"""The most similar platforms by profile: exact top-k inner products from sorted lists.

A profile is a vector of numbers for each platform, all of one length: the counts of its value
histogram (``operators.signals.histogram_counts``) as an array, its diagnostics, or a learnt vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwake.llm import shared

#: Profiles of one block, queries searched at once, such runs of queries that meet a block in one call, and pairs of blocks wanted.
BLOCK, QUERIES, RUNS, SPREAD = 8192, 512, 32, 64
#: Scores whose parts stay below this are exact in doubles.
EXACT = float(2**52)


def scaled(profile: Column, scale: float) -> Column:
    """floor(scale * x) of every component as double; NULL where one of them is null or not finite."""
    x = profile.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # floor() gives a long, which holds less than a double: only values that fit are rounded.
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < EXACT, F.floor(v * scale).cast("double")).otherwise(v * scale))
    return F.when(x.isNotNull() & ~bad, whole)


class Lists:
    """Profiles of one block and, for each component, their places in the list sorted by it.

    A query reads the list of a component from the top where its own component is positive, from
    the bottom where it is negative, and not at all where it is zero.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.n, self.d = x.shape
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.place = np.empty((self.n, self.d), np.int32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)

    def bounds(self, weights: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x profiles) once ``depth`` entries of every list are read.

        ``weights`` holds the positive parts of the queries, then the negative ones. A component that
        was seen counts with its value; one that was not lies between the far end of its list and the
        last entry read.
        """
        seen = np.hstack([self.place >= self.n - depth, self.place < depth])
        partial = weights @ np.where(seen, np.hstack([self.x, self.x]), 0).astype(weights.dtype).T
        unseen = (~seen).astype(weights.dtype).T
        ends = np.hstack([self.sorted[0], self.sorted[-1]])
        fronts = np.hstack([self.sorted[self.n - depth], self.sorted[depth - 1]])
        return tuple(partial + (weights * limit.astype(weights.dtype)) @ unseen for limit in (ends, fronts))

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int, rounds: int) -> list[tuple]:
        """The k best (query, profile, score) of the block for each query, ties to the smaller id.

        The lists are read in step, a stretch at a time. After each stretch a query is done when no
        more than a few profiles have an upper bound that reaches its k-th best lower bound, so that
        no outsider can qualify; the final scores of those left are then resolved. Ties stay in:
        a profile goes only when its upper bound is below. Lists read to their ends leave every
        profile, with all of its score known.
        """
        most = float(np.abs(self.x).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * max(self.d, 1)
        # Single precision holds whole numbers below 2^24.
        kind = np.float32 if most < 2**23 else np.float64
        weights = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).astype(kind)
        open_, stretch, out = np.arange(len(q)), -(-self.n // rounds), []
        depth = 0 if most < EXACT else self.n
        while len(open_):
            depth = min(depth + stretch, self.n)
            own = self.ids[None, :] == query_ids[open_, None]
            if depth < self.n and self.n > k:
                lower, upper = self.bounds(weights[open_], depth)
                lower[own] = -np.inf
                bar = np.partition(lower, self.n - k, axis=1)[:, self.n - k]
                left = (upper >= bar[:, None]) & ~own
                done = left.sum(axis=1) <= 8 * k
            else:
                left, done = ~own, np.ones(len(open_), bool)
            for j in np.flatnonzero(done):
                out += self.resolved(query_ids[open_[j]], np.flatnonzero(left[j]), q[open_[j]], k, most)
            open_ = open_[~done]
        return out

    def resolved(self, query, rows: np.ndarray, q: np.ndarray, k: int, most: float) -> list[tuple]:
        if most < EXACT:
            score = (self.x[rows] @ q).astype(np.int64)
        else:  # beyond doubles: whole numbers of any size, held to the range of a long
            whole = [[int(v) for v in r] for r in self.x[rows]]
            w = [int(v) for v in q]
            score = np.array([min(max(sum(a * b for a, b in zip(r, w, strict=True)), -(2**63)), 2**63 - 1) for r in whole], np.int64)
        ids = self.ids[rows]
        best = np.lexsort((ids, -score))[:k] if most < EXACT else sorted(range(len(rows)), key=lambda i: (-int(score[i]), ids[i]))[:k]
        return [(query, ids[i], int(score[i])) for i in best]


def _block(rows: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and profiles (rows x ``d``) of one block."""
    return np.array(rows.column("k").to_pylist()), pc.list_flatten(rows.column("x")).to_numpy().reshape(-1, d) if d else np.empty((rows.num_rows, 0))


def most_similar(
    profiles: DataFrame, queries: Column | str | None = None, *, key: str = "platform_id", profile: str = "profile", scale: float = 256.0,
    k: int = 5, block: int = BLOCK, query_block: int = QUERIES, rounds: int = 8,
) -> DataFrame:
    """The ``k`` most similar platforms of each query platform: ``query_id, rank, key, score``.

    Components become floor(``scale`` * x); the score is the integer inner product. ``queries`` is a
    condition on the rows of ``profiles`` (default: every row is a query). Candidates are all other
    rows; rows with the query's own key are its own. Ranks count from 1, ties go to the smaller key, and
    there are fewer than ``k`` rows where there are fewer candidates. Profiles that are null or hold a null
    or non-finite component take no part; profiles of different lengths do not meet. Rows without a key
    take no part; a repeated key is one query, its first profile (by value) counting, and every
    one of its rows is a candidate. An empty table gives no rows; other columns are ignored.

    Profiles are dealt into blocks of about ``block`` rows by hash, queries into blocks of up to ``RUNS`` times
    ``query_block``; each pair of blocks meets in one call, by a shuffle of both on the two block numbers. It is no
    join that could turn into a broadcast: the copies of all queries for all blocks grow with the square of the table.
    In a pair of blocks, for ``query_block`` queries at a time, the sorted lists of the components are read without
    random access: bounds on every score follow from the entries read so far, and reading stops when no outsider
    can qualify (see :class:`Lists`). The best of a block go on to the ranking of their query.
    """
    kind = profiles.schema[key].dataType.simpleString()
    chosen = F.lit(True) if queries is None else (F.expr(queries) if isinstance(queries, str) else queries)
    rows = profiles.select(F.col(key).alias("k"), scaled(F.col(profile), scale).alias("x"), F.coalesce(chosen, F.lit(False)).alias("q"))
    rows = shared.cut(rows.where("k IS NOT NULL AND x IS NOT NULL").withColumn("d", F.size("x")))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("m")).first()
    n_blocks = max(1, -(-sizes["n"] // block))
    n_queries = max(1, -(-sizes["m"] // (query_block * RUNS)), min(-(-sizes["m"] // query_block), -(-SPREAD // n_blocks)))
    hashed = F.xxhash64("k", "x", F.monotonically_increasing_id())
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("k", "x", "d", F.pmod(hashed, F.lit(n_blocks)).cast("int").alias("i")).withColumn("j", blocks(n_queries))
    asked = rows.where("q").groupBy("k").agg(F.min("x").alias("x")).withColumn("d", F.size("x"))
    right = asked.withColumn("j", F.pmod(F.xxhash64("k"), F.lit(n_queries)).cast("int")).withColumn("i", blocks(n_blocks))

    def search(key, profiles: pa.Table, asked: pa.Table) -> pa.Table:
        found, ids = [], profiles.schema.field("k").type
        if profiles.num_rows and asked.num_rows:
            lists = Lists(*_block(profiles, key[0].as_py()))
            asked_ids, q = _block(asked, key[0].as_py())
            for a in range(0, len(q), query_block):
                found += lists.top(asked_ids[a : a + query_block], q[a : a + query_block], k, rounds)
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (ids, ids, pa.int64()), strict=True)], names=["query_id", "k", "score"])

    by = ["d", "i", "j"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, f"query_id {kind}, k {kind}, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "k")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("k").alias(key), "score")
