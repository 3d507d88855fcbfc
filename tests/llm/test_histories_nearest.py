"""The trie of review histories and the most similar profiles against plain versions."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwake.llm import histories, nearest, shared

EXTRA = ", k string, a string, b string, depth string, pos string, x string, q string, score string, rank string"


def table(spark, rows, schema):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], schema + EXTRA)


def plain_trie(rows, platforms):
    said = {p: [] for p in platforms if p is not None}
    for p, *_ in rows:
        if p is not None:
            said.setdefault(p, [])
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    for p, o, d, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", digest(r[3]))):
        if p is not None:
            said[p].append((d or "", t or ""))
    members, ends = {}, {}
    for p, turns in said.items():
        ends[tuple(turns)] = ends.get(tuple(turns), []) + [p]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(p)
    out = []
    for node, of in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = {m: sum(c[:-1] == m for c in members if c) for m in below}
        saved = sum((len(members[m]) - 1) * (len(m[-1][1]) if m else 0) for m in below)
        up = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), up, len(of), kids[node], sum(v == 0 for v in kids.values()), saved, sorted(ends.get(node, []))))
    return sorted(out)


def some_reviews(seed, platforms, longest):
    r = random.Random(seed)
    rows = []
    for p in range(platforms):
        for i in range(r.randrange(0, longest)):
            rows.append((p, i if r.random() < 0.97 else None, r.choice(["keep", "reject", None]) if i > 4 else "keep", r.choice(["drogue lost", "é 🙂", None, ""]) if i > 3 else "seen"))
    return rows


SCHEMA = "platform_id long, reviewed_at long, decision string, note string"


@pytest.mark.parametrize("height", [2, 3, 16])
def test_trie(spark, height):
    long = [(70, i, "keep", "seen" if i < 3 else f"pass {i}") for i in range(40)] + [(71, i, "keep", "seen" if i < 3 else f"pass {min(i, 30)}") for i in range(45)]
    rows = some_reviews(3, 60, 9) + long + [(72, 5, "keep", "seen")] * 4 + [(None, 1, "keep", "seen"), (73, 1, "keep", "x" * 20_000)]
    rows += [(p, i, "keep", "same") for p in range(80, 95) for i in range(5)]
    platforms = [(100,), (3,), (None,), (101,)]
    nodes, ends = histories.review_trie(
        table(spark, rows, SCHEMA), table(spark, platforms, "platform_id long"), height=height)
    ended = {}
    for e in ends.collect():
        ended.setdefault((e.depth, e.a, e.b), []).append(e.platform_id)
    got = sorted(
        (n.platform_id, n.depth, n.parent_platform_id, n.n_members, n.n_children, n.n_leaves, n.saved_chars, sorted(ended.get((n.depth, n.a, n.b), [])))
        for n in nodes.collect())
    assert got == plain_trie(rows, [p for p, in platforms])


def test_trie_of_times_names_and_nothing(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [("b", day, "keep", "one"), ("b", day + dt.timedelta(hours=1), "reject", "two"), ("a", day + dt.timedelta(days=9), "keep", "one"), ("c", None, None, None)]
    schema = SCHEMA.replace("platform_id long", "platform_id string").replace("reviewed_at long", "reviewed_at timestamp")
    nodes, ends = histories.review_trie(table(spark, rows, schema))
    got = {(r.platform_id, r.depth, r.parent_platform_id, r.n_members, r.n_children, r.n_leaves, r.saved_chars) for r in nodes.collect()}
    assert got == {("a", 0, None, 3, 2, 2, 3), ("a", 1, "a", 2, 1, 1, 3), ("b", 2, "a", 1, 0, 1, 0), ("c", 1, "a", 1, 0, 1, 0)}
    assert ends.count() == 3
    nodes, ends = histories.review_trie(table(spark, [], schema))
    assert nodes.count() == 0 and ends.count() == 0


def test_listed_digest(spark):
    r = random.Random(8)
    rows = [(g, i) for g in range(5) for i in r.sample(range(-50, 9000), 300 if g else 4000)]
    got = shared.listed_sha256(spark.createDataFrame(rows, "g long, i long"), ["g"], "i", "d", chunk=64).collect()
    want = {g: hashlib.sha256(",".join(str(i) for h, i in sorted(rows) if h == g).encode()).hexdigest() for g in range(5)}
    assert {x.g: x.d for x in got} == want


def plain_similar(rows, asked, k, scale=256.0):
    good = [(p, [math.floor(v * scale) for v in x]) for p, x in rows if p is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    first = {}
    for p, x in good:
        first[p] = min(first.get(p, x), x)
    out = []
    for p, q in first.items():
        if asked(p):
            found = sorted((-sum(a * b for a, b in zip(q, x)), o) for o, x in good if o != p and len(x) == len(q))[:k]
            out += [(p, i, o, -s) for i, (s, o) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "query_block", "rounds"), [(8192, 512, 8), (40, 7, 5), (3, 1, 1)])
def test_similar(spark, block, query_block, rounds):
    g = np.random.default_rng(4)
    x = g.normal(0, 0.1, (260, 12)).round(3)
    x[100:150] = x[100]  # a group of equal profiles
    x[150:160] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(300, None), (301, [0.1] * 11 + [None]), (302, [float("nan")] * 12), (303, [float("inf")] + [0.0] * 11), (304, [1.0, 2.0]), (306, []), (308, []), (None, x[3].tolist())]
    rows += [rows[6], rows[7], (310, x[8].tolist()), (8, x[9].tolist())]
    d = nearest.most_similar(table(spark, rows, "platform_id long, profile array<double>"), F.col("platform_id") % 2 == 0, block=block, query_block=query_block, rounds=rounds)
    assert sorted(map(tuple, d.collect())) == plain_similar(rows, lambda p: p % 2 == 0, 5)


def test_similar_histograms_large_numbers_and_nothing(spark):
    r = random.Random(3)
    counts = [(f"p{i}", [r.randrange(50) for _ in range(6)]) for i in range(30)]
    d = nearest.most_similar(table(spark, counts, "platform_id string, profile array<long>"), scale=1.0, k=3)
    assert sorted(map(tuple, d.collect())) == plain_similar(counts, lambda p: True, 3, 1.0)
    big = [(i, [r.choice([-1, 1]) * r.randrange(1 << 29, 1 << 30) * 1.0 for _ in range(3)]) for i in range(20)]
    d = nearest.most_similar(table(spark, big, "platform_id int, profile array<double>"), scale=1.0, k=4)
    assert sorted(map(tuple, d.collect())) == plain_similar(big, lambda p: True, 4, 1.0)
    huge = [(1, [1e300, 1.0]), (2, [1e300, -1.0]), (3, [-1e300, 0.0])]
    d = nearest.most_similar(table(spark, huge, "platform_id int, profile array<double>"))
    assert {(q.query_id, q.rank, q.platform_id, q.score) for q in d.collect()} >= {(1, 1, 2, 2**63 - 1), (1, 2, 3, -(2**63))}
    assert nearest.most_similar(table(spark, [], "platform_id int, profile array<double>")).count() == 0


def test_queries_are_not_broadcast(spark):
    g = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(g.normal(0, 0.1, (400, 8)).round(3))]
    d = nearest.most_similar(table(spark, rows, "platform_id long, profile array<double>"), F.col("platform_id") % 50 == 0, block=20, query_block=2)
    assert sorted(map(tuple, d.collect())) == plain_similar(rows, lambda p: p % 50 == 0, 5)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_reading_stops_before_the_ends():
    g = np.random.default_rng(1)
    x = np.floor(g.normal(0, 32, (2000, 16)))
    lists = nearest.Lists(np.arange(2000), x)
    depths = []
    bounds = lists.bounds
    lists.bounds = lambda w, depth: (depths.append(depth), bounds(w, depth))[1]
    lists.resolved, left = lambda q, rows, *rest: [(q, len(rows))], 40
    assert all(n <= left for _, n in lists.top(np.arange(0, 2000, 100), x[::100], 5, 16)) and max(depths) < 2000
    exact = x @ x[::100].T
    for depth in (1, 500, 1500):
        lower, upper = bounds(np.hstack([np.maximum(x[::100], 0), np.minimum(x[::100], 0)]), depth)
        assert (lower <= exact.T).all() and (exact.T <= upper).all()
