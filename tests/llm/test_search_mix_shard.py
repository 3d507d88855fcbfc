"""Passage search, mixing and resharding against plain versions on small records."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import pytest
from notes import odd, prose, records
from pyspark.sql import functions as F

from fleetwake.llm import mixing, patterns, sharding


def plain_search(notes, reviews, window):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for k, note in notes:
        w, hit, items = low(note), set(), set()
        for event, text in reviews:
            p = low(text)
            m = min(window, len(p))
            for i in range(len(p) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == p[i : i + m]:
                        hit.update(range(j, j + m))
                        if event is not None:
                            items.add(str(event))
        out.append((k, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_search(spark, block):
    source = prose(7, 40, 5)
    w = source.split()
    reviews = [(3, source), (20, " ".join(w[5:17])), (4, "Short Passage"), (5, None), (6, "..."), (None, "drogue Lost"), (7, "one")]
    notes = odd() + [("p", "x. " + source.upper() + "; y", "z"), ("q", " ".join(w[3:12]), "z"), ("r", " ".join(w[3:14]), "z"), ("s", "a short passage", "z"), ("t", "drogue lost", "z")]
    r = spark.createDataFrame(reviews, "event_id long, note string").withColumn("t", F.lit(1))
    got = patterns.search(records(spark, notes), r, block_bytes=block).collect()
    assert sorted([tuple(x) for x in got], key=str) == plain_search([n[:2] for n in notes], reviews, 10)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "event_id long, note string")
    assert {r.n_hit for r in patterns.search(records(spark, odd()), empty).collect()} == {0}
    assert patterns.search(records(spark, []), empty).count() == 0


def test_wu_manber_finds_what_a_scan_finds():
    r = random.Random(5)
    words = [bytes([97 + r.randrange(3)]) for _ in range(3000)]
    for m in (1, 2, 3, 6):
        known = {tuple(words[i : i + m]): [i] for i in range(0, 60, 7)}
        found = [at for at, _ in patterns.WuManber(known, m).find(words)]
        assert found == [i for i in range(len(words) - m + 1) if tuple(words[i : i + m]) in known]


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1), (None, 1000)], "provenance string, source_size long")
    got = {r.provenance: r.target for r in mixing.targets(sizes).collect()}
    left, weight, room = 1111.0, {"a": 1, "b": 2, "c": 3, None: 1}, {"a": 30, "b": 300, "c": 3, None: 3000}
    want, open_ = {}, set(weight)
    while True:
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if weight[k] * level > room[k]}
        if not full:
            want |= {k: weight[k] * level for k in open_}
            break
        for k in full:
            want[k], left = room[k], left - room[k]
        open_ -= full
    assert got == pytest.approx(want)


def test_mix_comes_near_and_reruns_agree(spark):
    r = random.Random(3)
    rows = [(f"p{i}", prose(i, 1 + int(r.paretovariate(1.1)) % 900), f"s{i % 5}" if i % 3 else "s0") for i in range(900)]
    d = records(spark, rows + odd())
    once = mixing.mix(d).orderBy("platform_id", "size").collect()
    again = mixing.mix(d.repartition(7)).orderBy("platform_id", "size").collect()
    assert once == again and len(once) == 910
    taken, target = defaultdict(int), {}
    for x in once:
        assert x.taken == x.copies * x.size and 0 <= x.copies <= 3
        taken[x.source_size] += x.taken
        target[x.source_size] = x.target
    assert sum(target.values()) == pytest.approx(sum(set(target)))
    largest = {k: max(x.size for x in once if x.source_size == k) for k in target}
    for k in target:  # no nearer than half of the largest note, which is taken whole
        assert abs(taken[k] - target[k]) <= max(0.02 * target[k], largest[k] / 2)
    assert [x.size for x in once if x.platform_id in ("a", "b", "c")] == [0, 0, 0]


def test_mix_of_nothing(spark):
    assert mixing.mix(records(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(records(spark, [("a", None, None), ("b", "", "x")])).collect()] == [0, 0]


def test_min_cost_flow_is_least():
    r = random.Random(2)
    for _ in range(20):
        supply = [r.randrange(4) for _ in range(3)]
        capacity = [r.randrange(4) for _ in range(3)]
        if sum(supply) > sum(capacity):
            continue
        cost = [[r.randrange(5) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow(supply, capacity, lambda i, j: cost[i][j])
        units = [i for i, n in enumerate(supply) for _ in range(n)]
        best = min(
            sum(cost[i][j] for i, j in zip(units, to, strict=True))
            for to in itertools.product(range(3), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(3))
        )
        assert sum(cost[i][j] * n for (i, j), n in flow.items()) == best
        assert [sum(n for (a, _), n in flow.items() if a == i) for i in range(3)] == supply


def test_shards_are_even_and_move_least(spark, tmp_path):
    rows = [(f"p{i}", prose(i % 700, 5 + i % 40), "big" if i % 3 == 0 else f"s{i % 7}") for i in range(2000)]
    old = F.when(F.col("provenance") == "big", 0).when(F.col("provenance") == "s1", None).otherwise(F.crc32(F.col("provenance").cast("binary")) % 4)
    placed = sharding.plan(records(spark, rows), old=old, n_old=4, n_new=5).collect()
    size = defaultdict(int)
    for x in placed:
        size[x.shard] += x.size
    assert max(size.values()) - min(size.values()) <= 2 * max(x.size for x in placed)
    before = defaultdict(int)
    for x in placed:
        before[x.old_shard] += x.size
    total = sum(size.values())
    least = sum(max(0, b - total / 5) for b in before.values())
    assert sum(x.size for x in placed if x.shard != x.old_shard) <= least + 8 * max(x.size for x in placed)
    for s in size:
        assert sorted(x.slot for x in placed if x.shard == s) == list(range(sum(x.shard == s for x in placed)))
    table = spark.createDataFrame(placed)
    touched = sharding.rewrite(records(spark, rows), table, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == sum(x.shard in touched for x in placed)
    assert back.join(table.select("platform_id", "slot", "shard"), ["platform_id", "slot", "shard"]).count() == back.count()


def test_rewrite_of_null_and_repeated_keys(spark, tmp_path):
    rows = [(None if i % 5 == 0 else f"p{i % 40}", prose(i % 30, 5 + i % 20), f"s{i % 7}") for i in range(300)]
    rows += [("x", "the same note", f"s{i % 7}") for i in range(21)] + [(None, None, "s1"), (None, "", "s2")]
    d = records(spark, rows)
    old = F.crc32(F.col("provenance").cast("binary")) % 4
    for name, keep, given in (("old", (), old), ("keep", ("provenance",), None)):
        table = spark.createDataFrame(sharding.plan(d, old=old, n_old=4, n_new=5, keep=keep).collect())
        touched = sharding.rewrite(d, table, str(tmp_path / name), old=given)
        back = spark.read.parquet(str(tmp_path / name)).collect()
        want = [tuple(r) for r in table.where(F.col("shard").isin(touched)).select("shard", "slot", "platform_id", "size").collect()]
        assert sorted(((r.shard, r.slot, r.platform_id, len((r.note or "").encode()) + 1) for r in back), key=str) == sorted(want, key=str)
        stay = {r.old_shard for r in table.collect()} - set(touched)
        shard_of = {r.provenance: r.o for r in d.select("provenance", old.alias("o")).distinct().collect()}
        assert sorted([(r.platform_id, r.note, r.provenance) for r in back], key=str) == sorted([x for x in rows if shard_of[x[2]] not in stay], key=str)


def test_records_outside_the_old_shards_are_placed(spark):
    rows = [(f"p{i}", "x" * (i % 7), str([0, 1, 5, -3][i % 4])) for i in range(400)]
    placed = sharding.plan(records(spark, rows), old=F.col("provenance").cast("int"), n_old=2, n_new=8, keep=("provenance",)).collect()
    assert sorted((r.platform_id, r.provenance) for r in placed) == sorted((k, p) for k, _, p in rows)
    assert all(str(r.old_shard) == r.provenance and 0 <= r.shard < 8 for r in placed)
    sizes = [sum(r["size"] for r in placed if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 16
    for s in range(8):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))


def test_shards_of_odd_records(spark):
    import zlib

    rows = odd()
    placed = sharding.plan(records(spark, rows), old=F.lit(0), n_old=1, n_new=3).collect()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted((x.size, x.text_crc32) for x in placed) == want
    assert sharding.plan(records(spark, []), old=F.lit(0), n_old=1).count() == 0
