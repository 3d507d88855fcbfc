"""Clusters by rounds of mutually best merges against merging one pair at a time."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from fleetwake.operators import groups

START = dt.datetime(2025, 1, 1)


def plain(nodes, metrics, rule_of):
    """{platform: sorted members} by the best merge at a time."""
    out = {}
    for array in {a for a, _ in nodes.values()}:
        rule, mine = rule_of(array), [p for p, (a, _) in nodes.items() if a == array]
        groups_ = [(p,) for p in mine] if rule.assignment == "infer" else [tuple(sorted(mine))]
        while rule.assignment == "infer":
            offers = []
            for x, y in itertools.combinations(groups_, 2):
                pairs = [metrics.get((min(a, b), max(a, b))) for a in x for b in y]
                ties = [m[0] for m in pairs if m and m[1]]
                merged = tuple(sorted(x + y))
                times = [nodes[p][1] for p in merged]
                inside = [metrics.get((min(a, b), max(a, b))) for a, b in itertools.combinations(merged, 2)]
                if not ties or any(m is None or m[0] is None for m in inside) or len(merged) > (rule.max_members or 10**9):
                    continue
                spread, wide = (max(times) - min(times)).total_seconds(), max(m[0] for m in inside)
                if spread <= rule.max_start_gap_s and wide <= rule.max_diameter_m:
                    offers.append((min(ties), wide, spread, merged, x, y))
            if not offers:
                break
            *_, merged, x, y = min(offers)
            groups_ = [g for g in groups_ if g not in (x, y)] + [merged]
        out |= {p: g for g in groups_ for p in (sorted(g) if isinstance(g, tuple) else g)}
    return {p: tuple(sorted(g)) for p, g in out.items()}


@pytest.mark.parametrize("members", [None, 4])
def test_rounds_equal_single_merges(spark, members):
    r = random.Random(11)
    rule = groups.ClusterRule(7200.0, 60.0, 110.0, members)
    overrides = {2: groups.ClusterRule(3600.0, 20.0, 40.0, 3), 3: groups.ClusterRule(1.0, 1.0, 1.0, None, "single_cluster")}
    of = lambda a: overrides.get(a, rule)
    nodes = {f"p{i:02d}": (1 + i % 4, START + dt.timedelta(seconds=r.randrange(9000))) for i in range(60)}
    at = {p: (r.uniform(0, 250), r.uniform(0, 250)) for p in nodes}
    rows, metrics = [], {}
    for p, q in itertools.combinations(sorted(nodes), 2):
        if nodes[p][0] == nodes[q][0]:
            d = None if r.random() < 0.03 else ((at[p][0] - at[q][0]) ** 2 + (at[p][1] - at[q][1]) ** 2) ** 0.5
            gap, mine = abs((nodes[p][1] - nodes[q][1]).total_seconds()), of(nodes[p][0])
            link = d is not None and d <= mine.max_pair_m and gap <= mine.max_start_gap_s
            metrics[p, q] = (d, link)
            rows.append((nodes[p][0], p, q, gap, d, d, None if r.random() < 0.5 else d, link))
    m = spark.createDataFrame(rows, "array_id int, platform_1 string, platform_2 string, start_gap_s double, distance_m double, observed_m double, common_m double, link boolean")
    p = spark.createDataFrame([(k, a, t) for k, (a, t) in nodes.items()], "platform_id string, array_id int, start_time timestamp")
    found = groups.agglomerate(p, m, rule, overrides)
    got = {}
    for row in found.collect():
        got.setdefault((row.array_id, row.seed), []).append(row.platform_id)
    want = plain(nodes, metrics, of)
    assert {k: tuple(sorted(g)) for g in got.values() for k in g} == want and len(got) > 12
    named = groups.number_clusters(p, found, rule, overrides)
    assert {x.status for x in named.where("array_id = 3").collect()} == {"configured_single_cluster"}
    s = {x.cluster_id: x for x in groups.cluster_statistics(named, m).collect()}
    one = s["array_003__cluster_001"]
    inside = [x for x in rows if x[0] == 3]
    assert (one.members, one.unavailable, one.common_unavailable) == (15, sum(x[4] is None for x in inside), sum(x[6] is None for x in inside))
    assert one.common_diameter_m is None and one.max_available_m == max(x[4] for x in inside if x[4] is not None)
    assert all(x.diameter_m <= of(x.array_id).max_diameter_m for x in s.values() if x.array_id != 3)


def test_rules_are_checked(spark):
    for bad in ((0, 1, 1), (1, 2, 1), (1, 1, 1, 0), (1, 1, 1, None, "guess")):
        with pytest.raises(ValueError):
            groups.ClusterRule(*bad)
    p = spark.createDataFrame([], "platform_id string, array_id int, start_time timestamp")
    m = spark.createDataFrame([], "array_id int, platform_1 string, platform_2 string, start_gap_s double, distance_m double, link boolean")
    assert groups.agglomerate(p, m, groups.ClusterRule(1, 1, 1)).where(F.lit(True)).count() == 0
