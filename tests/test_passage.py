"""First passages of long series against a plain walk along each pair."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from fleetwake.operators import passage

EDGES = [1.0, 1.5, 2.25, 3.4, 5.0, 7.5]
STEP = 3600
START = dt.datetime(2025, 1, 1)


def series(seed, faults):
    r = random.Random(seed)
    rows = []
    for p in range(8):
        d, t = r.uniform(0.5, 1.2), START + dt.timedelta(seconds=STEP * r.randrange(30))
        for _ in range(r.choice([1, 30, 120, 200])):
            lost = faults and r.random() < 0.02
            rows.append((f"p{p}", t, None if lost else d, r.choice([60.0, 200.0]) if faults else 60.0))
            d = max(0.2, d * math.exp(r.gauss(0.01, 0.12)))
            t += dt.timedelta(seconds=STEP * (r.choice([1] * 60 + [4, 40]) if faults else 1))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, time timestamp, distance_km double, source_gap_min double")


def by_pair(rows):
    out = {}
    for p, *row in rows:
        out.setdefault(p, []).append(row)
    return out


def test_pair_mode(spark):
    rows = series(1, False)
    got = {(r.pair_id, r.shell): (r.entry_time, r.exit_time, r.entry_km, r.exit_km, r.status) for r in passage.first_passages(table(spark, rows), EDGES, STEP).collect()}
    for p, samples in by_pair(rows).items():
        for i in range(len(EDGES) - 1):
            entry = next((j for j, s in enumerate(samples) if EDGES[i] <= s[1] < EDGES[i + 1]), None)
            if entry is None:
                assert got[p, i] == (None, None, None, None, "not_observed_in_shell")
                continue
            end = next((s for s in samples[entry + 1 :] if s[1] > EDGES[i + 1]), None)
            a = samples[entry]
            want = (a[0], end and end[0], a[1], end and end[1], "reached" if end else "right_censored_track_end")
            assert got[p, i] == want


def plain_observed(samples, i, policy, limit):
    """(entry, exit, status, censor, missing, widest gap) of one pair and shell."""
    hard = [d is not None and g > limit for _, d, g in samples]
    ok = [d is not None and not h for (_, d, _), h in zip(samples, hard)]
    entry = None
    for j, (t, d, _) in enumerate(samples):
        if ok[j] and EDGES[i] <= d < EDGES[i + 1]:
            witnessed = j > 0 and ok[j - 1] and samples[j - 1][1] < EDGES[i] and (t - samples[j - 1][0]).total_seconds() == STEP
            if witnessed or (j == 0 and d == EDGES[i]):
                entry = j
                break
    if entry is None:
        return (None, None, "not_observed_entry", None, 0, None)
    end = next((j for j in range(entry + 1, len(samples)) if ok[j] and samples[j][1] >= EDGES[i + 1]), None)
    fault, widest, seen, missing, before = None, 0.0, samples[entry][0], 0, None
    for j in range(entry + 1, (len(samples) if end is None else end + 1)):
        t = samples[j][0]
        gap = (t - seen).total_seconds() / 60 if ok[j] else None
        bad = hard[j] or (policy == "strict_observed" and (not ok[j] or (t - samples[j - 1][0]).total_seconds() != STEP)) or (
            policy == "bridge_missing" and gap is not None and gap > limit)
        if bad and fault is None:
            fault, before = j, seen
        missing += not ok[j]
        if ok[j]:
            widest, seen = max(widest, gap), t
    a = samples[entry][0]
    if fault is not None:
        return (a, None, "right_censored_gap", before, missing, widest)
    if end is None:
        return (a, None, "right_censored_track_end", seen, missing, widest)
    return (a, samples[end][0], "reached", None, missing, widest)


@pytest.mark.parametrize("policy", ["strict_observed", "bridge_missing"])
def test_observed_mode(spark, policy):
    rows = series(2, True) + [("edge", START, 1.0, 60.0), ("edge", START + dt.timedelta(seconds=STEP), 1.5, 60.0)]
    p = passage.observed_passages(table(spark, rows), EDGES, STEP, policy=policy, max_gap_min=150.0)
    got = {(r.pair_id, r.shell): (r.entry_time, r.exit_time, r.status, r.censor_time, r.missing_count, r.max_gap_min) for r in p.collect()}
    want = {(q, i): plain_observed(s, i, policy, 150.0) for q, s in by_pair(rows).items() for i in range(len(EDGES) - 1)}
    assert got == want
    assert len({w[2] for w in want.values()}) == 4
