"""Separation memory from blocks of pairs against a plain sum over pairs."""

from __future__ import annotations

import itertools
import random

import pytest

from pyspark.sql import functions as F

from fleetwake.operators import dispersion, frames

WINDOWS = [("early", 0.5, 1.5), ("late", 1.0, 2.0)]


def points():
    r = random.Random(7)
    return [(k, f"p{i}", 6.0 * t, r.uniform(0, 9), r.uniform(0, 9)) for k in (1, 2) for i in range(7) for t in range(10) if r.random() < 0.8]


@pytest.mark.parametrize("block", [512, 3])
def test_memory(spark, block):
    rows = points()
    d = spark.createDataFrame(rows, "array_id int, platform_id string, age_h double, x_m double, y_m double").selectExpr("*", "timestamp_seconds(cast(age_h * 3600 as long)) AS time")
    got = {(r.array_id, r.group, r.bin): (r.samples, r.targets, r.mean_pairs, r.correlation) for r in dispersion.separation_memory(d, ["array_id"], WINDOWS, 4, pairs_per_block=block).collect()}
    at = {(k, p, t): (x, y) for k, p, t, x, y in rows}
    for k, (name, a, b), bin_ in itertools.product((1, 2), WINDOWS, range(4)):
        pairs = list(itertools.combinations(sorted({p for q, p, *_ in rows if q == k}), 2))
        ages = sorted({t for q, _, t, *_ in rows if q == k})
        dist = {(p, q, t): ((at[k, p, t][0] - at[k, q, t][0]) ** 2 + (at[k, p, t][1] - at[k, q, t][1]) ** 2) ** 0.5 for p, q in pairs for t in ages if (k, p, t) in at and (k, q, t) in at}
        found = []
        for t in ages:
            for s in ages:
                if a <= t / 24 < b and s <= t and min(int(((s - t) / t + 1) * 4), 3) == bin_:
                    both = [(dist[p, q, t], dist[p, q, s]) for p, q in pairs if (p, q, t) in dist and (p, q, s) in dist]
                    if both and sum(x * x for x, _ in both) > 0:
                        found.append((t, sum(x * y for x, y in both) / sum(x * x for x, _ in both), len(both)))
        samples, targets, mean_pairs, correlation = got[k, name, bin_]
        assert (samples, targets) == (len(found), len({t for t, *_ in found}))
        if found:
            assert mean_pairs == pytest.approx(sum(n for *_, n in found) / len(found)) and correlation == pytest.approx(sum(c for _, c, _ in found) / len(found))


def test_memory_writes_positions_and_not_pairs(spark, monkeypatch):
    rows = [(k, f"p{i}", 6.0 * t, float((i * 37 + t * 11) % 23), float((i * 17 + k) % 19)) for k in range(6) for i in range(20) for t in range(9)]
    d = spark.createDataFrame(rows, "array_id int, platform_id string, age_h double, x_m double, y_m double").selectExpr("*", "timestamp_seconds(cast(age_h * 3600 as long)) AS time")
    written, cut = [], frames.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(frames, "cut", counted)
    memory = lambda **kw: sorted(dispersion.separation_memory(d, ["array_id"], WINDOWS, 4, **kw).select("array_id", "group", "bin", "samples", "targets", F.round("correlation", 9)).collect())
    whole = memory()
    assert written and max(written) <= len(rows)  # a group of 20 has 190 pairs
    assert memory(spread=3, pairs_per_block=50) == whole
