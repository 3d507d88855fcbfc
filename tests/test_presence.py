"""Counts from presence bits against counting times one by one."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from fleetwake.operators import pairs

START = dt.datetime(2025, 1, 1)


def platforms():
    r = random.Random(4)
    out = {}
    for i in range(12):
        a, z = sorted((r.randrange(0, 300), r.randrange(0, 300)))
        out[f"p{i:02d}"] = {t: r.random() < 0.5 and a + 20 < t < z - 20 for t in range(a, z + 1) if r.random() < 0.8}
    out["p12"] = dict(out["p03"])
    out["p13"] = {t: True for t in range(0, 300)}
    return out


def table(spark, there):
    rows = [(ord(p[-1]) % 2, p, START + dt.timedelta(minutes=5 * t), ok, 1.0, 2.0) for p, at in there.items() for t, ok in at.items()]
    return spark.createDataFrame(rows, "array_id int, platform_id string, time timestamp, valid boolean, lon double, lat double")


@pytest.mark.parametrize("spread", [1, 3])
def test_coverage_and_first_common(spark, spread):
    there = platforms()
    g = table(spark, there)
    got = {(r.platform_id_1, r.platform_id_2): (r.scheduled, r.valid, r.before, r.after, r.inside_missing, r.first_valid, r.last_valid)
           for r in pairs.coverage(g, ("array_id",), spread).collect()}
    first = {(r.platform_id_1, r.platform_id_2): r.first_common for r in pairs.first_common(g, spread=spread).collect()}
    want, common = {}, {}
    at = lambda t: START + dt.timedelta(minutes=5 * t)
    for p, q in itertools.combinations(sorted(there), 2):
        both = sorted(set(there[p]) & set(there[q]))
        if ord(p[-1]) % 2 == ord(q[-1]) % 2 and both:
            common[p, q] = at(both[0])
            ok = [t for t in both if there[p][t] and there[q][t]]
            if ok:
                b, a = sum(t < ok[0] for t in both), sum(t > ok[-1] for t in both)
                want[p, q] = (len(both), len(ok), b, a, len(both) - len(ok) - b - a, at(ok[0]), at(ok[-1]))
            else:
                want[p, q] = (len(both), 0, 0, 0, 0, None, None)
    assert got == want and first == common and len(want) > 20


def test_search_counts(spark):
    there = platforms()
    g = table(spark, there)
    p = g.select("platform_id", "array_id").distinct()
    r = pairs.search_counts(p, g, spark.range(3), ("array_id",)).first()
    mates = [x for x in itertools.combinations(there, 2) if ord(x[0][-1]) % 2 == ord(x[1][-1]) % 2]
    assert (r.possible, r.eligible, r.overlapping, r.found) == (91, len(mates), sum(bool(set(there[a]) & set(there[b])) for a, b in mates), 3)


def test_bits(spark):
    d = spark.range(1).select(*[f(F.lit(v).cast("long")).alias(f"{n}{i}") for i, v in enumerate((1, 12, 1 << 61, (1 << 62) - 1)) for n, f in (("l", pairs.lowest), ("h", pairs.highest))],
                              pairs.below(F.lit(13).cast("long"), F.lit(3)).alias("b"), pairs.below(F.lit((1 << 62) - 1), F.lit(62)).alias("c")).first()
    assert [d.l0, d.h0, d.l1, d.h1, d.l2, d.h2, d.l3, d.h3, d.b, d.c] == [0, 0, 2, 3, 61, 61, 0, 61, 2, 62]
