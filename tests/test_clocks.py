"""Flagged edges under several clocks against the same rows repeated for each clock."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fleetwake.operators import compare, frames

LIMIT = 3.0


def test_clocks_share_neighbours_and_distances(spark, monkeypatch):
    r, rows = random.Random(3), []
    for p in range(4):
        t, lat = 0, 0.0
        for pos in range(60):
            t, lat = t + r.choice((2, 4, 400_000, 900_000, 1_700_000, 60_000_000)), lat + r.uniform(-3e-5, 3e-5)
            rows.append((f"p{p}", pos, t, None if r.random() < 0.1 else 10.0, lat))
    d = spark.createDataFrame(rows, "platform_id string, pos long, t long, lon double, lat double").withColumn("time", F.timestamp_micros("t")).drop("t")
    seen, blocks = [], frames.blocks

    def counted(df, *a, **kw):
        seen.append(df.count())
        return blocks(df, *a, **kw)

    monkeypatch.setattr(frames, "blocks", counted)
    got = {(x.scenario, x.platform_id): (x.changed_flags, x.changed_classes, x.changed_candidates) for x in compare.clock_sensitivity(d, LIMIT, max_gap_s=30.0).collect()}
    assert seen and max(seen) <= len(rows)  # rows are not repeated for each clock

    t, sign = F.unix_micros("time"), F.when(F.col("pos") % 2 == 0, 10).otherwise(-10)
    clocks = {"stored": t, "nearest_second": F.round(t / F.lit(1e6)).cast("long") * 1_000_000, "plus_minus_10_us": t + sign, "minus_plus_10_us": t - sign}
    many = d.withColumn("c", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.timestamp_micros(e).alias("time")) for n, e in clocks.items()])))
    _, points, edges = compare.jump_runs(many.select("c.scenario", "platform_id", "pos", "c.time", "lon", "lat"), LIMIT, key=["scenario", "platform_id"], max_gap_s=30.0)
    label = {(e.scenario, e.platform_id, e.row): e["class"] for e in edges.collect()}
    good = {(x.scenario, x.platform_id, x.row) for x in points.where("passes").collect()}
    want = {}
    for n in list(clocks)[1:]:
        for p in {x[0] for x in rows}:
            at = [(label.get(("stored", p, i)), label.get((n, p, i)), ("stored", p, i) in good, (n, p, i) in good) for i in range(60)]
            want[n, p] = (sum((a is None) != (b is None) for a, b, *_ in at), sum(a != b for a, b, *_ in at), sum(a != b for *_, a, b in at))
    assert got == want
    assert all(sum(w[i] for w in want.values()) > 0 for i in range(3))
