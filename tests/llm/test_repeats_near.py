"""Repeated passages and near duplicates against brute force on small records."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from notes import odd, prose, records
from pyspark.sql import functions as F

from fleetwake.llm import components, near, repeats, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_word_hashes_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["ab cd", "", None, "cd  ab\tcd", "x" * 3_000_000 + " ab", "ab"]
    data, offsets = words.raw(pa.array(texts))
    starts, ends, first = words.spans(data, offsets)
    h = words.hashes(data, starts, ends)
    assert list(np.diff(first)) == [2, 0, 0, 3, 2, 1]
    assert h[0] == h[3] == h[6] == h[7] and h[1] == h[2] == h[4] and h[0] != h[1]
    assert words.windows(h, 2)[0] != words.windows(h, 2)[2]


def plain_repeats(rows, window):
    out = []
    for k, text, _ in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            for k2, t2, _ in rows:
                if k is not None and k2 is not None and k2 < k:
                    v = WORD.findall(t2 or "")
                    if any(v[j : j + window] == w[i : i + window] for j in range(len(v) - window + 1)):
                        gone.update(range(i, i + window))
                        break
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark):
    a = prose(11, 60).split()
    b = prose(12, 60).split()
    rows = [
        ("a", None, ""), ("b", "", ""), ("m", " ".join(a), ""), ("n", " ".join(b[:20] + a[10:40] + b[20:]), ""), ("o", " ".join(a), ""),
        ("p", "\n".join(a[5:34]), ""), ("q", " ".join(a[5:24] + ["x"] + a[25:60]), ""), ("q", " ".join(a[5:24] + ["x"] + a[25:60]), ""),
        (None, " ".join(a), ""), ("l", " ".join(b[:30] * 2), ""), ("z", " ".join(b), ""), ("y", " ".join(a[:20] + a[:20]), ""), ("c", "one", ""),
    ]
    got = repeats.remove_repeats(records(spark, rows), window=20).collect()
    assert sorted([tuple(x) for x in got], key=str) == plain_repeats(rows, 20)
    assert repeats.remove_repeats(records(spark, [])).count() == 0
    assert repeats.remove_repeats(records(spark, odd())).count() == len(odd())


def plain_near(rows, length, percent):
    sets = []
    for _, text, _ in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    out = []
    for i, (k, _, _) in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None] if sets[i] else [k]
        c = min(known) if known and known != [None] else None
        out.append((k, len(sets[i]), c, k == c))
    return sorted(out, key=str)


def near_rows():
    r = random.Random(9)
    rows = odd()
    for g in range(6):
        base = prose(100 + g, 40 + 20 * g).split()
        for c in range(12):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"new{r.randrange(9999)}"
            rows.append((f"g{r.randrange(10**6):06d}", " ".join(w).upper() if c % 4 == 0 else " ".join(w), "x"))
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    got = near.near_duplicates(records(spark, rows), shingle=4).collect()
    assert sorted([tuple(x) for x in got], key=str) == plain_near(rows, 4, 80)
    assert near.near_duplicates(records(spark, [])).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    rows = near_rows()
    got = near.near_duplicates(records(spark, rows), shingle=4).collect()
    assert sorted([tuple(x) for x in got], key=str) == plain_near(rows, 4, 80)


def clauses(n=60, seed=4):
    """Documents of 10 to 12 of 50 clauses; every third has one clause fewer than the one before."""
    r, out = random.Random(seed), []
    texts = [prose(1000 + c, 30) for c in range(50)]
    for i in range(n):
        own = own[:-1] if i % 3 == 2 else [texts[c] for c in r.sample(range(50), r.randrange(10, 13))]
        out.append((f"c{r.randrange(10**8):08d}", " ".join(own), "x"))
    return out


def signature_classes(spark, rows):
    sets = near.shingles(pa.array([t for _, t, _ in rows]), 5)
    coordinates, names = near._signatures(sets)
    classes = {names[i]: (names[i], len(sets[i]), [int(x) for x in coordinates[i]]) for i in range(len(rows))}
    return list(classes.values()), spark.createDataFrame(list(classes.values()), "name binary, n long, coordinates array<long>")


@pytest.mark.parametrize("posted", [8192, 7])
def test_candidates_join_all_sets_that_agree(spark, monkeypatch, posted):
    monkeypatch.setattr(near, "POSTED", posted)
    listed, classes = signature_classes(spark, clauses(600))
    coordinates, n = np.array([c for _, _, c in listed]), np.array([n for _, n, _ in listed])
    agree = sum(coordinates[:, None, c] == coordinates[None, :, c] for c in range(near.COORDINATES)) >= near.MATCHES
    pairs = np.argwhere(np.triu(agree & (100 * np.minimum(n, n[:, None]) >= 80 * np.maximum(n, n[:, None])), 1))
    assert len(pairs) > 200
    of = {r.node: r.component for r in components.components(near.candidates(classes)).collect()}
    names = [bytes(name) for name, _, _ in listed]
    assert [] == [(a, b) for a, b in pairs if of.get(names[a], a) != of.get(names[b], b)]


def test_candidates_do_not_need_the_first_set_of_a_posting(spark):
    fresh = iter(range(10**6))
    sets = {x: [next(fresh) for _ in range(near.COORDINATES)] for x in (b"y", b"z")}
    sets[b"z"][:20] = sets[b"y"][:20]
    for c in range(20):  # heads every posting of the pair, agrees with it in that coordinate alone
        sets[b"%c" % c] = [sets[b"y"][i] if i == c else next(fresh) for i in range(near.COORDINATES)]
    classes = spark.createDataFrame([(x, 100, c) for x, c in sets.items()], "name binary, n long, coordinates array<long>")
    assert {tuple(sorted(map(bytes, r))) for r in near.candidates(classes).collect()} == {(b"y", b"z")}


def test_near_duplicates_of_shared_clauses(spark):
    rows = clauses()
    got = near.near_duplicates(records(spark, rows)).collect()
    assert sorted([tuple(x) for x in got], key=str) == plain_near(rows, 5, 80)


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_BYTES", 400_000, raising=False)
    members = spark.createDataFrame([(b"c", b"%d" % i, bytes([i]) * 80_000) for i in range(60)], "cluster binary, name binary, hashes binary")
    groups = near._blocks(members).groupBy("i", "j").agg(F.sum(F.octet_length("hashes")).alias("b"), F.collect_set("name").alias("names")).collect()
    assert max(g.b for g in groups) <= 4 * 400_000
    met = {(a, b) for g in groups for a in map(bytes, g.names) for b in map(bytes, g.names)}
    assert len(met) == 60 * 60
    monkeypatch.setattr(near, "BLOCK_BYTES", 2_000)
    rows = near_rows()
    got = near.near_duplicates(records(spark, rows), shingle=4).collect()
    assert sorted([tuple(x) for x in got], key=str) == plain_near(rows, 4, 80)


def test_deduplicate_keeps_one_of_each(spark):
    rows = near_rows()
    left = near.deduplicate(records(spark, rows), shingle=4)
    want = [k for k, _, _, kept in plain_near(rows, 4, 80) if kept]
    want.remove("h")  # of the repeated record one stays
    assert sorted(map(str, [r.platform_id for r in left.collect()])) == sorted(map(str, want)) and "note2" in left.columns


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
