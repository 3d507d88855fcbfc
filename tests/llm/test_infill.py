"""Fill-in-the-middle examples against a plain version with regular expressions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from notes import odd, prose, records

from fleetwake.llm import infill


def plain_example(key, note, seed=1):
    text = note or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def some_notes():
    r = random.Random(5)
    signs = "aZ éß中🙂\n<>PSM09\x00"
    notes = [("".join(r.choice(signs) for _ in range(r.randrange(0, 90)))) for _ in range(150)]
    notes += ["a" * 5000, "é" * 3000, ("ab" * 700 + " ") * 3, "🙂", "<P", "x<S", ">M>", "no <M> here", prose(9, 2000)]
    return [(f"p{i}", t, "crew") for i, t in enumerate(notes)]


@pytest.mark.parametrize("block", [1, 3, 16, infill.BLOCK])
def test_examples(spark, block):
    rows = odd() + some_notes()
    got = infill.fill_in_middle(records(spark, rows), block=block, keep=("provenance", "size"))
    got = got.withColumn("note", infill.restore()).collect()
    want = sorted([(*plain_example(k, t), p) for k, t, p in rows], key=str)
    assert sorted([(r.platform_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.note, r.provenance) for r in got], key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r["size"] == "x" for r in got)


def test_seed_shares_and_empty_table(spark):
    rows = [(i, "drogue lost at the surface, 12.5 m", "log") for i in range(3000)]
    d = infill.fill_in_middle(records(spark, rows, "long"), seed=7, plain_percent=30, spm_percent=50)
    assert infill.fill_in_middle(records(spark, []), keep=("name",)).count() == 0
    n = {f: c for f, c in d.groupBy("form").count().collect()}
    assert abs(n["plain"] - 900) < 120 and abs(n["spm"] - 1050) < 130
    assert d.where(infill.restore() != "drogue lost at the surface, 12.5 m").count() == 0


def test_fenwick_descends_to_the_block():
    r = random.Random(2)
    for n in (1, 2, 3, 7, 8, 33):
        counts = np.array([[r.randrange(4) for _ in range(n)], [r.randrange(9) for _ in range(n)]], np.int64)
        tree, upto = infill.Fenwick(counts), np.concatenate([[0], np.cumsum(counts[0])])
        for k in range(int(counts[0].sum()) + 1):
            at = max(i for i in range(n + 1) if upto[i] <= k)
            assert tree.find(k) == (at, k - upto[at], int(counts[1, :at].sum()))
