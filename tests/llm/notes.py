"""Deployment records for the tests: nulls, empty and very long notes, ties, repeats, clashing columns."""

from __future__ import annotations

import random

#: Columns of other tables, with names that the operators use inside.
EXTRA = "k string, t string, h string, n string, size string, name string, spans string, note2 string"


def records(spark, rows, key="string"):
    """(platform_id, note, provenance) rows as a table with further columns."""
    schema = f"platform_id {key}, note string, provenance string, {EXTRA}"
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], schema)


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"{'drifter float buoy drogue fix pass gap'.split()[r.randrange(7)]}{r.randrange(words)}" for _ in range(n))


def odd(seed: int = 1):
    """Rows that every operator must take."""
    long = prose(seed, 30_000)
    return [
        ("a", None, "crew"), ("b", "", "crew"), ("c", "   \n\t ", None), (None, prose(2, 60), "log"), ("d", prose(3, 80), None),
        ("e", prose(3, 80), "log"), ("f", long, "crew"), ("g", "ü ß 中文 \x00 🙂", "crew"), ("h", "one", "log"), ("h", "one", "log"),
    ]
