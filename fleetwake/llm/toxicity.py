"""Toxicity of deployment notes: a weighted lexicon found by Aho-Corasick in folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.llm import shared

#: Letters that look like Latin ones, signs and digits that stand for letters, marks
#: that are not seen, words of abuse to start from, and phrases in which such words mean no abuse.
LOOKALIKES = dict(zip("авеіјкмнорстухѕԁɡαεικνορτυχ", "abeijkmhopctyxsdgaeikvoptux", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
UNSEEN = "­​‌‍⁠﻿"
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "vermin")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "clown car", "stupid simple", "idiot proof")

_FOLD = str.maketrans({**LOOKALIKES, **dict.fromkeys(UNSEEN)})
_INNER = str.maketrans({**SIGNS, **DIGITS})
_WORD = re.compile(r"[^\W_]+(?:[@$!|]+[^\W_]+)*")
#: The same words with the signs at their ends; "!" and "|" end sentences and cells, so only begin a word.
_ENDED = re.compile(r"[@$!|]*" + _WORD.pattern + r"[@$]*")
_ENDS = re.compile(r"(?:^|[\W_])[@$!|]+[^\W_]|[@$](?:[\W_]|$)")
_ODD = re.compile(r"[0-9@$!|]")
SEED_WEIGHT = 3.0
STEMS = range(3, 9)


def spellings(text: str | None) -> tuple[list[str], dict[int, str]]:
    """(words of a text as :func:`fold` gives them, number of a word → its spelling with the signs at its ends)."""
    if not text:
        return [], {}
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    line = text.casefold().translate(_FOLD)
    found, ends = _WORD.findall(line), {}
    if _ODD.search(text):
        if _ENDS.search(line):
            ends = {i: w.translate(_INNER) for i, (w, plain) in enumerate(zip(_ENDED.findall(line), found, strict=True)) if w != plain and not plain.isdigit()}
        found = [w if w.isalpha() or w.isdigit() else w.translate(_INNER) for w in found]
    return found, ends


def fold(text: str | None) -> list[str]:
    """Words of a text in one spelling: compatibility forms, case, lookalikes, and inside words digits and signs."""
    return spellings(text)[0]


@dataclass(frozen=True)
class Lexicon:
    """Weights of word beginnings (``stems``) and whole words, and the curve from them to a score."""

    stems: dict[str, float]
    words: dict[str, float]
    curve: tuple[float, float, float] = (1.5, 1.0, -4.0)

    def automaton(self):
        a = ahocorasick.Automaton()
        for stem, w in self.stems.items():
            a.add_word(f" {stem}", (len(stem) + 1, w))
        for word, w in self.words.items():
            a.add_word(f" {word} ", (len(word) + 2, w))
        for phrase in EXCEPTIONS:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        a.make_automaton()
        return a


def _heaviest(word: str, automaton) -> float:
    return max((w for _, (_, w) in automaton.iter(f" {word} ") if w is not None), default=0.0)


def weigh(found: list[str], automaton, ends: dict[int, str] | None = None) -> tuple[float, int]:
    """(sum of the weights of a text's words, number of words); a word counts its heaviest entry once.

    ``ends`` has other spellings of some words; one is taken where it has a heavier entry than the word.
    """
    if ends:
        found = [ends[i] if i in ends and _heaviest(ends[i], automaton) > _heaviest(w, automaton) else w for i, w in enumerate(found)]
    line, best, spared = f" {' '.join(found)} ", {}, []
    for end, (length, weight) in automaton.iter(line):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    return sum(w for at, w in best.items() if not any(a <= at < b for a, b in spared)), len(found)


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weight by length, weight, and one, by text."""
    return np.stack([np.log1p(100 * total / np.maximum(n, 1)), np.log1p(total), np.ones(len(n))], axis=1)


def _counts(sample: DataFrame) -> DataFrame:
    """Per word beginning and whole word: texts and uses among rejected and kept notes of ``t, y``."""

    def run(batches):
        for batch in batches:
            table: dict = {}
            words = [0, 0]
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                used = Counter(fold(text))
                words[y] += sum(used.values())
                stems: Counter = Counter()
                for w, n in used.items():
                    stems[f"{w} "] += n
                    for size in STEMS:
                        if len(w) >= size:
                            stems[w[:size]] += n
                for stem, n in stems.items():
                    row = table.setdefault(stem, [0, 0, 0, 0])
                    row[y] += 1
                    row[2 + y] += n
            table[""] = [0, 0, *words]
            columns = np.array(list(table.values()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), *[pa.array(columns[:, i]) for i in range(4)]], names=["stem", "d0", "d1", "u0", "u1"])

    rows = sample.mapInArrow(run, "stem string, d0 long, d1 long, u0 long, u1 long")
    return rows.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("d0", "d1", "u0", "u1")])


def fit(deployments: DataFrame, reviews: DataFrame, *, key: str = "platform_id", note: str = "note", decision: str = "decision", good: str = "keep",
        bad: str = "reject", rows: int = 4000, entries: int = 5000, least_weight: float = 1.5, row_bytes: int = 1 << 17) -> Lexicon:
    """Learn the lexicon from reviewed notes: ``bad`` ones are toxic.

    Uses a bounded sample: up to ``rows`` bad and twice as many good notes of at most ``row_bytes``
    bytes, the lowest by hash of their key, each different text once. On one half of it, word beginnings of 3 to 8 letters and
    whole words get the log odds of their share of the words in bad and in good notes; those above
    ``least_weight`` that enough bad notes use are entries (the heaviest ``entries``). On the other
    half a logistic curve is fitted to weight and weight by length, with the classes weighted
    back to all reviews. Words that the reviews hardly use keep the weight of the seeds.
    """
    judged = reviews.where(F.col(decision).isin(good, bad)).select(F.col(key).alias("k"), (F.col(decision) == bad).cast("int").alias("y"))
    total = {r.y: r.n for r in judged.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashed = F.xxhash64(F.col("k").cast("string"))
    share = F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
    limit = {0: 2 * rows, 1: rows}
    picked = None
    for y in (0, 1):
        few = judged.where((F.col("y") == y) & (share < min(1.0, 2 * limit[y] / max(total.get(y, 0), 1)))).orderBy(hashed, "k").limit(limit[y])
        picked = few if picked is None else picked.union(few)
    sample = (
        deployments.where(F.octet_length(note) <= row_bytes).select(F.col(key).alias("k"), F.col(note).alias("t"))
        .join(F.broadcast(picked), "k").withColumn("h", F.xxhash64("t")).dropDuplicates(["h", "y"]).withColumn("half", F.pmod("h", F.lit(2)))
    )
    sample = shared.cut(sample.repartition(8, "h"))
    counts = _counts(sample.where("half = 0").select("t", "y"))
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    head = counts.where("stem = ''").first()
    seeds = dict.fromkeys(SEEDS, SEED_WEIGHT)
    if head is None or not head.u0 or not head.u1:
        return Lexicon({}, seeds)
    weight = F.log((F.col("u1") + 0.5) / head.u1) - F.log((F.col("u0") + 0.5) / head.u0)
    enough = max(4, 0.005 * size.get(1, 0))
    found = counts.where(F.col("stem") != "").withColumn("w", weight).where((F.col("w") >= least_weight) & (F.col("d1") >= enough))
    # A beginning counts by the notes as well: it should be likelier in bad notes than in good ones.
    found = found.where((F.col("d1") + 0.5) / (size.get(1, 0) + 1) > 2 * (F.col("d0") + 0.5) / (size.get(0, 0) + 1))
    entry = found.orderBy(F.desc("w"), "stem").limit(entries).select("stem", "w").collect()
    stems = {r.stem: r.w for r in entry if not r.stem.endswith(" ")}
    words = seeds | {r.stem.strip(): r.w for r in entry if r.stem.endswith(" ")}
    known = {r.stem.strip(): r for r in counts.where(F.col("stem").isin([f"{s} " for s in SEEDS])).collect()}
    for s, r in known.items():
        if r.d0 + r.d1 >= 10:
            words[s] = max(0.0, float(np.log((r.u1 + 0.5) / head.u1) - np.log((r.u0 + 0.5) / head.u0)))
    draft = Lexicon(stems, words)
    rest = weighed(sample.where("half = 1").select(F.struct("y").alias("k"), "t"), draft).select("k.y", "total", "n").collect()
    y = np.array([r.y for r in rest], dtype=float)
    if len(set(y)) < 2:
        return draft
    x = features(np.array([r.total for r in rest]), np.array([r.n for r in rest]))
    balance = np.where(y == 1, total[1] / max(1, y.sum()), total[0] / max(1, (1 - y).sum()))
    return Lexicon(stems, words, _curve(x, y, balance / balance.mean()))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    a = np.zeros(3)
    ridge = np.diag([1e-2, 1e-2, 1e-4])

    def loss(a):
        t = x @ a
        return (weight * (np.logaddexp(0, t) - y * t)).sum() + a @ ridge @ a / 2

    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ a)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ a)
        while loss(a - step) > loss(a) and np.abs(step).max() > 1e-9:
            step = step / 2
        a = a - step
    return tuple(float(v) for v in a)


def weighed(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``k, t`` → ``k, total, n``: weight and number of words of every whole text."""
    schema = df.select("k", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n")).schema
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        automaton = sent.value.automaton()
        for batch in shared.pieces(batches, "t"):
            texts = (spellings(t) for t in batch.column(1).to_pylist())
            pairs = [weigh(found, automaton, ends) for found, ends in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(a) for a, _ in pairs], pa.float64()), pa.array([b for _, b in pairs], pa.int64())], names=["k", "total", "n"]
            )

    return df.mapInArrow(run, schema)


def score(deployments: DataFrame, lexicon: Lexicon, *, key: str = "platform_id", note: str = "note", threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each record: ``key, score, predicted``.

    Notes are folded (compatibility forms, case, letters that look Latin, digits and signs inside
    words; also signs at their ends, where that spelling has the heavier entry), and the automaton finds the entries at word beginnings and the whole words; words inside an exception phrase
    do not count. ``score`` (0 to 1) is a logistic curve over the sum of the weights and the sum by length;
    ``predicted`` is 1 where it reaches ``threshold``. Null and empty notes have weight 0 and
    the score of that. ``keep`` names columns to carry along, others are ignored. Repeated records give
    repeated rows. Whole notes, no shuffle; the lexicon is bounded by its number of entries.
    """
    shared.small_batches(deployments.sparkSession)
    rows = weighed(deployments.select(F.struct(F.col(key).alias("k"), *[F.col(c).alias(f"keep_{c}") for c in keep]).alias("k"), F.col(note).alias("t")), lexicon)
    a, b, c = lexicon.curve
    by_length = F.log1p(100 * F.col("total") / F.greatest("n", F.lit(1)))
    s = 1 / (1 + F.exp(-(a * by_length + b * F.log1p("total") + c)))
    return rows.select(F.col("k.k").alias(key), s.alias("score"), (s >= threshold).cast("int").alias("predicted"), *[F.col(f"k.keep_{x}").alias(x) for x in keep])
