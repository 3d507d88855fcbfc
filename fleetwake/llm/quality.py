"""Quality of deployment notes: counting rules, and a hashed n-gram logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.llm import shared, words

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BITS = 18
_IS_SYMBOL = np.zeros(256, dtype=np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
# A code point of a word is a byte that neither separates words nor goes on with a character.
_IS_POINT = (words.IN_WORD & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: words inside three-word windows that the text has twice or more."""
    n = len(hashed) - 2
    covered = np.zeros(len(hashed), dtype=np.int64)
    if n > 0:
        text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))[:n]
        keys = words.mix(words.windows(hashed, 3) + text * np.uint64(0xD1B54A32D192ED03))
        keys = np.where(words.inner(first, 3, n), keys, np.arange(n, dtype=np.uint64))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(n, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for shift in range(3):
            covered[shift : shift + n] |= twice
    return _sums(covered, first)


def _repeated_lines(data: bytes) -> int:
    seen, n = set(), 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


class Grams:
    """Hash slots of the n-grams of a chunk of texts: bytes by four, words, and pairs of words.

    ``groups`` holds, for each kind, the slots and the offsets of the texts; every kind has slots of
    its own.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: np.ndarray, first: np.ndarray):
        shift, size = np.uint64(64 - BITS), 1 << BITS
        self.groups = []
        wide = data.astype(np.uint32)
        n = max(len(data) - 3, 0)
        four = wide[:n] | wide[1 : n + 1] << 8 | wide[2 : n + 2] << 16 | wide[3 : n + 3] << 24
        slots = ((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
        self.groups.append((slots, *self._limits(offsets, 3, n)))
        self.groups.append(((hashed >> shift).astype(np.int64) + size, *self._limits(first, 0, len(hashed))))
        two = words.windows(hashed, 2)
        self.groups.append(((two >> shift).astype(np.int64) + 2 * size, *self._limits(first, 1, len(two))))

    @staticmethod
    def _limits(offsets, less, n):
        begin = np.minimum(offsets[:-1], n)
        return begin, np.maximum(np.minimum(offsets[1:] - less, n), begin)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Sum over the kinds of the mean weight of a text's n-grams."""
        out = 0.0
        for slots, begin, end in self.groups:
            total = np.zeros(len(slots) + 1)
            np.cumsum(weights[slots], out=total[1:])
            out = out + (total[end] - total[begin]) / np.maximum(end - begin, 1)
        return out


@dataclass(frozen=True)
class Model:
    """Weights of the hashed n-grams, and the calibration of their sum."""

    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, grams: Grams) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * grams.logits(self.weights) + self.offset, -30, 30)))


def _descend(matrix, y: np.ndarray, n: int, steps: int, decay: float) -> np.ndarray:
    """Logistic regression by Adam on all rows of a sparse matrix (row, column, value)."""
    row, col, value = matrix
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = np.log(rate / (1 - rate))
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * w[col], len(y)) + bias)))
        g = np.bincount(col, value * (p - y)[row], n) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y).

    The labels are drawn in by one pseudo-count of each kind, so that a perfect separation has a
    finite curve; damped Newton steps.
    """
    good = y.sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    middle, scale = x.mean(), x.std() + 1e-9
    z = np.stack([(x - middle) / scale, np.ones_like(x)])

    def loss(a):
        t = a @ z
        return (np.logaddexp(0, t) - target * t).sum()

    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ z)))
        step = np.linalg.solve((z * (p * (1 - p))) @ z.T + 1e-6 * np.eye(2), z @ (p - target))
        while loss(a - step) > loss(a) and np.abs(step).max() > 1e-9:
            step = step / 2
        a = a - step
    return float(a[0] / scale), float(a[1] - a[0] * middle / scale)


def fit(deployments: DataFrame, reviews: DataFrame, *, key: str = "platform_id", note: str = "note", decision: str = "decision",
        good: str = "keep", bad: str = "reject", rows: int = 4000, row_bytes: int = 1 << 16, steps: int = 120, decay: float = 1e-6) -> Model:
    """Train on a bounded sample of reviewed notes: ``rows`` of them, the lowest by hash of their key.

    Notes of more than ``row_bytes`` bytes are not trained on, so that the sample is bounded in
    bytes too. A third of the sample is held back to calibrate the probabilities (a logistic curve). Reviews
    that neither keep nor reject are ignored; a model without both decisions keeps everything.
    """
    judged = reviews.where(F.col(decision).isin(good, bad)).select(F.col(key).alias("k"), (F.col(decision) == good).alias("y"))
    order = F.xxhash64(F.col("k").cast("string"))
    n = judged.count()
    if n > 4 * rows:  # narrow the rows that are sorted; the share leaves twice as many as are wanted
        judged = judged.where(F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53)) < 2 * rows / n)
    chosen = judged.orderBy(order, "k", "y").limit(rows)
    sample = (
        deployments.where(F.octet_length(note) <= row_bytes).select(F.col(key).alias("k"), F.col(note).cast("binary").alias("t"))
        .join(F.broadcast(chosen), "k").orderBy(F.xxhash64(F.col("k").cast("string")), "k", "t").limit(rows).collect()
    )
    size = 3 << BITS
    y = np.array([r.y for r in sample], dtype=float)
    if len(set(y)) < 2:
        return Model(np.zeros(size, dtype=np.float32), 1.0, 30.0)
    parts = []
    for i, r in enumerate(sample):
        data, offsets = words.raw(pa.array([bytes(r.t)], pa.binary()))
        starts, ends, first = words.spans(data, offsets)
        for slots, begin, end in Grams(data, offsets, words.hashes(data, starts, ends), first).groups:
            found, n = np.unique(slots[begin[0] : end[0]], return_counts=True)
            parts.append((np.full(len(found), i, np.int32), found.astype(np.int32), (n / max(end[0] - begin[0], 1)).astype(np.float32)))
    row, col, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    held = np.arange(len(y)) % 3 == 0
    use = ~held[row]
    kept = np.flatnonzero(~held)
    place = np.cumsum(~held) - 1
    # Values are small (means over a text); 32 brings the weights into the reach of the steps.
    w = 32 * _descend((place[row[use]], col[use], 32 * value[use]), y[kept], size, steps, decay)
    slope, offset = _calibrate(np.bincount(row, value * w[col], len(y))[held], y[held])
    return Model(w.astype(np.float32), slope, offset)


def score(deployments: DataFrame, model: Model, *, key: str = "platform_id", note: str = "note", threshold: float = 0.5) -> DataFrame:
    """One row for each record: counts, base verdict, probability and verdict.

    Columns: ``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    quality``. Words are runs of other characters than space and the controls 9 to 13; ``word_chars``
    counts their code points, ``n_symbols`` the characters ``# * $ % & | < >``, ``n_dup_lines`` the
    lines with a word that equal an earlier line, ``n_repeat_words`` the words inside three-word windows that the note has twice
    or more. A note fails with under 50 words, or where more than half of its words repeat so. Else it
    is kept where its calibrated ``quality`` reaches ``threshold``. Null and empty notes have no
    words and fail. Whole notes are scored in Arrow batches, without a shuffle; the model is a
    fixed number of weights. Other columns are ignored; repeated records give repeated rows.
    """
    schema = (
        f"k {deployments.schema[key].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, quality double"
    )
    shared.small_batches(deployments.sparkSession)
    sent = deployments.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in shared.pieces(batches, "t"):
            data, offsets = words.raw(batch.column(1))
            starts, ends, first = words.spans(data, offsets)
            hashed = words.hashes(data, starts, ends)
            n = np.diff(first)
            repeat = _repeated(hashed, first)
            body = data.tobytes()
            lines = [_repeated_lines(body[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            failed = (n < 50) | (100 * repeat > 50 * n)
            p = sent.value.probability(Grams(data, offsets, hashed, first))
            arrays = [n, _sums(_IS_POINT[data], offsets), _sums(_IS_SYMBOL[data], offsets), np.array(lines, np.int64), repeat, failed, ~failed & (p >= threshold), p]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, arrays)], names=["k", *names])

    rows = deployments.select(F.col(key).alias("k"), F.col(note).cast("binary").alias("t"))
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
