"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes that a table marks. Its 64-bit hash is a polynomial over random values
of its bytes; the hash of a window of words is the same polynomial over word hashes. Both come
from prefix sums, so that a word or a window costs the same at any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SEGMENT = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

IN_WORD = np.ones(256, dtype=bool)
IN_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the odd factor and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) <= n:
        for name, factor in (("up", _ODD), ("down", _INVERSE)):
            steps = np.full(max(n, SEGMENT) + 1, factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 0x632BE59BD9B4E019))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and len(offsets) > 1 else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end byte of every word, number of the first word of each text, one more at the end)."""
    inside = in_word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for ascending ranges of one array."""
    up, down = _powers(len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every word; works through the bytes in segments of bounded size."""
    table, out, i = _table(seed), np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")), i + 1)
        a = starts[i]
        out[i:j] = _ranges(table[data[a : ends[j - 1]]], starts[i:j] - a, ends[i:j] - a)
        i = j
    return mix(out)


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of so many words, by its first word (windows across texts included)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for i in range(0, n, SEGMENT):
        at = np.arange(min(SEGMENT, n - i))
        out[i : i + len(at)] = _ranges(words[i : i + len(at) + length - 1], at, at + length)
    return mix(out)


def inner(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n windows of so many words lie within one text."""
    ok = np.ones(max(n, 0), dtype=bool)
    if n > 0 and length > 1:
        for shift in range(1, length):
            at = first[1:-1] - shift
            ok[at[(at >= 0) & (at < n)]] = False
        # a cut is passed by a window only when words stand on both of its sides
    return ok
