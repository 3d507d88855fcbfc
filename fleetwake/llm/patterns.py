"""Which deployment notes contain passages of held-out review texts: Wu-Manber search over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.llm import shared

#: Fixed value: a word is a run of letters, digits or bytes of characters outside ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case; null has none."""
    return _WORD.findall(text.lower()) if text else []


class WuManber:
    """Tables for passages of one length, in words.

    A block is the last two words of a window (one word for passages of one word). ``shift`` says
    how far the window may move when it ends in a block; ``buckets`` holds the passages whose last
    block it is, by their first word.
    """

    def __init__(self, passages: dict[tuple, list], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for p, items in passages.items():
            for end in range(self.block, length + 1):
                block = p[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets.setdefault(p[-self.block :], {}).setdefault(p[0], []).append((p, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(first word, items) of every occurrence, from left to right."""
        m, b, far, shift = self.length, self.block, self.far, self.shift.get
        end, n = m, len(words)
        while end <= n:
            step = shift((words[end - 2], words[end - 1]) if b == 2 else (words[end - 1],), far)
            if step:
                end += step
                continue
            found = tuple(words[end - m : end])
            for p, items in self.buckets[found[-b:]].get(found[0], ()):
                if p == found:
                    yield end - m, items
            end += 1


def build(items: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    """Search tables for all windows of the items, one for each length that occurs."""
    by_length: dict[int, dict] = {}
    for name, text in items:
        words = split_words(text)
        m = min(window, len(words))
        if not m:
            continue
        for i in range(len(words) - m + 1):
            names = by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
            if not names or names[-1] != name:
                names.append(name)
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


def _blocks(reviews: DataFrame, event: str, note: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The passages in blocks of at most ``most`` bytes (one item at least)."""
    block, size = [], 0
    rows = reviews.where(F.col(note).isNotNull()).select(F.col(event).cast("string"), F.col(note).cast("binary"))
    for name, text in rows.toLocalIterator():
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((name, bytes(text)))
        size += len(text)
    if block:
        yield block


def search(
    deployments: DataFrame,
    reviews: DataFrame,
    *,
    key: str = "platform_id",
    note: str = "note",
    event: str = "event_id",
    review_note: str = "note",
    window: int = 10,
    block_bytes: int = 8 << 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each deployment record: ``key``, ``n_words``, ``n_hit``, ``items``.

    A window is ``window`` consecutive words of a review note (all its words where it has fewer,
    none where it has none). ``n_hit`` counts the words of the deployment note inside occurrences of
    any window, ``items`` lists the distinct ``event`` ids of those windows, sorted as strings.
    Words are runs of letters, digits and characters outside ASCII; A-Z count as a-z.

    Review notes are read block by block and each block of at most ``block_bytes`` is broadcast; a
    second and later block takes another pass over the notes, from a written table. Notes never
    meet, so a hot source or a long text costs no more than its own length. Null or empty notes
    have no words; a null event id is left out of ``items`` but its windows still hit. Repeated
    records give repeated rows; ``keep`` names columns to carry along, others are ignored.
    """
    df = deployments.select(
        F.col(key).alias("k"), F.col(note).alias("t"), F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("items"), *[F.col(c).alias(f"keep_{c}") for c in keep if c != note],
    )
    schema = df.schema
    shared.small_batches(deployments.sparkSession)
    sc = deployments.sparkSession.sparkContext
    blocks = _blocks(reviews, event, review_note, block_bytes)
    now, after, passes = next(blocks, []), next(blocks, None), 0
    while True:
        if passes:
            df = shared.cut(df)
        df = df.mapInArrow(_scanner(sc.broadcast(now), window, passes, after is None, note in keep), schema)
        passes += 1
        if after is None:
            break
        now, after = after, next(blocks, None)
    return df.select(F.col("k").alias(key), "n_words", "n_hit", "items", *[F.col("t" if c == note else f"keep_{c}").alias(c) for c in keep])


def _scanner(block, window: int, passes: int, last: bool, keep_note: bool):
    """A pass over the notes; hits of earlier passes come in and go on as word numbers."""

    def run(batches):
        tables = build(block.value, window)
        for batch in shared.pieces(batches, "t"):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            earlier = batch.column(4).to_pylist() if passes else None
            known = batch.column(5).to_pylist() if passes else None
            n_words, n_hit, hits, items = [], [], [], []
            for i, text in enumerate(texts):
                words = split_words(text)
                hit = set(earlier[i]) if passes else set()
                names = set(known[i]) if passes else set()
                for t in tables:
                    done = 0
                    for at, found in t.find(words):
                        hit.update(range(max(at, done), at + t.length))
                        done = at + t.length
                        names.update(x for x in found if x is not None)
                n_words.append(len(words))
                n_hit.append(len(hit))
                hits.append([] if last else sorted(hit))
                items.append(sorted(names))
            text = pa.nulls(len(texts), pa.string()) if last and not keep_note else batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), *batch.columns[6:]],
                names=batch.schema.names,
            )

    return run
