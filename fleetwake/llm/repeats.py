"""Passages that deployment notes repeat from earlier records: level-wise doubling of windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.llm import shared, words

_NOTHING = hashlib.sha256(b"").hexdigest()


def _slide(values: np.ndarray, width: int, combine) -> np.ndarray:
    """``combine`` over every run of ``width`` values, by doubling the width."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = combine(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(hashed: np.ndarray, first: np.ndarray, short: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the short window at every word, least of them in every long window, which are anchors).

    The anchor of a long window is its short window with the least hash (all of them in a tie), so
    equal long windows have equal anchors at equal places. Long windows across texts have the least
    hash 0 and no anchor.
    """
    grams = words.windows(hashed, short)
    width = window - short + 1
    if len(grams) < width:
        return grams, np.zeros(0, np.uint64), np.zeros(len(grams), bool)
    grams = np.maximum(grams, np.uint64(1))
    least = _slide(grams, width, np.minimum)
    least[~words.inner(first, window, len(least))] = 0
    padded = np.zeros(len(grams) + width - 1, dtype=np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    return grams, least, _slide(padded, width, np.maximum) == grams


def _read(df: DataFrame, short: int, window: int) -> DataFrame:
    """``k, h, t`` → one row with the number of words, their digest and the anchors."""
    schema = f"k {df.schema['k'].dataType.simpleString()}, h int, n_words long, digest binary, places array<int>, grams array<long>"

    def run(batches):
        for batch in shared.pieces(batches, "t"):
            data, offsets = words.raw(batch.column(2))
            starts, ends, first = words.spans(data, offsets)
            grams, _, chosen = anchors(words.hashes(data, starts, ends), first, short, window)
            at = np.flatnonzero(chosen)
            cuts = np.searchsorted(at, first)
            local = at - np.repeat(first[:-1], np.diff(cuts))
            body = data.tobytes()
            digests = [hashlib.sha256(b" ".join(body[a:b].split())).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            cuts = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(cuts, pa.array(local.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(grams[at].view(np.int64)))],
                names=["k", "h", "n_words", "digest", "places", "grams"],
            )

    return df.mapInArrow(run, schema)


def _extend(df: DataFrame, short: int, window: int) -> DataFrame:
    """``k, h, t, places`` → the long windows whose anchor is at one of the places: ``k, h, starts, hashes``."""
    schema = f"k {df.schema['k'].dataType.simpleString()}, h int, starts array<int>, hashes array<long>"

    def run(batches):
        for batch in shared.pieces(batches, "t"):
            data, offsets = words.raw(batch.column(2))
            starts, ends, first = words.spans(data, offsets)
            hashed = words.hashes(data, starts, ends)
            grams, least, _ = anchors(hashed, first, short, window)
            places = batch.column(3)
            at = places.flatten().to_numpy(zero_copy_only=False) + np.repeat(first[:-1], places.value_lengths().to_numpy(zero_copy_only=False))
            begin = at[:, None] - np.arange(window - short + 1)
            ok = (begin >= 0) & (begin < len(least))
            begin = np.where(ok, begin, 0)
            ok &= least[begin] == grams[at][:, None] if len(least) else False
            begin = np.unique(begin[ok])
            cuts = np.searchsorted(begin, first)
            full = words.windows(hashed, window)[begin].view(np.int64)
            local = (begin - np.repeat(first[:-1], np.diff(cuts))).astype(np.int32)
            cuts = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(cuts, pa.array(local)), pa.ListArray.from_arrays(cuts, pa.array(full))],
                names=["k", "h", "starts", "hashes"],
            )

    return df.mapInArrow(run, schema)


def _remove(df: DataFrame, window: int) -> DataFrame:
    """``k, h, t, starts`` → ``k, h, n_removed, kept_note``: the words outside the windows, with single spaces."""
    schema = f"k {df.schema['k'].dataType.simpleString()}, h int, n_removed long, kept_note string"

    def run(batches):
        for batch in shared.pieces(batches, "t"):
            counts, kept = [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = text.split()
                gone = np.zeros(len(own) + 1, dtype=np.int64)
                np.add.at(gone, starts, 1)
                np.add.at(gone, np.asarray(starts) + window, -1)
                left = np.cumsum(gone[:-1]) == 0
                counts.append(len(own) - int(left.sum()))
                kept.append(b" ".join([own[i] for i in np.flatnonzero(left)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], names=["k", "h", "n_removed", "kept_note"])

    return df.mapInArrow(run, schema)


def shared_windows(posts: DataFrame, value: str) -> DataFrame:
    """``value, first_k`` of the values that rows of different keys have; the first is the smallest key."""
    return posts.groupBy(value).agg(F.min("k").alias("first_k"), F.max("k").alias("last_k")).where("first_k < last_k").select(value, "first_k")


def remove_repeats(deployments: DataFrame, *, key: str = "platform_id", note: str = "note", window: int = 50) -> DataFrame:
    """One row for each record: ``key, n_words, n_removed, kept_sha256``.

    Words are runs of other characters than space and the controls 9 to 13, unchanged. A word is
    removed where a window of ``window`` consecutive words covers it whose word sequence also
    starts in a record with a smaller key; windows are judged on the input. ``kept_sha256`` is the
    digest of the kept words, joined by one space (of the empty text where none is kept).

    Level-wise: only windows of half the length that several records have are extended to the full
    length, and only full windows that several records have remove words (a longer repeat is a run
    of full windows, so the doubling ends there). Of the half windows, those with the least hash
    within some full window are posted (anchors): equal full windows have equal anchors, so none is
    missed. Records with equal word sequences are looked up by their digest and leave all but the
    first out of the levels. Values are grouped by minimum and maximum before they are joined back,
    so a passage that a third of the records share is one row of that table.

    Within a key records are told apart by a 32-bit hash of their notes (4 bytes fewer in each posted
    row). Null and empty notes have no words. Records with a null key lose nothing and are earlier than
    none. Records that share a key are not earlier than each other; exact repeats give equal rows.
    Windows are compared by 64-bit hashes. Other columns are ignored; an empty table gives an empty table.
    """
    shared.small_batches(deployments.sparkSession)
    short = window // 2
    rows = deployments.select(F.col(key).alias("k"), F.hash(note).alias("h"), F.col(note).cast("binary").alias("t"))
    read = shared.cut(_read(rows, short, window))
    heads = read.where("k IS NOT NULL AND n_words > 0").groupBy("digest").agg(F.min("k").alias("head"), F.max("k").alias("tail")).where("head < tail").select("digest", "head")
    records = read.select("k", "h", "n_words", "digest").join(heads, "digest", "left")
    records = shared.cut(records.select("k", "h", "n_words", "digest", F.coalesce(F.col("k") > F.col("head"), F.lit(False)).alias("copy")))

    # Half the length: anchors that records of different keys have.
    posts = read.where("k IS NOT NULL").select("k", "h", F.explode(F.arrays_zip("places", "grams")).alias("a")).select("k", "h", F.col("a.places").alias("place"), F.col("a.grams").alias("gram"))
    twice = shared_windows(posts, "gram").select("gram")
    alive = posts.join(twice, "gram").groupBy("k", "h").agg(F.collect_list("place").alias("places"))
    alive = alive.join(records.where("copy").select("k", "h").distinct(), ["k", "h"], "left_anti")
    suspects = shared.cut(rows.join(alive.hint("shuffle_hash"), ["k", "h"]).select("k", "h", "t", "places"))

    # Full length: the first record of every window, then the windows of later records.
    full = _extend(suspects, short, window).select("k", "h", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select("k", "h", F.col("w.starts").alias("start"), F.col("w.hashes").alias("value"))
    later = full.join(shared_windows(full, "value"), "value").where("k > first_k").groupBy("k", "h").agg(F.collect_list("start").alias("starts"))
    cutting = suspects.select("k", "h", "t").join(later.hint("shuffle_hash"), ["k", "h"]).select("k", "h", "t", "starts")
    done = _remove(cutting, window).select("k", "h", "n_removed", F.sha2("kept_note", 256).alias("kept")).dropDuplicates(["k", "h"])

    whole = F.col("copy") & (F.col("n_words") >= window)
    return records.join(done, ["k", "h"], "left").select(
        F.col("k").alias(key), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_NOTHING)).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
