"""Deployment notes turned into fill-in-the-middle examples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.llm import shared

#: The marks before the prefix, the suffix and the middle of an example.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of one block of a note.
BLOCK = 1024


def starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the notes: does a unit start there, does a code point start there.

    A unit is a run of letters A-Z and a-z, or any other code point.
    """
    point = (data & 0xC0) != 0x80
    letter = ((data | 0x20) - np.uint8(97)) < 26
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    unit[offsets[:-1][np.diff(offsets) > 0]] = True
    return unit, point


class Fenwick:
    """Counts of units and code points over the blocks of one note; node i holds its last (i & -i) blocks."""

    def __init__(self, counts: np.ndarray):
        self.blocks = counts.shape[1]
        self.tree = np.concatenate([np.zeros((2, 1), np.int64), counts], axis=1)
        step = 1
        while 2 * step <= self.blocks:
            upper = self.tree[:, 2 * step :: 2 * step]
            upper += self.tree[:, step :: 2 * step][:, : upper.shape[1]]
            step *= 2
        self.top = step

    def find(self, units: int) -> tuple[int, int, int]:
        """(blocks that hold no more than ``units`` units together, units left after them, their code points)."""
        at, points, step = 0, 0, self.top
        while step:
            if at + step <= self.blocks and self.tree[0, at + step] <= units:
                at += step
                units -= int(self.tree[0, at])
                points += int(self.tree[1, at])
            step //= 2
        return at, units, points


class Notes:
    """The notes of one batch as bytes, with the counts of their blocks."""

    def __init__(self, column: pa.Array, block: int):
        column = column.cast(pa.large_binary()).fill_null(b"")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.block = block
        self.unit, self.point = starts(self.data, self.offsets)
        n_blocks = -(-np.diff(self.offsets) // block)
        self.first = np.concatenate([[0], np.cumsum(n_blocks)])
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], n_blocks)
        at = np.repeat(self.offsets[:-1], n_blocks) + within * block
        if len(at):
            self.counts = np.stack([np.add.reduceat(x, at, dtype=np.int64) for x in (self.unit, self.point)])
        else:
            self.counts = np.zeros((2, 0), np.int64)

    def counts_of(self, i: int) -> np.ndarray:
        return self.counts[:, self.first[i] : self.first[i + 1]]

    def boundary(self, i: int, tree: Fenwick, units: int) -> tuple[int, int]:
        """Bytes and code points of note ``i`` before its unit number ``units`` (its whole size where there are no more)."""
        at, left, points = tree.find(units)
        low = self.offsets[i] + at * self.block
        if at == tree.blocks:
            return int(self.offsets[i + 1] - self.offsets[i]), points
        high = min(low + self.block, self.offsets[i + 1])
        here = int(np.flatnonzero(self.unit[low:high])[left])
        return int(low - self.offsets[i]) + here, points + int(np.count_nonzero(self.point[low : low + here]))


def examples(batch: pa.RecordBatch, block: int) -> list[pa.Array]:
    """Units, characters of prefix and middle, and the output of a batch ``note, form, h1, h2, …``."""
    notes = Notes(batch.column(0), block)
    forms, h1, h2 = (batch.column(j).to_pylist() for j in (1, 2, 3))
    n, prefix, middle, output = [], [], [], []
    for i, form in enumerate(forms):
        counts = notes.counts_of(i)
        size = int(counts[0].sum())
        n.append(size)
        text = notes.data[notes.offsets[i] : notes.offsets[i + 1]]
        if form == "plain":
            prefix.append(None)
            middle.append(None)
            output.append(text.tobytes())
            continue
        tree = Fenwick(counts)
        low, high = sorted((h1[i] % (size + 1), h2[i] % (size + 1)))
        (a, p), (b, q) = notes.boundary(i, tree, low), notes.boundary(i, tree, high)
        prefix.append(p)
        middle.append(q - p)
        head, body, tail = (x.tobytes() for x in (text[:a], text[a:b], text[b:]))
        p_, s_, m_ = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        output.append(p_ + head + s_ + tail + m_ + body if form == "psm" else s_ + tail + p_ + head + m_ + body)
    return [pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]


def fill_in_middle(
    deployments: DataFrame, *, key: str = "platform_id", note: str = "note", seed: int = 1,
    plain_percent: int = 10, spm_percent: int = 20, block: int = BLOCK, keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each record: ``key, n, form, prefix_chars, middle_chars, output`` and the kept columns.

    A note is cut into ``n`` units (runs of letters A-Z and a-z, or single other code points); two
    cuts, drawn from the SHA-256 of seed and key, divide it into prefix, middle and suffix. ``form``
    is ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or ``plain`` (the note as it is: empty
    notes, notes that contain a mark, and ``plain_percent`` of the others); characters are code points
    and null for ``plain``. Reruns agree; equal keys are cut alike.

    The cuts are found in a Fenwick tree over fixed blocks of a note, which sums units and code points:
    a descent by halves names the block of a cut, and only that block is looked through. Notes are taken
    whole, in Arrow batches, without a shuffle. A null note counts as empty, a null key as an empty
    string; repeated records give repeated rows, other columns are ignored, an empty table gives none.
    """
    shared.small_batches(deployments.sparkSession)
    k, t = F.col(key), F.coalesce(F.col(note), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(k.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    plain = (t == "") | marked | (h[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    carried = [k.alias("k0"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep, 1)]]
    given = deployments.select(F.col(note).alias("t"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"), *carried)
    kinds = [f"k{i} {deployments.schema[c].dataType.simpleString()}" for i, c in enumerate([key, *keep])]

    def run(batches):
        for batch in shared.pieces(batches, "t"):
            n, prefix, middle, output = examples(batch, block)
            columns = [batch.column(4), n, batch.column(1), prefix, middle, output, *batch.columns[5:]]
            names = ["k0", "n", "form", "prefix_chars", "middle_chars", "output", *batch.schema.names[5:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join([kinds[0], "n long, form string, prefix_chars long, middle_chars long, output string", *kinds[1:]])
    out = given.mapInArrow(run, schema)
    fixed = ["n", "form", "prefix_chars", "middle_chars", "output"]
    return out.select(F.col("k0").alias(key), *fixed, *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep, 1)])


def restore(output: str = "output", form: str = "form") -> F.Column:
    """The note of an example, exactly, from its output and form."""
    o, f = F.col(output), F.col(form)
    parts = F.split(o, "<[PSM]>", 4)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(f == "psm", F.concat(one, three, two)).when(f == "spm", F.concat(two, three, one)).otherwise(o)
