"""Near-duplicate deployment notes: MinHash coordinates in an inverted join, links confirmed on full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.llm import shared, words
from fleetwake.llm.components import components

#: Fixed values of the signature: coordinates, MinHash values in each, equal coordinates that a
#: candidate needs. A pair of similarity 0.8 agrees in a coordinate with probability 0.512, so
#: fewer than four of forty agree with a probability below 1e-8.
COORDINATES, EACH, MATCHES = 40, 3, 4
_FACTORS = words.mix(np.arange(1, COORDINATES * EACH + 1, dtype=np.uint64)) | np.uint64(1)
#: Members of a candidate cluster that one task compares with each other.
BLOCK = 2048
#: Bytes of their full sets, 8 for each shingle; the tighter of the two says how many blocks there are.
BLOCK_BYTES = 16 << 20
#: Members of a posting that one task compares with each other (100 bytes each).
POSTED = 8192
#: Keys of dropped records that are broadcast at most (16 bytes each).
BROADCAST_ROWS = 1_000_000


def shingles(column: pa.Array, length: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; shorter texts are one shingle."""
    data, offsets = words.raw(column)
    data = words.LOWER[data]
    starts, ends, first = words.spans(data, offsets)
    hashed = words.hashes(data, starts, ends)
    rolled, out = words.windows(hashed, length), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= length:
            out.append(np.unique(rolled[a : b - length + 1]))
        else:
            out.append(words.windows(hashed[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, list[bytes | None]]:
    """(coordinates of the texts that have shingles, 128-bit identity of every set)."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, COORDINATES), np.int64), [None] * len(sets)
    flat = np.concatenate(full)
    begin = np.cumsum([0, *map(len, full[:-1])])
    low = np.empty((COORDINATES * EACH, len(full)), dtype=np.uint64)
    turned = np.empty_like(flat)
    for j, factor in enumerate(_FACTORS):
        np.multiply(flat, factor, out=turned)
        low[j] = np.minimum.reduceat(turned, begin)
    coordinates = np.zeros((COORDINATES, len(full)), dtype=np.uint64)
    for e in range(EACH):
        coordinates = words.mix(coordinates * np.uint64(31) + low[e::EACH] + np.arange(COORDINATES, dtype=np.uint64)[:, None])
    one, two = np.add.reduceat(words.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), begin), np.bitwise_xor.reduceat(words.mix(flat + np.uint64(0x14057B7EF767814F)), begin)
    names = iter(np.stack([one, two], axis=1).astype(">u8"))
    return coordinates.T.view(np.int64), [next(names).tobytes() if len(s) else None for s in sets]


def _signed(df: DataFrame, length: int) -> DataFrame:
    """``k, h, t`` → ``k, h, n, name, coordinates``."""
    schema = f"k {df.schema['k'].dataType.simpleString()}, h long, n long, name binary, coordinates array<long>"

    def run(batches):
        for batch in shared.pieces(batches, "t", 1 << 20):
            sets = shingles(batch.column(2), length)
            coordinates, names = _signatures(sets)
            sizes = np.array([COORDINATES * (x is not None) for x in names], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(coordinates.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), lists],
                names=["k", "h", "n", "name", "coordinates"],
            )

    return df.mapInArrow(run, schema)


def _sets(df: DataFrame, length: int) -> DataFrame:
    """``cluster, name, t`` → ``cluster, name, hashes``: the full set as sorted 64-bit values."""

    def run(batches):
        for batch in shared.pieces(batches, "t", 1 << 20):
            sets = shingles(batch.column(2), length)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cluster", "name", "hashes"])

    return df.mapInArrow(run, "cluster binary, name binary, hashes binary")


def _briefs(classes: DataFrame) -> DataFrame:
    """``name, n, coordinates`` → ``name, n, brief``: 16 bits of every coordinate, in which equal coordinates are equal."""

    def run(batches):
        for batch in batches:
            low = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.uint16).reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in low], pa.binary())], names=["name", "n", "brief"])

    return classes.select("name", "n", "coordinates").mapInArrow(run, "name binary, n long, brief binary")


def agreeing(briefs: np.ndarray, n: np.ndarray, side: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (rows a, rows b) of the sets of each group that agree in ``MATCHES`` coordinates.

    ``first`` is the row of each group's beginning, and the end. Sizes too different for a link are
    passed over, and so are pairs within one ``side`` of a group that has two. Every set is compared
    with its group's first, all groups at once. Where some are left, each set that is reached is
    compared with those that are not, so no pair is lost and each group has fewer links than sets.
    """
    counts = np.diff(first)
    group = np.repeat(np.arange(len(counts)), counts)
    two = (np.maximum.reduceat(side, first[:-1]) != np.minimum.reduceat(side, first[:-1]))[group]

    def agree(a, b):
        equal = np.zeros(np.broadcast_shapes(a.shape, b.shape), dtype=np.uint8)
        for c in range(COORDINATES):
            equal += briefs[c, a] == briefs[c, b]
        near_ = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        return (equal >= MATCHES) & near_ & (~two[a] | (side[a] != side[b]))

    head = first[:-1][group]
    rows = np.arange(len(head))
    hit = agree(rows, head) & (rows != head)
    out_a, out_b = [rows[hit]], [head[hit]]
    missed = ~hit & (rows != head)
    for g in np.flatnonzero((np.add.reduceat(missed.astype(np.int64), first[:-1]) > 0) & (counts > 2)):
        own = rows[first[g] : first[g + 1]]
        queue, left = own[hit[own]], own[missed[own]]
        while len(left):
            if not len(queue):
                queue, left = left[:1], left[1:]
            some, queue = queue[:64], queue[64:]
            found = agree(some[:, None], left[None, :])
            reached = found.any(axis=0)
            out_a.append(left[reached])
            out_b.append(some[found.argmax(axis=0)[reached]])
            queue, left = np.concatenate([queue, left[reached]]), left[~reached]
    return np.concatenate(out_a), np.concatenate(out_b)


def _agreeing(posts: DataFrame, percent: int) -> DataFrame:
    """``value, i, j, block, name, n, brief``, each ``value, i, j`` in one piece of a partition → links ``a, b``."""

    def links(t: pa.Table) -> pa.RecordBatch:
        keys = np.stack([t.column(c).to_numpy() for c in ("value", "i", "j")])
        first = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
        briefs = np.frombuffer(b"".join(t.column("brief").to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)
        side = t.column("block").to_numpy() != keys[1]
        a, b = agreeing(np.ascontiguousarray(briefs.T), t.column("n").to_numpy(), side, first, percent)
        names = t.column("name").combine_chunks()
        return pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < POSTED:
                continue
            keys = np.stack([held.column(c).to_numpy() for c in ("value", "i", "j")])
            begin = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            if len(begin):  # the last group may go on in the next batch
                yield links(held.slice(0, begin[-1] + 1))
                held = held.slice(begin[-1] + 1)
        if held is not None and held.num_rows:
            yield links(held)

    return posts.select("value", "i", "j", "block", "name", "n", "brief").mapInArrow(run, "a binary, b binary")


def candidates(classes: DataFrame, percent: int = 80) -> DataFrame:
    """Links ``a, b`` that join all sets that agree in at least ``MATCHES`` coordinates; ``classes``: ``name, n, coordinates``.

    A pair with that many equal coordinates has one among the first ``COORDINATES - MATCHES + 1``
    (prefix), so only these are posted. The members of each posting are compared with each other by
    whole signatures, and only spanning links of those that agree leave it, so its rows do not
    multiply: a pair that agrees is joined directly or over others that agree. A posting of more than
    ``POSTED`` members is cut by hash into blocks, and every pair of blocks is a group of its own.
    """
    prefix = F.slice("coordinates", 1, COORDINATES - MATCHES + 1)
    posts = classes.select("name", F.explode(prefix).alias("value"))
    sizes = posts.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("value", F.ceil(F.col("m") / POSTED).cast("int").alias("blocks"))
    posts = posts.join(sizes, "value").join(_briefs(classes), "name")
    # The salt keeps blocks apart from the partitioning by name.
    posts = posts.withColumn("block", F.pmod(F.xxhash64("name", "value"), "blocks").cast("int"))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.select("value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", "n", "brief")
    return _agreeing(posts.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", "name"), percent)


def linked(names: list[bytes], sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """Spanning links of the sets with ``100 * intersection >= percent * union``.

    ``side`` separates the two blocks of a comparison; pairs within one side are left out unless all
    are on one. Grows each component from a set by the inverted lists of the elements of its
    members: a set is expanded once, and sets that are reached already are passed over.
    """
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    both = bool(side.any() and not side.all())
    out, open_ = [], np.ones(len(sets), dtype=bool)
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue and open_.any():
            i = queue.pop()
            begin, end = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            shared_ = np.bincount(np.concatenate([owner[a:b] for a, b in zip(begin, end, strict=True)]), minlength=len(sets))
            hit = open_ & (100 * shared_ >= percent * (lengths + lengths[i] - shared_))
            if both:
                hit &= side != side[i]
            for j in np.flatnonzero(hit):
                out.append((names[i], names[j]))
                queue.append(int(j))
            open_[hit] = False
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """``cluster, name, hashes`` → ``cluster, i, j, block, name, hashes``: the pairs of blocks of each cluster.

    A cluster of more than ``BLOCK`` sets or ``BLOCK_BYTES`` of hashes is cut by hash into blocks,
    so that a pair of blocks holds about two blocks in sets and in bytes (one set at least).
    """
    count, held = F.count(F.lit(1)), F.sum(F.octet_length("hashes"))
    blocks = F.least(count, F.greatest(F.ceil(count / BLOCK), F.ceil(held / BLOCK_BYTES)))
    sizes = members.groupBy("cluster").agg(blocks.cast("int").alias("blocks"))
    m = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("name"), "blocks").cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", "hashes")


def _confirm(members: DataFrame, percent: int) -> DataFrame:
    """Links between full sets within each candidate cluster; ``members``: ``cluster, name, hashes``."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("name")
        names = t.column("name").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("hashes").to_pylist()]
        side = t.column("block").to_numpy() != t.column("i").to_numpy()
        pairs = linked(names, sets, side, percent) if len(sets) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})

    return _blocks(members).groupBy("cluster", "i", "j").applyInArrow(run, "a binary, b binary")


def _resolve(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``k, h, t`` → ``k, h, n, component_id, kept`` for every row; h is the hash of the text."""
    shared.small_batches(rows.sparkSession)
    signed = shared.cut(_signed(rows, shingle))
    named = signed.where("name IS NOT NULL")
    classes = named.groupBy("name").agg(F.min_by("coordinates", F.struct("k", "h")).alias("coordinates"), F.min(F.struct("k", "h")).alias("one"), F.min("n").alias("n"))
    classes = shared.cut(classes)
    clusters = components(candidates(classes, percent))
    wanted = clusters.join(classes.select(F.col("name").alias("node"), "one"), "node").select(
        F.col("component").alias("cluster"), F.col("node").alias("name"), F.col("one.k").alias("k"), F.col("one.h").alias("h")
    )
    # One text of each candidate class; the hash build is on the small side, so texts are not sorted.
    same = rows["k"].eqNullSafe(wanted["k"]) & (rows["h"] == wanted["h"])
    found = rows.join(wanted.hint("shuffle_hash"), same).select("cluster", "name", "t").dropDuplicates(["name"])
    links = _confirm(shared.cut(_sets(found, shingle)), percent)
    reached = shared.cut(components(links).withColumnRenamed("node", "name"))

    d = signed.select("k", "h", "n", "name").join(reached, "name", "left").select("k", "h", "n", F.coalesce("component", "name").alias("component"))
    d = shared.cut(d)
    ids = d.where("component IS NOT NULL").groupBy("component").agg(F.min("k").alias("component_id"))
    d = d.join(ids, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("k")).otherwise(F.col("component_id")))
    return d.select("k", "h", "n", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(deployments: DataFrame, *, key: str = "platform_id", note: str = "note", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each record: ``key, n_shingles, component_id, kept``.

    The set of a note is its distinct shingles of ``shingle`` words (A-Z as a-z; words are runs of
    other characters than space and the controls 9 to 13); a note of fewer words is one shingle,
    an empty or null note has none and is linked with nothing. Notes are linked where
    ``100 * intersection >= percent * union``. ``component_id`` is the smallest key that links
    reach, the own key included, and a record is ``kept`` where it is the own key.

    Notes with equal sets become one class (128-bit identity), so copies cost nothing. Classes are
    posted under every coordinate and value of their signature's prefix, and all members of a
    posting are compared with each other; those with enough equal coordinates make candidate clusters,
    and in these every link is decided on the full sets (64-bit shingle hashes). Candidates miss a link
    with a probability below 1e-8, whatever other sets share its postings.

    Null keys: such records are never a ``component_id``, unless all of their component are null
    (then it is null, and the record is kept). Records that share a key are records of their own; all with the smallest key are
    kept. An empty table gives an empty table. Other columns are ignored.
    """
    rows = deployments.select(F.col(key).alias("k"), F.xxhash64(note).alias("h"), F.col(note).alias("t"))
    d = _resolve(rows, shingle, percent)
    return d.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")


def deduplicate(deployments: DataFrame, *, key: str = "platform_id", note: str = "note", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The records that :func:`near_duplicates` keeps, with all their columns; of repeated records one stays.

    The records that go are few columns of a table; up to ``BROADCAST_ROWS`` of them are broadcast,
    more are joined by a shuffle.
    """
    d = shared.cut(_resolve(deployments.select(F.col(key).alias("k"), F.xxhash64(note).alias("h"), F.col(note).alias("t")), shingle, percent))
    gone = d.where("NOT kept").select("k", "h").distinct()
    again = d.where("kept").groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "h")

    def match(df, small):
        small = F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("shuffle_hash")
        return small, df[key].eqNullSafe(small["k"]) & (F.xxhash64(df[note]) == small["h"])

    small, same = match(deployments, gone)
    left = deployments.join(small, same, "left_anti")
    if again.isEmpty():
        return left
    small, same = match(left, again)
    return left.join(small, same, "left_anti").unionByName(left.join(small, same, "left_semi").dropDuplicates([key, note]))
