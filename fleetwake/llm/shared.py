"""Small helpers that the text operators share."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.operators import frames

#: Word separators: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20


def cut(df: DataFrame) -> DataFrame:
    """Write a step to the shared folder and go on from the table, so that lost executors lose nothing of it."""
    path = f"{frames.shared_folder(df.sparkSession).rstrip('/')}/notes-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark, rows: int = 1000) -> None:
    """Hand Python at most so many rows at a time, where the session has no smaller number.

    Notes are long rows: the usual ten thousand are tens of megabytes in the JVM, in Arrow and in
    Python at once.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, room = 0, most
        for i, n in enumerate(sizes):
            if n > room and i > start:
                yield batch.slice(start, i - start)
                start, room = i, most
            room -= int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def listed_sha256(rows: DataFrame, by: list[str], item: str, out: str, chunk: int = 4096) -> DataFrame:
    """``by, out`` for every group: SHA-256 (lowercase hex) of its items, ascending and comma-joined.

    ``item`` is a whole number that a group holds once. Items are joined within ranges of ``chunk``
    numbers first; a group's ranges then pass through the digest in order, as a stream that no task
    has to hold.
    """
    ranges = rows.groupBy(*by, F.floor(F.col(item) / chunk).alias("__c")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string")), ",").alias("__t")
    )
    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in by], f"{out} string"])

    def run(batches):
        key, digest, kinds = None, None, None
        for batch in batches:
            kinds, done = batch.schema, []
            for *now, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now == key:
                    digest.update(b",")
                else:
                    if digest is not None:
                        done.append([*key, digest.hexdigest()])
                    key, digest = now, hashlib.sha256()
                digest.update(text.encode())
            if done:
                yield _batch(done, kinds)
        if digest is not None:
            yield _batch([[*key, digest.hexdigest()]], kinds)

    def _batch(done, kinds):
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*by, out])

    return ranges.repartition(*by).sortWithinPartitions(*by, "__c").select(*by, "__t").mapInArrow(run, schema)
