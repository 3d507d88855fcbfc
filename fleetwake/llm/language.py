"""The language of deployment notes: which language's dictionary compresses a note best."""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwake.llm import shared

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> bytes:
    """The runs of letters in lower case, with single spaces, as UTF-8."""
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "replace") if text else b""


def _slice(h: str) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.col(h), 11) / F.lit(float(1 << 53))


def fit(records: DataFrame, *, note: str = "note", lang: str = "lang", dictionary_bytes: int = 131_072, excerpt: int = 1000) -> dict[str, bytes]:
    """Language → content of its dictionary, from rows with a language and a note.

    A dictionary joins excerpts of up to ``excerpt`` characters of different notes, each from a place
    in the whole note that the note's hash names (not its opening, which notes may share), in the order of the hashes, up to ``dictionary_bytes``: a bounded sample, whatever the input. Notes are
    counted by language first, which says how small a hash must be, so no language is sorted whole.
    The driver gets the languages' counts and samples.
    """
    rows = records.where(F.col(lang).isNotNull() & F.col(note).isNotNull()).select(F.col(lang).alias("lang"), F.col(note).alias("note"), F.xxhash64(note).alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    wanted = 4 * (dictionary_bytes // excerpt + 1)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, wanted / n)])
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("note") - excerpt + 1, F.lit(1))).cast("int") + 1
    few = (
        rows.where(_slice("h") < share[F.col("lang")]).select("lang", "h", F.col("note").substr(begin, F.lit(excerpt)).alias("note"))
        .dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()
    )
    out = dict.fromkeys(counts, b"")
    for r in few:
        if len(out[r.lang]) < dictionary_bytes:
            out[r.lang] = (out[r.lang] + b" " + letters(r.note))[:dictionary_bytes]
    return {k: v for k, v in out.items() if v.strip()}


def _compressors(dictionaries: dict[str, bytes], block: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name, content in sorted(dictionaries.items()):
        params = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=4, write_content_size=0, write_dict_id=0, write_checksum=0, source_size=block, dict_size=len(content)
        )
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def classify(deployments: DataFrame, dictionaries: dict[str, bytes], *, key: str = "platform_id", note: str = "note",
             margin: float = 0.004, block: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each record: ``key, lang_pred, score, rejected``.

    The letters of a note are cut into blocks of ``block`` bytes, and each block is compressed by
    itself with every language's raw-content dictionary, so that a long note is judged by the
    dictionaries and not by its own repeats; the smallest sum names the language (ties: the first
    in code point order). ``score`` is 1 - smallest / next smallest (1 where only one language is
    known), and a record is ``rejected`` where the score is under ``margin``, or where the note is
    null or has no letter; the language is ``und`` then only in the latter case or without dictionaries.
    ``keep`` names columns to carry along; other columns are ignored. Repeated records give repeated
    rows. No shuffle; memory is a batch of rows.

    Deployment records have no language field in the library's own tables: ``lang`` is an extra
    column of the training rows given to :func:`fit`.
    """
    given = deployments.select(F.col(key).alias("k"), F.col(note).alias("t"), *[F.col(c).alias(f"keep_{c}") for c in keep if c != note])
    shared.small_batches(deployments.sparkSession)
    whole = note in keep
    schema = (given if whole else given.drop("t")).select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    content = deployments.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        coders = _compressors(content.value, block)
        for batch in shared.pieces(batches, "t"):
            names, scores, out = [], [], []
            for text in batch.column(1).to_pylist():
                data = letters(text)
                if not data or not coders or not any(c.isalpha() for c in data.decode()):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    out.append(True)
                    continue
                blocks = [data[i : i + block] for i in range(0, len(data), block)]
                sizes = sorted((sum(len(coder.compress(b)) for b in blocks), name) for name, coder in coders)
                score = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
                names.append(sizes[0][1])
                scores.append(score)
                out.append(score < margin)
            columns = [batch.column(0), *batch.columns[1 if whole else 2 :], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    done = given.mapInArrow(run, schema)
    return done.select(F.col("k").alias(key), "lang_pred", "score", "rejected", *[F.col("t" if c == note else f"keep_{c}").alias(c) for c in keep])
