"""Token counts of deployment notes with the whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwake.llm import shared

#: Fixed value: how the byte-level vocabulary splits a text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets the merged pre-tokens beyond so many; it only costs time.
REMEMBER = 1 << 19


def _load(definition: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.no_truncation()
    t.no_padding()
    return t


def whole_tokens(definition: str) -> frozenset[str]:
    """The strings proved to be one pre-token and one token when they are encoded alone.

    The merges of a byte-level vocabulary act within one pre-token, so such a string counts one
    wherever it is a pre-token. Every vocabulary string that is valid text is encoded and checked;
    the result is bounded by the vocabulary.
    """
    t, split = _load(definition), regex.compile(SPLIT)
    special = special_tokens(definition)
    texts = {t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())} - special
    texts = sorted(x for x in texts if x and "�" not in x and split.fullmatch(x))
    codes = t.encode_batch(texts, add_special_tokens=False)
    return frozenset(x for x, e in zip(texts, codes, strict=True) if len(e.ids) == 1 and split.findall(x) == [x])


def special_tokens(definition: str) -> set[str]:
    return {x.content for x in _load(definition).get_added_tokens_decoder().values()}


class Counter:
    """Counts tokens of texts; keeps the counts of pre-tokens that had to be merged."""

    def __init__(self, definition: str, whole: frozenset[str]):
        self.encoder, self.whole, self.known = _load(definition), whole, {}
        self.split = regex.compile(SPLIT)
        special = sorted(special_tokens(definition), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(self, texts: list[str]) -> list[int]:
        pieces = []
        out = []
        for text in texts:
            parts, n = [text], 0
            if self.special is not None and self.special.search(text):
                n = len(self.special.findall(text))
                parts = self.special.split(text)
            pre = [x for p in parts for x in self.split.findall(p)]
            # Most pre-tokens are whole tokens; the others go on to the merges.
            rest = [x for x in pre if x not in self.whole]
            out.append(n + len(pre) - len(rest))
            pieces.append(rest)
        new = {x for rest in pieces for x in rest} - self.known.keys()
        if len(self.known) + len(new) > REMEMBER:
            new = {x for rest in pieces for x in rest}
            self.known = {}
        new = sorted(new)
        for x, e in zip(new, self.encoder.encode_batch(new, add_special_tokens=False), strict=True):
            self.known[x] = len(e.ids)
        known = self.known
        return [n + sum([known[x] for x in rest]) for n, rest in zip(out, pieces, strict=True)]


def count_tokens(deployments: DataFrame, definition: str, *, key: str = "platform_id", note: str = "note", limit: int = 512) -> DataFrame:
    """One row for each record: ``key, n_bytes, n_tokens, over_limit``.

    ``definition`` is the text of a byte-level vocabulary file of the tokenizers library (its size
    bounds what is broadcast). Counts are those of ``encode(text, add_special_tokens=False)``: no
    begin, end or added tokens, no truncation, and a special string inside a text is one token, as
    by the library's default. Null and empty notes have no bytes and no tokens. Notes are counted
    whole, in Arrow batches, without a shuffle. Other columns are ignored; repeated records give
    repeated rows. Deployment records have no token counts of their own in the library.
    """
    schema = f"k {deployments.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    shared.small_batches(deployments.sparkSession)
    shared_model = deployments.sparkSession.sparkContext.broadcast((definition, whole_tokens(definition)))

    def run(batches):
        counter = Counter(*shared_model.value)
        for batch in shared.pieces(batches, "t"):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n_bytes = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["k", "n_bytes", "n_tokens", "over_limit"],
            )

    return deployments.select(F.col(key).alias("k"), F.col(note).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
