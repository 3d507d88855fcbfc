"""A corpus pipeline over the documents table; its stages are operators of ``fleetwake.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves, with the columns of
documents; the last one returns their places. A document is a deployment record: ``doc_id`` is its
``platform_id``, ``text`` its ``note`` and ``source`` its ``provenance``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwake.llm import language, mixing, near, patterns, sharding, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries tell; null or letterless texts and narrow margins go."""
    known = language.fit(docs, note="text")
    found = language.classify(docs.select(*COLUMNS), known, key="doc_id", note="text", keep=COLUMNS[1:])
    return found.where("NOT rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return near.deduplicate(docs.select(*COLUMNS), key="doc_id", note="text").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of ten words of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = patterns.search(docs.select(*COLUMNS), items, key="doc_id", note="text", event="item_id", review_note="text", keep=COLUMNS[1:])
    return found.where("n_hit = 0").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    docs = docs.select(*COLUMNS)
    taken = mixing.mix(docs, key="doc_id", note="text", provenance="source", keep=("source",))
    taken = taken.where("copies > 0").select(F.col("doc_id").alias("k"), F.col("source").alias("s"), "size", "copies").distinct()
    sized = docs.withColumn("size", mixing.n_words(F.col("text"))).withColumnRenamed("size", "own_size")
    same = sized["doc_id"].eqNullSafe(taken["k"]) & sized["source"].eqNullSafe(taken["s"]) & (sized["own_size"] == taken["size"])
    return sized.join(taken.hint("shuffle_hash"), same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def reshard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, from shards by source, with the fewest bytes moved."""
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(16)).cast("int")
    return sharding.plan(docs, old=old, n_old=16, n_new=16, key="doc_id", note="text", keep=("lang", "source", "n_chars"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", reshard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.cut(docs)
    return docs
