"""The pipeline of the text operators, stage by stage, and the registry."""

from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, SF).collect(), docs.schema)
        rows = left.collect()
        assert left.columns == docs.columns and all(before[r.doc_id] == r.text for r in rows)
        ids = [r.doc_id for r in rows]
        assert len(ids) >= 0.5 * len(set(before)), name
        if name != "mixing":
            assert len(set(ids)) == len(ids)
    placed = corpus_pipeline.reshard(spark, left, SF).collect()
    assert sorted(r.doc_id for r in placed) == sorted(r.doc_id for r in left.collect())
    for s in {r.shard for r in placed}:
        slots = sorted(r.slot for r in placed if r.shard == s)
        assert slots == list(range(len(slots)))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = docs.limit(60).collect()
    long = " ".join(r.text or "" for r in sample if r.lang == "en")
    odd = [(None, sample[0].text, "en", None, 5), (None, sample[0].text, "en", None, 5), (10**6, long * 3, "en", "src1", 0), (10**6 + 1, None, None, None, None),
           (10**6 + 2, "", "en", "src2", 0), (10**6 + 3, sample[1].text, None, "src2", 1), (10**6 + 3, sample[1].text, None, "src2", 1)]
    left = spark.createDataFrame([tuple(r) for r in sample] + odd, docs.schema)
    left = left.selectExpr("*", "'x' AS k", "1 AS size", "'y' AS copies", "2 AS old_shard")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, left, SF).collect()
        if name != "sharding":
            left = spark.createDataFrame(rows, docs.schema)
            assert all(r.text for r in rows) and 0 < len(rows) <= 3 * (len(sample) + len(odd)), name
    assert sum(r.doc_id == 10**6 for r in rows) <= 3 and len(rows) == left.count()
