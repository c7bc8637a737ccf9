"""The pipeline's stages, one after the other, on the small tables."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_and_run(spark):
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    empty = (docs.limit(1).withColumn("doc_id", F.lit(9_001)).withColumn("text", F.lit(" -- 12")).withColumn("mix_copy", F.lit(1)),)
    before = docs.unionByName(empty[0].drop("mix_copy"))
    counts = [before.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, SMALL)
        assert before.columns == docs.columns and before.schema["text"].dataType == docs.schema["text"].dataType
        counts.append(before.count())
    assert counts[1] == counts[0] - 1 and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] <= counts[3]
    assert before.groupBy("doc_id").count().filter("count > 1").isEmpty()
    got = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "text", "mix_copy", "mix_words", "mix_position"} <= set(got.columns) and got.count() > 0


def test_near_copies_as_by_hand(spark):
    """One document of each group of fingerprints within the bit distance, on all pairs of the table."""
    from tests.llm.test_copies import _kept_by_hand

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near copies"]
    got = sorted((x["doc_id"], x["text"]) for x in stage(spark, docs, "").select("doc_id", "text").collect())
    want = _kept_by_hand([(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()])
    assert got == sorted(want) and len(got) < docs.count()
