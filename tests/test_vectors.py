"""Retrieval from inverted lists against a full search, and exports with too many fields."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logquarry.operators import analysis
from logquarry.sources import sinks
from logquarry.sources.vectors import VectorIndex

SCHEMA = "source_key string, start_line long, text string, embedding array<float>"


def _chunks(spark, seed, n, sources=5, hubs=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(hubs, 8)) * 4
    vectors = centres[rng.integers(0, hubs, n)] + rng.normal(size=(n, 8)) * 0.3
    rows = [(f"s{i % sources}", i, f"a {i}\nb {i}", [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    rows += [("s1", 90_000, "none", None), ("s1", 90_001, "short", [1.0])]
    return spark.createDataFrame(rows, SCHEMA), vectors


def _full(chunks, query, k, source=None):
    rows = chunks.filter("size(embedding) = 8").withColumnRenamed("source_key", "source")
    return [(r["source"], r["start_line"]) for r in analysis.top_k_chunks(rows, query, k=k, source=source).collect()]


def test_retrieval_is_that_of_a_full_search_and_reads_fewer_lists(spark, tmp_path):
    chunks, vectors = _chunks(spark, 1, 900)
    index = VectorIndex(spark, str(tmp_path))
    index.store(chunks, lists=32)
    read = []
    for n, (k, source) in enumerate([(5, None), (12, "s3"), (1, None), (40, "s0")]):
        query = [float(x) for x in vectors[37 * n] + 0.05]
        got = index.nearest(query, k=k, source_key=source, probe=2, on_read=read.append).collect()
        assert [(r["source_key"], r["start_line"]) for r in got] == _full(chunks, query, k, source)
    assert sum(len(set(a) | set(b)) for a, b in zip(read[:6:2], read[1:6:2])) < 0.6 * 3 * 32
    everything = index.nearest([0.0] * 8, k=5000)
    assert everything.count() == 900


def test_storing_a_source_again_replaces_it(spark, tmp_path):
    chunks, vectors = _chunks(spark, 2, 200)
    index = VectorIndex(spark, str(tmp_path))
    index.store(chunks, lists=8)
    index.store(chunks.filter("source_key = 's2' and start_line % 2 = 0").withColumn("text", F.lit("new")))
    assert index.chunks().count() == 160 + 20
    query = [float(x) for x in vectors[2]]
    got = index.retrieve_lines(query, k=3, source_key="s2").collect()
    assert [r["line"] for r in got] == ["new"] * 3 and all(r["start_line"] % 2 == 0 for r in got)
    lines = index.retrieve_lines(query, k=1, source_key="s3").collect()
    assert [(r["line_no"], r["line"][:2]) for r in lines] == [(0, "a "), (1, "b ")]


def test_nothing_to_store(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    index.store(spark.createDataFrame([("s", 1, "t", None)], SCHEMA))
    assert index._centroids(spark.createDataFrame([], SCHEMA), 4).size == 0


def test_a_line_with_a_million_fields_is_refused(spark):
    lines = spark.range(1).select(
        F.timestamp_seconds(F.lit(1)).alias("sort_ts"), F.lit("s").alias("source"), F.lit(0).alias("line_index"),
        F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("f"), i.cast("string"))), F.array_repeat(F.lit("x"), 1_000_000)).alias("columns"),
    )
    with pytest.raises(ValueError, match="more than 2000 fields"):
        sinks.csv_keys(lines)
    few = lines.withColumn("columns", F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))
    assert sinks.csv_keys(few) == ["b", "a"] and sinks.csv_keys(few, most=2) == ["b", "a"]
