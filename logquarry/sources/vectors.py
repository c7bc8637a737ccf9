"""Stored chunk vectors with inverted lists, and exact retrieval that reads few of them.

Every chunk lies in the list of its nearest centroid, beside its distance to it. For a query at distance d from a
centroid, a chunk at distance r from it is at least |d - r| away (triangle inequality). So the lists nearest to the query
are read first; the k-th distance found there bounds what is still of use, and of the other lists only those are read, and
of those only the rows, whose bound lies below it. The result is that of a full search.

Centroids are ``lists`` vectors chosen by a digest of their place: they decide how much is read, never what is found. A
list is one folder, so there are as many as lists, not as sources. Storing a source again gives its chunks a higher
generation; older ones are passed over from then on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators.analysis import squared_distance
from logquarry.operators.running import settled

LISTS = 64
PROBE = 4  # lists that are read first
SLACK = 1e-5  # of a distance: float vectors' distances are rounded


def _placed(centroids: np.ndarray):
    @F.pandas_udf("list int, apart double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        found = np.full(len(vectors), -1, np.int32), np.full(len(vectors), np.nan)
        usable = np.array([v is not None and len(v) == centroids.shape[1] for v in vectors], bool)
        if usable.any():
            x = np.array(vectors[usable].tolist(), np.float64)
            apart = np.sqrt(np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None] - 2 * x @ centroids.T))
            nearest = apart.argmin(axis=1)
            found[0][usable], found[1][usable] = nearest, np.sqrt(((x - centroids[nearest]) ** 2).sum(axis=1))
        return pd.DataFrame({"list": found[0], "apart": found[1]})

    return place


class VectorIndex:
    """Chunks (source_key, start_line, text, embedding) under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _has(self, name: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _centroids(self, chunks: DataFrame, lists: int) -> np.ndarray:
        """The stored centroids; chosen from the first chunks that are stored. The driver holds ``lists`` vectors."""
        if not self._has("centroids"):
            usable = chunks.filter("embedding is not null").select("embedding", F.xxhash64("source_key", "start_line").alias("h"))
            first = [r["embedding"] for r in usable.orderBy("h").limit(lists).collect()]
            size = len(first[0]) if first else 0
            rows = [(k, [float(x) for x in v]) for k, v in enumerate(v for v in first if len(v) == size)]
            self.spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        stored = sorted(self.spark.read.parquet(f"{self.path}/centroids").collect())
        return np.array([r["centroid"] for r in stored], np.float64)

    def store(self, chunks: DataFrame, *, lists: int = LISTS) -> None:
        """Stores the chunk sets of the sources present, in place of earlier ones of theirs. A chunk without a vector of the
        index's size is not stored."""
        chunks = settled(chunks.select("source_key", "start_line", "text", "embedding"), "to-index")
        centroids = self._centroids(chunks, lists)
        if not len(centroids):
            return
        generation = self.spark.read.parquet(f"{self.path}/sources").agg(F.max("generation")).first()[0] + 1 if self._has("sources") else 0
        placed = chunks.withColumn("p", _placed(centroids)("embedding")).select("*", "p.*").drop("p").filter("list >= 0")
        placed = placed.withColumn("generation", F.lit(generation)).hint("rebalance", "list").sortWithinPartitions("list", "source_key", "apart")
        placed.write.mode("append").partitionBy("list").parquet(f"{self.path}/chunks")
        # the sources last: until then the new rows are of no generation that counts
        chunks.select("source_key").distinct().withColumn("generation", F.lit(generation)).write.mode("append").parquet(f"{self.path}/sources")

    def chunks(self) -> DataFrame:
        """All chunks that count."""
        rows = self.spark.read.schema("source_key string, start_line long, text string, embedding array<float>, apart double, generation int, list int").parquet(f"{self.path}/chunks")
        sources = self.spark.read.parquet(f"{self.path}/sources").groupBy("source_key").agg(F.max("generation").alias("generation"))
        return rows.join(sources, ["source_key", "generation"])

    def nearest(
        self, query: list[float], *, k: int = 12, source_key: str | None = None, probe: int = PROBE, on_read: Callable[[list[int]], None] | None = None
    ) -> DataFrame:
        """The k chunks nearest to a query (of one source, if named): source_key, start_line, text, squared distance, in
        line order. Ties go to the smaller source and line. ``on_read`` is told which lists are read."""
        read = on_read or (lambda lists: None)
        stored = sorted(self.spark.read.parquet(f"{self.path}/centroids").collect())
        to = np.sqrt(((np.array([r["centroid"] for r in stored]) - np.array(query)) ** 2).sum(axis=1))
        rows = self.chunks() if source_key is None else self.chunks().filter(F.col("source_key") == source_key)
        rows = rows.withColumn("distance", squared_distance(F.col("embedding"), query))
        order = ["distance", "source_key", "start_line"]
        first = [int(j) for j in np.argsort(to, kind="stable")[:probe]]
        read(first)
        best = rows.filter(F.col("list").isin(first)).select(*order, "text").orderBy(*order).limit(k)
        best = settled(best, "nearest")
        found = best.agg(F.count("*"), F.max("distance")).first()
        reach = float("inf") if found[0] < k else np.sqrt(found[1]) * (1 + SLACK) + SLACK
        # how far the chunks of each list lie from its centroid: read from the folders' column statistics alone
        span = self.spark.read.parquet(f"{self.path}/chunks").groupBy("list").agg(F.min("apart").alias("low"), F.max("apart").alias("high"))
        rest = [r["list"] for r in span.collect() if r["list"] not in first and max(to[r["list"]] - r["high"], r["low"] - to[r["list"]]) <= reach]
        read(sorted(rest))
        if rest:
            near = F.lit(False)
            for j in rest:
                own = F.col("list") == j
                near = near | (own if reach == float("inf") else own & F.col("apart").between(float(to[j] - reach), float(to[j] + reach)))
            more = rows.filter(F.col("list").isin(rest)).filter(near).select(*order, "text")
            best = best.unionByName(more).orderBy(*order).limit(k)
        return best.select("source_key", "start_line", "text", "distance").orderBy("source_key", "start_line")

    def retrieve_lines(self, query: list[float], **options) -> DataFrame:
        """(source_key, start_line, line_no, line): the lines of the nearest chunks, chunk by chunk."""
        found = self.nearest(query, **options)
        return found.select("source_key", "start_line", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line_no", "line"))
