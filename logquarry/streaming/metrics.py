"""What streaming queries observe, kept as a table of counters.

``feeds.observe_ingest`` counts rows while a micro-batch runs and Spark reports the counts with the batch's progress. The
listener here takes them from there, one short record for each micro-batch, so counting costs no pass over the data.
"""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch long, at timestamp, observation string, counter string, value long"


class Counters(StreamingQueryListener):
    """Collects the observed counts of all queries of a session until they are stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.lock = spark, threading.Lock()
        self.rows: list[tuple] = []
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        at = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00"))
        with self.lock:
            for name, row in progress.observedMetrics.items():
                self.rows += [(str(progress.id), progress.batchId, at, name, counter, int(value)) for counter, value in row.asDict().items() if value is not None]

    def store(self, path: str) -> int:
        """Appends what was collected since the last call; returns how many counters. A replayed batch is counted twice here
        and once by ``totals``."""
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return len(rows)

    def close(self) -> None:
        self.spark.streams.removeListener(self)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(observation, counter, total): each batch of a query once, as it was counted last."""
    batches = spark.read.schema(SCHEMA).parquet(path).groupBy("query", "batch", "observation", "counter")
    return batches.agg(F.max_by("value", "at").alias("value")).groupBy("observation", "counter").agg(F.sum("value").alias("total"))
