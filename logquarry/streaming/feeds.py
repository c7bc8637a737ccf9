"""Streaming sources and stateless stream transformations.

Sockets are not opened: a relay lands messages as files or in Kafka, and these readers take them from there. The
file source sees whole new files, so followed logs must be rotated chunks; text appended to a file that was
already read is not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logquarry.functions.fixed import RAW_LIMIT
from logquarry.functions.severity import is_failure
from logquarry.operators.parse import decode_payload
from logquarry.operators.search import feed_rows, important_enough
from logquarry.sources.files import scanned_path

FEED_SCHEMA = "payload binary, remote_ip string, transport string, received_at timestamp"
ALL_FILES = 2**31 - 1  # of a trigger: whatever has landed is one micro-batch


def landed(spark: SparkSession, path: str, schema: str | StructType, *, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A stream over files that land in a folder."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def kafka_feed(spark: SparkSession, options: dict[str, str], *, transport: str = "kafka") -> DataFrame:
    """Messages of a topic in the feed's columns (needs the Kafka connector on the class path)."""
    stream = spark.readStream.format("kafka").options(**options).load()
    return stream.select(
        F.col("value").alias("payload"),
        F.col("key").cast("string").alias("remote_ip"),
        F.lit(transport).alias("transport"),
        F.col("timestamp").alias("received_at"),
    )


def syslog_messages(feed: DataFrame) -> DataFrame:
    """Payloads to one row per message: newline framing, closing carriage returns cut, empties dropped.

    Invalid UTF-8 is replaced, never refused.
    """
    text = decode_payload(F.make_valid_utf8(F.col("payload").cast("string")))
    rows = feed.withColumn("raw", F.explode(F.split(text, "\n"))).drop("payload")
    return rows.withColumn("raw", F.rtrim(F.col("raw"), F.lit("\r"))).filter(F.length("raw") > 0)


def stream_syslog_feed(spark: SparkSession, path: str, **options) -> DataFrame:
    return syslog_messages(landed(spark, path, FEED_SCHEMA, **options))


def stream_log_files(spark: SparkSession, root: str, *, glob: str = "*", files_per_trigger: int = 1000, newest_first: bool = False) -> DataFrame:
    """Lines of new files below a root."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", str(newest_first).lower())
    lines = reader.text(root)
    return lines.select(scanned_path().alias("source"), F.col("value").alias("line"))


def stream_journal(spark: SparkSession, path: str, *, unit: str | None = None, priority: int | None = None, **options) -> DataFrame:
    """Entries of landed journal segments."""
    schema = "id long, ts timestamp, unit string, boot_id string, priority int, line string"
    entries = landed(spark, path, schema, **options)
    if unit is not None:
        entries = entries.filter(F.col("unit") == unit)
    if priority is not None:
        entries = entries.filter(F.col("priority") <= priority)
    return entries


def stream_failure_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(is_failure(F.col("line")))


def stream_live_feed(events: DataFrame, failure_lines: DataFrame | None = None, *, floor: str = "info") -> DataFrame:
    """Event feed and failure lines as one stream; a line has no importance of its own and counts as error."""
    feed = feed_rows(events).withColumn("origin", F.lit("hub"))
    if failure_lines is not None:
        lines = failure_lines.withColumn("origin", F.lit("files")).withColumnRenamed("line", "message")
        feed = feed.unionByName(lines, allowMissingColumns=True)
    return important_enough(feed.withColumn("importance", F.coalesce("importance", F.lit("error"))), floor)


def watermarked_dedup(events: DataFrame, *, key: str = "parser", ts: str = "event_ts", delay: str = "1 day") -> DataFrame:
    """Drop repeats of a key within the watermark: bounded state, for feeds that repeat only for a while."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def observe_ingest(messages: DataFrame, transports: list[str], *, name: str = "ingest") -> DataFrame:
    """Count received messages, oversize ones and each transport while the stream runs.

    The counts of every micro-batch are in the query's progress under ``name``; they cost no extra pass.
    """
    per_transport = [F.count_if(F.col("transport") == t).alias(f"transport_{t}") for t in transports]
    oversize = F.count_if(F.length("raw") > RAW_LIMIT).alias("truncated")
    return messages.observe(name, F.count(F.lit(1)).alias("received"), oversize, *per_transport)
