"""Micro-batch jobs: ingest, exact de-duplication, alert gate and retention.

Each job writes under ``batch=<id>`` with dynamic partition overwrite, so a batch that is replayed after a
failure replaces its own output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from logquarry.functions.syslog import FirewallMap
from logquarry.operators.bloom import bits_for, filter_of, folders_that_may_hold
from logquarry.operators.gate import FIRED, alert_gate, alert_records
from logquarry.operators.joins import first_per_key, geo_enrich
from logquarry.operators.parse import classify_events
from logquarry.operators.rules import match_alert_rules
from logquarry.operators.running import settled
from logquarry.operators.search import feed_rows
from logquarry.sources.store import DayTable

ROW_BITS, PARTITION_BITS = 27, 14  # of an event id; the batch has the 22 bits above
MEMORY_SCHEMA = "rule_id string, source string, t long"
HORIZON = timedelta(days=7)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what has landed, in micro-batches, and stop."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_available(stream: DataFrame, path: str, checkpoint: str, *, state_partitions: int | None = None) -> DataFrame:
    """Append a stream to a folder and return what is there afterwards.

    Every micro-batch opens and stores every partition of the state, so a small state should have few:
    ``state_partitions`` at most, where given. A checkpoint keeps the number it began with.
    """
    conf = stream.sparkSession.conf
    usual = conf.get("spark.sql.shuffle.partitions")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if state_partitions is not None:
        conf.set("spark.sql.shuffle.partitions", str(min(int(usual), state_partitions)))
    try:
        running = query.start()  # it goes on with a copy of the session's settings
    finally:
        conf.set("spark.sql.shuffle.partitions", usual)
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def put_batch(df: DataFrame, path: str, batch_id: int, by: list[str] | None = None) -> None:
    tagged = df.withColumn("batch", F.lit(batch_id).cast("long"))
    if by:  # few files per folder; AQE splits the large ones
        tagged = tagged.hint("rebalance", *by)
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch", *(by or [])).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def forget(spark: SparkSession, path: str, batch_id: int) -> None:
    """Deletes what one batch has stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _schema(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def _schema_of(df: DataFrame, more: str) -> StructType:
    return StructType([*df.schema.fields, *_schema(more).fields])


def read_batch(spark: SparkSession, path: str, batch_id: int, schema: StructType) -> DataFrame:
    """The rows one batch has stored: its own folder by name, with no listing or inference over the growing table."""
    stored = StructType([*schema.fields, StructField("batch", LongType())])
    folder = f"{path}/batch={batch_id}"
    if not _exists(spark, folder):
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).option("basePath", path).parquet(folder)


def gate_batch(hits: DataFrame, batch_id: int, path: str, *, cap: int = 30, horizon: timedelta = HORIZON) -> DataFrame:
    """Gate one micro-batch after the batches before it; returns its hits with their status, as stored.

    The gate moves through event time with the newest hit it has judged. A hit older than that came too late: judging it
    would change verdicts that are already given, so it is put into the side table ``late`` and takes no part. What the
    gate remembers is stored with each batch: the fires of the last ``horizon`` (no cooldown may be longer) and the time
    it has reached. A batch reads what the batch before it left and nothing else, so nothing is listed for ever, and a
    replayed batch gives the same rows again.
    """
    spark, memory = hits.sparkSession, f"{path}/gate"
    left = read_batch(spark, memory, batch_id - 1, _schema(MEMORY_SCHEMA))
    reached = left.filter("rule_id is null and source is null").agg(F.max("t")).first()[0]
    t = F.unix_micros(F.col("ts"))
    timely = F.coalesce(t >= reached, F.lit(True)) if reached is not None else F.lit(True)
    put_batch(hits.filter(~timely), f"{path}/late", batch_id)
    fires = left.filter("rule_id is not null or source is not null").select("rule_id", "source", "t")
    put_batch(alert_gate(hits.filter(timely), cap=cap, carried=fires), f"{path}/gated", batch_id)
    gated = read_batch(spark, f"{path}/gated", batch_id, _schema_of(hits, "status string"))
    newest = gated.agg(F.max(t)).first()[0]
    reached = max((x for x in (reached, newest) if x is not None), default=None)
    if reached is not None:
        fresh = gated.filter(F.col("status") == FIRED).select("rule_id", "source", t.alias("t"))
        oldest = reached - int(horizon / timedelta(microseconds=1))
        kept = fires.unionByName(fresh).filter((F.col("t") >= oldest) & (F.col("rule_id").isNotNull() | F.col("source").isNotNull()))
        mark = spark.createDataFrame([(None, None, reached)], MEMORY_SCHEMA)
        put_batch(kept.unionByName(mark).coalesce(1), memory, batch_id)
        forget(spark, memory, batch_id - 2)  # a replay of this batch needs the one before
    return gated


def event_id(batch_id: int) -> Column:
    """Ids from (batch, partition, row) in bits of their own: no two batches or partitions can meet. A partition with
    more rows, or a batch with more partitions, than the bits hold fails the batch."""
    place = F.monotonically_increasing_id()  # partition << 33 | row
    partition, row = F.shiftright(place, 33), place.bitwiseAND((1 << 33) - 1)
    fits = (partition < 1 << PARTITION_BITS) & (row < 1 << ROW_BITS)
    packed = F.lit(batch_id << (PARTITION_BITS + ROW_BITS)) + F.shiftleft(partition, ROW_BITS) + row
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("event ids are used up in a partition")).cast("long"))


def ingest_batch(
    path: str, rules: Callable[[], list[Row]], ranges: DataFrame | None, *, columns: FirewallMap | None = None, cap: int = 30
) -> Callable[[DataFrame, int], None]:
    """Handler of raw messages: parse, enrich, store, feed, match, gate, record. Rules are re-read every batch."""

    def handle(raw: DataFrame, batch_id: int) -> None:
        spark = raw.sparkSession
        if "id" not in raw.columns:
            raw = raw.withColumn("id", event_id(batch_id))
        events = classify_events(raw, columns)
        if ranges is not None:
            events = geo_enrich(events, ranges)
        dated = events.withColumns({"event_date": F.to_date("received_at"), "batch": F.lit(batch_id).cast("long")})
        table = DayTable(spark, f"{path}/events")
        table.append(dated, batch=batch_id)
        # the stored batch is the input of what follows: parsed once, and ids are settled
        stored = table.read(batch=batch_id)
        put_batch(feed_rows(stored), f"{path}/feed", batch_id)
        found = match_alert_rules(stored, rules())
        put_batch(found, f"{path}/hits", batch_id)  # matched once, for the gate and the records
        hits = read_batch(spark, f"{path}/hits", batch_id, found.schema).select(*found.columns)
        put_batch(alert_records(gate_batch(hits, batch_id, path, cap=cap)), f"{path}/alerts", batch_id)

    return handle


def gate_stream_batch(path: str, *, cap: int = 30) -> Callable[[DataFrame, int], None]:
    """Handler of a stream of hits: gate and store them with their status (``gated``), late ones apart (``late``)."""

    def handle(hits: DataFrame, batch_id: int) -> None:
        put_batch(hits, f"{path}/hits", batch_id)
        stored = read_batch(hits.sparkSession, f"{path}/hits", batch_id, hits.schema)
        gate_batch(stored.select(*hits.columns), batch_id, path, cap=cap)

    return handle


def store_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Handler of parsed events: store them by day (``DayTable``), each batch once."""

    def handle(events: DataFrame, batch_id: int) -> None:
        dated = events.withColumns({"event_date": F.to_date("received_at"), "batch": F.lit(batch_id).cast("long")})
        DayTable(events.sparkSession, path).append(dated, batch=batch_id)

    return handle


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The batches that have stored rows under a path, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _read_batches(spark: SparkSession, path: str, batches: list[int], schema: str) -> DataFrame:
    stored = _schema(f"{schema}, batch long")
    if not batches:
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches))


def _store_keys(keys: DataFrame, path: str, batch_id: int, n: int) -> None:
    """Keys of a batch beside their Bloom filter; the filter last, so that keys with one are whole."""
    put_batch(keys, f"{path}/keys", batch_id)
    put_batch(filter_of(read_batch(keys.sparkSession, f"{path}/keys", batch_id, keys.schema), "parser", bits_for(n)), f"{path}/blooms", batch_id)


def dedup_batch(
    path: str, *, order: str = "seq", horizon: int | None = None, folders: int = 64, on_read: Callable[[int, list[int]], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """Handler of parsed cloud events: keep keys never stored before, the first of each key.

    The keys of each batch lie in a folder of their own beside a Bloom filter of them. A batch asks all filters in one
    join and reads the keys of those folders alone that may hold one of its own, then decides exactly. When there are more
    than ``folders`` of them, all but the newest few are merged into one. ``on_read`` is told which folders a batch reads.

    With a ``horizon`` only the keys of that many earlier batches count, and older ones are deleted; use it where events
    are retained no longer than that.
    """

    def handle(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        put_batch(first_per_key(events, "parser", order), f"{path}/firsts", batch_id)
        firsts = read_batch(spark, f"{path}/firsts", batch_id, events.schema)
        earlier = [b for b in _batches(spark, f"{path}/blooms") if b < batch_id and (horizon is None or b >= batch_id - horizon)]
        filters = _read_batches(spark, f"{path}/blooms", earlier, "bits long, word long, mask long")
        wanted = folders_that_may_hold(firsts, "parser", filters, "batch") if earlier else []
        if on_read is not None:
            on_read(batch_id, wanted)
        known = _read_batches(spark, f"{path}/keys", wanted, "parser string")
        put_batch(firsts.join(known.select("parser"), "parser", "left_anti").select(*events.columns), f"{path}/events", batch_id)
        fresh = read_batch(spark, f"{path}/events", batch_id, events.schema).select("parser").filter("parser is not null")
        n = fresh.count()
        if n:
            _store_keys(fresh, path, batch_id, n)
        forget(spark, f"{path}/firsts", batch_id)
        if horizon is not None:
            for old in (b for b in _batches(spark, f"{path}/keys") if b < batch_id - horizon):
                forget(spark, f"{path}/keys", old)
                forget(spark, f"{path}/blooms", old)
        elif len(earlier) >= folders:
            _merge_keys(spark, path, earlier[: -max(1, folders // 8)])

    return handle


def _merge_keys(spark: SparkSession, path: str, batches: list[int]) -> None:
    """Puts the keys of several old batches into the folder of the last of them. If it dies midway, keys are stored twice,
    never lost: the others go only when the merged folder and its filter stand."""
    merged = settled(_read_batches(spark, f"{path}/keys", batches, "parser string").select("parser"), "merged-keys")
    _store_keys(merged, path, batches[-1], merged.count())
    for old in batches[:-1]:
        forget(spark, f"{path}/blooms", old)
        forget(spark, f"{path}/keys", old)


def sweep_partitions(spark: SparkSession, table: str, cutoff_day: str) -> int:
    """Drop whole days before a day from a table partitioned by event_date (yyyy-mm-dd); returns how many partitions.

    Only partition names are looked at, so an hourly sweep reads no data. The open day is cut by the filter of
    ``prune_by_age`` when it is read.
    """
    old = []
    for row in spark.sql(f"show partitions {table}").collect():
        spec = dict(part.split("=", 1) for part in row[0].split("/"))
        if spec["event_date"] < cutoff_day:
            old.append(spec)
    for spec in old:
        names = ", ".join(f"{k}='{v}'" for k, v in spec.items())
        spark.sql(f"alter table {table} drop if exists partition ({names})")
    return len(old)
