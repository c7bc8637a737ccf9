"""Writers. Paths are the caller's; every writer is a distributed write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.operators.running import running_rank, settled


def _reserved(spark, path: str, count: int, first_id: int | None) -> int:
    """The first of ``count`` ids that nobody else has. They are taken before anything is written, so a write that dies
    leaves a gap and never an id twice. There is one writer at a time."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_ids")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = [int(s.getPath().getName()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    first = max([0, *taken]) if first_id is None else first_id
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_ids/{first + count:020d}"), True).close()
    for old in taken:
        if old < first + count:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_ids/{old:020d}"), False)
    return first


def append_events(events: DataFrame, path: str, *, order: tuple[str, ...] = ("received_at",), first_id: int | None = None) -> int:
    """Append parsed events by day and source type, with consecutive new ids in the given order; returns the next id.

    Ids go on where the last append to this path ended, or begin at ``first_id``. Rows are placed by a range sort, and the
    row counts of its partitions give each its offset, so no task numbers them all.
    """
    spark = events.sparkSession
    lined = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    lined = settled(lined, "to-append").withColumn("_part", F.shiftright("_place", 33))
    held = sorted(tuple(r) for r in lined.groupBy("_part").agg(F.count("*")).collect())  # a row for each partition
    count = sum(n for _, n in held)
    at = first = _reserved(spark, path, count, first_id)
    offsets = []
    for part, n in held:
        offsets.append((part, at))
        at += n
    before = F.broadcast(spark.createDataFrame(offsets, "_part long, _first long"))
    numbered = lined.join(before, "_part").withColumn("id", F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1))
    dated = numbered.drop("_part", "_place", "_first").withColumn("event_date", F.to_date("received_at"))
    # rebalance gathers a target partition in few files, and AQE splits the ones that are too large
    dated.hint("rebalance", "event_date", "source_type").write.mode("append").partitionBy("event_date", "source_type").parquet(path)
    return first + count


def export_rows(lines: DataFrame, *, limit: int | None = None, ascending: bool = False) -> DataFrame:
    """The rows an export holds: newest (or oldest) first; all of them unless the caller names a limit."""
    order = F.asc if ascending else F.desc
    ordered = lines.orderBy(order("sort_ts"), order("source"), order("line_index"))
    return ordered if limit is None else ordered.limit(limit)


def text_rows(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("line").alias("value"))


def json_rows(lines: DataFrame) -> DataFrame:
    return lines.select(F.to_json(F.struct(*lines.columns)).alias("value"))


MOST_COLUMNS = 2_000  # fields a CSV export may have


def csv_keys(lines: DataFrame, *, most: int = MOST_COLUMNS) -> list[str]:
    """Columnized field names in the order they first occur. There are as many as columnizers define: more than ``most``
    are refused before anything is written, and no more than that ever reach the driver."""
    entries = lines.select("sort_ts", "source", "line_index", F.posexplode(F.map_keys("columns")).alias("pos", "key"))
    place = F.struct(-F.unix_micros("sort_ts"), "source", -F.col("line_index"), "pos")
    firsts = entries.groupBy("key").agg(F.min(place).alias("first")).orderBy("first").limit(most + 1)
    keys = [r["key"] for r in firsts.select("key").collect()]
    if len(keys) > most:
        raise ValueError(f"the lines have more than {most} fields; name the ones to export, or raise the limit")
    return keys


def csv_rows(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """timestamp (epoch seconds), source, line and one column per field, blank where a line has none.

    A field named like one of the first three takes its place.
    """
    keys = csv_keys(lines) if keys is None else keys

    def field(name: str) -> Column:
        return F.try_element_at("columns", F.lit(name))

    stamp = F.format_string("%.3f", F.unix_micros("ts") / 1_000_000)
    base = {"timestamp": F.when(F.col("ts").isNotNull(), stamp), "source": F.col("source"), "line": F.col("line")}
    first = [F.coalesce(field(n), v, F.lit("")).alias(n) for n, v in base.items()]
    return lines.select(*first, *[F.coalesce(field(k), F.lit("")).alias(k) for k in keys if k not in base])


def write_text(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def sender_rows(events: DataFrame) -> DataFrame:
    """Messages of remote senders; loopback senders are left out."""
    ip = F.col("remote_ip")
    return events.filter(~(ip.startswith("127.") | (ip == "::1")))


def route_per_sender(events: DataFrame, path: str) -> None:
    """One output folder per sending host; AQE splits a busy sender over several files."""
    line = F.col("message").alias("value")
    sender_rows(events).select("remote_ip", line).hint("rebalance", "remote_ip").write.mode("append").partitionBy("remote_ip").text(path)


def write_log_files(lines: DataFrame, path: str) -> None:
    """Lines (source, line_index, line) as text files below one folder per source, in order.

    Rows are range-partitioned by place, so a large source becomes several files whose names sort in order.
    """
    placed = lines.select("source", "line_index", F.col("line").alias("value"))
    ranged = placed.repartitionByRange("source", "line_index").sortWithinPartitions("source", "line_index")
    ranged.drop("line_index").write.partitionBy("source").text(path)


def is_chat_hook(url: Column) -> Column:
    """A chat channel hook: the host and path of the URL decide."""
    return F.lower(url).rlike(r"^https?://(?:ptb\.|canary\.)?discord\.com/api/webhooks/|^https?://discordapp\.com/api/webhooks/")


def alert_payloads(hits: DataFrame, *, app: str = "log-alerts", url: Column | None = None) -> DataFrame:
    """Add the generic JSON payload, the chat text and the request body of each alert."""
    url = F.lit(None).cast("string") if url is None else url
    generic = F.to_json(
        F.struct(
            F.lit(app).alias("app"),
            "origin",
            F.col("rule_name").alias("rule"),
            "rule_id",
            "source",
            "line",
            (F.unix_micros("ts") / 1_000_000).alias("ts"),
        )
    )
    chat = F.concat(
        F.lit(f"**{app}**\nRule: "), "rule_name", F.lit("\nSource: "), "source", F.lit("\n```\n"), F.substring("line", 1, 1800), F.lit("\n```")
    )
    chat = F.substring(chat, 1, 2000)
    body = F.when(F.coalesce(is_chat_hook(url), F.lit(False)), F.to_json(F.struct(chat.alias("content")))).otherwise(generic)
    return hits.withColumn("payload", generic).withColumn("chat_text", chat).withColumn("request_body", body)


def report_text(results: DataFrame, *, base_url: str) -> DataFrame:
    """Add the report text of scheduled analyses (file_path, severity, summary, anomalies, job_id)."""
    n = F.coalesce(F.size("anomalies"), F.lit(0))
    listed = F.transform(
        F.slice(F.coalesce("anomalies", F.array()), F.lit(1), F.lit(5)), lambda a: F.concat(F.lit("  - "), a["title"], F.lit(": "), a["detail"])
    )
    head = F.array(
        F.concat(F.lit("Scheduled analysis: "), "file_path"),
        F.concat(F.lit("Severity: "), F.coalesce("severity", F.lit("unknown"))),
        F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit(""))),
        F.concat(F.lit("Anomalies: "), n.cast("string")),
        F.concat(F.lit(f"View full report: {base_url.rstrip('/')}/analysis/"), F.col("job_id").cast("string")),
    )
    return results.withColumn("report", F.array_join(F.concat(head, listed), "\n"))


def chat_report(results: DataFrame, *, app: str = "log-alerts", base_url: str) -> DataFrame:
    """Add the chat text of scheduled analyses, shortened with dots beyond 2000 characters."""
    n = F.coalesce(F.size("anomalies"), F.lit(0)).cast("string")
    parts = F.array(
        F.lit(f"**[{app}] Scheduled log analysis**"),
        F.concat(F.lit("**File:** `"), F.coalesce("file_path", F.lit("?")), F.lit("`")),
        F.concat(F.lit("**Severity:** "), F.coalesce("severity", F.lit("?")), F.lit(" · **Anomalies:** "), n),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("**Summary:** "), "summary")),
        F.concat(F.lit(f"**Report:** {base_url.rstrip('/')}/analysis/"), F.col("job_id").cast("string")),
    )
    text = F.array_join(parts, "\n")
    short = F.concat(F.substring(text, 1, 1997), F.lit("..."))
    return results.withColumn("chat_text", F.when(F.length(text) > 2000, short).otherwise(text))


def numbered(df: DataFrame, order: str, *, out: str = "id", start: int = 1) -> DataFrame:
    """Consecutive ids along an integer order column, without gathering the table."""
    return running_rank(df, [], order, out="_rank").withColumn(out, F.col("_rank") + (start - 1)).drop("_rank")
