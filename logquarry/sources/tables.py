"""Landed exports and archives: journal, cloud pages, archived logs, analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import fixed
from logquarry.operators.search import between, newest

JOURNAL = "journal://"


def journal_scope(uri: str) -> tuple[str, str | None]:
    """``system``, ``boot`` or ``unit`` with the unit name."""
    uri = uri.strip()
    if uri in (JOURNAL + "system", JOURNAL + "boot"):
        return uri.removeprefix(JOURNAL), None
    if uri.startswith(JOURNAL + "unit/"):
        return "unit", uri.removeprefix(JOURNAL + "unit/")
    raise ValueError(f"not a journal source: {uri}")


def scan_journal_export(
    journal: DataFrame,
    uri: str,
    *,
    boot_id: str | None = None,
    priority: int | None = None,
    patterns: list[str] | None = None,
    since: Column | None = None,
    until: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The newest entries of a landed journal (ts, unit, boot_id, priority, line), oldest first."""
    kind, unit = journal_scope(uri)
    df = between(journal, "ts", since, until)
    if kind == "unit":
        df = df.filter(F.col("unit") == unit)
    if kind == "boot":
        if boot_id is None:
            raise ValueError("the current boot id is needed for journal://boot")
        df = df.filter(F.col("boot_id") == boot_id)
    if priority is not None:
        df = df.filter(F.col("priority") <= priority)
    for pattern in patterns or []:
        # lower-case patterns ignore case, as the journal's own search does
        df = df.filter(F.col("line").rlike(("(?i)" if pattern == pattern.lower() else "") + pattern))
    top = newest(df, "ts", limit).withColumn("source", F.lit(uri))
    return top.orderBy("ts", "id")


def scan_cloud_events(pages: DataFrame) -> DataFrame:
    """API pages (``page`` JSON text) to one row per event (``body`` JSON text).

    A page is a list of events, an object holding the list under one of the known keys, or one event.
    """
    page = F.col("page")
    direct = F.from_json(page, "array<string>")
    wrapped = [
        F.when(
            F.get_json_object(page, f"$.{key}").startswith("["), F.from_json(F.get_json_object(page, f"$.{key}"), "array<string>")
        )
        for key in fixed.CLOUD_PAGE_KEYS
    ]
    is_list = F.ltrim(page).startswith("[")
    events = F.when(is_list, direct).otherwise(F.coalesce(*wrapped, F.array(page)))
    kept = [c for c in pages.columns if c != "page"]
    rows = pages.select(*kept, F.explode(events).alias("body"))
    return rows.filter(F.ltrim("body").startswith("{"))


def scan_archive_logs(raw_logs: DataFrame, *, since_id: int = 0, limit: int | None = None) -> DataFrame:
    """Archived raw logs after an id as event rows; ids are negated so that they never meet live ids."""
    df = raw_logs.filter(F.col("id") > since_id)
    if limit is not None:
        df = df.orderBy("id").limit(limit)
    return df.select(
        (-F.col("id")).alias("id"),
        "received_at",
        F.lit("imported").alias("source_type"),
        F.lit("archive").alias("source_id"),
        F.coalesce("remote_ip", F.lit("")).alias("remote_ip"),
        F.coalesce("transport", F.lit("udp")).alias("transport"),
        F.coalesce("message", F.lit("")).alias("raw"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.lit("archive_import").alias("parser"),
    )


ANOMALIES = "array<struct<title:string,detail:string,related_log_indexes:array<bigint>>>"


def typed_anomalies(analyses: DataFrame) -> DataFrame:
    return analyses.withColumn("anomalies", F.from_json("anomalies_json", ANOMALIES)).drop("anomalies_json")


def scan_archive_analyses(analyses: DataFrame, *, since: Column, limit: int = 50) -> DataFrame:
    """Newest error-free archived analyses after a time."""
    df = analyses.filter((F.col("created_at") > since) & F.col("error").isNull())
    return typed_anomalies(newest(df, "created_at", limit)).withColumn("source", F.lit("archive"))
