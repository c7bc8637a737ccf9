"""Newest-first lists and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions import fixed
from logquarry.functions.text import basename, strip
from logquarry.functions.times import next_run
from logquarry.operators.running import BLOCK_BITS
from logquarry.operators.search import between, feed_rows, important_enough, newest


def recent_analyses(
    analyses: DataFrame, *, since: Column | None = None, until: Column | None = None, limit: int = 50
) -> DataFrame:
    return newest(between(analyses, "created_at", since, until), "created_at", limit)


def recent_summaries(summaries: DataFrame, granularity: str, limit: int) -> DataFrame:
    """Newest error-free summaries of a granularity."""
    return newest(summaries.filter((F.col("granularity") == granularity) & F.col("error").isNull()), "created_at", limit)


def window_analyses(analyses: DataFrame, since: Column, until: Column, limit: int) -> DataFrame:
    """The ``limit`` oldest analyses of a window without the auto-skipped ones."""
    df = between(analyses, "created_at", since, until).filter(F.col("model") != fixed.AUTO_SKIP_MODEL)
    return df.orderBy("id").limit(max(1, limit))


def recent_alert_events(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return newest(alerts, "ts", limit, tie="event_id")


FINISHED = ["done", "error", "failed"]


def recent_jobs(jobs: DataFrame, limit: int = 5) -> DataFrame:
    """Newest finished jobs that have a result or an error, with severity and summary from the result."""
    finished = jobs.filter(F.col("status").isin(FINISHED)).filter(
        F.col("result_json").isNotNull() | (F.coalesce("error", F.lit("")) != "")
    )
    at = F.coalesce("finished_at", "created_at")
    top = finished.orderBy(at.desc(), F.desc("id")).limit(max(1, limit))

    def text(key: str) -> Column:
        return F.coalesce(strip(F.get_json_object("result_json", f"$.{key}")), F.lit(""))

    return (
        top.withColumn("file_name", basename(F.col("file_path")))
        .withColumn("summary", text("summary"))
        .withColumn("severity", text("severity"))
    )


def keep_newest_jobs(jobs: DataFrame, keep: int = 5) -> DataFrame:
    """Drop finished jobs beyond the newest ``keep`` ; others stay."""
    finished = F.col("status").isin(FINISHED)
    at = F.coalesce("finished_at", "created_at")
    kept = jobs.filter(finished).orderBy(at.desc(), F.desc("id")).limit(max(1, keep))
    return jobs.filter(~finished).unionByName(kept)


def due_schedules(schedules: DataFrame, now: Column) -> DataFrame:
    """Enabled schedules whose time has come, with the run after this one."""
    due = schedules.filter(F.col("enabled") & F.col("next_run_at").isNotNull() & (F.col("next_run_at") <= now))
    return due.withColumn("following_run_at", next_run(now, F.col("interval_days"), F.col("run_at_hour")))


def live_feed(events: DataFrame, *, floor: str = "info", limit: int = 500) -> DataFrame:
    """The newest events at or above an importance, as feed rows."""
    return newest(important_enough(feed_rows(events), floor), "received_at", limit)


# --- retention ---------------------------------------------------------------------------------------------


def prune_by_age(events: DataFrame, cutoff: Column) -> DataFrame:
    """Events inside the retention window. On a table partitioned by day this prunes whole partitions."""
    return events.filter(F.col("received_at") >= cutoff)


def keep_newest(df: DataFrame, order: str, keep: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(keep)


def nth_smallest(df: DataFrame, order: str, n: int) -> int | None:
    """The n-th smallest value of an integer column, the largest if there are fewer; None for no rows.

    Blocks of values are counted, and only the block that holds the answer is looked at.
    """
    block = F.shiftright(order, BLOCK_BITS)
    counts = df.groupBy(block.alias("b")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    holding = counts.withColumn("before", before).filter(F.col("before") < n).orderBy(F.desc("b")).first()
    if holding is None:
        return None
    return df.filter(block == holding["b"]).orderBy(order).limit(n - holding["before"]).agg(F.max(order)).first()[0]


def within_cap(events: DataFrame, max_events: int, floors: dict[str, int] | None = None) -> Column | None:
    """Which rows stay when at most ``max_events`` do, oldest out first, but never the newest ``floor`` rows of a protected
    type. None if all stay.

    The newest rows of a protected type are those at or above one id, and the rows to delete are those at or
    below another: per-type top-k for the first, and for the second a top-k within the one block of ids whose count
    crosses the excess.
    """
    if max_events <= 0:
        return None
    excess = events.count() - max_events
    if excess <= 0:
        return None
    protected = F.lit(False)
    for kind, floor in (floors or {}).items():
        if floor > 0:
            mine = events.filter(F.col("source_type") == kind).select("id")
            lowest = mine.orderBy(F.desc("id")).limit(floor).agg(F.min("id")).first()[0]
            if lowest is not None:
                protected = protected | ((F.col("source_type") == kind) & (F.col("id") >= lowest))
    protected = F.coalesce(protected, F.lit(False))
    cut = nth_smallest(events.filter(~protected).select("id"), "id", excess)
    return None if cut is None else protected | (F.col("id") > cut)


def prune_by_cap(events: DataFrame, max_events: int, floors: dict[str, int] | None = None) -> DataFrame:
    """The rows ``within_cap``."""
    kept = within_cap(events, max_events, floors)
    return events if kept is None else events.filter(kept)
